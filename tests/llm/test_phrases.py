import random
import re
from collections import Counter

import numpy as np
import pytest

from tabella.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, n long, key long, score double, rank int, bar int"
EXTRA = ("x", 1, 2, 3, 0.5, 4, 5)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, text, lang, *EXTRA) for i, (lang, text) in enumerate(rows)], SCHEMA)


def brute(rows, top, least, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in held.items():
        lang, w = p[0], p[1:]
        score, k = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    covered = set()
    for p, b in held.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                sub = (p[0], *p[i : i + m])
                if 100 * b >= cover * f[sub]:
                    covered.add((p[0], " ".join(sub[1:]).encode()))
    rows = []
    for lang in n:
        mine = sorted(o for o in out if o[0] == lang and (lang, o[3]) not in covered)[:top]
        rows += [(lang, i, o[3].decode(), -o[2], o[4], o[5], n[lang], -o[1]) for i, o in enumerate(mine, 1)]
    return sorted(rows)


def prose(seed, n, words, mark=0.15):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for w in rng.choices(words, weights, k=n):
        out.append(w.title() if rng.random() < 0.1 else w)
        if rng.random() < mark:
            out.append(rng.choice([".", ", ", "\n", "\t", "  ", "; "]))
    return " ".join(out)


WORDS = "the of and to in straße über río x1 tiger stone cloud apple river lemon paper".split()
ROWS = [("en" if i % 3 else "de", prose(i, 200, WORDS)) for i in range(60)]
ROWS += [("en", "one two three four five. one two three four five! six seven eight")] * 9
ROWS += [(None, "NULL language, null language\tnull  language"), ("und", "null language"), ("en", None), ("en", ""), ("fr", "a a a a a a a a a"), ("fr", ".,;:!?")]
ROWS += [("es", "w" * 300_000 + " " + prose(99, 30_000, WORDS, 0.02))]


@pytest.mark.parametrize("top,least", [(5, 3), (2000, 2)])
def test_equals_brute_force(spark, top, least):
    got = phrases.collocations(table(spark, ROWS).repartition(6), top=top, least=least, first=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, top, least)


def test_lowering_the_bar_step_by_step(spark, monkeypatch):
    """With a first bar above almost everything the list is settled in several rounds, and is the same."""
    monkeypatch.setattr(phrases, "STEP", 2)
    seen = []
    bars = phrases._bars
    monkeypatch.setattr(phrases, "_bars", lambda pairs, langs, rank: seen.append(rank) or bars(pairs, langs, rank))
    got = phrases.collocations(table(spark, ROWS), top=20, least=3, first=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, 20, 3)
    assert len(seen) > 1


def test_full_sieves_and_small_slices_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SIEVE_BITS", 64)
    full = phrases.sieve
    monkeypatch.setattr(phrases, "sieve", lambda keys: full(keys, 64))
    cut = phrases.slices
    monkeypatch.setattr(phrases, "slices", lambda texts, lang, n: cut(texts, lang, n, 50))
    got = phrases.collocations(table(spark, ROWS[:20] + ROWS[-9:-1]), top=30, least=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS[:20] + ROWS[-9:-1], 30, 3)


def test_empty_tables(spark):
    for rows in ([], [("en", None)], [("en", ". , ;")], [(None, "one two")]):
        out = phrases.collocations(table(spark, rows))
        assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_slices_meet_every_phrase_once():
    text = prose(3, 400, WORDS).encode()
    for n in (2, 3, 4):
        want = Counter()
        for some in phrases.slices([text], "en", n):
            at = some.runs(n)
            want.update(some.spell(at, n).to_pylist())
        for limit in (1, 7, 64):
            got = Counter()
            for some in phrases.slices([text], "en", n, limit):
                at, count = some.distinct(some.runs(n), n) if len(some.runs(n)) else (np.zeros(0, int), [])
                got.update(dict(zip(some.spell(at, n).to_pylist(), map(int, count))) if len(at) else {})
            assert got == want and want


def test_products_beyond_64_bits_stay_exact(spark):
    big = 9 * 10**15
    df = spark.createDataFrame([(big, big + 7, big + 1)], "a long, l long, r long")
    out = df.select(phrases._score(*[df[c] for c in "alr"]).alias("s")).first()[0]
    assert out == 2_000_000 * big // (2 * big + 8)
