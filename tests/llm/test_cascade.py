import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_data import prose
from tabella.llm import cascade
from tabella.llm.cascade import RULES, Rule, Text, ordered


def repeats(text, size=8):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return len({i + j for i in range(len(w) - size + 1) if runs[tuple(w[i : i + size])] > 1 for j in range(size)})


TEXTS = [
    "", "   \t\n\x0b ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 30, prose(1, 300), prose(2, 40) + "\n" + prose(2, 40) + "\n\n" + prose(2, 40),
    "line one\nline one\nline two \nline two\n \n \n", "x### y$$ z%% <b>&amp;</b> | * " * 10, "12 34 56 78 90 " * 9, "ⅷ ² ½ é ñ " * 8, "- point\n* point\n• point\n" * 9,
    "cut short...\ncut again…  \nwhole\n" * 8, "    nbsp line\x1cfile " * 6, "\U0001f600 " * 25,
]


@pytest.mark.parametrize("text", TEXTS)
def test_measures_by_plain_counting(text):
    t, w = Text(text), re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert t.n_words == len(w) and t.word_chars == sum(map(len, w))
    assert t.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
    assert t.n_dup_lines == sum(lines[i] in lines[:i] for i in range(len(lines)))
    assert t.n_repeat_words == repeats(text)
    assert t.n_stutters == sum(a == b for a, b in zip(w, w[1:]))
    assert t.n_top_word == max(Counter(w).values(), default=0)
    assert t.n_letter_words == sum(any(c.isalpha() for c in x) for x in w)


def test_repeated_windows_on_random_words():
    rng = random.Random(3)
    for n in (*range(0, 24), 60, 200):
        for _ in range(6):
            some = [rng.choice("ab") for _ in range(n)]
            cut = rng.randrange(n + 1)
            text = " ".join(some + some[cut : cut + 12])
            assert Text(text).n_repeat_words == repeats(text)


def test_order_by_rejections_per_cost():
    """A costly rule that rejects most can still come after a cheap one; shared measures are paid once; useless rules come last."""
    names = list(cascade.MEASURES)
    rules = (Rule("dear", ("n_repeat_words",), bool), Rule("cheap", ("n_symbols",), bool), Rule("idle", ("word_chars",), bool), Rule("free", ("n_words", "n_symbols"), bool))
    cost = np.zeros((10, len(names)), np.int64)
    for name, paid in (("n_repeat_words", 1000), ("n_symbols", 10), ("word_chars", 5), ("words", 50), ("n_words", 1)):
        cost[:, names.index(name)] = paid
    rejected = np.zeros((10, 4), bool)
    rejected[:6, 0] = rejected[4:6, 1] = rejected[6:8, 3] = True
    assert [r.name for r in ordered(rules, rejected, cost)] == ["cheap", "free", "dear", "idle"]
    assert sorted(r.name for r in ordered(rules, rejected[:0], cost[:0])) == ["cheap", "dear", "free", "idle"]


def test_any_order_keeps_the_same_texts_and_stops_early(spark, messy):
    want = {}
    for order in (list(RULES), list(RULES)[::-1], cascade.plan(messy)):
        got = cascade.screen(messy, order, cascade.BASE).collect()
        kept = sorted((str(r["id"]), r["kept"], *[r[m] for m in cascade.BASE]) for r in got)
        assert want.setdefault("rows", kept) == kept
        for r in got:
            assert r["kept"] == (r["rejected_by"] is None) and r["n_rules"] == (len(order) if r["kept"] else [o.name for o in order].index(r["rejected_by"]) + 1)
    assert len(kept) == messy.count() and any(k[1] for k in kept) and not all(k[1] for k in kept)


def test_measures_are_only_taken_when_asked(monkeypatch):
    t = Text("one ### two")
    assert [r.rejects(t) for r in RULES if r.name == "symbols"] == [True]
    assert set(t.__dict__) == {"text", "words", "n_words", "n_symbols"}


def test_sample_is_bounded_and_does_not_change_the_result(spark, messy):
    for sample in (1, 5, 2_000):
        rejected, cost = cascade.trial(messy, RULES, sample)
        assert len(rejected) == len(cost) <= messy.count()
        order = ordered(RULES, rejected, cost)
        assert sorted(r.name for r in order) == sorted(r.name for r in RULES)


def test_dropping_keeps_all_columns(spark, messy, none):
    out = cascade.drop_low_quality(messy)
    assert out.columns == messy.columns and {r["doc_id"] for r in out.collect()} == {0, 1, 2, 8}
    for df in (cascade.drop_low_quality(none), cascade.screen(none, cascade.plan(none), cascade.BASE)):
        assert df.count() == 0


def test_clean_texts_are_kept_and_junk_goes():
    clean = prose(5, 400).replace(" ", " ", 1)
    assert not any(r.rejects(Text(clean)) for r in RULES)
    for junk in ("### ".join(clean.split()), " | ".join(clean.split()), clean[:200] * 8, " ".join(w for w in clean.split()[:40] for _ in range(5)), "1 2 3 " + "44 " * 60):
        assert any(r.rejects(Text(junk)) for r in RULES)
