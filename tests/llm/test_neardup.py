import random
import re

import numpy as np
import pytest

from tabella.llm import common, neardup
from tabella.llm.neardup import Similar, near_duplicates
from llm_data import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, words, share):
    return " ".join(rng.choice("qwert") + w if rng.random() < share else w for w in words)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80), (2, 60)])
def test_agrees_with_brute_force(spark, words, percent):
    rng = random.Random(percent)
    bases = [prose(s, rng.choice([2, 6, 30, 150])).split() for s in range(8)]
    docs = [(i, edited(rng, bases[i % 8], rng.choice([0, 0.01, 0.03, 0.06]))) for i in range(300)]
    docs += [(1000 + i, prose(500 + i, rng.randint(0, 8))) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), how=Similar(words, percent))
    assert {r["id"]: (r["n_shingles"], r["component"], r["kept"]) for r in got.collect()} == brute(docs, words, percent)


def test_one_large_group_keeps_chained_links(spark):
    """A hub's star misses pairs of its members; the prefix search finds them."""
    rng = random.Random(3)
    base = prose(9, 80).split()
    docs = [(i, edited(rng, base, rng.random() * 0.12)) for i in range(400)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), how=Similar(3, 85))
    assert {r["id"]: (r["n_shingles"], r["component"], r["kept"]) for r in got.collect()} == brute(docs, 3, 85)


def test_odd_rows(messy, none):
    got = {r["id"]: r for r in near_duplicates(messy, how=Similar(3, 85)).collect()}
    assert sorted(got) == list(range(12))
    assert [got[i]["component"] for i in (0, 1, 2)] == [0, 0, 0]
    assert [got[i]["n_shingles"] for i in (3, 4, 5, 6, 7, 9)] == [0, 0, 1, 1, 1, 1]
    assert got[7]["component"] == 6 and got[3]["kept"] and got[4]["kept"]
    assert near_duplicates(none).count() == 0


def test_whole_rows_stay_once(messy, none):
    out = neardup.drop_near_duplicates(messy)
    assert out.columns == messy.columns
    ids = sorted((r["doc_id"] for r in out.collect() if r["doc_id"] is not None))
    assert ids == [0, 3, 4, 5, 6, 8, 9, 10, 11]
    assert out.filter("doc_id is null").count() == 2
    assert neardup.drop_near_duplicates(none).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 5000):
        same = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 2**63, n + max(1, n // 4), dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(pool[: n + 0]), np.sort(pool[: max(1, n - n // 4)])
            same.append((np.mean(neardup.signature(a) == neardup.signature(b)), len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
        got, want = np.mean(same, axis=0)
        assert abs(got - want) < 0.05


def test_bands_rarely_miss_the_threshold():
    for percent in (50, 60, 70, 80, 85, 90, 95):
        how = Similar(5, percent)
        assert (1 - (percent / 100) ** how.rows) ** (neardup.BINS // how.rows) < 1e-5


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert common.components(links.filter("a < 0")).count() == 0


def test_ranks_are_dense_in_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, id % 2) as k", "id")
    got = common.ranked(rows, ["k"], ["id"], "rank", rows=100).groupBy("k").agg({"rank": "max", "*": "count"}).collect()
    assert sorted(r["max(rank)"] + 1 - r["count(1)"] for r in got) == [0, 0, 0]
