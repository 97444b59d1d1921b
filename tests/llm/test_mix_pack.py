import random
from bisect import bisect_left
from fractions import Fraction
from itertools import islice

import pytest
from pyspark.sql import functions as F

from tabella.llm import mixing, packing


def test_pfair_stays_within_a_block_in_every_phase():
    for seed in range(100):
        rng = random.Random(seed)
        blocks = {f"s{i}": rng.randint(0, 300) for i in range(rng.randint(1, 8))}
        phases = mixing.plan(blocks, {s: rng.random() + 0.01 for s in blocks}, rng.choice([10, 50, 97]))
        done, end = dict.fromkeys(blocks, 0), 0
        for p in phases:
            assert p.start == end and sum(p.counts.values()) == p.slots
            end += p.slots
            seen = dict.fromkeys(p.pattern, 0)
            for k, s in enumerate(p.pattern, 1):
                seen[s] += 1
                assert all(abs(seen[q] - k * p.pattern.count(q) / len(p.pattern)) < 1 for q in seen)
            for s, n in p.counts.items():
                assert p.first[s] == done[s]
                done[s] += n
        assert done == blocks and end == sum(blocks.values())


def test_each_row_has_one_place_and_prefixes_meet_the_target(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    weights = {"hot": 5, "s0": 2, "s1": 1, "s2": 1, "s3": 1}
    got = mixing.mix(rows, weights, block=10, period=100).orderBy("position").collect()
    assert len({r["position"] for r in got}) == len({r["id"] for r in got}) == 4000
    assert [r["slot"] for r in got] == sorted(r["slot"] for r in got)
    for slots in range(1, 60):
        for s, w in weights.items():
            n = len({r["block"] for r in got if r["slot"] < slots and r["source"] == s})
            assert abs(n - slots * w / 10) < 1
    last = {s: max(r["slot"] for r in got if r["source"] == s) for s in (*weights, "s4")}
    assert min(r["slot"] for r in got if r["source"] == "s4") > max(v for s, v in last.items() if s != "s4")


def fluid(blocks, weights, k):
    """What each source has had after k slots if all are read at once, those left by their share of the weights."""
    had, t = dict.fromkeys(blocks, Fraction(0)), Fraction(0)
    while t < k:
        left = {s: Fraction(weights[s]) for s in blocks if had[s] < blocks[s]}
        total = sum(left.values())
        step = min(k - t, min((blocks[s] - had[s]) * total / w for s, w in left.items()))
        had = {s: h + step * left[s] / total if s in left else h for s, h in had.items()}
        t += step
    return had


def test_slots_meet_the_given_weights_to_within_a_block():
    for seed in range(60):
        rng = random.Random(seed)
        blocks = [rng.randint(0, 60) for _ in range(rng.randint(1, 9))]
        weights = [rng.choice([rng.random() + 0.01, 10 ** rng.uniform(-6, 6)]) for _ in blocks]
        n = dict.fromkeys(range(len(blocks)), 0)
        for k, (s, j) in enumerate(mixing.slots(blocks, weights), 1):
            assert j == n[s]
            n[s] += 1
            if k % 7 == 0:
                assert all(abs(n[q] - x) < 1 for q, x in fluid(dict(enumerate(blocks)), weights, k).items())
        assert list(n.values()) == blocks


def test_slots_do_not_drift_over_many_blocks():
    blocks = [15_000, 9_000, 2_500, 1_500, 900, 600, 300, 200]
    weights = [n**0.5 for n in blocks]
    n = [0] * 8
    for k, (s, _) in enumerate(mixing.slots(blocks, weights), 1):
        n[s] += 1
        if max(n[i] / blocks[i] for i in range(8)) < 0.99:
            assert all(abs(c - k * w / sum(weights)) < 1 for c, w in zip(n, weights))
    hot = [1_000_000 // 100] + [20] * 1_000  # more sources than a schedule in whole parts of 1,000 slots can tell apart
    first = list(islice(mixing.slots(hot, [1_000_000**0.5] + [2_000**0.5] * 1_000), 10_000))
    assert abs(sum(s == 0 for s, _ in first) - 10_000 * 1_000 / (1_000 + 1_000 * 2_000**0.5)) < 1


def test_mixing_takes_any_number_of_sources(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 2500)).alias("source"))
    got = mixing.mix(rows, block=2).collect()
    assert len({r["position"] for r in got}) == len({r["id"] for r in got}) == 6000
    assert sorted({r["slot"] for r in got}) == list(range(len({(r["source"], r["block"]) for r in got})))


def test_mixing_odd_rows(messy, none, spark):
    got = mixing.mix(messy, block=2).collect()
    assert len(got) == messy.count() and len({r["position"] for r in got}) == len(got)
    out = mixing.in_mixed_order(messy)
    assert out.columns == messy.columns and sorted(map(str, out.collect())) == sorted(map(str, messy.collect()))
    assert mixing.mix(none).count() == 0 and mixing.in_mixed_order(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(messy, {"s0": 0})


def test_mixed_order_is_the_order_of_the_files(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("string").alias("source"))
    places = {r["id"]: r["position"] for r in mixing.mix(rows, block=7).collect()}
    mixing.in_mixed_order(rows, block=7).write.parquet(str(tmp_path / "m"))
    read = []
    for f in sorted((tmp_path / "m").glob("part-*.parquet")):
        read += [r["doc_id"] for r in spark.read.parquet(str(f)).collect()]
    assert [places[i] for i in read] == sorted(places.values())


def test_plan_is_best_fit_and_whole():
    for seed in range(150):
        rng = random.Random(seed)
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 4)))
        sizes = {n: rng.randint(1, 30) for n in rng.sample(range(1, lengths[-1] + 1), min(lengths[-1], 12))}
        plan = packing.best_plan(sizes, lengths)
        bins, seen = {}, {n: [] for n in sizes}
        for n, lo, hi, each, first, offset in plan.runs:
            for p in range(lo, hi):
                seen[n].append(p)
                bins.setdefault(first + (p - lo) // each, []).append((offset + (p - lo) % each * n, n))
        assert all(sorted(v) == list(range(sizes[n])) for n, v in seen.items())
        cost = 0
        for b, items in bins.items():
            end = 0
            for at, n in sorted(items):
                assert at == end
                end += n
            group = [g for g in plan.groups if g[0] <= b][-1]
            assert group[1:] == (end, lengths[bisect_left(lengths, end)])
            cost += packing.sequence_cost(group[2])
        assert len(bins) == plan.bins and abs(cost - plan.cost) < 1e-6


def one_by_one(items, open_size):
    """Best fit of one item after the other, longest first: what the plan on counts must equal in bins and contents."""
    rooms = []
    for n in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(open_size(n) - n)
    return sorted(rooms)


def test_plan_on_counts_equals_best_fit_one_by_one():
    for seed in range(60):
        rng = random.Random(seed)
        sizes = {n: rng.randint(1, 25) for n in rng.sample(range(1, 41), 9)}
        plan = packing.pack_histogram(sizes, lambda n: 40, [40], float)
        rooms = []
        for i, (first, used, _) in enumerate(plan.groups):
            end = plan.groups[i + 1][0] if i + 1 < len(plan.groups) else plan.bins
            rooms += [40 - used] * (end - first)
        assert sorted(rooms) == one_by_one([n for n, c in sizes.items() for _ in range(c)], lambda n: 40)


def test_packing_odd_rows(messy, none):
    got = packing.pack(messy, lengths=(64, 256)).collect()
    assert {r["id"] for r in got if r["length"] == 0} == {3, 4, None}
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in messy.collect() if r["doc_id"] is not None}
    for i, n in words.items():
        mine = [r for r in got if r["id"] == i]
        assert sum(r["length"] for r in mine) == n * (2 if i == 11 else 1)
    taken = sorted((r["bin"], r["offset"], r["length"], r["capacity"]) for r in got if r["length"])
    for a, b in zip(taken, taken[1:]):
        assert a[0] != b[0] or a[1] + a[2] == b[1]
    assert all(o + n <= c for _, o, n, c in taken)
    assert packing.pack(none).count() == 0


def test_bins_follow_the_order_of_the_rows(spark, tmp_path):
    rng = random.Random(3)
    n = {i: rng.choice([0, 1, 3, 5, 9, 16, 40]) for i in range(600)}
    rows = spark.createDataFrame([(i, " ".join("w" * n[i]), "ab"[i % 3 == 0]) for i in range(600)], "doc_id long, text string, source string")
    seen = []
    for k, weights in enumerate(({"a": 9.0, "b": 1.0}, {"a": 1.0, "b": 9.0})):
        mixing.in_mixed_order(rows, weights, block=5).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        place = {r["doc_id"]: r["at"] for r in mixing.with_reading_order(docs, "at").collect()}
        mixed = {r["id"]: r["position"] for r in mixing.mix(rows, weights, block=5).collect()}
        assert sorted(place, key=place.get) == sorted(mixed, key=mixed.get) and sorted(place.values()) == list(range(600))
        again = mixing.with_reading_order(mixing.in_mixed_order(docs, weights, block=5).cache(), "at").collect()
        assert {r["doc_id"]: r["at"] for r in again} == place
        got = packing.pack(mixing.with_reading_order(docs, "at"), lengths=(16, 32), order="at").collect()
        assert {i: sum(r["length"] for r in got if r["id"] == i) for i in n} == n
        first, held = {}, {}
        for r in got:
            if r["length"]:
                first[r["bin"]] = min(first.get(r["bin"], (10**9, 0)), (place[r["id"]], r["piece"]))
                held.setdefault(r["bin"], []).append((r["offset"], r["length"], r["used"]))
        assert sorted(first) == list(range(len(first))) and sorted(first, key=first.get) == sorted(first)
        for v in held.values():
            end = 0
            for at, size, used in sorted(v):
                assert at == end
                end += size
            assert end == used
        seen.append({(r["id"], r["piece"]): r["bin"] for r in got})
    assert seen[0] != seen[1]
