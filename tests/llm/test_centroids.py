import hashlib
import math

import numpy as np
import pytest

from tabella.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, v int, id string, dots long, cluster string, n int, total int, distance double"
EXTRA = (1, "x", 3, "y", 5, 6, 0.5)


def table(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA)


def brute(rows, k, dim, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(held[j]) for x in zip(*held[j])] if j in held else c for j, c in enumerate(centres)]
    near = [nearest(v) for _, v in kept]
    own = {}
    for d, j in near:
        own[j] = own.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), j, d, own[j], sum(own.values()), sha[j]) for (i, _), (d, j) in zip(kept, near))


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_equals_brute_force_with_many_rounds(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 8))
    rows = [(i, (centre[i % 6] + 0.4 * rng.standard_normal(8)).tolist()) for i in range(600)]
    for k, rounds in ((7, 5), (40, 2), (1, 1), (3, 0)):
        assert got(centroids.cluster(table(spark, rows).repartition(5), k=k, dim=8, rounds=rounds)) == brute(rows, k, 8, rounds)


def test_odd_rows(spark):
    one = [0.25, -0.001]
    rows = [
        (1, one), (1, one), (2, one), (3, [0.0, 0.0]), (4, [-1.0, 7.5]), (5, None), (6, []), (7, [1.0]), (8, [1.0, 2.0, 3.0]),
        (9, [float("nan"), 0.0]), (10, [float("inf"), 0.0]), (11, [None, 0.0]), (None, [3.0, 3.0]), (None, one), (12, [1000.0, -1000.0]),
        (13, [1.0, 0.0]), (14, [-1.0, 0.0]),
    ]
    for k in (2, 4, 40):
        assert got(centroids.cluster(table(spark, rows), k=k, dim=2)) == brute(rows, k, 2, 5)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [])]):
        out = centroids.cluster(table(spark, rows))
        assert out.count() == 0 and out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_one_vector_in_most_rows(spark):
    rows = [(i, [0.5, 0.5] if i % 3 else [i / 10, -i / 20]) for i in range(300)]
    assert got(centroids.cluster(table(spark, rows).repartition(7), k=5, dim=2)) == brute(rows, 5, 2, 5)


def test_large_components_stay_exact_or_are_refused(spark):
    rows = [(i, [(-1) ** i * 500_000.0 + i, 400_000.0 - i]) for i in range(50)]
    assert got(centroids.cluster(table(spark, rows), k=3, dim=2)) == brute(rows, 3, 2, 5)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(table(spark, [(1, [1e9, 0.0])]), dim=2).collect()


def test_products_change_by_moved_components_only():
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (50, 6))
    old, new = rng.integers(-300, 300, (4, 6)), None
    new = old.copy()
    new[1, 2] += 5
    new[3] -= 7
    dots = v @ old.T
    centroids.add_changes(dots, v, new - old)
    assert (dots == v @ new.T).all()
    huge = v * (1 << 18)
    dots = huge @ (old * (1 << 18)).T
    centroids.add_changes(dots, huge, (new - old) * (1 << 18))
    assert (dots == huge @ (new * (1 << 18)).T).all()
