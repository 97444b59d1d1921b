import math

import numpy as np

from tabella.llm import ann_search, exact_search

QUERY = "id % 20 = 0"
SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, id string, q int, c int, dim int"
EXTRA = (1, 0.5, 2, "x", 3, 4, 5)


def table(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA)


def exact(rows, k=20, scale=64):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(scale * float(np.float32(x))) for x in v] if scale else [float(np.float32(x)) for x in v]
            sound[i] = min(sound.get(i, w), w)
    out = []
    for q, a in sound.items():
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound.items() if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def vectors(n, dim, seed, lengths=False):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((5, dim))
    x = np.where(rng.random(n)[:, None] < 0.5, centre[rng.integers(0, 5, n)] + 0.05 * rng.standard_normal((n, dim)), rng.standard_normal((n, dim)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * np.exp(2 * rng.standard_normal((n, 1))) if lengths else x


def test_exact_on_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "BUCKET", 32)
    for dim, lengths in ((3, True), (16, True), (16, False)):
        rows = [(i, v.tolist()) for i, v in enumerate(vectors(400, dim, dim, lengths))]
        got = exact_search.exact_top_k(table(spark, rows), QUERY)
        assert sorted(tuple(r) for r in got.collect()) == exact(rows)


ODD = [
    (0, [0.5, 0.5]), (20, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, []),
    (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [-1.0, -1.0]), (10, [1.0, 0.0, 0.0]), (40, [1.0, 0.0, 0.0]),
    (None, [9.0, 9.0]), (11, [-0.001, 0.001]), (60, [0.0, 0.0]), (80, [1e6, 1e6]), (2, [0.9, 0.9]),
]


def test_exact_odd_rows(spark):
    got = exact_search.exact_top_k(table(spark, ODD), QUERY)
    assert sorted(tuple(r) for r in got.collect()) == exact(ODD)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert exact_search.exact_top_k(table(spark, ODD).limit(0), QUERY).count() == 0


def test_pruning_skips_products(monkeypatch):
    """With separated lengths and clusters far fewer candidates are verified than there are pairs."""
    x = np.floor(64 * vectors(4000, 16, 1, lengths=True))
    seen = []
    products = exact_search.products
    monkeypatch.setattr(exact_search, "products", lambda a, b: seen.append(len(a) * len(b)) or products(a, b))
    exact_search._cell(20)(np.arange(200) * 20, x[::20], np.arange(4000), x)
    assert sum(seen) < 0.5 * 200 * 4000


def test_neighbours_recall_and_scores(spark):
    for lengths in (False, True):
        rows = [(i, v.tolist()) for i, v in enumerate(vectors(3000, 24, 5, lengths))]
        want = exact(rows, scale=None)
        got = ann_search.nearest(table(spark, rows), QUERY).collect()
        assert len(got) == len(want)
        true = {(q, i): s for q, _, i, s in want}
        hit = [r for r in got if (r["query_id"], r["vec_id"]) in true]
        assert len(hit) / len(want) >= 0.95
        assert all(abs(r["score"] - true[r["query_id"], r["vec_id"]]) <= 1e-9 * max(1, abs(r["score"])) for r in hit)


def test_neighbours_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 3]
    want = [w for w in exact([(i, v) for i, v in rows if v and any(v)], scale=None)]
    got = ann_search.nearest(table(spark, rows), QUERY)
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()) == [(q, r, i, round(s, 9)) for q, r, i, s in want]
    assert ann_search.nearest(table(spark, rows).limit(0), QUERY).count() == 0


def test_pigeonhole_finds_all_inside_the_radius():
    rng = np.random.default_rng(2)
    there = rng.integers(0, 2**63, (500, 4), dtype=np.uint64)
    asked = there[:5].copy()
    for i in range(5):  # 31 flipped bits: one substring has at most one of them
        for b in rng.choice(256, 31, replace=False):
            asked[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    q, c = ann_search._inside(asked, there, 1)
    assert {(i, i) for i in range(5)} <= set(zip(q.tolist(), c.tolist()))


def test_codes_have_no_idle_bits_and_the_index_saves_on_clusters():
    """Every substring tells vectors apart; in clusters the probes visit few codes and settle most queries."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((200, 64))
    x = np.repeat(centre, 20, axis=0) + 0.05 * rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    wide = np.concatenate([x, np.zeros((4000, 1))], axis=1)
    code = ann_search.codes(wide, ann_search.rotations(wide[::8], ann_search.Settings()))
    parts = code.view(np.uint16)
    assert code.shape == (4000, 4) and parts.shape[1] == 16 and all(len(np.unique(parts[:, j])) > 100 for j in range(16))
    told = {}
    q, c = ann_search._inside(code[::20], code, 15, told)
    assert told["visited"] < 0.02 * told["pairs"] and told["read"] < 0.2 * told["asked"]
    assert (np.bincount(q, minlength=200) >= 15).all()


def test_recall_on_the_given_table(spark):
    from tabella.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    got = {}
    for r in queries.op9(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        hit += len(got[ids[at]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9
