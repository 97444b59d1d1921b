"""Approximate nearest neighbours by inner product: multi-index hashing of learned binary codes.

How much the index saves depends on how much nearer the neighbours are than the rest. On vectors in clusters nearly all queries
find enough codes within the probed radius and a few percent of the codes are visited; on vectors that point everywhere (the
nearest at a cosine of 0.4, so 95 of 256 bits apart) no probing is cheaper than the directory, which is then read.

Codes are the signs of several learned rotations (iterative quantization on a bounded sample). Within a block of like length
each vector gets one more component that makes all lengths equal, so the angle follows the inner product. A code is cut into
16-bit substrings, each of them indexed. By the pigeonhole principle a code within radius m (r + 1) - 1 of the query's agrees
with it in one of m substrings up to r bits: probing all substring values within r bits retrieves every code of that radius.
The radius grows until enough codes are inside; once more values would have to be probed than there are codes in the block,
the block's directory is read instead. Everything inside the radius is reranked on the original vectors in doubles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import saved
from tabella.llm.vectors import best_of, search, sound

BLOCK = 4_096
NARROW = 0.8  # a block's shortest vector is at least this part of its longest
CUT = 16


@dataclass(frozen=True)
class Settings:
    """``bits`` a code has, a multiple of 64; ``sample`` vectors teach the rotations; a radius must hold ``share`` of a block and 10 k codes."""

    bits: int = 256
    sample: int = 5_000
    rounds: int = 25
    share: float = 0.06


def rotations(x: np.ndarray, how: Settings, seed: int = 3) -> np.ndarray:
    """Columns to multiply with; d learned ones a start, as many starts as the bits need."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(math.ceil(how.bits / d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(how.rounds if len(x) else 0):
            a, _, b = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = b.T @ a.T
        out.append(r)
    return np.concatenate(out, axis=1)[:, : how.bits]


def codes(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words: one bit a rotated component, and no bit that says nothing."""
    return np.packbits(x @ turn >= 0, axis=1, bitorder="little").view(np.uint64)


def _inside(asked: np.ndarray, there: np.ndarray, need: int, told: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, code) pairs: of each query every code within the least probed radius that holds ``need`` codes.

    ``told``, if given, receives how many codes the probes visited and for how many queries the directory was read.
    """
    n, m = len(there), there.shape[1] * 64 // CUT
    need = min(need, n)
    seen = np.zeros((len(asked), n), bool)
    parts, wanted = there.view(np.uint16), asked.view(np.uint16)
    masks = np.concatenate([[0], 1 << np.arange(CUT)]).astype(np.uint16)
    for s in range(m):
        order = np.argsort(parts[:, s], kind="stable")
        values = parts[order, s]
        probes = (wanted[:, s, None] ^ masks).ravel()
        lo, hi = np.searchsorted(values, probes, "left"), np.searchsorted(values, probes, "right")
        size = hi - lo
        total = int(size.sum())
        if total:
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
            seen[np.repeat(np.repeat(np.arange(len(asked)), len(masks)), size), order[at]] = True
    radius = 2 * m - 1  # one bit in each substring
    q, c = np.nonzero(seen)
    near = np.bitwise_count(asked[q] ^ there[c]).sum(axis=1) <= radius
    q, c = q[near], c[near]
    enough = np.bincount(q, minlength=len(asked)) >= need
    rest = np.flatnonzero(~enough)
    if told is not None:
        told.update(visited=told.get("visited", 0) + int(seen.sum()), pairs=told.get("pairs", 0) + seen.size, read=told.get("read", 0) + len(rest), asked=told.get("asked", 0) + len(asked))
    held = enough[q]
    out_q, out_c = [q[held]], [c[held]]
    for lo in range(0, len(rest), 128):
        some = rest[lo : lo + 128]
        far = np.zeros((len(some), n), np.uint16)
        for w in range(there.shape[1]):
            far += np.bitwise_count(asked[some, w, None] ^ there[None, :, w])
        radius = np.partition(far, need - 1, axis=1)[:, need - 1]
        a, b = np.nonzero(far <= radius[:, None])
        out_q.append(some[a])
        out_c.append(b)
    return np.concatenate(out_q), np.concatenate(out_c)


def _cell(k: int, turns: dict[int, np.ndarray], how: Settings):
    def run(q_ids, q, c_ids, c):
        turn = turns[q.shape[1]]
        length = np.linalg.norm(c, axis=1)
        order = np.argsort(-length, kind="stable")
        c_ids, c, length = c_ids[order], c[order], length[order]
        long_q = np.linalg.norm(q, axis=1)
        asked = codes(np.concatenate([q / long_q[:, None], np.zeros((len(q), 1))], axis=1), turn)
        hq, hc, hs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kth = np.full(len(q), -np.inf)
        lo = 0
        while lo < len(c):
            hi = min(lo + BLOCK, int(np.searchsorted(-length, -NARROW * length[lo], side="right")))
            live = np.flatnonzero(kth <= long_q * length[lo] * (1 + 1e-9))  # no shorter vector can beat the others' k-th
            if not len(live):
                break
            part = c[lo:hi] / length[lo]
            rest = np.sqrt(np.maximum(1 - (part**2).sum(axis=1), 0))
            qi, ci = _inside(asked[live], codes(np.concatenate([part, rest[:, None]], axis=1), turn), max(10 * k, math.ceil(how.share * len(part))))
            qi, ci = live[qi], lo + ci
            other = q_ids[qi] != c_ids[ci]
            qi, ci = qi[other], ci[other]
            s = np.empty(len(qi))
            for at in range(0, len(qi), 50_000):
                s[at : at + 50_000] = (q[qi[at : at + 50_000]] * c[ci[at : at + 50_000]]).sum(axis=1)
            hq, hc, hs = np.concatenate([hq, qi]), np.concatenate([hc, ci]), np.concatenate([hs, s])
            place = best_of(hq, hc, hs, c_ids, k)
            hq, hc, hs = hq[place], hc[place], hs[place]
            n = np.bincount(hq, minlength=len(q))
            full = n >= k
            kth[full] = hs[(np.cumsum(n) - 1)[full]]
            lo = hi
        return q_ids[hq], c_ids[hc], hs

    return run


def nearest(table: DataFrame, is_query: Column | str, k: int = 20, how: Settings = Settings(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """About the ``k`` largest inner products of every query row (``is_query`` reads ``id``) with every other row.

    Every row is indexed; only the rotations are learned, on about ``how.sample`` rows cut by a hash of the id. Null, empty and
    zero vectors and vectors with null or non-finite components take no part; of several rows of one id the smallest vector
    counts; vectors of another dimension are no candidates. Fewer than k others give fewer rows. Ties go to the smaller id.
    Scores are exact. Other columns are not read.
    """
    rows = saved(sound(table, id, vector).filter(F.exists("v", lambda x: x != 0)), "near-vectors")
    dims = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    turns = {}
    for d, n in dims.items():
        place = (F.xxhash64("id").cast("double") + 2.0**63) / 2.0**64
        sample = np.array([r["v"] for r in rows.filter((F.size("v") == d) & (place < how.sample / n)).select("v").collect()], float).reshape(-1, d)
        lengths = np.linalg.norm(sample, axis=1, keepdims=True)
        x = np.concatenate([sample / lengths, np.zeros((len(sample), 1))], axis=1)
        turns[d] = rotations(x, how)
    return search(rows, is_query, k, _cell(k, turns, how), "double", "near")
