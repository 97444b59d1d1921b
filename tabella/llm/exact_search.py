"""Exact search for the largest inner products of integer vectors, by buckets of like length.

Candidates of a panel are sorted by length and cut into buckets. A query's k-th best product so far divided by its length and
the bucket's greatest length is the bucket's local cosine threshold. Above 1 this bucket and all shorter ones are done with.
If it is high, only candidates whose coordinates lie in the range that the threshold allows on the query's largest
coordinates are verified (coordinate pruning); if it is low, those that are long enough (length pruning). Verified means the
whole product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabella.llm.vectors import best_of, search, sound

BUCKET = 512
FOCUS = 3
HIGH = 0.6
SLACK = 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-valued doubles."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return a @ b.T
    return (a.astype(np.int64) @ b.astype(np.int64).T)


def _cell(k: int):
    def run(q_ids, q, c_ids, c):
        by_length = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
        c_ids, c = c_ids[by_length], c[by_length]
        long_c, long_q = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
        unit = c / np.maximum(long_c, 1e-300)[:, None]
        u = q / np.maximum(long_q, 1e-300)[:, None]
        focus = np.argsort(-np.abs(u), axis=1)[:, :FOCUS]
        kth = np.full(len(q), -np.inf)
        hq, hc, hs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, products(q[:1], c[:1]).dtype)

        def keep(qi, ci, s):
            nonlocal hq, hc, hs
            hq, hc, hs = np.concatenate([hq, qi]), np.concatenate([hc, ci]), np.concatenate([hs, s])
            place = best_of(hq, hc, hs, c_ids, k)
            hq, hc, hs = hq[place], hc[place], hs[place]
            n = np.bincount(hq, minlength=len(q))
            last = np.cumsum(n) - 1
            kth[n >= k] = hs[last[n >= k]]

        for lo in range(0, len(c), BUCKET):
            hi = min(lo + BUCKET, len(c))
            most = long_q * long_c[lo]
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(most > 0, kth / most, np.where(kth > 0, np.inf, -np.inf))
            open_ = local <= 1 + SLACK
            if not open_.any():
                break
            sharp = open_ & (local > HIGH)
            plain = np.flatnonzero(open_ & ~sharp)
            found = []
            if len(plain):
                # Long enough: the length times the query's reaches the k-th product; buckets are sorted, so it is a prefix.
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where((kth[plain] > 0) & (long_q[plain] > 0), kth[plain] / long_q[plain] * (1 - SLACK), -np.inf)
                end = int(np.searchsorted(-long_c[lo:hi], -least.min(), side="right"))
                s = products(q[plain], c[lo : lo + end])
                bar = kth[plain]
                if s.shape[1] > k:
                    bar = np.maximum(bar, np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1])
                r, col = np.nonzero(s >= bar[:, None])
                found.append((plain[r], lo + col, s[r, col]))
            for i in np.flatnonzero(sharp):
                t = min(local[i], 1.0)
                f = focus[i]
                mid, wide = u[i, f] * t, np.sqrt(np.maximum((1 - u[i, f] ** 2) * (1 - t * t), 0)) + 1e-7
                # Above the middle of the range a larger cosine moves the bounds, so the range of all cosines >= t is taken.
                up = np.where(u[i, f] >= t, 1.0, mid + wide)
                down = np.where(u[i, f] <= -t, -1.0, mid - wide)
                part = unit[lo:hi, f]
                at = lo + np.flatnonzero(((part <= up + 1e-7) & (part >= down - 1e-7)).all(axis=1))
                if len(at):
                    s = products(q[i : i + 1], c[at])[0]
                    some = s >= kth[i]
                    found.append((np.full(int(some.sum()), i), at[some], s[some]))
            qi, ci, s = (np.concatenate(x) for x in zip(*found)) if found else (hq[:0], hc[:0], hs[:0])
            other = q_ids[qi] != c_ids[ci]
            if other.any():
                keep(qi[other], ci[other], s[other])
        return q_ids[hq], c_ids[hc], hs.astype(np.int64)

    return run


def exact_top_k(table: DataFrame, is_query: Column | str, k: int = 20, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` largest integer products of every query row (``is_query`` reads ``id``) with every other row.

    A vector x becomes floor(scale * x), x as double. Null or empty vectors and vectors with null or non-finite components take
    no part; of several rows of one id the smallest vector counts; vectors of another dimension are no candidates. Fewer than
    k others give fewer rows. Ties go to the smaller id. Other columns are not read.
    """
    rows = sound(table, id, vector).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    return search(rows, is_query, k, _cell(k), "long", "exact")
