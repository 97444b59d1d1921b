"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges, exact confirmation.

1. Every text becomes its set of word shingles (64-bit hashes). One permutation is cut into bins; an empty bin takes the
   value of another by its own fixed sequence of probes (optimal densification). Bands of bins are bucket keys.
2. Texts with equal sets are one class from here on; a class is named by its smallest id.
3. Each bucket emits a star: its smallest class against each other one, so a bucket of n rows gives n - 1 pairs. All pairs
   are confirmed on the full sets, and links give components.
4. A star can miss a link between two members. So the classes of all buckets that still hold more than one component are
   searched exactly: a link of similarity t needs a common shingle among the rarest n - ceil(t n) + 1 of both sets (prefix
   filter), and only pairs of different components are built. Nothing is capped, and no bucket is paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import chunks, components, mixed, pick, saved, shingle_hashes, strings

BINS = 180
PROBES = 512


@dataclass(frozen=True)
class Similar:
    """``words`` per shingle; linked from ``percent`` / 100 of the union on."""

    words: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Bins a band; at the threshold itself a pair is missed by all bands less than once in 100,000."""
        return next(r for r in (10, 9, 6, 5, 4, 3, 2, 1) if (1 - (self.percent / 100) ** r) ** (BINS // r) < 1e-5)


def _probes() -> np.ndarray:
    """For each bin the fixed sequence of bins that it asks while it is empty."""
    return np.random.default_rng(11).integers(0, BINS, (BINS, PROBES))


_PROBES = _probes()
_EDGES = np.array([(i << 64) // BINS for i in range(1, BINS)], dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin of one sorted set; empty bins are densified."""
    cut = np.concatenate([[0], np.searchsorted(shingles, _EDGES), [len(shingles)]])
    full = cut[:-1] < cut[1:]
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for lo, hi in ((0, 4), (4, 32), (32, PROBES)):
        if not len(empty):
            break
        hit = full[_PROBES[empty, lo:hi]]
        found = hit.any(axis=1)
        source[empty[found]] = _PROBES[empty[found], lo + hit[found].argmax(axis=1)]
        empty = empty[~found]
    if len(empty):
        held = np.flatnonzero(full)
        source[empty] = held[np.searchsorted(held, empty) % len(held)]
    return shingles[cut[:-1][source]]


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One bucket key for each band of ``rows`` bins."""
    n = BINS // rows
    cells = sig[: n * rows].reshape(n, rows)
    key = mixed(np.arange(n, dtype=np.uint64) + np.uint64(1))
    for j in range(rows):
        key = mixed(key * np.uint64(0x9FB21C651E98DF25) + cells[:, j])
    return key


def _features(how: Similar):
    """Arrow batches of (id, text) to (id, n, sig_a, sig_b, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n_bands = how.rows, BINS // how.rows
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for lo, hi, data, offsets in chunks(strings(batch, "text")):
                sets = shingle_hashes(data, offsets, how.words)
                keys = np.zeros((hi - lo, n_bands), np.uint64)
                sums = np.zeros((2, hi - lo), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        keys[i] = bands(signature(s), rows)
                        sums[0, i] = np.add.reduce(s)
                        sums[1, i] = np.add.reduce(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * n_bands), pa.array(keys.ravel().view(np.int64)))
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), flat], ["id", "n", "sig_a", "sig_b", "bands"])

    return run


def _confirm(how: Similar):
    """Arrow batches of (a, b, text_a, text_b) to the pairs that are linked on their full sets."""

    def sets(texts: pa.Array) -> list[np.ndarray]:
        return [s for _, _, data, offsets in chunks(texts) for s in shingle_hashes(data, offsets, how.words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
            linked = []
            hubs = strings(batch, "text_a")
            for lo in range(0, len(a), 256):
                for i, right in enumerate(sets(strings(batch, "text_b").slice(lo, 256)), lo):
                    if a[i] != hub:
                        hub, hub_set = a[i], sets(hubs.slice(i, 1))[0]
                    at = np.searchsorted(hub_set, right)
                    both = int((hub_set[np.minimum(at, len(hub_set) - 1)] == right).sum())
                    linked.append(100 * both >= how.percent * (len(hub_set) + len(right) - both))
            mask = np.array(linked, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)[mask]) for x in (a, b)], ["a", "b"])

    return run


def _shingle_rows(how: Similar):
    """Arrow batches of (id, text) to one row for each shingle of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(strings(batch, "text"), 1 << 18):
                sets = shingle_hashes(data, offsets, how.words)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], ["id", "shingle"])

    return run


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the given ids."""
    return texts.join(ids, "id", "left_semi")


def _linked(pairs: DataFrame, texts: DataFrame, how: Similar) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. The hub's text is joined last, so its rows lie together."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(how), "a long, b long")


def _rest(buckets: DataFrame, state: DataFrame, classes: DataFrame, texts: DataFrame, how: Similar) -> DataFrame | None:
    """Links between components that share a bucket, by an exact prefix-filter search; None if no bucket is mixed."""
    member = buckets.join(state, F.col("id") == F.col("rep"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    split = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    open_ = saved(member.join(split, "key", "left_semi").select(F.col("rep").alias("id"), "component").distinct(), "near-open")
    if open_.isEmpty():
        return None
    rows = saved(_texts_of(texts, open_).select("id", "text").mapInArrow(_shingle_rows(how), "id long, shingle long"), "near-shingles")
    placed = rows.join(open_, "id").join(classes.select(F.col("rep").alias("id"), "n"), "id")
    often = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), (F.min("component") != F.max("component")).alias("across"))
    # A shingle of one component only can't be shared by a pair that is looked for; such ones come first and count as ``own``.
    # Then rare ones, by the hash where equally rare: the same order in every set.
    order = F.struct("across", "df", "shingle")
    sets = placed.join(often, "shingle").groupBy("id", "n", "component").agg(F.sort_array(F.collect_list(order)).alias("all"), F.sum((~F.col("across")).cast("int")).alias("own"))
    kept = F.col("n") - F.ceil(F.col("n") * how.percent / 100) + 1
    near = sets.select("id", "n", "component", "own", F.posexplode(F.slice("all", F.lit(1), kept.cast("int"))).alias("at", "s"))
    prefix = saved(near.filter("s.across").select("id", "n", "component", "own", "at", F.col("s.shingle").alias("shingle")), "near-prefix")
    # Of each shingle's list only rows outside the component of its largest part look for partners; both ends are smaller than
    # the list squared, and a list of one component has no partners at all.
    parts = prefix.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"))
    top = parts.groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("shingle", F.col("top.component").alias("main"))
    mixed_rows = prefix.join(top, "shingle")
    few = mixed_rows.filter("component <> main").select("shingle", *[F.col(c).alias(c + "_x") for c in ("id", "n", "component", "own", "at")])
    all_ = mixed_rows.select("shingle", "main", *[F.col(c).alias(c + "_y") for c in ("id", "n", "component", "own", "at")])
    # A pair that shares s shingles has one within the first n - s + 1 of either set (s for the sizes of this pair); and it
    # shares at most what stands before this one in both, this one, and what follows it.
    need = how.percent * (F.col("n_x") + F.col("n_y"))
    early = ((100 + how.percent) * (F.col("n_x") - F.col("at_x")) >= need) & ((100 + how.percent) * (F.col("n_y") - F.col("at_y")) >= need)
    most = F.least(F.col("at_x") - F.col("own_x"), F.col("at_y") - F.col("own_y")) + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    enough = early & ((100 + how.percent) * most >= need)
    once = (F.col("component_y") == F.col("main")) | (F.col("id_x") < F.col("id_y"))
    fits = (F.col("component_x") != F.col("component_y")) & enough & once
    pairs = saved(few.join(all_, "shingle").filter(fits).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct(), "near-pairs")
    return _linked(pairs, texts, how)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", how: Similar = Similar()) -> DataFrame:
    """Groups of documents whose shingle sets are alike: ``id``, ``n_shingles``, ``component``, ``kept``.

    One row per distinct id; rows without an id take no part. Null and empty texts and texts without words have no shingles,
    stay alone and are kept. Of rows that repeat an id the class of the smallest signature counts. Equal texts are always one
    group. ``component`` is the smallest id reachable over links; ``kept`` marks the row that has that id itself.
    Other columns of ``docs`` are not read.
    """
    texts = pick(docs, id=id, text=text).filter("id is not null")
    found = saved(texts.mapInArrow(_features(how), "id long, n long, sig_a long, sig_b long, bands array<long>"), "near-features")
    one = found.groupBy("id").agg(F.min(F.struct("n", "sig_a", "sig_b")).alias("s")).select("id", "s.*")
    classes = saved(found.filter("n > 0").groupBy("sig_a", "sig_b", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "near-classes")
    spread = classes.select("rep", "n", F.explode("bands").alias("key"))
    stars = spread.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size"), F.max("rep").alias("last")).filter("hub <> last").select("key", "hub")
    buckets = saved(spread.join(stars, "key").select("key", "hub", "rep", "n"), "near-buckets")
    sizes = classes.select(F.col("rep").alias("hub"), F.col("n").alias("n_hub"))
    edges = buckets.filter("rep <> hub").select("hub", "rep", "n").distinct().join(sizes, "hub")
    pairs = saved(edges.filter(100 * F.least("n", "n_hub") >= how.percent * F.greatest("n", "n_hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b")), "near-edges")
    wanted = buckets.select(F.col("rep").alias("id")).distinct()
    held = saved(_texts_of(texts, wanted).dropDuplicates(["id"]), "near-texts")
    links = saved(_linked(pairs, held, how), "near-links")
    state = components(links, "near-groups")
    more = _rest(buckets, state, classes, held, how)
    if more is not None:
        more = saved(more, "near-more")
        if not more.isEmpty():
            state = components(links.union(more), "near-all")
    named = classes.join(state, F.col("rep") == F.col("id"), "left").select("sig_a", "sig_b", "n", F.coalesce("component", "rep").alias("component"))
    out = one.join(named, ["sig_a", "sig_b", "n"], "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component"), (F.col("id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", how: Similar = Similar()) -> DataFrame:
    """One document of each group, whole rows; of rows with the same id one stays, and rows without an id stay."""
    groups = saved(near_duplicates(docs, id, text, how), "near-result")
    out = docs.join(groups.filter("kept").select(F.col("id").alias("_kept_id")), F.col(id) == F.col("_kept_id"), "left_semi")
    twice = docs.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("_twice_id")).count().filter("count > 1").select("_twice_id")
    if not twice.isEmpty():
        again = F.col(id) == F.col("_twice_id")
        out = out.join(twice, again, "left_anti").unionByName(out.join(twice, again, "left_semi").dropDuplicates([id]))
    return out.unionByName(docs.filter(F.col(id).isNull()))
