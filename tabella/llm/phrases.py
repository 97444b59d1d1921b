"""Collocations by best-first growth of phrases, bounded by the counts of their prefixes.

A phrase's score is its lowest 2,000,000 f(phrase) / (f(first part) + f(rest)) over all cuts. If a phrase begins with a prefix
p, it occurs at most f(p) times and its rest at least as often as itself, so no phrase that p grows into scores above
2,000,000 f(p) / (f(first words of p) + f(p)): the prefix's bound. One-word prefixes are all bounded by 1,000,000 and are all
grown; after that a language's bar is lowered step by step, and only prefixes whose bound reaches the bar are grown, until as
many phrases at or above the bar survive as are asked for. Whatever was not grown scores below the bar, so the list is exact.

Counts come from passes over the whole texts. What a pass counts is narrowed by sieves of fixed size (phrases that matter,
hashed to bits); a wrong hit only means that one phrase more is counted, never that one is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabella.llm.common import mixed, pick, saved, strings, word_hashes

TOP, LEAST, COVER, LONGEST = 2_000, 30, 80, 4
#: Prefixes above the first bar, as a multiple of ``top``; every later round takes ``STEP`` times as many.
FIRST, STEP = 8, 8
#: A sieve has 32 bits a phrase, and no more than this many (8 MB).
SIEVE_BITS = 1 << 26
SLICE_BYTES = 4 << 20
_CUT = b"."
_PLAIN = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FOLD = np.uint64(0xD1B54A32D192ED03)


@dataclass
class Slice:
    """Consecutive words of one language: numbers (0 stands for the end of a piece), spellings and hashes by number.

    The first ``old`` numbers repeat the end of the slice before, so that phrases across the edge are met, and met once.
    """

    ids: np.ndarray
    words: pa.Array
    seed: np.uint64
    old: int

    @cached_property
    def hashes(self) -> np.ndarray:
        return mixed(word_hashes(*_bytes_of(self.words))[0] ^ self.seed)

    def runs(self, n: int) -> np.ndarray:
        """Where phrases of ``n`` words start that do not lie in the repeated words alone."""
        if len(self.ids) < n:
            return np.zeros(0, np.int64)
        whole = np.ones(len(self.ids) - n + 1, bool)
        for j in range(n):
            whole &= self.ids[j : len(self.ids) - n + 1 + j] != 0
        whole[: max(0, self.old - n + 1)] = False
        return np.flatnonzero(whole)

    def hash_at(self, at: np.ndarray, n: int) -> np.ndarray:
        """The hashes of the phrases of ``n`` words that start there."""
        h = self.hashes[self.ids[at]]
        for j in range(1, n):
            h = mixed(h * _FOLD + self.hashes[self.ids[at + j]])
        return h

    def distinct(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One start of every different phrase of ``n`` words among these starts, and how often it is there. Exact, on numbers."""
        runs = self.ids[at]
        for j in range(1, n):
            if j > 1:
                runs = np.unique(runs, return_inverse=True)[1]
            runs = runs * len(self.words) + self.ids[at + j]
        _, first, count = np.unique(runs, return_index=True, return_counts=True)
        return at[first], count

    def spell(self, at: np.ndarray, n: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.ids[at + j])) for j in range(n)], pa.scalar(" ", self.words.type))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, and where each text begins and ends."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def slices(texts: list[bytes], lang: str, n: int, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of one language as slices of about ``limit`` bytes, cut between words; a very long text is just more slices."""
    seed = _seed(lang)
    data = _CUT.join(texts).translate(_PLAIN).replace(_CUT, b" . ")
    carry: list[bytes] = []
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= limit else data.find(b" ", at + limit)
        end = len(data) if end < 0 else end
        ids, words = _numbers(b" ".join([*carry, data[at:end]]))
        at = end
        yield Slice(ids, words, seed, len(carry))
        carry = words.take(pa.array(ids[max(0, len(ids) - n + 1) :])).cast(pa.large_binary()).to_pylist() if n > 1 else []


def _numbers(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of a text as numbers, and the word of every number; the end of a piece is number 0."""
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)])
    coded = pc.split_pattern(one, " ").flatten().dictionary_encode()
    words = coded.dictionary
    cut, blank = pc.equal(words, _CUT.decode()), pc.equal(words, "")
    number = np.cumsum(~(cut.to_numpy(zero_copy_only=False) | blank.to_numpy(zero_copy_only=False)))
    number[cut.to_numpy(zero_copy_only=False)], number[blank.to_numpy(zero_copy_only=False)] = 0, -1
    kept = pa.concat_arrays([pa.array([_CUT.decode()], words.type), words.filter(pc.invert(pc.or_(cut, blank)))])
    ids = number[coded.indices.to_numpy(zero_copy_only=False)]
    return ids[ids >= 0], kept


class Sieve:
    """A set of phrases of which only hashed bits are kept; ``has`` may say yes too often, never no too often."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in (hashes & self.mask, mixed(hashes) & self.mask):
            out &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes that ``Slice.hash_at`` gives to these phrases of these languages; an empty phrase stands for its language."""
    seeds = {lang: _seed(lang) for lang in langs.unique().to_pylist()}
    seed = np.array([seeds[lang] for lang in langs.to_pylist()], np.uint64)
    h, row = word_hashes(*_bytes_of(phrases))
    h = mixed(h ^ seed[row])
    first, count = np.searchsorted(row, np.arange(len(phrases))), np.bincount(row, minlength=len(phrases))
    out = mixed(seed)
    for j in range(int(count.max(initial=0))):
        some = np.flatnonzero(count > j)
        out[some] = h[first[some]] if j == 0 else mixed(out[some] * _FOLD + h[first[some] + j])
    return out


def sieve(keys: DataFrame, bits: int = SIEVE_BITS) -> Sieve:
    """A sieve of the phrases (``lang``, ``phrase``) or of the hashes (``key``). At most ``bits`` / 64 numbers reach the driver."""
    size = 1 << 10
    while size < min(bits, 32 * keys.count()):
        size *= 2
    ready = "key" in keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if ready:
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            else:
                h = phrase_hashes(batch.column(0), batch.column(1))
            place = np.concatenate([h, mixed(h)]) & np.uint64(size - 1)
            bit = np.left_shift(np.uint64(1), place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(bit.view(np.int64))], ["slot", "bit"])

    places = (keys.select("key") if ready else keys.select("lang", "phrase")).mapInArrow(run, "slot int, bit long")
    got = places.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    held = np.zeros(size // 64, np.uint64)
    held[got["slot"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Sieve(held)


def _scan(docs: DataFrame, n: int, schema: str, emit: Callable[[Slice], tuple], langs_open: Sieve | None = None) -> DataFrame:
    """``emit`` over all slices of a pass; its columns, behind ``lang`` where the schema begins with it.

    Languages outside ``langs_open`` are passed over."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.string() if part.endswith("string") else pa.int64() for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for lang, text in zip(langs, strings(batch, "text").cast(pa.large_binary()).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                if langs_open is not None and not langs_open.has(phrase_hashes(pa.array([lang]), pa.array([""])))[0]:
                    continue
                for some in slices(texts, lang, n):
                    columns = emit(some)
                    if names[0] == "lang":
                        columns = ([lang] * len(columns[0]), *columns)
                    yield pa.RecordBatch.from_arrays([c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return docs.select("lang", "text").mapInArrow(run, schema)


def _counted(docs: DataFrame, n: int, wanted: Callable[[Slice, np.ndarray], np.ndarray], langs_open: Sieve | None = None) -> DataFrame:
    """``lang``, ``phrase``, ``a``: exact counts of the phrases of ``n`` words whose starts ``wanted`` keeps.

    ``wanted`` looks at the phrase alone, so a phrase is counted everywhere or nowhere.
    """

    def emit(some: Slice) -> tuple:
        at = some.runs(n)
        at, count = some.distinct(at[wanted(some, at)], n) if len(at) else (at, at)
        return some.spell(at, n), count

    return _scan(docs, n, "lang string, phrase string, n long", emit, langs_open).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _part(at: int, size: int) -> Column:
    """``size`` words of ``phrase`` from word ``at``."""
    return F.array_join(F.slice(F.split("phrase", " "), at + 1, size), " ")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(2,000,000 a / (l + r)), in decimals: the product may pass 64 bits."""
    wide = "decimal(20,0)"
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast(wide), l.cast(wide) + r.cast(wide))


def _scored(phrases: DataFrame, size: int, counts: dict[int, DataFrame]) -> DataFrame:
    """``l``, ``r``, ``score`` of the lowest cut and the ``bound`` of what the phrase may grow into; every part must be in ``counts``."""
    cuts, bounds = [], []
    for k in range(1, size):
        for name, at, width in ((f"l{k}", 0, k), (f"r{k}", k, size - k)):
            part = counts[width].select("lang", F.col("phrase").alias(f"p_{name}"), F.col("a").alias(name))
            phrases = phrases.withColumn(f"p_{name}", _part(at, width)).join(part, ["lang", f"p_{name}"]).drop(f"p_{name}")
        cuts.append(F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        bounds.append(_score(F.col("a"), F.col(f"l{k}"), F.col("a")))
    lowest = F.array_min(F.array(*cuts))
    return phrases.withColumn("_cut", lowest).select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"), F.array_min(F.array(*bounds)).alias("bound"))


def _uncovered(phrases: DataFrame, size: int, longer: DataFrame, cover: int) -> DataFrame:
    """Those that no phrase one word longer covers. If a longer one does, so does the phrase between: it occurs as often or more."""
    inside = [longer.select("lang", _part(i, size).alias("phrase"), F.col("a").alias("_by")) for i in (0, 1)]
    most = inside[0].union(inside[1]).groupBy("lang", "phrase").agg(F.max("_by").alias("_by"))
    covered = F.col("_by").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * cover
    return phrases.join(most, ["lang", "phrase"], "left").filter(F.coalesce(~covered, F.lit(True))).drop("_by")


def _round(docs: DataFrame, counts: dict[int, DataFrame], pairs: DataFrame, frequent: Sieve, bars: DataFrame, least: int, cover: int, label: str) -> DataFrame:
    """All surviving phrases of the languages in ``bars`` that score at or above their bar."""
    langs_open = sieve(bars.select("lang", F.lit("").alias("phrase")))
    grown = lambda found: found.join(bars, "lang").filter(F.col("bound") >= F.col("bar"))
    high = lambda found: found.join(bars, "lang").filter(F.col("score") >= F.col("bar")).drop("bar", "bound")

    def all_pairs(some: Slice, at: np.ndarray, n: int) -> np.ndarray:
        return np.logical_and.reduce([frequent.has(some.hash_at(at + j, 2)) for j in range(n - 1)])

    # Trigrams: what the prefixes grow into, and whatever could cover a pair that scores high.
    grow2, high2 = sieve(grown(pairs)), sieve(high(pairs))

    def three(some: Slice, at: np.ndarray) -> np.ndarray:
        return all_pairs(some, at, 3) & (grow2.has(some.hash_at(at, 2)) | high2.has(some.hash_at(at + 1, 2)))

    triples = saved(_counted(docs, 3, three, langs_open).filter(F.col("a") >= least), f"{label}-3")
    scored3 = saved(_scored(triples, 3, counts), f"{label}-3s")
    grow3, high3 = sieve(grown(scored3)), sieve(high(scored3))

    def four(some: Slice, at: np.ndarray) -> np.ndarray:
        return all_pairs(some, at, 4) & (grow3.has(some.hash_at(at, 3)) | high3.has(some.hash_at(at + 1, 3)))

    fours = saved(_counted(docs, 4, four, langs_open).filter(F.col("a") >= least), f"{label}-4")
    # A four-word phrase's rest of three words need not have been grown itself: such rests are counted now.
    starts = grown(scored3).select("lang", F.col("phrase").alias("_start"))
    begun = saved(fours.withColumn("_start", _part(0, 3)).join(starts, ["lang", "_start"], "left_semi").drop("_start"), f"{label}-4b")
    rests = saved(begun.select("lang", _part(1, 3).alias("phrase")).distinct().join(triples, ["lang", "phrase"], "left_anti"), f"{label}-rests")
    known = triples
    if not rests.isEmpty():
        rest = sieve(rests)

        def three_more(some: Slice, at: np.ndarray) -> np.ndarray:
            return rest.has(some.hash_at(at, 3))

        more = _counted(docs, 3, three_more, langs_open).join(triples, ["lang", "phrase"], "left_anti")
        known = saved(triples.unionByName(more), f"{label}-3a")
    scored4 = _scored(begun, 4, {**counts, 3: known})
    survive = [_uncovered(high(pairs), 2, triples, cover), _uncovered(high(scored3), 3, fours, cover), high(scored4)]
    return saved(survive[0].unionByName(survive[1]).unionByName(survive[2]), f"{label}-kept")


def _bars(pairs: DataFrame, langs: DataFrame, rank: int) -> DataFrame:
    """Per language the bound of the prefix at that rank, 0 where there are no more prefixes: then everything is grown."""
    higher = Window.partitionBy("lang").orderBy(F.desc("bound"))  # a row per value of the bound, 1,000,001 a language at most
    sizes = pairs.groupBy("lang", "bound").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.sum("_n").over(higher))
    found = sizes.filter(F.col("_n") >= rank).groupBy("lang").agg(F.max("bound").alias("bound"))
    return langs.join(found, "lang", "left").select("lang", F.coalesce("bound", F.lit(0)).alias("bar"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST, cover: int = COVER, first: int = FIRST) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's best phrases of two to four words.

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line breaks and pieces into words at blanks and tabs. A
    phrase must occur ``least`` times within pieces, overlaps included; one that lies inside a longer such phrase with at
    least ``cover`` percent of its count is dropped. Order: score, then count, both falling, then the phrase by its bytes;
    ``top`` at most. A null language is ``und``, a null text is empty; repeated rows count each; a language without phrases
    has no row, and an empty table gives none. Other columns are not read.
    """
    docs = pick(docs, lang=lang, text=text).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # Words: every one-word prefix.
    def every_word(some: Slice) -> tuple:
        count = np.bincount(some.ids, minlength=len(some.words))[1:]
        held = np.flatnonzero(count)
        return some.words.take(pa.array(held + 1)), count[held]

    words = saved(_scan(docs, 1, "lang string, phrase string, n long", every_word).groupBy("lang", "phrase").agg(F.sum("n").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    counts = {1: saved(words.filter(F.col("a") >= least), "words-frequent")}
    often = sieve(counts[1])

    def both_often(some: Slice, at: np.ndarray) -> np.ndarray:
        known = often.has(some.hashes)[some.ids]
        return known[at] & known[at + 1]

    # Pairs grow from all one-word prefixes. First their hashes are counted, which can only be too many; then the few left, exactly.
    def hashed(some: Slice) -> tuple:
        at = some.runs(2)
        key, count = np.unique(some.hash_at(at[both_often(some, at)], 2), return_counts=True)
        return key.view(np.int64), count

    keys = _scan(docs, 2, "key long, n long", hashed).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    likely = sieve(saved(keys.select("key"), "pairs-hashed"))

    def likely_pair(some: Slice, at: np.ndarray) -> np.ndarray:
        return likely.has(some.hash_at(at, 2))

    counts[2] = saved(_counted(docs, 2, likely_pair).filter(F.col("a") >= least), "pairs-counted")
    pairs = saved(_scored(counts[2], 2, counts), "pairs")
    frequent = sieve(pairs)
    open_langs, rank, done = pairs.select("lang").distinct(), first * top, None
    turn = 0
    while True:
        turn += 1
        bars = saved(_bars(pairs, open_langs, rank), f"bars-{turn}")
        found = _round(docs, counts, pairs, frequent, bars, least, cover, f"phrases-{turn}")
        held = found.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
        settled = bars.join(held, "lang", "left").filter((F.col("bar") == 0) | (F.coalesce("_n", F.lit(0)) >= top))
        ours = found.join(settled.select("lang"), "lang", "left_semi")
        done = ours if done is None else done.unionByName(ours)
        open_langs = bars.select("lang").join(settled.select("lang"), "lang", "left_anti")
        if open_langs.isEmpty():
            break
        open_langs, rank = saved(open_langs, f"open-{turn}"), rank * STEP
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = done.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
