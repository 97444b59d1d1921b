"""Language identification by error-correcting output codes.

Every learned language gets a codeword of bits. For each bit a binary classifier over hashed byte n-grams of the letters
(1 to 3 bytes) says how strongly a text speaks for 1. Decoding takes the codeword with the least weighted loss over all
bits; a second codeword almost as near is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import chunks, mixed, pick, saved, strings

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: What that pattern leaves although it is no letter: fractions, Roman numerals, raised numbers.
_NUMERALS = {c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the sampled texts of one language and ``sample`` those of all (two of each language at least).

    A sampled text is 8 KB on the driver, so the usual sample is 100 MB. There may be any number of languages.
    """

    per_language: int = 1_500
    sample: int = 12_000
    features: int = 4_096
    rounds: int = 80
    ridge: float = 1e-4
    ambiguous: float = 0.2


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    codes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ambiguous: float = 0.2


def codebook(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +-1, one column a classifier: all splits up to 5 languages, else the best of some random books."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        splits = [[1 if (1 + 2 * s) >> i & 1 else -1 for i in range(n)] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, float).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, kept = -1.0, None
    for _ in range(50):
        book = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(book.sum(axis=0)) == n).any():
            continue
        far = ((bits - book @ book.T) / 2 + bits * np.eye(n)).min()
        if far > best:
            best, kept = far, book
    return kept


def letters(text: str) -> str:
    """The letters of a text in lower case, everything between them as one space."""
    low = text.lower()
    if not low.isascii():
        for c in _NUMERALS.intersection(low):
            low = low.replace(c, " ")
    return _NOT_LETTERS.sub(" ", low).strip()


_SALTS = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in (1, 2, 3)]


def shares(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, square roots of n-gram shares, n-grams a row); letters are lower-cased, words keep one space between them."""
    for lo in range(0, len(texts), 256):
        part = texts.slice(lo, 256).to_pylist()
        clean = pa.array([letters(t) for t in part], pa.large_string())
        for a, b, data, offsets in chunks(clean, 1 << 20):
            n, size = b - a, np.diff(offsets)
            # Spaces between texts: no n-gram joins two of them.
            padded = np.full(len(data) + 3 * n + 3, 32, np.uint64)
            row = np.repeat(np.arange(n), size)
            at = np.arange(len(data)) + 3 * row + 1
            padded[at] = data
            one = padded[at]
            two = one << np.uint64(8) | padded[at + 1]
            three = padded[at - 1] << np.uint64(16) | two
            counts = np.zeros(n * width)
            for salt, grams in zip(_SALTS, (one, two, three)):
                counts += np.bincount(row * width + (mixed(grams + salt) % np.uint64(width)).astype(np.int64), minlength=n * width)
            yield lo + a, np.sqrt(counts.reshape(n, width) / np.maximum(3 * size, 1)[:, None]).astype(np.float32), size


def _classifiers(x: np.ndarray, y: np.ndarray, weight: np.ndarray, how: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weighted logistic classifiers of all bits at once by accelerated gradient steps; y is rows x bits of +-1."""
    n, d = x.shape
    w, b = np.zeros((d, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    rate = np.float32(4.0 / max(1.0, float(weight.max())))  # rows have unit length: each loss is 1/4-smooth
    for t in range(1, how.rounds + 1):
        g = -weight * y / (1 + np.exp(np.clip(y * (x @ vw + vb), -30, 30)))
        w2, b2 = vw - rate * (x.T @ g / n + how.ridge * vw), vb - rate * g.mean(axis=0) / 2
        vw, vb = w2 + (t - 1) / (t + 2) * (w2 - w), b2 + (t - 1) / (t + 2) * (b2 - b)
        w, b = w2, b2
    return w, b


def fit(docs: DataFrame, learn: Callable[[Column], Column] | None = None, how: Settings = Settings(), id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows with a text and a language whose id passes ``learn``.

    Of each language about ``per_language`` rows are taken by a hash of the id (all, if fewer), fewer where there are so many
    languages that ``sample`` would be passed; whole texts are read. Languages weigh the same however many rows they have.
    Four fifths of the sample train the classifiers; how far each of them is trusted is measured on the rest. Without such
    rows there are no languages and every prediction is ``und``.
    """
    rows = pick(docs, id=id, text=text, lang=lang).filter("text is not null and lang is not null and id is not null")
    rows = rows.filter(learn(F.col("id"))) if learn else rows
    counts = saved(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    found = counts.orderBy("lang").collect()
    model = Model([r["lang"] for r in found], codebook(len(found)), ambiguous=how.ambiguous)
    if len(found) < 2:
        return model
    each = min(how.per_language, max(2, how.sample // len(found)))
    place = (F.xxhash64("id").cast("double") + 2.0**63) / 2.0**64
    kept = rows.join(counts, "lang").filter(place < F.lit(float(each)) / F.col("n"))
    grams = kept.select("lang", "text").mapInArrow(_sample(how.features), "lang string, grams binary")
    sample = saved(grams, "language-sample").collect()
    x = np.stack([np.frombuffer(r["grams"], np.float16) for r in sample]).astype(np.float32) if sample else np.zeros((0, how.features), np.float32)
    order = {k: i for i, k in enumerate(model.languages)}
    of = np.array([order[r["lang"]] for r in sample], int)
    del sample
    y = model.codes[of].astype(np.float32)
    weight = (len(of) / len(order) / np.bincount(of, minlength=len(order))[of]).astype(np.float32)[:, None]
    aside = np.arange(len(x)) % 5 == 4
    learned = ~aside
    model.weights, model.bias = _classifiers(x[learned], y[learned], weight[learned], how)
    if not aside.any():
        aside = learned
    margins = x[aside] @ model.weights + model.bias
    right = ((margins * y[aside] > 0) * weight[aside]).sum(axis=0) / weight[aside].sum()
    # A classifier's weight in decoding is the log odds of its being right.
    model.trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    return model


def _sample(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for lo in range(0, batch.num_rows, 256):
                for first, x, size in shares(strings(batch, "text").slice(lo, 256), width):
                    rows = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
                    yield pa.RecordBatch.from_arrays([langs.slice(lo + first, len(size)), rows], ["lang", "grams"])

    return run


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) of each row of bit margins by the least weighted logistic loss.

    Equal losses go to the language whose name comes first, and are ambiguous.
    """
    loss = np.logaddexp(0, -margins[:, None, :] * model.codes[None]) @ model.trust
    order = np.sort(loss, axis=1)
    p = np.exp(-(loss - order[:, :1]))
    p /= p.sum(axis=1, keepdims=True)
    return loss.argmin(axis=1), p.max(axis=1), order[:, 1] - order[:, 0] < model.ambiguous * model.trust.sum()


def _predict(model: Model, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("id")), strings(batch, "text")
            for first, x, size in shares(texts, width):
                n = len(size)
                part = ids.slice(first, n)
                langs, score, doubt = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                if len(model.languages) == 1:
                    which, best, unsure = np.zeros(n, int), np.ones(n), np.zeros(n, bool)
                elif model.languages:
                    which, best, unsure = decode(x @ model.weights + model.bias, model)
                for i in np.flatnonzero(size) if model.languages else ():
                    langs[i], score[i], doubt[i] = model.languages[which[i]], best[i], unsure[i]
                yield pa.RecordBatch.from_arrays([part, pa.array(langs, pa.string()), pa.array(score), pa.array(doubt)], ["id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", how: Settings = Settings()) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` of every row's whole text.

    A text that is null or has no letter is ``und`` with score 0 and ambiguous. Rows that repeat an id are rows of the result
    each; a null id stays null. Other columns are not read.
    """
    rows = pick(docs, id=id, text=text)
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_predict(model, how.features), f"id {kind}, lang_pred string, score double, ambiguous boolean")
