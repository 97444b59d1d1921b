"""Secrets in text: fixed patterns, and a linear-chain conditional random field that finds what they miss.

The field tags every token of a line as begin (B), inside (I) or outside (O) of a secret. A token's features are its shape,
the hashed words around it and figures of the whole file; transitions link neighbouring tags, and Viterbi finds the best tags.
It is trained here on a bounded sample of texts whose secrets the fixed patterns mark, so it learns what such values and
their surroundings look like and finds values behind other names or in other places.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import chunks, mixed, pick, saved, strings

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "api")
O, B, I = 0, 1, 2
NEVER = -1e4
WORD_CELLS = 4_096
SHAPES = 9 * 16 * 4
LOOKS = 16 * 4  # a shape without its length
WORDS_AT = (0, -1, -2, -3, 1)
SHAPES_AT = (0, -1, 1)
FILE_CELLS = 16
N_FEATURES = len(WORDS_AT) * (WORD_CELLS + 1) + len(SHAPES_AT) * (SHAPES + 1) + LOOKS + 1 + FILE_CELLS
MUTE = N_FEATURES  # a cell without weight
WIDTH = len(WORDS_AT) + len(SHAPES_AT) + 2


@dataclass(frozen=True)
class Settings:
    """``train_texts`` bounds the sampled texts, ``train_lines`` the lines with and without a secret that are learned from."""

    train_texts: int = 20_000
    train_lines: int = 2_000
    around: int = 30
    rounds: int = 40
    ridge: float = 1e-5


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.float32))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]  # a run is whole or fails as a whole
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def values(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The secret itself in each span: behind a name, the value."""
    return [ASSIGN.match(text, s).span(2) if kind == "assign" else (s, e) for kind, s, e in spans]


_CLASS = np.full(256, 5, np.uint8)  # 0 space, 1 digit, 2 upper, 3 lower, 4 sign inside words, 5 sign of its own
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 3
_CLASS[[ord(c) for c in "+/_.-"]] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x100000001B3)
_LENGTHS = np.array([2, 3, 4, 6, 9, 13, 20, 32])


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    line: np.ndarray
    cells: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of a run of texts with their lines and feature cells, all as arrays."""
    n_rows = len(offsets) - 1
    kind = _CLASS[data]
    held = np.flatnonzero(kind)
    empty = np.zeros(0, np.int64)
    if not len(held):
        return Tokens(empty, empty, empty, empty, np.zeros((0, WIDTH), np.int64))
    k = kind[held]
    row = np.repeat(np.arange(n_rows), np.diff(offsets))[held]
    new = np.ones(len(held), bool)
    new[1:] = (held[1:] != held[:-1] + 1) | (k[1:] == 5) | (k[:-1] == 5) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(held)))
    start, end, trow = held[begin], held[begin] + size, row[begin]
    breaks = np.cumsum(data == 10)
    line = breaks[start] + trow  # rows are cut apart as lines are
    counts = [np.add.reduceat((k == c).astype(np.int32), begin) for c in (1, 2, 3, 4)]
    turns = np.zeros(len(held), np.int32)
    turns[1:] = (k[1:] != k[:-1]) & ~new[1:]
    turned = np.searchsorted([1, 2, 4], np.add.reduceat(turns, begin), side="right")
    shape = np.searchsorted(_LENGTHS, size, side="right")
    for c in counts:
        shape = shape * 2 + (c > 0)
    shape = shape * 4 + turned
    rel = np.arange(len(held)) - np.repeat(begin, size)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _MULT, np.uint64)]))
    word = (mixed(np.add.reduceat((_LOWER[data[held]].astype(np.uint64) + np.uint64(1)) * power[rel], begin)) % np.uint64(WORD_CELLS)).astype(np.int64)
    # Figures of the file: share of digits and of signs among its characters.
    long = np.maximum(np.diff(offsets), 1)
    digits = np.bincount(row, k == 1, n_rows) / long
    signs = np.bincount(row, k >= 4, n_rows) / long
    file = np.searchsorted([0.01, 0.05, 0.2], digits, side="right") * 4 + np.searchsorted([0.02, 0.06, 0.15], signs, side="right")
    n = len(start)
    cells = np.empty((n, WIDTH), np.int64)
    base, column = 0, 0
    for part, size_, places in ((word, WORD_CELLS, WORDS_AT), (shape, SHAPES, SHAPES_AT), (shape % LOOKS, LOOKS, (0,))):
        for d in places:
            at = np.arange(n) + d
            ok = (at >= 0) & (at < n)
            at = np.where(ok, at, 0)
            ok &= line[at] == line
            cells[:, column] = base + np.where(ok, part[at], size_)
            base, column = base + size_ + 1, column + 1
    cells[:, column] = base + file[trow]
    return Tokens(start, end, trow, line, cells)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _allowed(steps: np.ndarray) -> np.ndarray:
    steps = steps.copy()
    steps[O, I] = NEVER
    return steps


def train(lines: list[tuple[np.ndarray, np.ndarray]], how: Settings) -> Model:
    """Conditional likelihood by AdaGrad; each line is (cells, tags), all lines step together.

    Each line is learned from twice, once with its words muted, so that a value's shape counts behind a name never seen.
    """
    def mute(cells: np.ndarray) -> np.ndarray:
        return np.where(np.arange(cells.shape[1]) < len(WORDS_AT), MUTE, cells)

    lines = sorted([*lines, *((mute(c), t) for c, t in lines)], key=lambda x: -len(x[1]))
    n, most, width = len(lines), len(lines[0][1]), lines[0][0].shape[1]
    size = np.array([len(t) for _, t in lines])
    cells, tags = np.zeros((n, most, width), np.int64), np.zeros((n, most), np.int64)
    for i, (c, t) in enumerate(lines):
        cells[i, : len(t)], tags[i, : len(t)] = c, t
    here = np.arange(most)[None] < size[:, None]
    flat = cells[here]
    w, steps = np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3))
    gw2, gs2 = np.full_like(w, 1e-6), np.full_like(steps, 1e-6)
    truth = np.eye(3)[tags]
    seen = np.zeros((3, 3))
    for t in range(1, most):
        m = here[:, t]
        np.add.at(seen, (tags[m, t - 1], tags[m, t]), 1)
    for _ in range(how.rounds):
        emit = np.zeros((n, most, 3))
        emit[here] = w[flat].sum(axis=1)
        emit[:, 0, I] += NEVER
        go = _allowed(steps)
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0]
        for t in range(1, most):
            to = _logsum(fwd[:, t - 1, :, None] + go[None], 1) + emit[:, t]
            fwd[:, t] = np.where(here[:, t, None], to, fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            back = _logsum(go[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(here[:, t + 1, None], back, 0)
        z = _logsum(fwd[:, -1], 1)
        p = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0))
        wrong = (p - truth)[here]
        gw = np.stack([np.bincount(flat.ravel(), np.repeat(wrong[:, c], width), N_FEATURES + 1) for c in range(3)], axis=1) / n + how.ridge * w
        expected = np.zeros((3, 3))
        for t in range(1, most):
            m = here[:, t]
            pair = fwd[m, t - 1, :, None] + go[None] + (emit[m, t] + bwd[m, t])[:, None, :] - z[m, None, None]
            expected += np.exp(np.minimum(pair, 0)).sum(axis=0)
        gs = (expected - seen) / n + 1e-2 * steps
        gw[MUTE] = 0
        gw2 += gw**2
        gs2 += gs**2
        w -= 0.5 * gw / np.sqrt(gw2)
        steps -= 0.2 * gs / np.sqrt(gs2)
    return Model(w.astype(np.float32), _allowed(steps))


def viterbi(emit: np.ndarray, line: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best tags of tokens in runs of equal ``line``; all runs step together, the longest first."""
    tags = np.zeros(len(line), np.int8)
    if not len(line):
        return tags
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(begin, len(line)))
    # If each token prefers O by more than any two steps can give back, the whole line is O.
    finite = steps[steps > NEVER / 2]
    least = 2 * (finite.max() - finite.min())
    open_ = np.logical_or.reduceat(emit[:, O] - np.maximum(emit[:, B], emit[:, I]) <= least, begin)
    begin, size = begin[open_], size[open_]
    if not len(begin):
        return tags
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lines longer than t
    best = emit[begin].astype(np.float64)
    best[:, I] += NEVER
    froms = []
    for t in range(1, size[0]):
        n = live[t]
        ways = best[:n, :, None] + steps[None]
        came = ways.argmax(axis=1).astype(np.int8)
        froms.append(came)
        best[:n] = np.take_along_axis(ways, came[:, None, :].astype(np.int64), 1)[:, 0] + emit[begin[:n] + t]
    tag = best.argmax(axis=1).astype(np.int8)
    tags[begin + size - 1] = tag
    for t in range(size[0] - 1, 0, -1):
        n = live[t]
        tag[:n] = froms[t - 1][np.arange(n), tag[:n]]
        tags[begin[:n] + t - 1] = tag[:n]
    return tags


def _marked(spans: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    tags = np.zeros(len(start), np.int64)
    for s, e in spans:
        inside = np.flatnonzero((start < e) & (end > s))
        tags[inside] = I
        tags[inside[:1]] = B
    return tags


def _bytes(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(len(text[:s].encode()), len(text[:e].encode())) for s, e in spans]


def _lessons(how: Settings):
    """Sampled texts to windows of tokens around each secret, and for some texts without one a window of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cells, marks = [], [], []
            for lo, hi, data, offsets in chunks(strings(batch, "text"), 1 << 18):
                tok = tokens(data, offsets)
                for i in range(hi - lo):
                    a, b = np.searchsorted(tok.row, [i, i + 1])
                    if a == b:
                        continue
                    text = bytes(data[offsets[i] : offsets[i + 1]]).decode()
                    spans = _bytes(text, values(text, base_spans(text)))
                    tags = _marked(spans, tok.start[a:b] - offsets[i], tok.end[a:b] - offsets[i])
                    centres = np.flatnonzero(tags == B)
                    for c in centres[:8] if len(centres) else [(b - a) // 2]:
                        same = np.flatnonzero(tok.line[a:b] == tok.line[a + c])
                        x, y = max(same[0], c - how.around), min(same[-1] + 1, c + how.around + 1)
                        found.append(bool(len(centres)))
                        cells.append(tok.cells[a + x : a + y].astype(np.int32).tobytes())
                        marks.append(tags[x:y].astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.bool_()), pa.array(cells, pa.binary()), pa.array(marks, pa.binary())], ["secret", "cells", "tags"])

    return run


def fit(docs: DataFrame, how: Settings = Settings(), id: str = "doc_id", text: str = "text") -> Model | None:
    """Train on a sample cut by a hash of the id; None if the sample holds no secret.

    About ``train_texts`` texts are read whole (all, if fewer); at most about ``train_lines`` windows with and as many without
    a secret, of at most 2 * ``around`` + 1 tokens, reach the driver.
    """
    texts = pick(docs, id=id, text=text).filter("text is not null and text <> ''")
    share = min(1.0, how.train_texts / max(1, docs.count()))
    sample = texts.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    windows = saved(sample.mapInArrow(_lessons(how), "secret boolean, cells binary, tags binary"), "secret-windows")
    counts = {r["secret"]: r["count"] for r in windows.groupBy("secret").count().collect()}
    if not counts.get(True):
        return None
    keep = F.pmod(F.xxhash64("cells"), F.lit(1_000_000)) < F.when(F.col("secret"), int(min(1, how.train_lines / counts[True]) * 1e6)).otherwise(int(min(1, how.train_lines / max(1, counts.get(False, 0))) * 1e6))
    rows = windows.filter(keep).collect() or windows.filter("secret").limit(how.train_lines).collect()
    lines = [(np.frombuffer(r["cells"], np.int32).reshape(-1, WIDTH), np.frombuffer(r["tags"], np.int8)) for r in rows]
    return train(lines, how)


def crf_spans(tok: Tokens, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes of each B and the Is that follow it."""
    b = np.flatnonzero(tags == B)
    stop = np.flatnonzero(np.append(tags != I, True))
    last = stop[np.searchsorted(stop, b + 1)] - 1
    return tok.row[b], tok.start[b], tok.end[last]


def _scan(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("id")), strings(batch, "text")
            for lo, hi, data, offsets in chunks(texts):
                spans = [base_spans(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                if model is not None:
                    tok = tokens(data, offsets)
                    emit = model.weights[tok.cells].sum(axis=1) if len(tok.row) else np.zeros((0, 3))
                    for r, s, e in zip(*(x.tolist() for x in crf_spans(tok, viterbi(emit, tok.line, model.steps)))):
                        raw = bytes(data[offsets[r] : offsets[r + 1]])
                        a, b = s - int(offsets[r]), e - int(offsets[r])
                        while b > a and raw[b - 1 : b] in (b".", b"-"):  # the end of a sentence
                            b -= 1
                        start = len(raw[:a].decode())
                        end = start + len(raw[a:b].decode())
                        if end > start and not any(x < end and start < y for _, x, y in spans[r]):
                            spans[r].append(("crf", start, end))
                every = [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in spans]
                told = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in every], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), told], ["id", "spans"])

    return run


def find_secrets(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``spans``, an array of (kind, start, end) by start, then kind; code points, ends exclusive.

    Every whole text is read; null and empty texts have no spans. Kinds ``assign``, ``access`` and ``hex`` are those of the
    fixed patterns, ``crf`` what the field finds besides and what no other span touches. Rows that repeat an id are rows of
    the result each; other columns are not read.
    """
    rows = pick(docs, id=id, text=text)
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_scan(model), f"id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    """Lowercase hex of SHA-256 over kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
