"""Toxicity: a lexicon trie met with Levenshtein automata, and windows around the hits that tell quotation from abuse.

The lexicon is learned: words and word beginnings (stems) that lean to the toxic class, from a bounded, documented sample
of labelled rows. Words of a text run through one lazily built automaton, the meeting of the trie with the Levenshtein
automaton of each term (0 edits below 5 letters, 1 below 9, else 2), so a misspelled term costs a few dictionary steps.
Each hit is weighed by its window: quotation marks around it and words of reporting nearby count against abuse. A logistic
model over a handful of figures per text gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import pick, saved, spare, text_shingles

WORD = re.compile(r"\w+")
QUOTED = re.compile(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|„[^“”\n]{1,80}[“”]|«[^»\n]{1,80}»")
MARKS = "\"“”„«»‘’'"
REPORTING = frozenset("said says say quoted quote quotes wrote writes called calls word term meaning reported dijo dice palabra sagte sagt wort dit disait mot".split())
FIGURES = 8
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled sample, ``max_terms`` the lexicon; ``window`` is in words on either side."""

    train_rows: int = 20_000
    max_terms: int = 5_000
    window: int = 6
    min_lean: float = 2.5
    min_z: float = 3.0
    min_texts: int = 3


@dataclass
class Model:
    terms: list[tuple[str, float]] = field(default_factory=list)
    stems: list[tuple[str, float]] = field(default_factory=list)
    harmless: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FIGURES))
    window: int = 6


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The lexicon trie met with the Levenshtein automata of its terms; states are built when a word first needs them."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int] | None] = [None]
        self.reach = [0]
        self.stem: list[int | None] = [None]
        for i, term in enumerate(terms):
            self.ends[self._path(term, edits(term))] = (i, edits(term))
        for i, stem in enumerate(stems):
            self.stem[self._path(stem, 0)] = len(terms) + i
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.hits: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0}, None)

    def _path(self, word: str, most: int) -> int:
        node = 0
        self.reach[0] = max(self.reach[0], most)
        for c in word:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.ends.append(None)
                self.reach.append(0)
                self.stem.append(None)
            node = self.next[node][c]
            self.reach[node] = max(self.reach[node], most)
        return node

    def _state(self, least: dict[int, int], stem: int | None) -> int:
        todo = list(least)
        while todo:  # skipped letters of the term
            node = todo.pop()
            e = least[node] + 1
            for child in self.next[node].values():
                if e <= self.reach[child] and e < least.get(child, 99):
                    least[child] = e
                    todo.append(child)
        for node, e in least.items():
            if e == 0 and stem is None:
                stem = self.stem[node]
        key = (stem, *sorted(least.items()))
        if len(key) == 1 and stem is None:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append((least, stem))
            self.steps.append({})
            found = [(e, self.ends[n][0]) for n, e in least.items() if self.ends[n] and e <= self.ends[n][1]]
            if stem is not None:
                found.append((0, stem))
            self.hits.append(min(found) if found else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        least, stem = self.sets[state]
        out: dict[int, int] = {}
        for node, e in least.items():
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.reach[child] and cost < out.get(child, 99):
                    out[child] = cost
            if e + 1 <= self.reach[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
        self.steps[state][c] = to = self._state(out, stem)
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry, or None."""
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        return self.hits[state]


class Reader:
    """Texts to figures, with one automaton and one word cache for each task."""

    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton([t for t, _ in model.terms], [t for t, _ in model.stems])
        self.weight = [w for _, w in (*model.terms, *model.stems)]
        self.cache: dict[str, tuple[int, int] | None] = {w: None for w in model.harmless}

    def look(self, word: str) -> tuple[int, int] | None:
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {w: None for w in self.model.harmless}
        self.cache[word] = hit = self.automaton.find(word)
        return hit

    def figures(self, text: str) -> np.ndarray:
        """bias, largest weight, sum of weights, entries, quoted, misspelled, share of words, all hits."""
        out = np.zeros(FIGURES)
        out[0] = 1
        low = text.lower()
        words = WORD.findall(low)
        if not any(self.look(w) for w in set(words)):
            return out
        spots = [m.span() for m in WORD.finditer(low)]
        free, quoted, wrong, seen = [], 0.0, 0, set()
        for i, w in enumerate(words):
            hit = self.look(w)
            if hit:
                q = self.quoted(low, words, spots, i)
                seen.add(hit[1])
                wrong += hit[0] > 0
                quoted += q
                free.append(self.weight[hit[1]] * (1 - q) / (1 + hit[0]))
        out[1:] = max(free), np.log1p(sum(free)), np.log1p(len(seen)), np.log1p(quoted), np.log1p(wrong), min(1, 10 * len(free) / len(words)), np.log1p(len(free))
        return out

    def quoted(self, text: str, words: list[str], spots: list[tuple[int, int]], i: int) -> float:
        """0 to 1: how far the window of a hit looks like quotation."""
        k = self.model.window
        before = text[spots[max(0, i - k)][0] : spots[i][0]]
        after = text[spots[i][1] : spots[min(len(words) - 1, i + k)][1] + 1]
        marks = any(m in MARKS for m in before) and any(m in MARKS for m in after)
        near = any(w in REPORTING for w in words[max(0, i - k) : i] + words[i + 1 : i + 1 + k // 2])
        return 0.9 if marks and near else 0.6 if marks else 0.3 if near else 0.0

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.figures(text) @ self.model.weights, -30, 30))))


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each batch, in how many toxic and other texts a word (w) or beginning (4 to 6 letters) stands outside quotation marks."""
    for batch in batches:
        counts = {True: Counter(), False: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = set(WORD.findall(QUOTED.sub(" ", (text or "").lower())))
            counts[toxic == 1].update(("w", w) for w in words if 3 <= len(w) <= 40)
            counts[toxic == 1].update({(str(n), w[:n]) for w in words for n in (4, 5, 6) if len(w) > n})
        keys = list(counts[True].keys() | counts[False].keys())
        yield pd.DataFrame({"kind": [k for k, _ in keys], "word": [w for _, w in keys], "pos": [counts[True][k] for k in keys], "neg": [counts[False][k] for k in keys]})


def _least_shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        first = [s[0] if len(s) else np.uint64(0) for s in (text_shingles(t, 3) for t in batch["text"])]
        yield batch.assign(least=np.array(first, np.uint64).view(np.int64))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the ridge-penalized logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column] | None = None, how: Settings = Settings(), id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from labelled rows whose id passes ``learn``.

    Rows with a null id, text or label teach nothing; of several labels of one id the largest counts, and of near copies in the
    sample one. The sample is cut by a hash of the id to about ``train_rows``; only counts of leaning words (at most
    ``max_terms``) and ``FIGURES`` numbers a sampled text reach the driver. Without rows of both classes nothing is a hit.
    """
    marks = pick(labels, id=id, toxic=label).filter("id is not null and toxic is not null")
    marks = marks.filter(learn(F.col("id"))) if learn else marks
    marks = marks.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = marks.count()
    share = min(1.0, how.train_rows / max(1, total))
    marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = pick(docs, id=id, text=text).filter("text is not null")
    sample = texts.join(marks, "id").select("text", "toxic").mapInPandas(_least_shingle, "text string, toxic int, least long")
    sample = saved(sample.groupBy("least", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-sample")
    sides = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sides.get(1, 0), sides.get(0, 0)
    model = Model(window=how.window)
    if not pos or not neg:
        model.weights[0] = 30.0 if pos else -30.0
        return model
    counts = sample.mapInPandas(_word_counts, "kind string, word string, pos long, neg long").groupBy("kind", "word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lean = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    counts = saved(counts.filter("pos > 0").withColumn("lean", lean).withColumn("z", lean / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))), "toxic-counts")
    strong = counts.filter((F.col("lean") >= how.min_lean) & (F.col("z") >= how.min_z) & (F.col("pos") >= max(how.min_texts, pos // 500)))
    rows = strong.orderBy(F.desc("z"), "kind", "word").limit(how.max_terms).collect()
    words = {r["word"]: r for r in rows if r["kind"] == "w"}
    stems: dict[str, float] = {}
    for r in sorted((r for r in rows if r["kind"] != "w"), key=lambda r: len(r["word"])):
        under = [w for w in words if w.startswith(r["word"])]
        best = max((words[w]["pos"] for w in under), default=0)
        if not any(r["word"].startswith(s) for s in stems) and r["pos"] >= 1.5 * best and r["pos"] >= 2 * how.min_texts:
            stems[r["word"]] = float(r["lean"])
    model.stems = sorted(stems.items())
    model.terms = sorted((w, float(r["lean"])) for w, r in words.items() if not any(w.startswith(s) for s in stems))
    # Words close to a term that the sample knows as harmless are no misspellings of it.
    known = {t for t, _ in model.terms}
    automaton = Automaton(sorted(known), list(stems))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[automaton.find(w) is not None for w in batch["word"]]]

    mild = counts.filter((F.col("kind") == "w") & (F.col("lean") < 0.5)).select("word")
    near = saved(mild.union(_only_clean(sample)).distinct().mapInPandas(close, "word string"), "toxic-near")
    model.harmless = frozenset(r["word"] for r in near.collect() if r["word"] not in known and not any(r["word"].startswith(s) for s in stems))
    seen = sample.mapInPandas(_figures(model), "toxic int, figures array<double>").collect()
    model.weights = _logistic(np.array([r["figures"] for r in seen]), np.array([r["toxic"] == 1 for r in seen], float))
    return model


def _only_clean(sample: DataFrame) -> DataFrame:
    """Words of two or more texts, none of them toxic."""
    counts = sample.mapInPandas(_word_counts, "kind string, word string, pos long, neg long").filter("kind = 'w'")
    return counts.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos = 0 and neg > 1").select("word")


def _figures(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "figures": [reader.figures(t or "") for t in batch["text"]]})

    return run


def _scores(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model)
        for texts in batches:
            yield pd.Series([reader.score(t or "") for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text. Null reads as empty; a text without a hit gets the base score."""
    return docs.withColumn(out, _scores(model)(F.col(text)))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows below the threshold, with the columns they came with."""
    name = spare(docs, "_toxic_score")
    return score(docs, model, text, name).filter(F.col(name) < threshold).drop(name)
