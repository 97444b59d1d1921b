"""Quality rules as a short-circuit cascade: the rule that rejects most per unit of cost comes first, and the first rejection ends it.

Rules read measures of a text (counts of words, symbols, repeated lines and windows). On a sample every measure is timed and
every rule tried; the order is built greedily: the next rule is the one that rejects most of the texts still alive for each
second that its measures cost, where measures taken for an earlier rule are free. Whether a text is kept does not depend on
the order, so neither timing nor the sample can change the result, only the work.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from time import perf_counter_ns

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import pick, strings

WINDOW = 8
SAMPLE = 2_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = " \t\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_BULLETS = ("-", "*", "•")


def windows_found_twice(words: list[str], size: int = WINDOW) -> int:
    """How many words lie in a window of ``size`` words (a power of two) that the text holds twice or more, the first one included."""
    n = len(words)
    if n <= size:
        return 0
    numbers: dict[str, int] = {}
    runs = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    held = 1
    while held < size:  # runs of 2, 4, 8 words as exact numbers
        m = len(runs) - held
        runs = np.unique(runs[:m] * (int(runs.max()) + 1) + runs[held:], return_inverse=True)[1]
        held *= 2
    twice = np.bincount(runs)[runs] > 1
    if not twice.any():
        return 0
    total = np.concatenate([[0], np.cumsum(twice)])
    at = np.arange(n)
    return int((total[np.minimum(at, len(twice) - 1) + 1] > total[np.maximum(at - size + 1, 0)]).sum())


class Text:
    """The measures of one text, each taken once and only when something asks for it."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(_BLANK)]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_repeat_words(self) -> int:
        return windows_found_twice(self.words)

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for w in self.words if w[0].isalpha() or any(map(str.isalpha, w)))

    @cached_property
    def n_stutters(self) -> int:
        return sum(map(str.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_cut_lines(self) -> int:
        return sum(1 for line in self.lines if line.rstrip(_BLANK).endswith(("...", "…")))

    @cached_property
    def n_bullet_lines(self) -> int:
        return sum(1 for line in self.lines if line.lstrip(_BLANK).startswith(_BULLETS))


#: Measures in an order in which each comes after those that it reads, so that its own cost can be timed.
MEASURES = {
    "words": (), "lines": (), "n_words": ("words",), "word_chars": (), "n_symbols": (), "n_lines": ("lines",), "n_dup_lines": ("lines",), "n_repeat_words": ("words",),
    "n_letter_words": ("words",), "n_stutters": ("words",), "n_top_word": ("words",), "n_cut_lines": ("lines",), "n_bullet_lines": ("lines",),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A text goes if ``rejects``; ``reads`` names the measures that it looks at."""

    name: str
    reads: tuple[str, ...]
    rejects: Callable[[Text], bool]


#: The first two are the base that always holds; the others look for boilerplate, mark-up, numbers and stutter.
RULES = (
    Rule("few_words", ("n_words",), lambda t: t.n_words < 20),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
    Rule("symbols", ("n_words", "n_symbols"), lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", ("n_words", "word_chars"), lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("letters", ("n_words", "n_letter_words"), lambda t: 10 * t.n_letter_words < 7 * t.n_words),
    Rule("stutter", ("n_words", "n_stutters"), lambda t: 100 * t.n_stutters > 25 * t.n_words),
    Rule("top_word", ("n_words", "n_top_word"), lambda t: 100 * t.n_top_word > 35 * t.n_words),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda t: 100 * t.n_dup_lines > 50 * t.n_lines),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda t: 100 * t.n_cut_lines > 50 * t.n_lines),
    Rule("bullet_lines", ("n_lines", "n_bullet_lines"), lambda t: 100 * t.n_bullet_lines > 90 * t.n_lines),
)


def _needs(rule: Rule) -> list[str]:
    """All measures that a rule takes, those that others read first."""
    wanted = set(rule.reads)
    wanted |= {below for name in rule.reads for below in MEASURES[name]}
    return [name for name in MEASURES if name in wanted]


def trial(docs: DataFrame, rules: tuple[Rule, ...], sample: int, id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(texts x rules) rejections and (texts x measures) nanoseconds on about ``sample`` texts, chosen by a hash of id and text."""
    rows = pick(docs, id=id, text=text).select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("id", "text").alias("h"))
    total = rows.count()
    if total > sample:
        rows = rows.filter(F.col("h") < int(-(2**63) + 2**64 * (sample / total)))
    names = list(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, out = [], []
            for one in strings(batch, "text"):
                t = Text(one.as_py())
                spent = []
                for name in names:
                    begun = perf_counter_ns()
                    getattr(t, name)
                    spent.append(perf_counter_ns() - begun)
                costs.append(spent)
                out.append([rule.rejects(t) for rule in rules])
            yield pa.RecordBatch.from_arrays([pa.array(costs, pa.list_(pa.int64())), pa.array(out, pa.list_(pa.bool_()))], ["cost", "rejected"])

    got = rows.select("text").mapInArrow(run, "cost array<long>, rejected array<boolean>").collect()  # a few numbers a sampled text
    return np.array([r["rejected"] for r in got], bool).reshape(-1, len(rules)), np.array([r["cost"] for r in got], np.int64).reshape(-1, len(names))


def ordered(rules: tuple[Rule, ...], rejected: np.ndarray, cost: np.ndarray) -> list[Rule]:
    """Rules by rejections per cost among the texts that the rules before them leave; measures already taken cost nothing.

    Rules that reject nobody in the sample come last, the cheapest first; equal rules stay in the order given.
    """
    names = list(MEASURES)
    alive, taken, left, out = np.ones(len(rejected), bool), set(), list(range(len(rules))), []
    while left:
        def gain(i):
            missing = [names.index(m) for m in _needs(rules[i]) if m not in taken]
            paid = 1 + int(cost[alive][:, missing].sum())
            return (int(rejected[alive, i].sum()) / paid, -paid)

        best = max(left, key=lambda i: (*gain(i), -i))
        left.remove(best)
        out.append(rules[best])
        taken |= set(_needs(rules[best]))
        alive &= ~rejected[:, best]
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, id: str = "doc_id", text: str = "text") -> list[Rule]:
    """The order in which ``screen`` runs the rules over a table, from a sample of about ``sample`` of its texts."""
    return ordered(rules, *trial(docs, rules, sample, id, text))


def screen(docs: DataFrame, order: list[Rule], measures: tuple[str, ...] = (), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, the asked ``measures`` (long), ``kept``, ``rejected_by`` (null if kept) and ``n_rules`` (how many were run) of every row.

    A text is kept if no rule rejects it; rules after the first rejection are not run, nor are measures taken that nothing
    asked for. Whole texts are read. A null text counts as empty, repeated rows have a row each, a null id stays null; other
    columns are not read.
    """
    rows = pick(docs, id=id, text=text)
    names = ["id", *measures, "kept", "rejected_by", "n_rules"]
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{m} long" for m in measures], "kept boolean, rejected_by string, n_rules int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, verdicts, steps = [[] for _ in measures], [], []
            for one in strings(batch, "text"):
                t = Text(one.as_py())
                at = next((i for i, rule in enumerate(order) if rule.rejects(t)), None)
                verdicts.append(None if at is None else order[at].name)
                steps.append(len(order) if at is None else at + 1)
                for column, name in zip(taken, measures):
                    column.append(getattr(t, name))
            by = pa.array(verdicts, pa.string())
            ids = batch.column(batch.schema.get_field_index("id"))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in taken], by.is_null(), by, pa.array(steps, pa.int32())], names)

    return rows.mapInArrow(run, schema)


def drop_low_quality(docs: DataFrame, order: list[Rule] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no rule rejects, with all their columns."""
    order = plan(docs, id=id, text=text) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [not any(rule.rejects(t) for rule in order) for t in (Text(one.as_py()) for one in strings(batch, text))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
