"""Licence scan: sparse TF-IDF cosine to templates, then the nearest licensed ancestor directory.

Lines, paragraphs and the whole of every text are compared with short notices and licence texts. A file with a notice of its
own has that licence. A licence file (by name, or because the whole of it is a licence) speaks for its directory; every other
file takes the licence of its nearest ancestor directory that has one, found by joins on paths, not by walking them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabella.llm.common import pick, saved

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENCE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice(\.|$)"
#: The most common first.
COMMON = "the of and to in a is that for it with as was be by on are at from or this an have not will all if any under its you may can file has no out see use work your".split()

#: Short notices and openings of licence texts, by SPDX name.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["Copyright. All rights reserved."],
}


@dataclass(frozen=True)
class Settings:
    """Least cosine of a notice, and of a whole text that is a licence file."""

    notice: float = 0.6
    whole: float = 0.85


class Matcher:
    """Templates as sparse TF-IDF vectors; words of no template count in a text's length with the weight of an unseen word."""

    def __init__(self, templates: Mapping[str, Sequence[str]], least: float):
        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        bags = [Counter(WORD.findall(templates[name][i].lower())) for name, i in self.names]
        seen = Counter(w for bag in bags for w in bag)
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in seen.items()}
        self.unseen = math.log(1 + len(bags)) + 1
        self.lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        room, held = [], [defaultdict(float) for _ in bags]
        for t, bag in enumerate(bags):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in bag.items()))
            room.append(least**2)
            for w, n in bag.items():
                held[t][w] = (n * self.idf[w] / norm) ** 2
                self.lists[w].append((t, n * self.idf[w] / norm))
        # Common words that together can't reach the least cosine with any template: a text with no other template word is skipped.
        weak = set()
        for w in COMMON:
            if all(h.get(w, 0) < r for h, r in zip(held, room)):
                room = [r - h.get(w, 0) for h, r in zip(held, room)]
                weak.add(w)
        self.anchors = frozenset(w for w in self.idf if w not in weak)

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """(cosine, licence) of the nearest template, the first by name where equally near."""
        bag = Counter(words)
        if self.anchors.isdisjoint(bag):
            return 0.0, None
        dots: dict[int, float] = defaultdict(float)
        square = 0.0
        for w, n in bag.items():
            weight = n * self.idf.get(w, self.unseen)
            square += weight * weight
            for t, part in self.lists.get(w, ()):
                dots[t] += weight * part
        score, name = min((-d, self.names[t][0]) for t, d in dots.items())
        return min(1.0, -score / math.sqrt(square)), name

    def scan(self, text: str) -> tuple[str | None, float, int, str | None, float]:
        """(licence of the best notice, cosine, line; licence and cosine of the whole text)."""
        low = text.lower()
        words = WORD.findall(low)
        if self.anchors.isdisjoint(words):
            return None, 0.0, -1, None, 0.0
        whole, whole_name = self.best(words)
        notice, name, at = whole, whole_name, 0
        block: list[str] = []
        first = 0
        for i, line in enumerate([*low.split("\n"), ""]):
            own = WORD.findall(line)
            if own:
                score, licence = self.best(own)
                if licence and score > notice:
                    notice, name, at = score, licence, i
                first = i if not block else first
                block += own
            elif block:
                score, licence = self.best(block)
                if licence and score > notice:
                    notice, name, at = score, licence, first
                block = []
        return name, notice, at, whole_name, whole


def _scan(templates: Mapping[str, Sequence[str]], how: Settings):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates, min(how.notice, how.whole))
        for texts in batches:
            rows = [matcher.scan(t or "") for t in texts]
            yield pd.DataFrame(rows, columns=["notice", "notice_cosine", "line", "whole", "whole_cosine"])

    return F.pandas_udf(run, "struct<notice: string, notice_cosine: double, line: long, whole: string, whole_cosine: double>")


def scan_licences(files: DataFrame, id: str = "path", path: str = "path", text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, how: Settings = Settings()) -> DataFrame:
    """``id``, ``path``, ``licence``, ``found`` (notice, file, inherited or null), ``cosine``, ``line``, ``from_directory``.

    One row for each row. A path is split at ``/``; a null path is a file of no directory and inherits nothing. Null and empty texts
    have no notice. Of several licence files of a directory the one with the highest cosine counts, then the first by licence
    name; a licence file's own licence is its own. ``line`` is the notice's first line from 0. Other columns are not read.
    """
    rows = pick(files, id=id, path=path, text=text)
    seen = rows.withColumn("s", _scan(templates, how)("text")).select("id", "path", "s.*")
    base = F.element_at(F.split("path", "/"), -1)
    directory = F.when(F.col("path").isNotNull(), F.regexp_replace("path", r"/?[^/]*$", ""))
    is_file = ((F.col("whole_cosine") >= how.whole) | (base.rlike(LICENCE_NAME) & (F.col("notice_cosine") >= how.notice))) & F.col("path").isNotNull()
    seen = saved(seen.withColumn("directory", directory).withColumn("speaks", F.coalesce(is_file, F.lit(False))), "licence-scan")
    said = seen.filter("speaks").groupBy("directory", "notice").agg(F.max("notice_cosine").alias("c"))
    said = said.groupBy("directory").agg(F.min(F.struct((-F.col("c")).alias("c"), "notice")).alias("b")).select(F.col("directory").alias("above"), F.col("b.notice").alias("licence"), (-F.col("b.c")).alias("cosine"))
    # Every directory that holds files, once, beside all its ancestors: its depth times the directories, never the files.
    parts = F.split("directory", "/")
    dirs = seen.filter("path is not null").select("directory").distinct()
    ancestors = dirs.select("directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("above")).distinct()
    near = ancestors.join(said, "above").groupBy("directory").agg(F.max_by(F.struct("above", "licence", "cosine"), F.length("above")).alias("up"))
    out = seen.join(near.withColumnRenamed("directory", "_d"), F.col("directory") == F.col("_d"), "left")
    own = F.col("notice_cosine") >= how.notice
    found = F.when(F.col("speaks"), "file").when(own, "notice").when(F.col("up").isNotNull(), "inherited")
    return out.select(
        "id",
        "path",
        F.when(own, F.col("notice")).otherwise(F.col("up.licence")).alias("licence"),
        found.alias("found"),
        F.when(own, F.col("notice_cosine")).otherwise(F.col("up.cosine")).alias("cosine"),
        F.when(own, F.col("line")).alias("line"),
        F.when(~own, F.col("up.above")).alias("from_directory"),
    )
