"""Licence scan: TF-IDF cosine to templates, then nearest-ancestor inheritance.

A file's units are its lines, its paragraphs of several lines (runs of
lines with words) and the whole file, so a notice is found wherever it stands
in the text and a licence file is compared as a whole.  A unit's vector has its words' term frequency times inverse document
frequency; document frequencies of all words are counted over all files.  Words
of no template cannot add to a product, only to the unit's length; their
frequencies stay in a table, which is joined to the units that could reach
``threshold`` if all such words had the least weight there is.  A unit
whose best cosine reaches ``threshold`` carries that template's licence; the
file's licence is that of its best unit (ties: the template that comes first
by name).  A licence whose whole text is part of another (``CONTAINED``) counts
only if no unit carries the other.

Files without a licence of their own inherit it from the nearest ancestor
directory that holds a licence file (by name) with a detected licence; of
several, the best score and then the smallest path count.  Inheritance works
on distinct directories: they are joined with the licensed directories
through their ancestor paths, the deepest wins, and the result is joined
back to the files on the directory.

Only small rows are shuffled, never texts; templates and their weights (a
bounded parameter) are all that goes to tasks.  Null text has no licence of
its own; a null path has no directory and inherits nothing.  Repeated rows
get equal results.  Columns other than path, text and ``carry`` are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trueline.llm.common import stage

THRESHOLD = 0.6
#: Words that a task counts before it hands them on.
COUNTED_WORDS = 200_000
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|copyright)([-._][a-z0-9.-]*)?$"

# The parts of the BSD licences.
BSD_OPENING = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
               "that the following conditions are met:")
BSD_SOURCE = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
              "following disclaimer.")
BSD_BINARY = ("2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
              "the following disclaimer in the documentation and/or other materials provided with the distribution.")
BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission.")
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: Licences whose text is part of another's.
CONTAINED = {"BSD-2-Clause": "BSD-3-Clause"}
# Notices, headers and short texts of common licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        BSD_OPENING,
        f"{BSD_OPENING} {BSD_SOURCE} {BSD_BINARY} {BSD_DISCLAIMER}"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        BSD_NAMES,
        f"{BSD_OPENING} {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES} {BSD_DISCLAIMER}"),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright to the public domain. CC0 1.0",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version."),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",),
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def units_of(text: str) -> list[list[str]]:
    """Words of every line, of every paragraph of several lines and of the whole
    text, if it is more than one paragraph."""
    out, paragraph, whole, paragraphs = [], [], [], 0
    for line in [*text.split("\n"), ""]:
        words = words_of(line)
        if words:
            out.append(words)
            paragraph.append(words)
            whole += words
        else:
            paragraphs += bool(paragraph)
            if len(paragraph) > 1:
                out.append([w for p in paragraph for w in p])
            paragraph = []
    return [*out, whole] if paragraphs > 1 else out


def template_words(templates: dict[str, tuple[str, ...]]) -> set[str]:
    return {w for texts in templates.values() for t in texts for w in words_of(t)}


def document_frequencies(files: DataFrame) -> DataFrame:
    """(word, files): files that hold each word; the word "" has their number."""
    def run(batches):
        def rows():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()),
                                               "n": pa.array(list(counts.values()), pa.int64())})

        counts: Counter = Counter()
        for b in batches:
            counts[""] += len(b)
            for text in b.column(0).to_pylist():
                counts.update(set(words_of(text)))
                if len(counts) > COUNTED_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return (files.select(F.coalesce("text", F.lit(""))).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("files")))


class Matcher:
    """Templates as sparse TF-IDF vectors of unit length."""

    def __init__(self, templates: dict[str, tuple[str, ...]], n: int, df: dict[str, int], threshold: float):
        self.threshold, self.n, self.df = threshold, n, df
        self.idf = {w: self.weight(df.get(w, 0)) for w in sorted(template_words(templates))}
        self.names: list[str] = []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for name in sorted(templates):
            for text in templates[name]:
                tf = Counter(words_of(text))
                length = math.sqrt(sum((c * self.idf[w]) ** 2 for w, c in tf.items()))
                for w, c in tf.items():
                    self.postings.setdefault(w, []).append((len(self.names), c * self.idf[w] / length))
                self.names.append(name)

    def weight(self, files: int) -> float:
        """Inverse document frequency of a word that ``files`` files hold."""
        return math.log((1 + self.n) / (1 + files)) + 1

    def product(self, words: list[str]) -> tuple[float, str, float, dict[str, int]] | None:
        """(best product, its licence, squared length of the template words,
        other words) of a unit, if it can reach the threshold."""
        tf = Counter(words)
        others = {w: c for w, c in tf.items() if w not in self.idf}
        if len(others) == len(tf):
            return None
        # In order of the words, so that equal units give equal sums.
        known = sorted((w, c) for w, c in tf.items() if w in self.idf)
        square = sum((c * self.idf[w]) ** 2 for w, c in known)
        least = sum(c * c for c in others.values())  # no weight is below 1
        if square < self.threshold ** 2 * (square + least) * (1 - 1e-9):  # a cosine is at most sqrt(known / length)
            return None
        dots = [0.0] * len(self.names)
        for w, c in known:
            for t, weight in self.postings[w]:
                dots[t] += c * self.idf[w] * weight
        top = max(range(len(dots)), key=lambda t: (round(dots[t], 9), -t))
        if self.score(dots[top], square, least) < self.threshold:
            return None
        return dots[top], self.names[top], square, others

    def score(self, dot: float, square: float, others: float) -> float:
        return round(dot / math.sqrt(square + others), 9)

    def length(self, counts: list[tuple[int, int]]) -> float:
        """Squared length of words (times in the unit, files that hold it)."""
        return math.fsum((c * self.weight(files)) ** 2 for c, files in counts)

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """(cosine, licence) of a unit, if it reaches the threshold."""
        found = self.product(words)
        if not found:
            return None
        dot, name, square, others = found
        score = self.score(dot, square, self.length([(c, self.df.get(w, 0)) for w, c in others.items()]))
        return (score, name) if score >= self.threshold else None

    def scan(self, text: str) -> tuple[float, str] | None:
        found = [f for f in map(self.best, units_of(text)) if f]
        names = {name for _, name in found}
        return min((f for f in found if CONTAINED.get(f[1]) not in names), key=lambda f: (-f[0], f[1]), default=None)


def detect(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD,
           carry: tuple[str, ...] = ()) -> DataFrame:
    """The ``carry`` columns, path, own (licence or null) and score."""
    templates = templates or TEMPLATES
    frequencies = stage(document_frequencies(files), "document-frequencies")
    known = frequencies.where(F.col("word").isin("", *template_words(templates)))
    df = {r["word"]: r["files"] for r in known.collect()}  # one row per template word
    matcher = Matcher(templates, df.pop("", 0), df, threshold)
    own = StructType.fromDDL("__row long, __units array<struct<dot:double,name:string,square:double,"
                             "others:array<struct<word:string,n:bigint>>>>")
    kept = [*(files.schema[c] for c in carry), files.schema["path"]]
    units_type = pa.list_(pa.struct([
        ("dot", pa.float64()), ("name", pa.string()), ("square", pa.float64()),
        ("others", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))]))

    def products(batches):
        for b in batches:
            units = [[{"dot": f[0], "name": f[1], "square": f[2],
                       "others": [{"word": w, "n": c} for w, c in f[3].items()]}
                      for f in map(matcher.product, units_of(t)) if f] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(units, units_type), *b.columns[2:]],
                                             [*own.names, *(k.name for k in kept)])

    def scores(batches):
        for b in batches:
            rows = []
            for row, dot, name, square, counts in zip(*(b.column(k).to_pylist() for k in range(5))):
                others = matcher.length([(c["n"], c["files"]) for c in counts or ()])
                rows.append((row, name, matcher.score(dot, square, others)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.float64()))],
                ["__row", "name", "value"])

    # Row numbers are fixed by the staged files.
    rows = files.select(F.coalesce("text", F.lit("")).alias("__text"),
                        F.monotonically_increasing_id().alias("__row"), *carry, "path")
    rows = stage(rows.mapInArrow(products, StructType([*own.fields, *kept])), "products")
    units = rows.select("__row", F.posexplode("__units").alias("unit", "u")).select("__row", "unit", "u.*")
    counts = (units.select("__row", "unit", F.inline("others")).join(frequencies, "word")
              .groupBy("__row", "unit").agg(F.collect_list(F.struct("n", "files")).alias("counts")))
    found = (units.join(counts, ["__row", "unit"], "left").select("__row", "dot", "name", "square", "counts")
             .mapInArrow(scores, "__row long, name string, value double").where(F.col("value") >= threshold))
    unit = F.struct((-F.col("value")).alias("s"), "name")
    best = found.groupBy("__row").agg(
        F.min(F.when(~F.col("name").isin(*CONTAINED), unit)).alias("free"),
        *[F.when(~F.bool_or(F.col("name") == F.lit(more)), F.min(F.when(F.col("name") == F.lit(less), unit))).alias(less)
          for less, more in CONTAINED.items()])
    best = best.select("__row", F.least("free", *[F.col(f"`{c}`") for c in CONTAINED]).alias("best"))
    return rows.join(best, "__row", "left").select(
        *carry, "path", F.col("best.name").alias("own"), (-F.col("best.s")).alias("score"))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """The ``carry`` columns, path, licence, how ('own', 'inherited' or
    'none'), score (own only) and from_dir (inherited only)."""
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    found = stage(detect(files, templates, threshold, carry).withColumn("dir", directory), "licences")
    licensed = found.where(name.rlike(LICENCE_FILE) & F.col("own").isNotNull() & F.col("dir").isNotNull())
    top = F.min(F.struct((-F.col("score")).alias("s"), "path", "own"))
    licensed = stage(licensed.groupBy(F.col("dir").alias("from_dir")).agg(top.alias("best")).select(
        "from_dir", F.col("best.own").alias("inherited")), "licensed-dirs")
    # Every directory with itself and its ancestors; the root is "".
    steps = F.split("dir", "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(steps)))
    dirs = stage(found.where("own is null and dir is not null").select("dir").distinct(), "dirs")
    up = dirs.select("dir", steps.alias("steps"), depth.alias("depth")).select(
        "dir", "depth", F.concat_ws("/", F.slice("steps", F.lit(1), F.col("depth"))).alias("from_dir"))
    up = up.where((F.col("depth") > 0) | (F.col("dir") != ""))
    nearest = up.join(licensed, "from_dir").groupBy("dir").agg(
        F.max_by(F.struct("from_dir", "inherited"), "depth").alias("near"))
    nearest = stage(nearest, "nearest")
    out = found.join(nearest, "dir", "left")
    gets = F.col("own").isNull() & F.col("near").isNotNull()
    return out.select(
        *carry, "path", F.coalesce("own", "near.inherited").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(gets, "inherited").otherwise("none").alias("how"),
        "score", F.when(gets, F.col("near.from_dir")).alias("from_dir"))
