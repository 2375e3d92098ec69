"""Operator 10, licence scans by a trained paragraph classifier.

Word 1- to 3-grams of known notices feed a multinomial logistic regression
with lasso weights, one class per licence family and one for ``unknown``.
It is trained on notices spelled out from ``FAMILIES`` and on a bounded
sample of corpus paragraphs as ``unknown``; a temperature, fitted on
paragraphs that training did not see, calibrates its probabilities.  A
paragraph gets a family only if its calibrated probability against ``unknown``
passes and the paragraph holds most of one of the family's template phrases.
Each family is judged on its own, so a paragraph may get several: the best
one's words are taken out and the rest is judged again.

The lasso leaves few n-grams, and each needs its rarest word.  One
Aho-Corasick pass over a text finds such words; without any, every n-gram
weight is zero, so the paragraph is ``unknown`` by the intercepts alone and
needs no scoring.  Lines with such a word are judged, and so are windows around
it that cross line breaks.  Whole texts of all rows are scanned.

Defined cases
    * null and empty texts have no paragraphs and no licences;
    * a paragraph is the lines between blank lines; letters are lower-cased,
      all but letters and digits (line breaks too) separates words;
    * a family counts once in a paragraph; ``or`` and ``and`` in an SPDX
      expression open a further identifier;
    * a document's licences are a sorted array without repeats, empty if none;
    * a corpus without paragraphs trains on the spelled-out notices alone;
    * repeated rows are scanned one by one; other columns are not read; an
      empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import safe_text

#: Names and phrases of public licences: family -> (names, long phrases).
FAMILIES = {
    "MIT": (["MIT License", "MIT licence", "the terms of the MIT license", "Expat License"],
            ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
             "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"]),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
                   ["you may not use this file except in compliance with the License. You may obtain a copy of the License at"]),
    "GPL": (["GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL v3", "GPL-3.0 license", "GNU General Public License"],
            ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"]),
    "LGPL": (["GNU Lesser General Public License, version 3", "GNU LGPL v2.1", "GNU Lesser General Public License"],
             ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"]),
    "AGPL": (["GNU Affero General Public License, version 3", "GNU AGPL v3", "GNU Affero General Public License"],
             ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"]),
    "BSD": (["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-style license"],
            ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"]),
    "MPL": (["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
            ["This Source Code Form is subject to the terms of the Mozilla Public License"]),
    "CC-BY": (["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 License"], []),
    "CC-BY-SA": (["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"], []),
    "CC-BY-NC": (["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"], []),
    "CC0": (["CC0 1.0 Universal", "CC0 public domain dedication"],
            ["has waived all copyright and related or neighboring rights to this work"]),
    "reserved": (["All rights reserved"], ["No part of this publication may be reproduced, distributed, or transmitted in any form without prior written permission"]),
}
#: The family's identifiers after ``SPDX-License-Identifier:``.
SPDX = {"MIT": ("MIT",), "Apache-2.0": ("Apache-2.0",), "GPL": ("GPL",), "LGPL": ("LGPL",), "AGPL": ("AGPL",), "BSD": ("BSD",), "MPL": ("MPL",),
        "CC-BY": ("CC-BY-4.0", "CC-BY-3.0"), "CC-BY-SA": ("CC-BY-SA",), "CC-BY-NC": ("CC-BY-NC",), "CC0": ("CC0",)}
for _family, _ids in SPDX.items():
    FAMILIES[_family][0].extend(f"SPDX-License-Identifier: {i}" for i in _ids)
TAG = ["spdx", "license", "identifier"]
#: Openings that notices are spelled out with.
OPENINGS = ("{}.", "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.",
            "This work is licensed under {}.", "This project is available under the {}", "Distributed under the {}, see the file for details",
            "Copyright 2019 the authors. Licensed under the {}.", "The code is released under the {} by its authors", "{}")
#: Sentences with notice words that name no licence.
NO_NOTICE = ("See the file for details.", "This project is available to the public.", "He is a licensed driver and a free man.",
             "The work is released by its authors.", "A copy of the letter was obtained under the table.",
             "General public opinion is free.", "Version 2.0 was released in 2019.", "All people have rights.",
             "Creative work in common attribution.", "The source code is on this page.", "Version 3.", "4.0", "The terms of use.")
UNKNOWN_SAMPLE = 4000
LASSO, THRESHOLD, HOLDS = 0.0005, 0.5, 0.8
#: n-grams in a larger share of the unknown paragraphs are no features.
COMMON = 0.002
#: Characters of a window on either side of a word that opens it (the longest
#: phrase has 140, more when wrapped), and how far on the next one opens.
REACH, STEP = 450, 150


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def spdx_spread(words: list[str]) -> list[str]:
    """The words, with the tag repeated for each identifier of an expression
    and an empty word before each tag."""
    if TAG[0] not in words:
        return words
    out, since = [], None
    for i, w in enumerate(words):
        if since is not None and w in ("or", "and") and since <= 6:
            out += ["", *TAG]
            since = 0
            continue
        out += ["", w] if w == TAG[0] else [w]
        since = 0 if words[max(0, i - 2):i + 1] == TAG else None if since is None else since + 1
    return out


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def holds(words: list[str], family: str, families=FAMILIES) -> float:
    """The largest share of a family phrase's word bigrams (its words, if it
    is one word) that the paragraph holds."""
    names, phrases = families[family]
    best = 0.0
    have = grams(words)
    for p in [*names, *phrases]:
        w = words_of(p)
        want = {" ".join(w[i:i + 2]) for i in range(len(w) - 1)} or set(w)
        best = max(best, len(want & have) / len(want))
    return best


def best_phrase(words: list[str], family: str, families=FAMILIES) -> tuple[float, int, set[int]]:
    """(share, bigrams) of the family phrase that the words hold most of, the
    longer one of equals, and the places of the family's phrases."""
    names, phrases = families[family]
    pairs = list(zip(words, words[1:]))
    best, spread, places = (0.0, 0), set(), set()
    for p in [*names, *phrases]:
        w = words_of(p)
        want = set(zip(w, w[1:])) or {(w[0],)}
        runs: list[list[int]] = []
        for i, x in enumerate(pairs if len(w) > 1 else [(x,) for x in words]):
            if x in want:
                # a run goes on over a few other words, but not over a cut
                if runs and i - runs[-1][-1] <= 4 and "" not in words[runs[-1][-1]:i]:
                    runs[-1].append(i)
                else:
                    runs.append([i])
        reach = range(min(len(w), 2))
        kinds = lambda at: len({tuple(words[i + j] for j in reach) for i in at}) / len(want)
        share = kinds([i for run in runs for i in run])
        for run in runs:
            if kinds(run) >= HOLDS:
                places |= {i + j for i in run for j in reach}
        if (share, len(want)) > best:
            best, spread = (share, len(want)), {i + j for run in runs for i in run for j in reach}
    return (*best, places or spread)


def notices(families=FAMILIES) -> list[tuple[str, str]]:
    """(family, paragraph) spelled out from names, openings and phrases."""
    out = []
    for family, (names, phrases) in families.items():
        out += [(family, o.format(n)) for n in names for o in OPENINGS]
        for p in phrases:
            w = p.split()
            half = max(8, len(w) * 2 // 3)
            out += [(family, p), (family, p + "."), (family, " ".join(w[:half])), (family, " ".join(w[-half:]))] * 3
    return out


class LicenceModel:
    """Sparse weights per n-gram, intercepts and temperature."""

    def __init__(self, classes, weights: dict[str, list[float]], intercepts: list[float], temperature: float):
        self.classes, self.weights, self.intercepts, self.temperature = classes, weights, intercepts, temperature
        # first word -> further words of the weighted n-grams that it opens
        self.opens: dict[str, dict[tuple[str, ...], list[float]]] = {}
        for g, w in weights.items():
            first, *more = g.split()
            self.opens.setdefault(first, {})[tuple(more)] = w

    def triggers(self) -> list[str]:
        """A word of every weighted n-gram: without any, all weights are off."""
        chosen: set[str] = set()
        for g in sorted(self.weights, key=lambda g: (g.count(" "), g)):
            parts = g.split()
            if not chosen.intersection(parts):
                chosen.add(max(parts, key=lambda w: (len(w), w)))
        return sorted(chosen)

    def probabilities(self, words: list[str]) -> list[float]:
        z = list(self.intercepts)
        for g in grams(words):
            for i, w in enumerate(self.weights.get(g, ())):
                z[i] += w
        z = [x / self.temperature for x in z]
        top = max(z)
        e = [math.exp(x - top) for x in z]
        s = sum(e)
        return [x / s for x in e]

    def may_name(self, words: list[str], unknown: int) -> bool:
        """Whether some family's probability against ``unknown`` may pass: the
        sums that ``probabilities`` makes, of the weighted n-grams alone.  They
        are added in another order, which the margin allows for."""
        z, seen = list(self.intercepts), set()
        for i, first in enumerate(words):
            if first in self.opens:
                tails = self.opens[first]
                for n in (1, 2, 3):
                    tail = tuple(words[i + 1:i + n])
                    if len(tail) == n - 1 and tail in tails and (first, *tail) not in seen:
                        seen.add((first, *tail))
                        for k, w in enumerate(tails[tail]):
                            z[k] += w
        least = z[unknown] + self.temperature * math.log(THRESHOLD / (1 - THRESHOLD)) - 1e-6
        return any(x >= least for k, x in enumerate(z) if k != unknown)

    def judge(self, text: str, families=FAMILIES) -> list[tuple[str, float, float]]:
        """(family, calibrated probability, share of the template held) of
        every family that the text names."""
        words = spdx_spread(words_of(text))
        unknown, out = self.classes.index("unknown"), {}
        while True:
            # ordinary paragraphs, nearly all, end here
            if not self.may_name(words, unknown):
                return [(f, *x) for f, x in out.items()]
            p = self.probabilities(words)
            passed = []
            for i, family in enumerate(self.classes):
                if i != unknown and family not in out and p[i] >= THRESHOLD * (p[i] + p[unknown]):
                    share, size, at = best_phrase(words, family, families)
                    if share >= HOLDS:
                        passed.append((share, size, p[i] / (p[i] + p[unknown]), family, at))
            if not passed:
                return [(f, *x) for f, x in out.items()]
            share, _, prob, family, at = max(passed, key=lambda x: x[:4])
            out[family] = (prob, share)
            # an empty word keeps what stood around the phrase apart
            words = ["" if i in at else w for i, w in enumerate(words)]


def unknown_paragraphs(docs: DataFrame, text_col: str, bound: int = UNKNOWN_SAMPLE, families=FAMILIES) -> list[str]:
    """At most ``bound`` corpus lines of the smallest hashes, without those
    that hold most of a template phrase."""
    # one line of a document by its hash, so that the ordering sees few rows
    pick = docs.select(safe_text(text_col).alias("t")).select(F.array_min(F.transform(
        F.filter(F.split("t", "\\n"), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.substring(x, 1, 2000).alias("p")))).alias("s"))
    rows = pick.filter("s is not null").select("s.h", "s.p").orderBy("h", "p").limit(bound).collect()
    out = []
    for text in {r["p"] for r in rows}:
        w = words_of(text)
        if max(holds(w, f, families) for f in families) < 0.6:
            out.append(text)
    return sorted(out)


def fit_licences(spark, unknown: list[str], families=FAMILIES) -> LicenceModel:
    """Train, then fit the temperature on the paragraphs set aside."""
    classes = ["unknown", *sorted(families)]
    pairs = notices(families) + [("unknown", t) for t in [*NO_NOTICE] * 3 + unknown]
    # n-grams that ordinary paragraphs have as well tell nothing apart
    common: dict[str, int] = {}
    for text in unknown:
        for g in grams(words_of(text)):
            common[g] = common.get(g, 0) + 1
    vocabulary: dict[str, int] = {}
    for family, text in pairs:
        if family != "unknown":
            for g in sorted(grams(words_of(text))):
                if common.get(g, 0) <= COMMON * len(unknown):
                    vocabulary.setdefault(g, len(vocabulary))

    def vector(text):
        at = sorted(vocabulary[g] for g in grams(words_of(text)) if g in vocabulary)
        return SparseVector(len(vocabulary), at, [1.0] * len(at))

    rows = [(float(classes.index(f)), vector(t)) for i, (f, t) in enumerate(pairs) if i % 5]
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    fitted = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=LASSO, maxIter=80,
                                standardization=False).fit(spark.createDataFrame(rows, schema).coalesce(1))
    table = fitted.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in table[:, i]] for g, i in vocabulary.items() if abs(table[:, i]).max() > 1e-9}
    model = LicenceModel(classes, weights, [float(x) for x in fitted.interceptVector.toArray()], 1.0)
    aside = [(classes.index(f), words_of(t)) for i, (f, t) in enumerate(pairs) if not i % 5]

    def loss(temperature):
        model.temperature = temperature
        return -sum(math.log(max(model.probabilities(w)[y], 1e-12)) for y, w in aside)

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def scan_licences(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, found`` per row: (line, family, probability, share) of each
    family that a paragraph names; ``line`` is the paragraph's first."""
    spark = docs.sparkSession
    found = T.ArrayType(T.StructType([
        T.StructField("line", T.IntegerType()), T.StructField("family", T.StringType()),
        T.StructField("probability", T.DoubleType()), T.StructField("share", T.DoubleType())]))
    rows = docs.select(F.col(id_col).alias("id"), safe_text(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("found", found)])
    # plain values, bounded by FAMILIES; tasks need not have this module
    sent = spark.sparkContext.broadcast((model.classes, model.weights, model.intercepts, model.temperature))

    def run(batches):
        import bisect

        import ahocorasick
        import pyarrow as pa

        blank = re.compile(r"\n(?:[ \t\r]*\n)+")
        m = LicenceModel(*sent.value)
        automaton = ahocorasick.Automaton()
        for t in m.triggers():
            automaton.add_word(t, len(t))
        automaton.make_automaton()
        kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64())]))
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                text, spots = raw.lower(), []
                for end, size in automaton.iter(text):
                    before, after = text[end - size:end - size + 1], text[end + 1:end + 2]
                    if (before.isascii() and before.isalnum() and end >= size) or (after.isascii() and after.isalnum()):
                        continue        # inside a longer word
                    spots.append(end)
                hits = []
                if spots:
                    ends = [x.start() for x in blank.finditer(text)] + [len(text)]
                    starts = [0] + [x.end() for x in blank.finditer(text)]
                    at = number = 0
                    seen, judged, named = -1, -1, {}
                    for spot in sorted(spots):
                        k = bisect.bisect_right(starts, spot) - 1
                        lo, hi = starts[k], ends[k]
                        if lo != at or not number:
                            number = 1 + text.count("\n", 0, lo)
                            at, judged = lo, -1
                        pieces = []
                        first, last = text.rfind("\n", lo, spot) + 1 or lo, text.find("\n", spot, hi)
                        last = hi if last < 0 else last
                        if first > seen:
                            seen = first
                            pieces.append(text[first:last])
                        # the line alone is the whole window unless the paragraph goes on around it
                        if spot > judged and (first > lo or last < hi or last - first > REACH):
                            judged = spot + STEP
                            left, right = max(lo, spot - REACH), min(hi, spot + STEP + REACH)
                            while left > lo and spot - left < 2 * REACH and text[left - 1].isalnum():
                                left -= 1
                            while right < hi and right - spot < 2 * REACH and text[right].isalnum():
                                right += 1
                            pieces.append(text[left:right])
                        for piece in pieces:
                            for family, probability, share in m.judge(piece):
                                old = named.get((number - 1, family), (0.0, 0.0))
                                named[number - 1, family] = max(old, (probability, share))
                    hits = [{"line": n, "family": f, "probability": x[0], "share": x[1]} for (n, f), x in sorted(named.items())]
                out.append(hits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["id", "found"])

    return rows.mapInArrow(run, schema)


def op10_licences(spark, sf_dir: str) -> DataFrame:
    from convspark.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents")
    model = fit_licences(spark, unknown_paragraphs(docs, "text"))
    out = scan_licences(docs, model)
    return out.select(F.col("id").alias("doc_id"), F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))).alias("licences"),
                      F.size(F.array_distinct(F.transform("found", lambda x: x["line"]))).alias("n_paragraphs"),
                      F.array_min(F.transform("found", lambda x: x["probability"])).alias("min_probability"))
