"""Licence scans by a trained paragraph classifier.

Sentences that hold a licence word, joined over the lines of a paragraph, and their single lines are
paragraphs to classify: sparse word unigrams and bigrams, hashed into buckets, go into a multinomial
logistic regression over licence families and an unknown class. A family counts if its probability passes a threshold that is calibrated on held-out
passages, and if the paragraph agrees with one of the family's templates. The scan is one projection
of DataFrame functions; only the fit, on made-up passages, runs in the driver.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

#: Buckets of hashed n-grams.
BUCKETS = 2048
#: A paragraph is looked at if it holds one of these, in lower case. They are part of what a notice is: each template
#: holds one, and a paragraph without any grants nothing, however many of a template's other words it has.
ANCHORS = ("licen", "copyright", "rights reserved", "public domain", "warrant", "spdx", "creative commons", "cc0", "cc by")
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What begins a line of a wrapped notice: marks of comments and lists.
MARKS = r'[^\p{L}\p{N}"(\n]*'
#: Ends of sentences: lines without letters and digits, and sentence ends before a capital, a digit, a quote or a bracket.
CUT = rf'\n[^\p{{L}}\p{{N}}]*\n|(?<=[.!?])(?:[ \t]+|[ \t\r]*\n{MARKS})(?=[\p{{Lu}}0-9"(])'
#: Line feeds within a sentence: after a word's hyphen, and others.
HYPHEN, FEED = rf"(?<=\p{{L}}-)[ \t\r]*\n{MARKS}(?=\p{{L}})", rf"(?<![ \t\r])[ \t\r]*\n{MARKS}"

# What notices of each family say.
TEMPLATES: dict[str, list[str]] = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "bsd": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.", "Released under the LGPL license"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "This program is licensed under the terms of the GNU Affero General Public License.", "Released under the AGPL license"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0 license"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under the Creative Commons Attribution-NonCommercial License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0.", "This is free and unencumbered work released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020 The Authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the copyright holder.", "This document is proprietary and confidential; all rights reserved."],
}
FAMILIES = list(TEMPLATES)
# Passages with licence words that give no licence.
OTHER = [
    "He lost his driving license on the way home.", "She took poetic license with the facts.", "The pilot renewed her license last spring.", "The product comes with a two year warranty.", "A warrant was issued for his arrest.",
    "Copyright law has changed over the years.", "The licence fee for television went up again.", "The restaurant has no licence to sell wine.", "Fishing without a licence is fined.", "The debate about copyright went on for hours.",
    "He is a licensed electrician from the north.", "The license plate was covered in mud.", "These lands were once in the public domain of the crown.", "The warranty does not cover water damage.", "Their concerns were warranted by the results.",
    "The agency grants licences to new operators each year.", "Licensing the patent took several rounds of talks.", "We ask whether more study is warranted here.", "Copyright infringement claims were settled out of court.", "A license server must be running before the tests.",
]


def words_of(passage: str) -> list[str]:
    return re.findall(WORD, passage.lower())


def buckets_of(words: list[str]) -> list[int]:
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return sorted({xxhash.xxh64_intdigest(g.encode(), seed=42) % BUCKETS for g in grams})


def passages(seed: int, n: int) -> tuple[list[str], np.ndarray]:
    """Made-up passages: templates with words lost and added, and others of no licence; the class of each (last: unknown)."""
    r = random.Random(seed)
    salad = lambda k: " ".join("".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(k))
    texts, classes = [], []
    for i in range(n):
        c = i % (len(FAMILIES) + 6)
        if c < len(FAMILIES):
            w = r.choice(TEMPLATES[FAMILIES[c]]).split()
            if len(w) > 6:
                w = [x for x in w if r.random() > 0.08]
            texts.append(" ".join([salad(r.choice((0, 0, 1, 3))), *w, salad(r.choice((0, 0, 1, 4)))]))
        elif c % 2:
            texts.append(" ".join([salad(r.choice((0, 2))), r.choice(OTHER), salad(r.choice((0, 2)))]))
        else:
            w = salad(r.randint(3, 14)).split()
            w.insert(r.randint(0, len(w)), r.choice(("license", "licence", "licensed", "copyright", "warranty", "public domain", "licenses", "under license")))
            texts.append(" ".join(w))
        classes.append(min(c, len(FAMILIES)))
    return texts, np.array(classes)


def _rows(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), BUCKETS))
    for i, t in enumerate(texts):
        b = buckets_of(words_of(t))
        x[i, b] = 1 / np.sqrt(max(1, len(b)))
    return x


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w[:-1] + w[-1]
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, float]:
    """Weights (a row for each bucket, the last for the bias; a column for each class) and the threshold:
    the least probability at which no held-out passage without a licence is given a family."""
    texts, y = passages(1, 900)
    x, k = _rows(texts), len(FAMILIES) + 1
    w, speed, target = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k)), np.eye(k)[y]
    for _ in range(160):
        error = _probabilities(x, w) - target
        g = np.concatenate((x.T @ error, error.sum(0, keepdims=True) * 0.2)) / len(y) + 2e-5 * w
        speed = 0.9 * speed - 6.0 * g
        w += speed
    held, z = passages(2, 900)
    p = _probabilities(_rows(held), w)
    wrong = p[z == len(FAMILIES), :-1].max(1)
    return np.round(w, 6), float(min(0.9, max(0.5, wrong.max() + 0.02)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, n_licences, n_unknown, paragraphs): for every whole text (null: empty) the
    families found, sorted and comma-joined; how many paragraphs gave one; how many held a licence word but gave none;
    and the looked-at paragraphs with family (null: unknown) and probability. A sentence over several lines is looked at
    joined and line by line: joined it counts if it gives a family that none of its lines gives, and then its lines of no
    family, and pieces of its notice that look like another's, don't count; else its lines that hold a licence word do. Repeated rows stay repeated; a text without
    licence words has no paragraphs. Very long texts are looked at whole; of other columns than doc_id and text nothing is read."""
    w, threshold = model()
    weights = F.from_json(F.lit(json.dumps(w[:-1].tolist())), "array<array<double>>")
    bias = F.from_json(F.lit(json.dumps(w[-1].tolist())), "array<double>")
    templates = F.from_json(F.lit(json.dumps([[sorted(set(words_of(t))) for t in TEMPLATES[f]] for f in FAMILIES])), "array<array<array<string>>>")
    names = F.array(*[F.lit(f) for f in FAMILIES])
    known = len(FAMILIES)

    def anchored(s: Column) -> Column:
        low = F.lower(s)
        out = F.lit(False)
        for a in ANCHORS:
            out = out | F.contains(low, F.lit(a))
        return out

    def grams(x: Column) -> Column:
        words = x["words"]
        pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        buckets = F.array_distinct(F.transform(F.concat(words, pairs), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))
        return F.struct(x["text"].alias("text"), words.alias("words"), buckets.alias("buckets"))

    def scores(x: Column) -> Column:
        total = F.aggregate(x["buckets"], F.array_repeat(F.lit(0.0), known + 1), lambda a, b: F.zip_with(a, F.element_at(weights, b + 1), lambda p, q: p + q))
        scaled = F.zip_with(total, bias, lambda t, b: t / F.sqrt(F.greatest(F.size(x["buckets"]), F.lit(1)).cast("double")) + b)
        return F.struct(x["text"].alias("text"), x["words"].alias("words"), scaled.alias("z"))

    def chosen(x: Column) -> Column:
        top = F.array_max(x["z"])
        total = F.aggregate(x["z"], F.lit(0.0), lambda a, z: a + F.exp(z - top))
        return F.struct(x["text"].alias("text"), F.array_distinct(x["words"]).alias("words"), F.array_position(x["z"], top).cast("int").alias("class"), (F.lit(1.0) / total).alias("p"))

    def confirmed(x: Column) -> Column:
        own = F.element_at(templates, F.least(x["class"], F.lit(known)))
        like = F.exists(own, lambda t: F.size(F.array_intersect(t, x["words"])) >= F.lit(0.75) * F.size(t))
        ok = (x["class"] <= known) & (x["p"] >= threshold) & like
        return F.struct(x["text"].alias("text"), F.when(ok, F.element_at(names, F.least(x["class"], F.lit(known)))).alias("family"), x["p"].alias("p"), x["words"].alias("words"), own.alias("own"))

    def joined(s: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(s, HYPHEN, ""), FEED, " ")

    def candidates(s: Column) -> Column:
        """The sentence, joined, and if it has several lines those of them that hold a licence word."""
        return F.concat(F.array(joined(s)), F.when(F.contains(s, F.lit("\n")), F.filter(F.split(s, r"\n+"), anchored)).otherwise(F.array().cast("array<string>")))

    def scored(texts: Column) -> Column:
        tokens = F.transform(texts, lambda s: F.struct(s.alias("text"), F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)).alias("words")))
        return F.transform(F.transform(F.transform(F.transform(tokens, grams), scores), chosen), confirmed)

    def counted(x: Column) -> Column:
        """Of a joined sentence and its lines those that count."""
        whole, lines = F.element_at(x, 1), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
        again = F.exists(lines, lambda y: y["family"] == F.element_at(x, 1)["family"])
        news = whole["family"].isNotNull() & ~F.coalesce(again, F.lit(False))

        def stands(y: Column) -> Column:
            """Not a piece of the joined sentence's notice: it holds a whole template, or words of its own."""
            full = F.exists(y["own"], lambda t: F.size(F.array_except(t, y["words"])) == 0)
            piece = F.exists(F.element_at(x, 1)["own"], lambda t: F.size(F.array_intersect(t, y["words"])) >= F.lit(0.75) * F.size(y["words"]))
            return y["family"].isNotNull() & (full | ~piece)

        return F.when(news, F.concat(F.array(whole), F.filter(lines, stands))).when(F.size(x) == 1, x).otherwise(lines)

    def shown(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("text", "family", "p")])

    text = F.coalesce(F.col("text"), F.lit(""))
    sentences = F.filter(F.split(text, CUT), lambda s: anchored(joined(s)))
    found = F.transform(F.flatten(F.transform(F.transform(F.transform(sentences, candidates), scored), counted)), shown)
    nothing = F.array().cast("array<struct<text:string,family:string,p:double>>")
    out = docs.select("doc_id", F.when(anchored(joined(text)), found).otherwise(nothing).alias("paragraphs"))
    families = F.filter(F.transform("paragraphs", lambda x: x["family"]), lambda f: f.isNotNull())
    return out.select("doc_id", F.array_join(F.array_sort(F.array_distinct(families)), ",").alias("licences"), F.size(families).cast("long").alias("n_licences"), (F.size("paragraphs") - F.size(families)).cast("long").alias("n_unknown"), "paragraphs")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", "licences", "n_licences", "n_unknown")


#: The notices that the documents hold, as whole lines.
SQL = """
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s FROM documents),
seen AS (SELECT doc_id, CASE s WHEN 'Licensed under CC BY-NC 4.0.' THEN 'cc-by-nc' WHEN 'This work is licensed under the GNU General Public License, version 3.' THEN 'gpl'
    WHEN 'Licensed under the Apache License, Version 2.0.' THEN 'apache' WHEN 'Released under the MIT License.' THEN 'mit' WHEN 'All rights reserved.' THEN 'proprietary' END AS family,
    regexp_matches(lower(s), 'licen|copyright|rights reserved|public domain|warrant|spdx|creative commons|cc0|cc by') AS anchored FROM line)
SELECT doc_id, coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') AS licences, count(family) AS n_licences,
       count(*) FILTER (WHERE anchored AND family IS NULL) AS n_unknown
FROM seen GROUP BY doc_id
"""
