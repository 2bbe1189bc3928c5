"""Licence scans: a paragraph classifier, calibrated, and confirmed by comparison with templates."""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

# licences' names, the notices that their authors suggest, and paragraphs of their texts.
TEMPLATES = {
    "MIT": [
        "MIT License", "MIT licensed", "MIT licence", "License: MIT",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Distributed under the MIT software license, see the accompanying file.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "ISC License", "ISC licensed", "Released under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Apache-2.0": [
        "Apache License", "Apache licence", "Apache 2.0", "Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "This code is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "GNU General Public License", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL version 2 or later.",
        "Code is licensed under GPLv2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "GNU Lesser General Public License", "LGPL-2.1", "LGPL-3.0", "LGPLv3", "LGPLv2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the LGPL, version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "GNU Affero General Public License", "AGPL-3.0", "AGPLv3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "BSD License", "BSD licence", "BSD licensed", "BSD 3-Clause", "BSD 2-Clause", "BSD-3-Clause", "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "This software is distributed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "Mozilla Public License", "MPL-2.0", "MPL 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EUPL": [
        "European Union Public Licence", "EUPL-1.2", "EUPL v1.2",
        'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.',
        "This work is distributed under the European Union Public Licence.",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "BSL-1.0": [
        "Boost Software License", "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY": [
        "CC BY 4.0", "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution License.",
    ],
    "CC-BY-NC": [
        "CC BY-NC", "CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes; CC BY-NC applies.",
    ],
    "CC-BY-SA": [
        "CC BY-SA", "CC-BY-SA-4.0",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ],
    "CC0": [
        "CC0 1.0", "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
}
# Whole notices that no training row is made of; the least probability is calibrated on them.
HELD = {
    "MIT": ["This package is available under the MIT license, see COPYING.", "The library is MIT licensed.", "Licensed under MIT"],
    "ISC": ["Available under the ISC licence."],
    "Apache-2.0": ["The source is offered under the terms of the Apache License 2.0.", "Apache License, Version 2.0, January 2004"],
    "GPL": ["You can use it under the terms of the GNU General Public License v2 or later.", "The tool is covered by the GPLv3."],
    "LGPL": ["The bindings are covered by the GNU Lesser General Public License.", "Licensed under LGPLv3 or later."],
    "AGPL": ["The server is available under the GNU Affero General Public License, version 3.", "Licensed under AGPLv3."],
    "BSD": ["The scripts are BSD licensed.", "Licensed under the 2-clause BSD license, see LICENSE."],
    "MPL-2.0": ["The files are under the Mozilla Public License 2.0.", "Licensed under MPL 2.0."],
    "EUPL": ["Licensed under the EUPL v1.2."],
    "BSL-1.0": ["Use is subject to the Boost Software License."],
    "CC-BY": ["Except where noted, content is under a Creative Commons Attribution 4.0 licence.", "Photos: CC BY 4.0."],
    "CC-BY-NC": ["Figures are shared under a Creative Commons Attribution-NonCommercial licence."],
    "CC-BY-SA": ["Content is under CC BY-SA unless noted.", "Licensed under a Creative Commons Attribution-ShareAlike licence."],
    "CC0": ["The dataset is dedicated to the public domain with CC0 1.0."],
}
# Paragraphs with a licence's words that are none.
OTHERS = [
    "All rights reserved.", "Copyright 2020 by the publisher. All rights reserved.", "Her driving license was renewed in May.",
    "The warranty covers parts and labour for two years.", "He asked for permission to leave the room early.",
    "The court held that copyright had not been infringed by the quotation.", "Students study at the institute of technology, MIT, in Cambridge.",
    "The Apache helicopter landed near the village.", "Gnus and zebras graze on the plains of the national park.",
    "The license plate of the car was found near the river.", "A fishing licence is required for the lake; licences are sold at the shop.",
    "Permission was granted by the city to build a new bridge.", "The general public was not admitted to the hearing.",
    "A software license agreement was signed between the two companies.", "Version 3 of the report was published in the spring.",
    "The restaurant lost its license to sell alcohol.", "No part of this publication may be reproduced without prior written permission.",
    "The foundation gave free meals to the public during the winter.", "Poetic license lets the author change the dates of the battle.",
    "The works of the composer are in the public domain in most countries.", "Creative people in common rooms share ideas.",
    "Redistribution of land was the aim of the reform.", "The source of the river was found in binary star charts by mistake.",
    "The pilot's licence was suspended after the incident.", "Copyright law protects original works of authorship.",
    "Terms and conditions apply; see the store for details.", "By continuing you accept the terms of service and the privacy policy.",
    "The attribution of the painting to the master is disputed.", "A commercial license costs more than a private one.",
    "Licensed premises must close at midnight.", "The doctor is licensed to practice in three states.",
]
# The same, held out.
HELD_OTHERS = [
    "The taxi driver showed his licence to the officer.", "Their software was used by the public library.", "Version 2.0 of the bridge plan was published by the city.",
    "The company sells licenses for its commercial products.", "You may not use the pool after midnight.", "She received a copy of the book along with a letter.",
    "The material is available under the counter.", "The general hoped that the work would be useful.", "The licensed trader sold the boat without warranty.",
    "Copies of the permission slip shall be kept by the school.",
]
UNKNOWN = "unknown"
#: Cropped and sprinkled copies of each training paragraph, and of each held-out one.
COPIES, SEED = 16, 11
PENALTY, L1_SHARE, ROUNDS = 0.0005, 0.5, 300
#: One in so many held-out paragraphs that are not of the family predicted may come above the least probability.
FALSE = 20
#: The share of a template's word pairs that a paragraph must hold to confirm a prediction.
CONFIRMED = 0.6
#: A whole paragraph of so many word pairs may also be part of a template, with that share of its own pairs.
LEAST_OWN = 3
# Words that tell nothing.
LITTLE = "a an and as at be by for from in is it of on or that the this to with".split()
#: Comment signs at the ends of a line.
SIGNS = "^[\\x20\\t]*(?://+|/\\*+|\\*+/?|#+|--+|;+|%+|<!--)|(?:\\*+/|-->)[\\x20\\t\\r]*$"


def _let(value: Column, body) -> Column:
    """body(value), the value computed once: a column that is used in several places, or in a lambda, would be computed in each."""
    return F.transform(F.array(value), body)[0]


def grams(text: Column) -> Column:
    """The distinct words and pairs of words of a text, lower-cased."""
    words = F.filter(F.transform(F.split(F.lower(text), "[^a-z0-9.\\-]+"), lambda w: F.regexp_replace(w, "^[.\\-]+|[.\\-]+$", "")), lambda w: w != "")

    def both(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.concat(w, F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.concat_ws(" ", a, b))))

    return _let(words, both)


def training(seed: int = SEED) -> list[tuple[str, str, bool]]:
    """(text, class, held out): paragraphs whole, cropped at both ends and between words of other paragraphs.

    No notice is on both sides: what is held out was written apart.
    """
    rng = random.Random(seed)
    filler = " ".join(OTHERS).split()
    rows = []
    for held, named, others in ((False, TEMPLATES, OTHERS), (True, HELD, HELD_OTHERS)):
        for name, texts in [*named.items(), (UNKNOWN, others)]:
            for text in texts:
                words = text.split()
                rows.append((text, name, held))
                for _ in range(COPIES if name != UNKNOWN else COPIES // 2):
                    lo, hi = rng.randrange(1 + len(words) // 6), len(words) - rng.randrange(1 + len(words) // 6)
                    around = [" ".join(rng.sample(filler, rng.randrange(0, 8))) for _ in range(2)]
                    rows.append((f"{around[0]} {' '.join(words[lo:hi])} {around[1]}", name, held))
    return rows


@dataclass
class Model:
    """Weights by word or pair, intercepts by class, and the least probability of a prediction."""

    classes: list[str]
    weights: DataFrame
    intercepts: list[float]
    least: float = 0.0

    def scored(self, paragraphs: DataFrame) -> DataFrame:
        """Adds `family` and `probability` to paragraphs with `uid` and `grams`, which goes.

        Weights are a few thousand rows, from the training paragraphs alone, so they are broadcast. What has no
        weight leaves no row, so the sums are of the few words that have one.
        """
        names = [f"z{k}" for k in range(len(self.classes))]
        hits = paragraphs.select("uid", F.explode("grams").alias("gram")).join(F.broadcast(self.weights), "gram")
        sums = hits.groupBy("uid").agg(*(F.sum(F.get("w", F.lit(k))).alias(n) for k, n in enumerate(names)))
        both = paragraphs.drop("grams").join(sums, "uid", "left").withColumns(
            {n: F.coalesce(n, F.lit(0.0)) + b for n, b in zip(names, self.intercepts, strict=True)})
        top = F.greatest(*names)
        total = sum((F.exp(F.col(n) - top) for n in names[1:]), F.exp(F.col(names[0]) - top))
        best = F.array_max(F.array(*(F.struct(F.col(n).alias("z"), F.lit(c).alias("c")) for n, c in zip(names, self.classes, strict=True))))
        return both.withColumns({"family": best["c"], "probability": 1 / total}).drop(*names)


@cache
def learned(rows: tuple[tuple[str, bool, tuple[str, ...]], ...]) -> tuple[list[tuple[str, list[float]]], list[float], float]:
    """Weights, intercepts and the least probability, from (class, held out, grams): a thousand rows, on the driver.

    Multinomial logistic regression by proximal gradient steps with momentum; the L1 share of the penalty leaves few
    weights. The least probability is calibrated on held-out paragraphs: of those that are no notice, or of another family, one in FALSE
    comes above it. So what is like no family is unknown.
    """
    classes = [*TEMPLATES, UNKNOWN]
    often = Counter(g for _, held, grams in rows if not held for g in grams)
    place = {g: k for k, g in enumerate(sorted(g for g, n in often.items() if n > 1))}
    x = np.zeros((len(rows), len(place) + 1))
    x[:, -1] = 1
    for k, (_, _, grams) in enumerate(rows):
        x[k, [place[g] for g in grams if g in place]] = 1
    y = np.eye(len(classes))[[classes.index(name) for name, *_ in rows]]
    held = np.array([h for _, h, _ in rows])
    a, t = x[~held], y[~held]
    l1, l2 = PENALTY * L1_SHARE, PENALTY * (1 - L1_SHARE)
    top = np.ones(x.shape[1])
    for _ in range(30):
        top = a.T @ (a @ (top / np.linalg.norm(top)))
    step = 1 / (0.5 * 1.05 * np.linalg.norm(top) / len(a) + l2)

    def chances(w, rows):
        z = rows @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    free = np.zeros((x.shape[1], 1))
    free[-1] = 1  # intercepts are not held down
    w = ahead = np.zeros((x.shape[1], len(classes)))
    pace = 1.0
    for _ in range(ROUNDS):
        g = ahead - step * (a.T @ (chances(ahead, a) - t) / len(a) + l2 * (1 - free) * ahead)
        new = np.sign(g) * np.maximum(np.abs(g) - step * l1 * (1 - free), 0)
        faster = (1 + sqrt(1 + 4 * pace * pace)) / 2
        w, ahead, pace = new, new + (pace - 1) / faster * (new - w), faster
    p, name = chances(w, x[held]), y[held].argmax(axis=1)
    known = len(classes) - 1
    said, sure = p[:, :known].argmax(axis=1), p[:, :known].max(axis=1)
    least = np.quantile(sure[(said != name) | (name == known)], 1 - 1 / FALSE)
    weights = [(g, w[k].tolist()) for g, k in place.items() if w[k].any()]
    return weights, w[-1].tolist(), float(least)


def fit(spark: SparkSession) -> Model:
    """The model of the listed notices. Its words come from the same expression that reads the paragraphs."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("name", T.StringType()), T.StructField("held", T.BooleanType())])
    rows = spark.createDataFrame(training(), schema).coalesce(1).select("name", "held", grams(F.col("text")).alias("grams")).collect()
    weights, intercepts, least = learned(tuple((r.name, r.held, tuple(r.grams)) for r in rows))
    return Model([*TEMPLATES, UNKNOWN], spark.createDataFrame(weights, "gram string, w array<double>"), intercepts, least)


def templates(spark: SparkSession) -> DataFrame:
    """The templates' word pairs: family, template, pairs. A name of one word is that."""
    rows = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, template string")
    all_of = grams(F.col("template"))
    return rows.select("family", "template", F.when(F.size(all_of) == 1, all_of).otherwise(F.filter(all_of, lambda g: g.contains(" "))).alias("pairs"))


def _piece(word: str) -> str:
    """The longest run of letters and digits, which a text that holds the word holds between others."""
    return max(re.findall("[a-z0-9]+", word), key=lambda x: (x not in LITTLE, not x.isdigit(), len(x)))


def telling(templates: list[list[str]]) -> list[list[str]]:
    """For each template's word pairs, words of which a text holds at least one, if it holds CONFIRMED of the pairs.

    Words with letters come first, of those the ones that serve another template, then the longest, so that few and rare ones have to be
    looked for. Short templates choose first.
    """
    out: list[list[str]] = [[] for _ in templates]
    chosen: set[str] = set()
    for k in sorted(range(len(templates)), key=lambda k: len(templates[k])):
        left = list(templates[k])
        for word in sorted({w for p in left for w in p.split()}, key=lambda w: (len(_piece(w)) < 2 or _piece(w).isdigit() or w in LITTLE, w not in chosen, -len(w), w)):
            if len(left) < CONFIRMED * len(templates[k]):
                break
            if rest := [p for p in left if word not in p.split()]:
                if len(rest) == len(left):
                    continue
            out[k].append(word)
            left = rest
        chosen |= set(out[k])
    return out


def blocks(text: Column) -> Column:
    """A text's paragraphs: it is cut at each line end before a blank line, so all but the first begin with one."""
    return F.split(text, "\n(?=[\\x20\\t\\r]*\n)")


def units(block: Column, start: Column) -> Column:
    """A paragraph's lines, and itself, its lines joined and comment signs taken off: struct(paragraph, whole, line).

    `paragraph` is the number of the line, and of the whole one's first line that is not blank; the block begins at line `start`.
    """
    lines = F.split(block, "\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, SIGNS, ""))
    blank = F.coalesce(F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))), True) - 1, F.lit(0))
    one = lambda n, whole, x: F.struct(n.cast("long").alias("paragraph"), F.lit(whole).alias("whole"), x.alias("line"))
    each = F.transform(lines, lambda x, i: one(start + i, False, x))
    return F.concat(each, F.filter(F.array(one(start + blank, True, F.trim(F.array_join(bare, " ")))), lambda x: F.size(lines) - blank > 1))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, unknown: bool = False) -> DataFrame:
    """The licence notices of all texts, a row each: doc_id, paragraph, whole, family, probability, confirmed_share, line.

    Both lines and the paragraphs between blank lines, their lines joined, are scored. `paragraph` is the number of the first
    line, from 0, and `line` the line or the joined paragraph. A paragraph that is mostly a template's words, and holds more of them than any
    of its lines, stands for its lines of that family; any other gives no row if one of its lines alone is a notice of that family.
    A prediction counts if its probability reaches the model's least one, and if a template confirms it: the graded score is the share of a
    template's word pairs that the text holds, and of several templates of the family the best counts, from CONFIRMED on. A paragraph as
    a whole may also have CONFIRMED of its own pairs, LEAST_OWN or more, in a template, if it holds one of that
    template's telling words. What is scored and is no notice is `unknown`; such rows come with unknown=True.
    What holds no telling word of any template cannot be confirmed, so it is not scored: the words are computed so that without them no line
    can hold the share of a template's pairs that confirms it (see telling).

    One pass finds the paragraphs; what is shuffled are their words that have weights. Nulls: a null text has no paragraphs; a null id is
    carried. Of families equally probable the last by name counts. Repeated rows give their notices each. A very long line or paragraph is one row in
    memory, with its words. Other columns are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    model = model or fit(spark)
    listed = templates(spark).collect()
    known = [(r.family, r.pairs, t) for r, t in zip(listed, telling([r.pairs for r in listed]), strict=True)]
    pieces = sorted({_piece(w) for *_, ws in known for w in ws})
    has = lambda c: F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*map(F.lit, pieces)))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(has(F.col("text")))
    counts = F.transform(blocks(F.col("text")), lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit("\n"), F.lit(""))) + 1)
    found = F.filter(F.transform(blocks(F.col("text")), lambda x, i: F.struct(i.alias("k"), x.alias("block"))), lambda x: has(x["block"]))
    parts = docs.withColumn("doc", F.monotonically_increasing_id()).select("doc_id", "doc", counts.alias("counts"), F.explode(found).alias("of"))
    parts = parts.select("doc_id", "doc", "of.*", F.aggregate(F.slice("counts", 1, F.col("of.k")), F.lit(0), lambda a, x: a + x).alias("start"))
    texts = parts.select("doc_id", "doc", "k", F.explode(F.filter(units(F.col("block"), F.col("start")), lambda x: has(x["line"]))).alias("of"))
    texts = cut(texts.select("doc_id", "doc", "k", "of.*")).withColumn("uid", F.monotonically_increasing_id())
    scored = model.scored(texts.withColumn("grams", grams(F.col("line"))))
    said = (F.col("family") != UNKNOWN) & (F.col("probability") >= model.least)
    of = F.broadcast(spark.createDataFrame([(f, [(p, t) for g, p, t in known if g == f]) for f in TEMPLATES],
                                           "named string, templates array<struct<pairs:array<string>,telling:array<string>>>"))
    own = scored.join(of, (F.col("family") == F.col("named")) & said, "left")

    def shares(text: Column) -> Column:
        def share(all_of: Column, own: Column, t: Column) -> Column:
            held = F.size(F.array_intersect(all_of, t["pairs"]))
            part = F.when(F.col("whole") & (F.size(own) >= LEAST_OWN) & F.arrays_overlap(all_of, t["telling"]), held / F.greatest(F.size(own), F.lit(1))).otherwise(0.0)
            return F.struct(F.greatest(held / F.size(t["pairs"]), part).alias("share"), part.alias("part"), held.alias("held"))

        pairs = lambda g: F.filter(g, lambda x: x.contains(" "))
        return _let(grams(text), lambda g: _let(pairs(g), lambda own: F.transform("templates", lambda t: share(g, own, t))))

    # Exploded, so that the shares are values to what follows.
    judged = own.select("*", F.explode_outer(F.when(F.col("named").isNotNull(), F.array(shares(F.col("line"))))).alias("shares"))
    best = judged.withColumns(
        {"confirmed_share": F.array_max("shares")["share"], "tight": F.exists("shares", lambda x: x["part"] >= CONFIRMED),
         "held": F.array_max(F.transform("shares", lambda x: x["held"]))}).withColumn(
        "notice", F.coalesce(F.col("confirmed_share") >= CONFIRMED, F.lit(False))).drop("named", "templates", "shares")
    best = cut(best.withColumn("family", F.when(F.col("notice"), F.col("family")).otherwise(UNKNOWN)))
    key = ["doc", "k", "family"]
    cols = ["doc_id", "paragraph", "whole", "family", "probability", "confirmed_share", "line"]
    lines = best.where("notice AND NOT whole")
    most = lines.groupBy(*key).agg(F.max("held").alias("most"))
    whole = cut(best.where("notice AND whole").join(most, key, "left"))
    tight = whole.where("most IS NULL OR (tight AND held > most)")
    lines = lines.join(tight.select(*key), key, "left_anti")
    out = tight.select(*cols).unionByName(lines.select(*cols))
    return out.unionByName(best.where("NOT notice").select(*cols)) if unknown else out
