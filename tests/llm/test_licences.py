import pytest
from pyspark.sql import functions as F

from kindred.llm import licences as L


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark)


def test_held_out_accuracy(spark, model):
    """On croppings of another seed, and none of the other paragraphs taken for a licence."""
    rows = spark.createDataFrame(L.training(99), "text string, name string, held boolean").withColumn("grams", L.grams(F.col("text")))
    got = model.scored(rows.withColumn("uid", F.monotonically_increasing_id())).toPandas()
    got["pred"] = got.family.where(got.probability >= model.least, L.UNKNOWN)
    assert (got.pred == got.name).mean() > 0.97
    assert (got[got.name == L.UNKNOWN].pred == L.UNKNOWN).mean() > 0.98


def test_sparse(model):
    rows = model.weights.collect()
    assert 50 < len(rows) < 1000 and sum(x == 0 for r in rows for x in r.w) > len(rows) * len(model.classes) / 2


def test_scan(spark, model):
    rows = [(1, "Intro.\nReleased under the MIT License.\nEnd"), (2, "All rights reserved."), (3, "licensed under the apache license,  version 2.0!"), (None, "SPDX-License-Identifier: MIT"),
            (4, None), (5, ""), (6, "word " * 100_000 + "\nLicensed under CC BY-NC 4.0."), (1, "Intro.\nReleased under the MIT License.\nEnd"), (7, "The license of the fishing boat is new."),
            (8, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, paragraph int, family string").repartition(3)
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in L.scan(df, model=model).collect()), key=str)
    assert got == sorted([(1, 1, "MIT"), (1, 1, "MIT"), (3, 0, "Apache-2.0"), (None, 0, "MIT"), (6, 1, "CC-BY-NC"), (8, 0, "Apache-2.0"), (8, 1, "GPL")], key=str)


def test_confirmation_is_needed(spark, model):
    df = spark.createDataFrame([(1, "gpl gpl license gnu public license general gnu gpl")], "doc_id long, text string")
    assert L.scan(df, model=model).count() == 0


MIT = """The MIT License (MIT)

Copyright (c) 2020 A. Nonymous

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
BSD = """Copyright (c) 2020, A. Nonymous
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
"""


def test_wrapped_notices(spark, model):
    rows = [(1, MIT), (2, BSD), (3, APACHE), (4, GPL)]
    got = {(r.doc_id, r.paragraph, r.family) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    assert {(1, 4, "MIT"), (2, 3, "BSD"), (4, 0, "GPL")} <= got
    assert {f for k, _, f in got if k == 3} == {"Apache-2.0"} and {(k, f) for k, _, f in got} == {(1, "MIT"), (2, "BSD"), (3, "Apache-2.0"), (4, "GPL")}


LINES = ["You may not use the material for commercial purposes.", "This is free and unencumbered software released into the",
         "All copyright and related or neighboring rights to this work are waived by the author to the extent possible under law."]


def test_prefilter_loses_nothing(spark, model):
    """As if all lines were scored: those that the model and the templates accept are found."""
    texts = [*LINES, *(t for t, _, _ in L.training(99))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = model.scored(df.withColumnRenamed("doc_id", "uid").withColumn("grams", L.grams(F.col("text"))))
    own = scored.withColumn("own", L.grams(F.col("text"))).join(L.templates(spark), "family")
    sure = own.where((F.col("probability") >= model.least) & (F.size(F.array_intersect("own", "pairs")) / F.size("pairs") >= L.CONFIRMED))
    want = {(r.uid, r.family) for r in sure.select("uid", "family").distinct().collect()}
    assert any(k < len(LINES) for k, _ in want)
    assert want <= {(r.doc_id, r.family) for r in L.scan(df, model=model).collect()}


def test_empty(spark, model):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string"), model=model).count() == 0


def test_whole_notices_held_out(spark, model):
    """No training row is made of these."""
    rows = [r for r in L.training(7) if r[2]]
    assert not {t for t, _, _ in rows} & {t for t, _, held in L.training(7) if not held}
    df = spark.createDataFrame(rows, "text string, name string, held boolean").withColumn("grams", L.grams(F.col("text")))
    got = model.scored(df.withColumn("uid", F.monotonically_increasing_id())).toPandas()
    pred = got.family.where(got.probability >= model.least, L.UNKNOWN)
    known = got.name != L.UNKNOWN
    assert (pred[known] == got.name[known]).mean() >= 0.9 and (pred[~known] == L.UNKNOWN).mean() >= 1 - 1 / L.FALSE - 0.02


# Notices as projects write them, in no list of the module.
WILD = [
    ("MIT", "Foo is MIT licensed."), ("MIT", "This repository is released under the MIT License. See LICENSE for details."), ("MIT", "MIT licence; see COPYING"),
    ("MIT", "The code in this directory is available under the MIT license."), ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "Source code is offered under Apache 2.0, see LICENSE.txt."), ("GPL", "Code is licensed under GPLv3."),
    ("GPL", "The plugin is released under the GNU General Public License, version 2."), ("LGPL", "The library is distributed under the GNU Lesser General Public License."),
    ("AGPL", "This server is free software under the GNU Affero General Public License."), ("BSD", "This module is BSD licensed."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Distributed under the terms of the 3-clause BSD License."), ("MPL-2.0", "Parts of this package fall under the Mozilla Public License, version 2.0."),
    ("EUPL", "The software is published under the European Union Public Licence."), ("BSL-1.0", "The headers are covered by the Boost Software License, Version 1.0."),
    ("CC-BY", "The text is licensed under CC BY 4.0, the code is not."), ("CC-BY-NC", "Images may be reused under CC BY-NC 4.0."),
    ("CC-BY-SA", "Wiki content is available under the Creative Commons Attribution-ShareAlike License."), ("CC0", "The data are released under CC0 1.0."),
    ("ISC", "This package is released under the ISC license."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
            ' IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE.'),
]
PROSE = ["The licence of the boat was renewed.", "The general public likes the new software version.", "All permission slips must be signed by the conditions of the school.",
         "The committee released its report under pressure.", "A copy of the public record may be obtained at the office.", "Creative work is common at the foundation."]


def test_notices_in_the_wild(spark, model):
    rows = [(k, t) for k, (_, t) in enumerate(WILD)] + [(1000 + k, t) for k, t in enumerate(PROSE)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model=model).collect()
    found = {(r.doc_id, r.family) for r in got}
    missed = [(f, t) for k, (f, t) in enumerate(WILD) if (k, f) not in found]
    assert len(missed) <= 0.1 * len(WILD), missed
    assert sum((k, f) not in {(j, WILD[j][0]) for j in range(len(WILD))} for k, f in found if k < 1000) <= 2
    assert not [r for r in got if r.doc_id >= 1000]


def test_unknown_is_told(spark, model):
    """What is scored and no notice comes as unknown; what holds no telling word is not scored; lines are counted through paragraphs."""
    rows = [(1, "First words.\n\nSecond one\nReleased under the MIT License.\n \nThe restaurant lost its license to sell alcohol."), (2, "nothing here"), (3, None), (4, "")]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model, unknown=True).collect() if not r.whole)
    assert got == [(1, 3, "MIT"), (1, 5, "unknown")]
