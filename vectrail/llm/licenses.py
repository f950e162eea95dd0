"""License scan: a sparse word n-gram logistic regression over paragraphs, confirmed by templates.

Training rows are variations of the families' templates, labelled by construction, and a bounded sample of ordinary
paragraphs of the corpus. The regression (L1, so that few n-grams carry weight) is Spark's own, over a vocabulary and not
hashes: long ordinary units would gather the weights of n-grams that they only collide with. Calibration is held out
by template: a first regression never sees one template of each family, and on that template's variations and on ordinary
paragraphs set aside a temperature is chosen, and the bound below which a prediction becomes "unknown". A prediction also
has to be confirmed: the text resembles one of its family's templates, and none of another family's more. Otherwise it is
unknown too.

A unit is a sentence of a paragraph: lines up to a blank one, without comment marks, joined, so that wrapped notices are
whole; or a sentence of a line by itself. Units of more than SPAN words are read in overlapping spans. The classifier reads
every unit of every document; templates only confirm what it finds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Notices and passages by which the families are announced.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GPLv2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the terms of the ISC License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution-NonCommercial 4.0 license.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution 4.0 license.",
    ),
    "mpl-2.0": (
        "Licensed under the MPL 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org.",
    ),
    "public-domain": (
        "Dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ),
}
FAMILIES = tuple(TEMPLATES)
NONE, UNKNOWN = "none", "unknown"
#: Bound of the labelled sample: ordinary units, about so many in all, and at most so many of a document, of about so many documents.
ORDINARY, OF_DOCUMENT, SAMPLE_DOCS = 1500, 16, 2000
MIN_RESEMBLANCE, MIN_PRECISION = 0.7, 0.99
#: The template of each family that calibration holds out.
HELD_OUT = 1
#: Words of a span of a long unit; the next begins half a span later.
SPAN = 160
#: Most frequent n-grams of ordinary units that the vocabulary has beside all those of the templates.
FEATURES = 1 << 12
_OTHER = "[^a-z0-9]+"
#: Comment marks and blanks at a line's beginning and at its end; the second is tried only where a blank or a mark begins.
_BEFORE = "(?m)^[ \\t]*(?:/\\*+|\\*+/?|//+|#+|--+|;+|%+|<!--|>)?[ \\t]*"
_AFTER = "(?m)(?:(?<![ \\t])[ \\t]++(?:\\*++/|-->)?|(?<!\\*)\\*++/|-->|(?=\\r))[ \\t\\r]*$"
_SENTENCE = " (?<=[.!?] ) *(?=\\p{Lu})"


def _plain(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def variations() -> list[tuple[str, str, int]]:
    """(family, text, number of the template): each template whole, without each of its words, and its beginnings of at least 70 %."""
    out = []
    for family, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = text.split()
            out += [(family, text, k)] * 4
            out += [(family, " ".join(words[:i] + words[i + 1 :]), k) for i in range(len(words)) if len(words) > 4]
            out += [(family, " ".join(words[:n]), k) for n in range(max(3, math.ceil(0.7 * len(words))), len(words))]
    return out


def grams(tok: Column) -> Column:
    """The tokens and the pairs of neighbours; the last token, which has no next one, is there twice."""
    return F.concat(tok, F.zip_with(tok, F.slice(tok, 2, F.size(tok)), lambda a, b: F.concat_ws(" ", a, b)))


def vocabulary(ordinary: DataFrame) -> list[str]:
    """All n-grams of the templates, and the FEATURES n-grams that most of the ordinary units (tok) hold."""
    texts = [_plain(t) for texts in TEMPLATES.values() for t in texts]
    own = {g for w in texts for g in (*w, *map(" ".join, zip(w, w[1:], strict=False)))}
    held = ordinary.select(F.explode(F.array_distinct(grams(F.col("tok")))).alias("g")).groupBy("g").count()
    return sorted(own | {r.g for r in held.orderBy(F.desc("count"), "g").limit(FEATURES).collect()})


def resemblance(found: Column, family: str) -> Column:
    """Largest part of one of the family's templates' distinct tokens that the given tokens hold."""
    scores = []
    for text in TEMPLATES[family]:
        words = sorted(set(_plain(text)))
        shared = F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in words])))
        scores.append(shared / F.lit(float(len(words))))
    return F.greatest(*scores)


@dataclass
class LicenseModel:
    pipeline: PipelineModel
    classes: tuple[str, ...]
    temperature: float
    bound: float

    def score(self, units: DataFrame) -> DataFrame:
        """Those of units (tok) whose class isn't NONE, with p, the calibrated probabilities by class."""
        raw = vector_to_array(F.col("rawPrediction"))
        scaled = F.transform(raw, lambda x: x / F.lit(self.temperature))
        d = self.pipeline.transform(units.withColumn("grams", grams(F.col("tok"))))
        # a lambda over one element: the scores of a unit are made once
        d = d.filter(F.exists(F.array(raw), lambda z: F.element_at(z, 1) < F.array_max(z))).withColumn("_z", scaled)
        d = d.withColumn("_e", F.transform("_z", lambda x: F.exp(x - F.array_max("_z"))))
        d = d.withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
        d = d.withColumn("p", F.transform("_e", lambda x: x / F.col("_s")))
        return d.drop("grams", "features", "rawPrediction", "probability", "prediction", "_z", "_e", "_s")


def units(text: Column) -> Column:
    """Array of the units of a text, as arrays of tokens."""
    pieces = lambda x: F.array_union(F.transform(F.split(x, "\\n\\s*\\n"), lambda y: F.replace(y, F.lit("\n"), F.lit(" "))), F.split(x, "\n+"))
    # a lambda over one element: the text without marks is made once, for its paragraphs and its lines
    plain = F.regexp_replace(F.regexp_replace(text, _BEFORE, ""), _AFTER, "")
    sentences = F.flatten(F.transform(F.flatten(F.transform(F.array(plain), pieces)), lambda x: F.split(x, _SENTENCE)))
    # distinct as strings, which are hashed; arrays of arrays would be compared pair by pair
    found = F.transform(F.array_distinct(F.transform(sentences, lambda x: F.trim(F.regexp_replace(F.lower(x), _OTHER, " ")))), lambda x: F.split(x, " "))
    half = SPAN // 2
    spans = F.flatten(F.transform(found, lambda t: F.when(F.size(t) <= SPAN, F.array(t)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / half)), lambda i: F.slice(t, (i * half + 1).cast("int"), SPAN)))))
    return F.filter(spans, lambda t: F.element_at(t, 1) != "")


def _calibrated(z: list[float], t: float) -> list[float]:
    e = [math.exp((x - max(z)) / t) for x in z]
    return [x / sum(e) for x in e]


def confirmed(scores: Column, family: Column) -> Column:
    """Whether the resemblances, by family, confirm a family."""
    own = F.element_at(scores, F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), family).cast("int"))
    return (own >= MIN_RESEMBLANCE) & (own >= F.array_max(scores))


def calibrate(held: list[tuple[int, list[float], set[int]]]) -> tuple[float, float]:
    """(temperature, bound) from held-out (class, raw scores, classes that the templates confirm): the temperature of the
    largest likelihood, and the least probability from which confirmed predictions are right MIN_PRECISION of the time; 1
    if there is none."""
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=lambda t: -sum(math.log(max(_calibrated(z, t)[y], 1e-12)) for y, z, _ in held))
    made = [(max(p), p.index(max(p)) == y) for y, z, sure in held if (p := _calibrated(z, temperature)).index(max(p)) in sure]
    made.sort(key=lambda x: -x[0])
    right, bound = 0, 1.0
    for n, (p, ok) in enumerate(made, 1):
        right += ok
        if right >= MIN_PRECISION * n and (n == len(made) or made[n][0] < p):  # equal ones count together
            bound = p
    return temperature, bound


def train(docs: DataFrame) -> LicenseModel:
    """Fit on template variations and about ORDINARY sampled units of docs (doc_id, text)."""
    spark = docs.sparkSession
    step = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.lit(3)), F.lit(step)) == 0).filter("text is not null")
    lines = sample.select("doc_id", F.explode(F.array(units(F.col("text")))).alias("u"))  # made once, for its size and its elements
    lines = lines.select("doc_id", F.size("u").alias("n"), F.explode("u").alias("tok"))
    share = F.lit(OF_DOCUMENT) / F.col("n")
    pick = lambda seed: F.pmod(F.xxhash64("doc_id", "tok", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    alike = F.greatest(*[resemblance(F.col("tok"), f) for f in FAMILIES])
    lines = materialize(lines.filter((pick(4) < share) & (alike < 0.4)).select("doc_id", "tok"), "ordinary")
    lines = lines.filter(pick(5) < F.lit(ORDINARY / max(1, lines.count())))  # no sort
    positive_rows = [(f, _plain(t), i, k == HELD_OUT) for i, (f, t, k) in enumerate(variations())]
    positive = spark.createDataFrame(positive_rows, "family string, tok array<string>, i long, held boolean")
    i = F.xxhash64("doc_id", "tok")
    rows = positive.unionByName(lines.select(F.lit(NONE).alias("family"), "tok", i.alias("i"), (F.pmod(F.xxhash64(i, F.lit(7)), F.lit(4)) == 0).alias("held")))
    classes = (NONE, *FAMILIES)
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    # every family weighs as much as any other, the ordinary units as much as all of them
    counts = {f: sum(x == f for x, _, _ in variations()) for f in FAMILIES}
    weight = F.lit(len(positive_rows) / ORDINARY)
    for f, n in counts.items():
        weight = F.when(F.col("family") == f, F.lit(len(positive_rows) / len(FAMILIES) / n)).otherwise(weight)
    rows = materialize(rows.withColumn("grams", grams(F.col("tok"))).withColumn("label", label).withColumn("weight", weight), "labelled")
    stages = [
        CountVectorizerModel.from_vocabulary(vocabulary(lines), inputCol="grams", outputCol="features", binary=True),
        LogisticRegression(maxIter=20, regParam=0.0005, elasticNetParam=1.0, family="multinomial", standardization=False, weightCol="weight"),
    ]
    first = Pipeline(stages=stages).fit(rows.filter("not held"))
    out = first.transform(rows.filter("held")).withColumn("like", F.array(*[resemblance(F.col("tok"), f) for f in FAMILIES]))
    ok = F.array(*[confirmed(F.col("like"), F.lit(f)) for f in FAMILIES])
    held = [(int(r.label), list(r.z), {1 + k for k, x in enumerate(r.ok) if x}) for r in out.select("label", vector_to_array("rawPrediction").alias("z"), ok.alias("ok")).collect()]
    return LicenseModel(Pipeline(stages=stages).fit(rows), classes, *calibrate(held))


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, at, family, probability, resemblance of the units of docs that announce a license."""
    found = docs.select("doc_id", F.posexplode(units(F.col("text"))).alias("at", "tok"))
    s = model.score(found).withColumn("top", F.array_max("p")).withColumn("k", F.array_position("p", F.array_max("p")).cast("int"))
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("k"))
    s = s.withColumn("family", family).withColumn("like", F.array(*[resemblance(F.col("tok"), f) for f in FAMILIES]))
    own = F.element_at("like", F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("int"))
    sure = (F.col("top") >= model.bound) & confirmed(F.col("like"), F.col("family"))
    s = s.withColumn("resemblance", own)
    return s.select("doc_id", "at", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), F.col("top").alias("probability"), "resemblance")


def document_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, family, n_paragraphs, probability, resemblance of every row of docs (doc_id, text).

    family is that of the most probable confirmed paragraph, "unknown" if paragraphs look like a license but none is
    confirmed, "none" without any. Null and blank texts are "none"; repeated rows are each returned; rows with null
    doc_id share one result; of units that tie the family later in the alphabet is named. Very long texts are cut into units
    of at most SPAN words; other columns are ignored. An empty table gives an empty result.
    """
    d = docs.select("doc_id", "text")
    if d.isEmpty():
        return d.sparkSession.createDataFrame([], "doc_id bigint, family string, n_paragraphs bigint, probability double, resemblance double")
    found = scan(d, train(d))
    rank = F.struct((F.col("family") != UNKNOWN).alias("sure"), "probability", "resemblance", "family")
    best = found.groupBy(F.col("doc_id").alias("_id")).agg(F.max(rank).alias("b"), F.count("*").alias("n"))
    out = d.select("doc_id").join(best, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select(
        "doc_id", F.coalesce("b.family", F.lit(NONE)).alias("family"), F.coalesce("n", F.lit(0)).alias("n_paragraphs"),
        F.round(F.coalesce("b.probability", F.lit(0.0)), 3).alias("probability"), F.round(F.coalesce("b.resemblance", F.lit(0.0)), 3).alias("resemblance"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licenses(table(spark, sf_dir, "documents"))
