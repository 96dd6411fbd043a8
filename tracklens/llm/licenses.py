"""Licence scan: a trained paragraph classifier, with DataFrame and ML functions of the JVM only.

A paragraph is what stands between blank lines, its line breaks taken as blanks, so that a wrapped notice is whole. A
long one is looked at in overlapping windows of words, so that a notice within prose is not drowned. They are scored by
a sparse multinomial logistic regression over word 1- to 3-grams, fitted on notices of each licence family, cut and
joined in many ways, against paragraphs of the corpus. How far the best family's score must lead the unknown class's is
calibrated on held-out examples, and a prediction counts once the paragraph covers most of a template sentence of that
family.

No n-gram of stop words alone is a feature, so a paragraph without any word of the weights' vocabulary has the
unknown class's constant score and is left out before any n-gram is built. Weights and templates are tables of a few
thousand rows at most, whatever the corpus holds.
"""

from __future__ import annotations

import json

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, written

# Opening sentences of public licence notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "under the terms of the MIT License",
        "distributed under the MIT License",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "under the terms of the Apache License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "under the terms of the BSD License",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "under the terms of the Mozilla Public License",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "public domain": [
        "Released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential.",
        "No part of this document may be reproduced without written permission.",
    ],
}
# Sentences with words of licences that are none.
OTHERS = [
    "She renewed her driving license at the public office.",
    "The general took a copy of the map and the source of the river was free of ice.",
    "Students of the institute released a new version of the work.",
    "The software was written by a group of people with permission of the author.",
    "An Apache helicopter was used in the film, version two of the story.",
    "The foundation published a library of public works.",
    "All rights and duties of the members are reserved for the meeting.",
    "Commercial use of the land is under review, no conditions are met.",
    "The copyright of the song was sold, the contract says.",
]
UNKNOWN = "unknown"
WINDOW, STRIDE = 64, 32  # words; any sentence of up to WINDOW - STRIDE words is whole in some window


@dataclass(frozen=True)
class LicenceModel:
    families: list[str]  # the last is UNKNOWN
    intercepts: list[float]
    weights: dict[str, list[float]]  # by n-gram, a weight for each family
    slope: float
    offset: float


def words_of(text: Column) -> Column:
    """Words in lower case; a licence is a license."""
    spelled = F.regexp_replace(F.lower(text), "licen[cs]e", "license")
    return F.filter(F.split(spelled, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows_of(text: Column) -> Column:
    """An array of (paragraph, window, words): the paragraphs, from 0, and the windows of each."""
    blocks = F.split(text, r"\n[ \t\r]*\n\s*")

    def cut(block, number):
        words = words_of(block)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - (WINDOW - STRIDE) - 1), F.lit(STRIDE))
        return F.transform(F.array(words), lambda w: F.transform(starts, lambda at: F.struct(number.cast("int").alias("paragraph"), (at / STRIDE).cast("int").alias("window"), F.slice(w, at + 1, WINDOW).alias("words"))))[0]

    return F.flatten(F.transform(blocks, cut))


def ngrams(words: Column, n: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def _features(words: Column) -> Column:
    return F.array_distinct(F.concat(*[ngrams(words, n) for n in (1, 2, 3)]))


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small fixed table, as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _examples() -> list[dict]:
    out = []
    for family, sentences in TEMPLATES.items():
        for k, sentence in enumerate(sentences):
            words = sentence.split()
            out += [{"t": sentence, "y": family}] * 6
            out.append({"t": f"{sentence} {sentences[(k + 1) % len(sentences)]}", "y": family})
            out.append({"t": f"Copyright 2020 The Authors. {sentence}", "y": family})
            out += [{"t": " ".join(words[i : i + 9]), "y": family} for i in range(0, len(words) - 8, 3)]
    return out + [{"t": t, "y": UNKNOWN} for t in OTHERS for _ in range(3)]


def fit_licences(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400) -> LicenceModel:
    """Fits on the templates and all windows of all paragraphs of at most sample_rows hashed documents.

    Windows of the corpus with a 3-gram of a template are left out of the unknown class.
    """
    spark = documents.sparkSession
    known = _table(spark, _examples(), "t string, y string").select(words_of(F.col("t")).alias("words"), "y")
    templates = known.filter(F.col("y") != UNKNOWN).select(F.explode(ngrams(F.col("words"), 3)).alias("g")).distinct()
    grams = [r["g"] for r in templates.collect()]  # of the templates: a few hundred
    docs = hashed_sample(documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), F.col("_id"), sample_rows)
    words = docs.select(F.explode(windows_of(F.col("_text"))).alias("x")).select("x.words").filter("size(words) > 0")
    background = words.filter(~F.arrays_overlap(ngrams(F.col("words"), 3), F.lit(grams))).select("words", F.lit(UNKNOWN).alias("y"))
    families = [*TEMPLATES, UNKNOWN]
    index = F.array_position(F.lit(families), F.col("y")) - 1
    rows = known.unionByName(background).select(_features(F.col("words")).alias("f"), index.cast("double").alias("label"), (F.pmod(F.xxhash64("words"), F.lit(4)) == 0).alias("held"))
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    kept = F.filter("f", lambda g: ~F.forall(F.split(g, " "), lambda w: w.isin(*sorted(stop))))
    rows = written(rows.select(kept.alias("f"), "label", "held"), "licence-examples")
    vectors = CountVectorizer(inputCol="f", outputCol="features", binary=True, minDF=2, vocabSize=20_000).fit(known.select(_features(F.col("words")).alias("f")).select(kept.alias("f")))
    data = vectors.transform(rows)
    fit = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.0003, maxIter=80, standardization=False).fit(data.filter("not held"))
    matrix, intercepts = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray().tolist()
    if len(intercepts) != len(families):  # only where a class had no rows, which the templates exclude
        raise ValueError("a licence family has no examples")
    weights = {g: [round(float(x), 6) for x in matrix[:, j]] for j, g in enumerate(vectors.vocabulary) if abs(matrix[:, j]).max() > 1e-6}
    model = LicenceModel(families, intercepts, weights, 1.0, 0.0)
    # Calibration: by how much the best family leads, against whether the row has a licence, on rows kept from the fit.
    u = len(families) - 1
    lead = _lead(model, F.col("f"))
    margin = data.filter("held").select(lead.alias("x"), (F.col("label") != u).cast("double").alias("label"))
    held = margin.groupBy().agg(F.min("label"), F.max("label")).first()
    if held[0] == held[1]:
        return model
    from pyspark.ml.feature import VectorAssembler

    line = LogisticRegression(regParam=0.01).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(margin))
    return LicenceModel(families, intercepts, weights, float(line.coefficients[0]), float(line.intercept))


def _lead(model: LicenceModel, features: Column) -> Column:
    """The best family's score less the unknown class's; for a handful of rows."""
    table = F.from_json(F.lit(json.dumps(model.weights)), "map<string, array<double>>")
    start = F.array(*[F.lit(float(x)) for x in model.intercepts])
    sums = F.aggregate(F.array_intersect(features, F.map_keys(table)), start, lambda acc, g: F.zip_with(acc, table[g], lambda a, b: a + b))
    return F.array_max(F.slice(sums, 1, len(model.families) - 1)) - F.element_at(sums, -1)


def scan_paragraphs(documents: DataFrame, model: LicenceModel, *, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.8) -> DataFrame:
    """(id, text_key, paragraph, window, family, probability, coverage, confirmed): the windows of paragraphs in which
    a licence is predicted. text_key (xxhash64 of the text) tells rows apart that share an id; equal rows count once.
    Null texts and ids have none.
    """
    spark, u = documents.sparkSession, len(model.families) - 1
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    content = sorted({w for g in model.weights for w in g.split(" ")} - stop)
    weights = _table(spark, [{"g": g, **{f"w{i}": x for i, x in enumerate(ws)}} for g, ws in model.weights.items()], "g string, " + ", ".join(f"w{i} double" for i in range(u + 1)))
    place = ["_id", "_key", "paragraph", "window"]
    cut = documents.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.explode(windows_of(F.col(text_col))).alias("_x")).select("_id", "_key", "_x.*")
    candidates = cut.filter(F.arrays_overlap("words", F.lit(content)))
    grams = candidates.select(*place, F.explode(_features(F.col("words"))).alias("g"))
    # The weights have as many rows as the templates have n-grams, a few thousand at most. Few n-grams have one, so only
    # those are dealt out, once for rows that repeat.
    sums = grams.join(F.broadcast(weights), "g").dropDuplicates([*place, "g"]).groupBy(*place).agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(u + 1)])
    scores = F.array(*[F.col(f"s{i}") + float(b) for i, b in enumerate(model.intercepts[:u])])
    best = F.array_max(scores)
    lead = best - (F.col(f"s{u}") + float(model.intercepts[u]))
    probability = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), lead * model.slope + model.offset))))
    at = F.array_position(scores, best).cast("int")
    predicted = sums.select(*place, F.element_at(F.lit(model.families), at).alias("family"), probability.alias("probability")).filter("probability >= 0.5")

    # Template comparison, for predicted windows only: the share of a sentence's 2-grams that the window has.
    sentences = _table(spark, [{"family": f, "s": s} for f, ss in TEMPLATES.items() for s in ss], "family string, s string").select("family", ngrams(words_of(F.col("s")), 2).alias("_sentence"))
    pairs = candidates.select(*place, ngrams(F.col("words"), 2).alias("_grams")).join(predicted, place).join(F.broadcast(sentences), "family")
    share = F.size(F.array_intersect("_grams", "_sentence")) / F.size(F.array_distinct("_sentence"))
    return (
        pairs.groupBy(*place, "family", "probability").agg(F.max(share).alias("coverage"))
        .select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), "paragraph", "window", "family", F.round("probability", 6).alias("probability"), F.round("coverage", 6).alias("coverage"), (F.col("coverage") >= coverage).alias("confirmed"))
    )


def document_licences(documents: DataFrame, model: LicenceModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licence, licences, probability, coverage, paragraphs) for every row: the surest confirmed licence (that of
    the first paragraph on ties), else "unknown" where one is predicted but not confirmed, else "none"; licences are
    all confirmed families, sorted; paragraphs counts those in which a licence is predicted."""
    found = scan_paragraphs(documents, model, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "_id")
    surest = found.groupBy("_id", F.col("text_key").alias("_key")).agg(
        F.max(F.struct("confirmed", "probability", "coverage", (-F.col("paragraph")).alias("minus"), "family")).alias("_best"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("_all"), F.count_distinct("paragraph").alias("_n"),
    )
    rows = documents.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_text"))
    rows = rows.join(surest, (F.col("_doc") == F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    licence = F.when(F.col("_best").isNull(), "none").when(F.col("_best.confirmed"), F.col("_best.family")).otherwise(UNKNOWN)
    return rows.select(
        F.col("_doc").alias(id_col), licence.alias("licence"), F.coalesce("_all", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("_best.probability", F.lit(0.0)).alias("probability"), F.coalesce("_best.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("_n", F.lit(0)).alias("paragraphs"),
    )
