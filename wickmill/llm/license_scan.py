"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the ``\\n``-split parts of a text. Their features are the presence of lower-case word unigrams and bigrams. A
multinomial logistic regression with an L1 penalty tells licence families and ``unknown`` apart. It is trained here on the
templates (whole and cut) and on background paragraphs drawn from the corpus; a temperature, chosen on rows kept aside,
calibrates its probabilities. A paragraph gets a family when that is the likeliest class with at least ``SURE``, and some template
of that family has at least ``CONFIRM`` of its bigrams in the paragraph; otherwise it is unknown.

A confirmed paragraph must hold most bigrams of a template, so it holds one of that template's anchor words, which
are chosen such that the bigrams without one are too few. Texts without any anchor need no scoring; that drops nothing.

Everything is DataFrame functions on one row at a time, and Spark's own learner. The background is a bounded sample:
``MOST_BACKGROUND`` paragraphs of the ``BACKGROUND_DOCS`` documents with the smallest hash of their id. Every paragraph of every text is scanned.

Defined cases: null or empty text has no paragraph with a licence; equal probabilities fall to the family first by name; repeated
rows give equal rows; an empty corpus trains on the fixed negatives alone; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickmill.llm.common import stored

SURE = 0.5
CONFIRM = 0.6
BACKGROUND_DOCS, MOST_BACKGROUND = 200, 1_500
VOCABULARY = 4_096
UNKNOWN = "unknown"
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)

# Usual short notices of licence families.
TEMPLATES = {
    "agpl": [
        "GNU Affero General Public License version 3",
        "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "GNU Lesser General Public License version 2.1",
        "This library is free software under the terms of the GNU Lesser General Public License",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved",
        "This document is confidential and proprietary; unauthorized copying is strictly prohibited",
    ],
    "public-domain": [
        "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal",
        "This work has been released into the public domain",
    ],
}
# Sentences with licence words that state no licence.
NEGATIVES = [
    "Please renew your driver license before the end of the month",
    "The MIT campus lies on the river and is open to the public",
    "The rights of tenants are reserved for the court to decide",
    "The public library opens at nine and copying is free of charge",
    "An apache helicopter landed under heavy rain",
    "The general public was invited to the foundation",
    "Their work is licensed by the city every year",
    "Version 2.0 of the program was released in May",
    "The commons debated the creative industries bill",
    "He was granted permission to use the source",
    "Modification of the building is permitted under the law",
    "Cc the author by mail",
]
FAMILIES = [*sorted(TEMPLATES), UNKNOWN]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    return F.when(
        F.size(tokens) > 1, F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda k: F.concat_ws(" ", F.get(tokens, k), F.get(tokens, k + 1)))
    ).otherwise(F.array().cast("array<string>"))


def features(text: Column) -> Column:
    return F.array_distinct(F.transform(F.array(words(text)), lambda w: F.concat(w, bigrams(w)))[0])


def _plain(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _pairs(tokens: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(tokens, tokens[1:])})


def _cuts(text: str) -> list[str]:
    """A template whole, without its first or last fifth, and doubled in an ordinary frame."""
    tokens = text.split()
    fifth = max(1, len(tokens) // 5)
    whole = [text, text.upper(), f"Notice. {text}. More text follows here.", f"{text} {text}"]
    return whole + ([" ".join(tokens[fifth:]), " ".join(tokens[:-fifth])] if len(tokens) > 4 else [])


def training_rows(docs: DataFrame) -> DataFrame:
    """text, label (number of the family), part: templates, fixed negatives and the background sample."""
    spark = docs.sparkSession
    fixed = [(cut, k) for k, family in enumerate(FAMILIES[:-1]) for t in TEMPLATES[family] for cut in _cuts(t)]
    fixed += [(t, len(FAMILIES) - 1) for t in NEGATIVES for _ in range(3)]
    rows = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(k).alias("label")) for t, k in fixed))
    told = spark.range(1, numPartitions=1).select(F.explode(rows).alias("r")).select("r.*")
    some = docs.where("text IS NOT NULL").select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(BACKGROUND_DOCS)
    lines = some.select(F.explode(F.split("text", "\n", -1)).alias("text")).where(F.length("text").between(1, 2_000))
    # A paragraph that a template would confirm is no background.
    held = F.greatest(*(_held(F.col("text"), _pairs(_plain(t))) for ts in TEMPLATES.values() for t in ts))
    background = lines.where(held < CONFIRM).orderBy(F.xxhash64("text"), "text").limit(MOST_BACKGROUND)
    every = told.unionByName(background.select("text", F.lit(len(FAMILIES) - 1).alias("label")))
    return every.withColumn("part", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(4)))


def _held(text: Column, pairs: list[str]) -> Column:
    """Share of a template's bigrams that the paragraph has."""
    return F.size(F.array_intersect(features(text), F.array(*map(F.lit, pairs)))) / F.lit(float(len(pairs)))


def train(docs: DataFrame) -> dict:
    """Coefficients that are not zero, by n-gram; intercepts; the temperature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    # A few thousand rows by the two limits: one partition keeps the learner's many small steps cheap.
    rows = stored(training_rows(docs).withColumn("grams", features(F.col("text"))), "licence-training").coalesce(1).cache()
    vocabulary = CountVectorizer(inputCol="grams", outputCol="x", vocabSize=VOCABULARY, minDF=2.0, binary=True).fit(rows)
    counted = vocabulary.transform(rows)
    learner = LogisticRegression(
        featuresCol="x", labelCol="label", family="multinomial", regParam=0.0005, elasticNetParam=0.9, maxIter=50, standardization=False
    )
    model = learner.fit(counted.where("part > 0"))
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    some = abs(matrix).sum(axis=0) > 1e-9
    weights = {g: [float(v) for v in matrix[:, k]] for k, g in enumerate(vocabulary.vocabulary) if some[k]}
    # Classes that the rows did not show keep the least intercept.
    found = {"weights": weights, "intercepts": [float(v) for v in intercepts], "temperature": 1.0}
    logits = _logits(F.col("grams"), found)
    losses = [
        F.avg(-F.log(F.greatest(_softmax(logits, t)[F.col("label")], F.lit(1e-9)))).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)
    ]
    row = rows.where("part = 0").agg(*losses).first()
    found["temperature"] = min(((v, t) for v, t in zip(row, TEMPERATURES) if v is not None), default=(0, 1.0))[1]
    rows.unpersist()
    return found


def _logits(grams: Column, model: dict) -> Column:
    keys = list(model["weights"])
    vector = lambda values: F.array(*map(F.lit, values))
    if not keys:
        return vector(model["intercepts"])
    table = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(vector, model["weights"].values())))
    present = F.array_intersect(grams, F.array(*map(F.lit, keys)))
    return F.aggregate(
        F.transform(present, lambda g: table[g]), vector(model["intercepts"]), lambda total, w: F.zip_with(total, w, lambda a, b: a + b)
    )


def _softmax(logits: Column, temperature: float) -> Column:
    raised = lambda all_: F.transform(all_, lambda v: F.exp((v - F.array_max(all_)) / temperature))
    shared = lambda powers: F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda s, p: s + p))
    once = lambda value, use: F.transform(F.array(value), use)[0]
    return once(once(logits, raised), shared)


def anchors() -> list[str]:
    """Words of which every paragraph that can be confirmed holds one.

    For each template, its rarest-looking words (longest first) until the bigrams without one are below the share to confirm.
    """
    chosen: set[str] = set()
    for template in (t for ts in TEMPLATES.values() for t in ts):
        tokens = _plain(template)
        pairs = _pairs(tokens)
        for word in sorted(set(tokens), key=lambda w: (w not in chosen, -len(w), w)):
            if sum(not set(p.split()) & chosen for p in pairs) < CONFIRM * len(pairs):
                break
            chosen.add(word)
    return sorted(chosen)


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_paragraphs, licences (families found, in order) and hits (``family:paragraph:per mille``) of every document."""
    model = model or train(docs)
    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(anchors()) + r")(?![a-z0-9])"
    once = lambda value, use: F.transform(F.array(value), use)[0]
    name = lambda k: F.get(F.array(*map(F.lit, FAMILIES)), k)

    def confirmed(grams: Column, family: Column) -> Column:
        share = F.lit(0.0)
        for f, templates in TEMPLATES.items():
            best = F.greatest(
                F.lit(0.0),
                *(F.size(F.array_intersect(grams, F.array(*map(F.lit, p)))) / F.lit(float(len(p))) for p in map(_pairs, map(_plain, templates))),
            )
            share = F.when(family == f, best).otherwise(share)
        return share >= CONFIRM

    def judged(paragraph: Column) -> Column:
        def verdict(grams: Column) -> Column:
            def chosen(p: Column) -> Column:
                best = F.array_position(p, F.array_max(p)).cast("int") - 1
                family = F.when((F.array_max(p) >= SURE) & confirmed(grams, name(best)), name(best)).otherwise(F.lit(UNKNOWN))
                return F.struct(family.alias("family"), F.array_max(p).alias("p"))

            return once(_softmax(_logits(grams, model), model["temperature"]), chosen)

        return once(features(paragraph), verdict)

    numbered = F.transform(F.split("text", "\n", -1), lambda p, k: F.struct((k + 1).alias("no"), p.alias("p")))
    anchored = F.filter(numbered, lambda s: s["p"].rlike(pattern))
    scored = F.transform(anchored, lambda s: F.struct(s["no"].alias("no"), judged(s["p"]).alias("v")))
    found = F.when(F.col("text").rlike(pattern), F.filter(scored, lambda s: s["v"]["family"] != UNKNOWN))
    none = F.array().cast("array<string>")
    return (
        docs.select("doc_id", "text", F.coalesce(F.size(F.filter(F.split("text", "\n", -1), lambda p: p.rlike("[^\\s]"))), F.lit(0)).cast("long").alias("n_paragraphs"))
        .withColumn("_found", found)
        .select(
            "doc_id",
            "n_paragraphs",
            F.coalesce(F.array_sort(F.array_distinct(F.transform("_found", lambda s: s["v"]["family"]))), none).alias("licences"),
            F.coalesce(
                F.transform("_found", lambda s: F.concat_ws(":", s["v"]["family"], s["no"], F.floor(s["v"]["p"] * 1000))), none
            ).alias("hits"),
        )
    )
