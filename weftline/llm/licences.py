"""Licence scans by a trained paragraph classifier, scored in DataFrame operations only.

Paragraphs are sentences, whose wrapped lines are joined, of blocks between
blank lines (or lines of marks only); lines of a sentence are also tried on
their own, as titles and lists have no sentence ends. A multinomial logistic regression
over word 1- and 2-grams that are present, trained on altered copies of the
families' template sentences and on other prose, has a class for unknown text;
a temperature fitted on held-out copies calibrates its probabilities. A
prediction counts if a template of the family is contained in the paragraph.

Every template has a cue word and a paragraph needs one, so texts without cues
are passed by. Each distinct paragraph with a cue is scored once, by a join of
its n-grams with the table of weights, whose size is fixed by the templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

# Sentences by which licence families are named or granted.
TEMPLATES = {
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL-3.0 license."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Released under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD License.", "Licensed under the 3-clause BSD license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved, no part of this publication may be reproduced or redistributed without prior written permission."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense license."],
}
# Prose with cue words that grants nothing.
OTHER = ["The driver had to show a license at the border.", "Ask for permission before you enter the garden.", "Copyright law differs between countries.", "He lost his fishing licence last summer.", "Music in the public domain is played here every week.", "The warranty covers the engine for two years.", "Wealth was redistributed after the reform.", "Software is licensed in many ways.", "The general public was released from the hall.", "A new version of the library was built under the bridge.", "She reserved all tickets and has the rights to them.", "The author signed a license agreement with the publisher."]

UNKNOWN = "unknown"
CUE = r"(?i)licen[cs]|copyright|permission|redistribut|public domain|rights reserved"
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_CUT = r"\n(?=[^\p{L}\p{N}\n]*\n)|(?<=[.!?:])\s+"
#: The cue where it may be wrapped.
_CUE_WRAPPED = CUE.replace(" ", r"[^\p{L}\p{N}]+")
#: A prediction is dropped below this probability, or below this share of a template's words.
CONFIDENT, CONTAINED = 0.5, 0.75


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass(frozen=True)
class Model:
    classes: list[str]
    grams: list[str]
    weights: np.ndarray  # classes by grams, over the temperature
    bias: np.ndarray


def _examples(rng: np.random.Generator, copies: int) -> tuple[list[list[str]], list[int]]:
    """Altered copies: some words dropped, others put around."""
    noise = lambda n: ["".join(rng.choice(list("aehinorst"), rng.integers(2, 8))) for _ in range(n)]
    texts, labels = [], []
    for label, sentences in enumerate([*TEMPLATES.values(), OTHER]):
        for sentence in sentences:
            for k in range(copies):
                words = _words(sentence)
                if k and len(words) > 6:
                    words = [w for w in words if rng.random() > 0.08]
                texts.append(noise(int(rng.integers(0, 12))) * (k % 3 == 1) + words + noise(int(rng.integers(0, 12))) * (k % 3 == 2))
                labels.append(label)
    for _ in range(20 * copies):
        some = _words(str(rng.choice([s for v in TEMPLATES.values() for s in v])))
        texts.append(noise(int(rng.integers(1, 20))) + list(rng.choice(some, min(3, len(some)))))
        labels.append(len(TEMPLATES))
    return texts, labels


@lru_cache(1)
def train(copies: int = 12, steps: int = 150, rate: float = 0.5) -> Model:
    """Fitted on the altered copies, with fixed seeds."""
    texts, labels = _examples(np.random.default_rng(5), copies)
    known = {g for sentences in TEMPLATES.values() for s in sentences for g in _grams(_words(s))} | {g for s in OTHER for g in _grams(_words(s))}
    grams = sorted(known)
    place, n = {g: k for k, g in enumerate(grams)}, len(TEMPLATES) + 1

    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(grams) + 1))
        x[:, -1] = 1
        for r, words in enumerate(rows):
            for g in _grams(words):
                if g in place:
                    x[r, place[g]] = 1
        return x

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(texts), np.eye(n)[labels]
    w, g2 = np.zeros((n, x.shape[1])), np.full((n, x.shape[1]), 1e-6)
    balance = (1 / (n * y.sum(axis=0)))[labels][:, None]
    for _ in range(steps):
        g = (balance * (softmax(x @ w.T) - y)).T @ x + 1e-5 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    held, held_labels = _examples(np.random.default_rng(6), 4)
    z = matrix(held) @ w.T
    losses = [(-np.log(softmax(z / t)[np.arange(len(z)), held_labels] + 1e-12).mean(), t) for t in np.linspace(0.5, 4, 36)]
    w = w / min(losses)[1]
    return Model([*TEMPLATES, UNKNOWN], grams, w[:, :-1], w[:, -1])


def sentences(text: Column) -> Column:
    """Sentences of a text, with their line feeds, that have a cue."""
    return F.filter(F.split(text, _CUT), lambda x: x.rlike(_CUE_WRAPPED))


def paragraphs(sentence: Column) -> Column:
    """A sentence with its lines joined, and each of its lines, that have a cue: structs of paragraph and whether it is a line."""
    lines = F.split(sentence, "\n")
    joined = F.regexp_replace(sentence, r"(?<=[\p{L}\p{N}])-[\x20\t\r]*\n[^\p{L}\p{N}\n]*", "-")
    joined = F.regexp_replace(joined, r"[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}\n]*", " ")
    whole = F.when(F.size(lines) > 1, F.array(joined)).otherwise(F.array().cast("array<string>"))
    each = F.concat(F.transform(lines, lambda x: F.struct(x.alias("paragraph"), F.lit(True).alias("line"))), F.transform(whole, lambda x: F.struct(x.alias("paragraph"), F.lit(False).alias("line"))))
    return F.filter(each, lambda x: x["paragraph"].rlike(CUE))


def classify(found: DataFrame, model: Model) -> DataFrame:
    """paragraph, family, probability, contained (share of the best template's words) of paragraphs (paragraph) with a confirmed prediction."""
    spark = found.sparkSession
    n = len(model.classes)
    words = F.regexp_extract_all(F.lower("paragraph"), F.lit(_WORD), F.lit(0))
    found = found.select("paragraph", words.alias("words"))
    pairs = F.transform(F.slice("words", 1, F.size("words") - 1), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    grams = F.array_distinct(F.when(F.size("words") > 1, F.concat("words", pairs)).otherwise(F.col("words")))
    weights = _table(spark, [(g, [float(x) for x in model.weights[:, k]]) for k, g in enumerate(model.grams)], "gram string, w array<double>")
    sums = found.select("paragraph", F.explode(grams).alias("gram")).join(F.broadcast(weights), "gram")
    sums = sums.groupBy("paragraph").agg(*[F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(n)])
    scores = F.array(*[F.col(f"z{k}") + F.lit(float(model.bias[k])) for k in range(n)])
    top = sums.select("paragraph", scores.alias("z")).withColumn("m", F.array_max("z"))
    top = top.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("m"))))
    top = top.withColumn("family", F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("z", F.col("m")).cast("int")))
    top = top.filter((F.col("probability") >= CONFIDENT) & (F.col("family") != UNKNOWN))
    templates = _table(spark, [(f, sorted(set(_words(s)))) for f, sentences in TEMPLATES.items() for s in sentences], "family string, template array<string>")
    top = top.join(F.broadcast(templates), "family").withColumn("words", F.regexp_extract_all(F.lower("paragraph"), F.lit(_WORD), F.lit(0)))
    shared = F.size(F.array_intersect("template", "words")) / F.size("template")
    return top.groupBy("paragraph").agg(F.first("family").alias("family"), F.first("probability").alias("probability"), F.max(shared).alias("contained")).filter(F.col("contained") >= CONTAINED)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table: a relation inside the plan, made of the model's own constants."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    literal = F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in zip(names, row, strict=True)]) for row in rows])
    return spark.range(1).select(F.explode(literal).alias("r")).select("r.*")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, families (sorted, joined by commas), family and probability of the surest paragraph, for every row of docs (doc_id, text).

    Null and empty texts and texts without licences have 0, an empty list and
    nulls. Rows that repeat a doc_id are one document and get the same result,
    null as a doc_id among them. Equal probabilities are decided by the family's
    name. Other columns are ignored. An empty table gives no rows.
    """
    model = model or train()
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike(_CUE_WRAPPED)).select("doc_id", F.explode(sentences(F.col("text"))).alias("sentence"))
    # written: few paragraphs have a cue, and both the model and the documents read them
    held = materialise(held.withColumn("at", F.monotonically_increasing_id()).select("doc_id", "at", F.inline(paragraphs(F.col("sentence")))), "licence-paragraphs")
    # written first: a join right above an aggregate can't split a paragraph that many documents have
    known = materialise(classify(held.select("paragraph").distinct(), model), "licences")
    hits = held.join(known, "paragraph")
    best = F.max(F.struct("probability", "family"))
    # lines of a wrapped sentence count if the sentence doesn't, or if one of them names its family already
    hit = F.struct("probability", "family")
    hits = hits.groupBy("doc_id", "at").agg(F.collect_list(F.when(F.col("line"), hit)).alias("lines"), F.first(F.when(~F.col("line"), hit), ignorenulls=True).alias("whole"))
    listed = F.col("whole").isNull() | F.exists("lines", lambda x: x["family"] == F.col("whole.family"))
    hits = hits.select("doc_id", F.inline(F.when(listed, F.col("lines")).otherwise(F.array("whole"))))
    by = hits.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), best.alias("best"))
    out = docs.select("doc_id").join(by, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), F.col("best.family").alias("family"), F.col("best.probability").alias("probability"))
