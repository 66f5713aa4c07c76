"""Licence notices in documents by a trained paragraph classifier.

Only DataFrame functions are used. A paragraph is a line; its features are the different word bigrams
(lower-cased, signs dropped) that occur in the templates below, so vectors are sparse and all other
words weigh nothing. A multinomial logistic regression with an *unknown* class as its base line is
trained by gradient steps that are joins and grouped sums: rows of each class are the templates, whole
and with a third of their bigrams left out, and rows of the unknown class are the corpus paragraphs
that share bigrams with a template without holding half of one, and templates with two thirds of their
bigrams left out. The probability of a family is ``exp(s) / (1 + sum exp(s))``, that of unknown ``1 /
(1 + sum exp(s))``.

A predicted family is confirmed by comparison: the paragraph must hold at least ``share`` of the bigrams
of one of the family's templates. Every paragraph of every document is scored, whole.

Defined results: null and empty texts and lines of one word have no notice; several notices give one
row each; rows repeated with their identifier give one row a line; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_of

# Notices in common use, by licence family.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL", "under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0"),
    ("CC-BY", "Licensed under CC BY 4.0"),
    ("CC0", "dedicated to the public domain under CC0 1.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

STEPS = 12
BACKGROUND = 2000
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _bigrams(line: Column) -> Column:
    """Hashes of the different word bigrams of a line."""
    lowered = F.translate(line, _LETTERS, _LETTERS.lower())
    words = F.split(F.trim(F.regexp_replace(lowered, "[^a-z0-9\\x80-\\x{10FFFF}]+", " ")), " ")
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.array_distinct(F.array_compact(pairs))


def templates(spark: SparkSession) -> DataFrame:
    """(template, family, size, feature): one row per bigram; a few hundred rows, whatever the data."""
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, text string")
    known = rows.select("template", "family", _bigrams(F.col("text")).alias("b"))
    return cut(known.select("template", "family", F.size("b").alias("size"), F.explode("b").alias("feature")))


def _hits(docs: DataFrame, known: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, print, line, feature) of all template bigrams in all lines."""
    lines = docs.select(
        docs[doc_id].alias("doc_id"), F.xxhash64(text_of(docs, text)).alias("print"), F.posexplode(F.split(text_of(docs, text), "\n")).alias("line", "body")
    )
    features = lines.select("doc_id", "print", "line", F.explode(_bigrams(F.col("body"))).alias("feature"))
    # The broadcast side is the template table, whose size is fixed above.
    return features.join(F.broadcast(known.select("feature").distinct()), "feature").distinct()


def train(known: DataFrame, hits: DataFrame, steps: int = STEPS, background: int = BACKGROUND) -> DataFrame:
    """(feature, family, weight); feature 0 is the constant."""
    pieces = []
    for drop, label in ((0, True), (1, True), (2, True), (3, True), (4, False), (5, False)):
        part = F.pmod(F.xxhash64("feature", F.lit("part")), F.lit(3))
        keep = F.lit(True) if drop == 0 else part != drop - 1 if label else part == drop - 4
        name = F.concat(F.lit(f"t{drop}-"), F.col("template"))
        pieces.append(known.where(keep).select(name.alias("row"), (F.col("family") if label else F.lit(None)).alias("label"), "feature"))
    line = [F.col("doc_id"), F.col("print"), F.col("line")]
    half = hits.join(F.broadcast(known), "feature").groupBy(*line, "template", "size").agg(F.count("*").alias("n"))
    weak = half.groupBy(*line).agg(F.max(F.col("n") / F.col("size")).alias("most")).where("most < 0.5")
    # Bounded by `background` lines, those with the smallest hash.
    picked = weak.orderBy(F.xxhash64(*line), *line).limit(background)
    equal = F.col("h.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("h.print") == F.col("p.print")) & (F.col("h.line") == F.col("p.line"))
    unknown = hits.alias("h").join(F.broadcast(picked.alias("p")), equal)
    unknown = unknown.select(F.concat_ws("-", F.lit("u"), "h.print", "h.line").alias("row"), F.lit(None).cast("string").alias("label"), "feature")
    rows = unknown
    for piece in pieces:
        rows = rows.unionByName(piece)
    rows = rows.distinct()
    constant = rows.select("row", "label").distinct().withColumn("feature", F.lit(0).cast("bigint"))
    rows = cut(rows.unionByName(constant))
    families = known.select("family").distinct()
    share = 1.0 / F.count("*").over(Window.partitionBy("label"))
    labels = cut(rows.select("row", "label").distinct().withColumn("importance", share))
    # Templates are few, so every family has a weight for every feature from the start.
    weights = cut(rows.select("feature").distinct().crossJoin(F.broadcast(families)).withColumn("weight", F.lit(0.0)))
    for _ in range(steps):
        scores = rows.join(weights, "feature").groupBy("row", "label", "family").agg(F.exp(F.least(F.sum("weight"), F.lit(30.0))).alias("e"))
        own = Window.partitionBy("row")
        error = scores.withColumn("p", F.col("e") / (1 + F.sum("e").over(own))).join(labels.select("row", "importance"), "row")
        error = error.select("row", "family", ((F.col("family").eqNullSafe(F.col("label"))).cast("double") - F.col("p")).alias("d"), "importance")
        slopes = rows.select("row", "feature").join(error, "row").groupBy("feature", "family").agg(F.sum(F.col("d") * F.col("importance")).alias("slope"))
        moved = weights.join(slopes, ["feature", "family"], "left")
        weights = cut(moved.select("feature", "family", (F.col("weight") * 0.999 + 2.0 * F.coalesce("slope", F.lit(0.0))).alias("weight")))
    return weights


def notices(docs: DataFrame, share: float = 0.6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per line with a licence notice: ``doc_id``, ``line`` (from 0), ``family``, ``probability``,
    ``unknown`` (probability of the unknown class) and ``similarity`` to the nearest template."""
    known = templates(docs.sparkSession)
    hits = cut(_hits(docs, known, text, doc_id))
    weights = train(known, hits)
    line = ["doc_id", "print", "line"]
    base = weights.where("feature = 0").select("family", F.col("weight").alias("base"))
    # Weights are bounded by the templates: bigrams times families.
    sums = hits.join(F.broadcast(weights), "feature").groupBy(*line, "family").agg(F.sum("weight").alias("sum"))
    scored = sums.join(F.broadcast(base), "family").withColumn("e", F.exp(F.least(F.col("sum") + F.col("base"), F.lit(30.0))))
    best = scored.groupBy(*line).agg(F.sum("e").alias("all"), F.max(F.struct("e", "family")).alias("best"))
    best = best.select(*line, "best.family", (F.col("best.e") / (1 + F.col("all"))).alias("probability"), (1 / (1 + F.col("all"))).alias("unknown"))
    best = best.where("probability > unknown")
    matched = hits.join(F.broadcast(known), "feature").groupBy(*line, "family", "template", "size").agg(F.count("*").alias("n"))
    matched = matched.groupBy(*line, "family").agg(F.max(F.col("n") / F.col("size")).alias("similarity")).where(F.col("similarity") >= share)
    b, m = best.alias("b"), matched.alias("m")
    same = F.col("b.doc_id").eqNullSafe(F.col("m.doc_id"))
    for name in ("print", "line", "family"):
        same &= F.col(f"b.{name}") == F.col(f"m.{name}")
    return b.join(m, same).select("b.doc_id", "b.line", "b.family", "b.probability", "b.unknown", "m.similarity")
