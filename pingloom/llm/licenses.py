"""License scans by diagonal voting.

All rolling word k-grams of all documents are hashed and joined with the places where the templates hold them. A hit
lies on the diagonal (place in the document - place in the template) and votes for it. A phrase stands where all its
k-grams vote on one diagonal. Longer notices may have words put in or left out, which moves the diagonal, so the votes
of neighbouring diagonals (``REACH`` to either side) are merged; the share of the template's k-grams that they cover,
each verified word by word, is the score of the span. Spans above ``LEAST`` are found; of overlapping spans of different
templates the better one stays.

Everything is a DataFrame expression. Templates are sent to all tasks as long as they have ``SENT`` k-grams at most; more
of them are joined by a shuffle. The documents are read once: each brings, besides its k-grams, one row of its own, so
that documents without hits need no second scan and no join. All hits of a document meet in one task.

Defined results: null, empty and wordless texts have no words, no places and no labels; null ids and repeated rows stay
rows of their own; a very long text is handled whole (its words and hashes are arrays); templates shorter than k words
lower k for all; an empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keyed
from .url_filter import LOWER, UPPER

#: Words of a k-gram; diagonals merged to either side; share of a notice's k-grams for a label; k-grams sent to tasks.
K, REACH, LEAST, SENT = 3, 8, 0.6, 100_000
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases that count wherever they stand.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Opening words or short notices of common licenses.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License version"),
    ("lgpl", "licensed under the GNU Lesser General Public License version"),
    ("agpl", "licensed under the GNU Affero General Public License version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def _with_grams(df: DataFrame, k: int) -> DataFrame:
    """``df`` (text) with its words ``w`` and the hashes ``h`` of their k-grams."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), GAP, -1), "")
    hashed = f"transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(k))}))"
    return df.withColumn("w", words).withColumn("h", F.expr(f"CASE WHEN size(w) < {k} THEN cast(array() AS array<bigint>) ELSE {hashed} END"))


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], k: int = K) -> tuple[DataFrame, int]:
    """``template, label, phrase, grams, t_at, gram, t_words``: a row for each k-gram of each template; and k."""
    rows = [(i, label, i < len(phrases), text) for i, (label, text) in enumerate([*phrases, *notices])]
    df = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string")
    least = _with_grams(df, 1).agg(F.min(F.size("w"))).first()[0]
    k = min(k, least or k)
    if least == 0:
        raise ValueError("a template has no words")
    df = _with_grams(df, k)
    return df.select("template", "label", "phrase", F.size("h").alias("grams"), "w", F.posexplode("h").alias("t_at", "gram")).withColumn("t_words", F.expr(f"slice(w, t_at + 1, {k})")).drop("w"), k


def gram_hits(docs: DataFrame, templates: DataFrame, k: int) -> DataFrame:
    """``row, doc_id, n_words`` of each document with null for the rest, and of each hit with template, label, phrase, grams, diagonal and t_at."""
    # the null behind the last hash is the document's own row
    grams = _with_grams(docs, k).select("row", "doc_id", F.size("w").alias("n_words"), "w", F.posexplode(F.concat("h", F.array(F.lit(None).cast("long")))).alias("at", "gram"))
    if templates.count() <= SENT:
        hits = grams.join(F.broadcast(templates), "gram", "left").withColumn("met", F.expr(f"slice(w, at + 1, {k})"))
    else:
        hits = grams.withColumn("met", F.expr(f"CASE WHEN gram IS NOT NULL THEN slice(w, at + 1, {k}) END")).drop("w").join(templates, "gram", "left")
    return hits.filter("gram IS NULL OR met = t_words").select("row", "doc_id", "n_words", "template", "label", "phrase", "grams", (F.col("at") - F.col("t_at")).alias("diagonal"), "t_at")


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, k: int = K, reach: int = REACH, least: float = LEAST) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    ``spans`` lists what was found in the order of places: label, first and last word, share of k-grams covered.
    """
    docs, row = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    templates, k = template_grams(docs.sparkSession, phrases, notices, k)
    hits = gram_hits(docs.withColumnRenamed(row, "row"), templates, k).repartition("row")  # all that follows stays within a document
    # a template holds a k-gram at a place once, so the rows of a diagonal are different places
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "grams", "diagonal").agg(F.collect_list("t_at").alias("places"))
    near = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-reach, reach)
    votes = votes.withColumn("merged", F.when(~F.col("phrase"), F.collect_list(F.struct("diagonal", "places")).over(near)))
    share = F.when(F.col("phrase"), F.size("places") / F.col("grams")).otherwise(F.size(F.array_distinct(F.flatten("merged.places"))) / F.col("grams"))
    votes = votes.withColumn("share", F.round(share, 6))
    votes = votes.withColumn("good", F.when(F.col("phrase"), F.col("share") == 1).otherwise(F.col("share") >= least))
    votes = votes.withColumn("first", F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.expr("array_min(transform(merged, m -> m.diagonal + array_min(m.places)))")))
    votes = votes.withColumn("last", F.when(F.col("phrase"), F.col("diagonal") + F.col("grams") - 1).otherwise(F.expr("array_max(transform(merged, m -> m.diagonal + array_max(m.places)))")) + k - 1)
    # neighbouring good diagonals are one span: the one with the largest share
    before = F.lag("diagonal").over(W.partitionBy("row", "template", "good").orderBy("diagonal"))
    votes = votes.withColumn("new", (F.col("phrase") | before.isNull() | (F.col("diagonal") - before > reach)).cast("int"))
    votes = votes.withColumn("island", F.sum("new").over(W.partitionBy("row", "template", "good").orderBy("diagonal").rowsBetween(W.unboundedPreceding, 0)))
    best = F.row_number().over(W.partitionBy("row", "template", "good", "island").orderBy(F.col("share").desc(), "diagonal"))
    votes = votes.withColumn("best", best == 1)
    span = F.struct(F.col("first"), F.col("last"), "share", "grams", "template", "label", "phrase")
    out = votes.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(F.when(F.col("good") & F.col("best"), span))).alias("found"), F.max("share").alias("nearest"))
    # of overlapping notices the one with the larger share stays, then the longer, then the earlier template
    better = "y.template <> x.template AND NOT y.phrase AND y.first <= x.last AND x.first <= y.last AND (y.share, y.grams, -y.template) > (x.share, x.grams, -x.template)"
    out = out.withColumn("spans", F.expr(f"filter(found, x -> x.phrase OR NOT exists(found, y -> {better}))")).withColumn("base", F.filter("found", lambda x: x["phrase"]))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.col(f"{spans}.label"))), ",")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").cast("long").alias("first_word"),
        F.array_max("base.first").cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("spans").alias("labels"),
        F.coalesce("nearest", F.lit(0.0)).alias("score"),
        F.transform("spans", lambda x: F.struct(x["label"].alias("label"), x["first"].alias("first_word"), x["last"].alias("last_word"), x["share"].alias("share"))).alias("spans"),
    )
