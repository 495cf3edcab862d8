"""License scan by diagonal voting.

Every rolling word k-gram hash of a text is joined with the positions that
the same hash has in license templates. A hit at text word p and template
word j votes for the diagonal p - j. A phrase is found where all its grams
vote for one diagonal; a longer template where neighbouring diagonals
(words put in or left out) together cover enough of it.

The template tables are parameters: their rows are bounded by the words of
the templates given, whatever the corpus, so they are broadcast. All work
on texts is per row; the only shuffle carries hits and one row a document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import BREAK, join_sorted, text_of

#: The phrases that are always searched, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Sentences of well-known public licenses.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}


@dataclass(frozen=True)
class Params:
    phrases: dict = field(default_factory=lambda: PHRASES)
    templates: dict = field(default_factory=lambda: TEMPLATES)
    #: Words of a gram of the templates; phrases take 2, the words of the shortest.
    k: int = 4
    #: Diagonals at most so far from the next lower one join its span...
    gap: int = 3
    #: ...and also, as a second way, those at most this part of the template's words away: a stretch put in the middle.
    wide: float = 0.2
    #: Part of a template's grams that a span must have.
    coverage: float = 0.6


def _positions(spark, texts: dict, k: int, kind: str, name: str) -> DataFrame:
    """hash -> array of (kind, label, words, k, j); at most a row for each word of the templates."""
    rows = [(kind, f"{kind}:{i}", label, len(w := t.split()), j, w[j : j + k]) for i, (t, label) in enumerate(texts) for j in range(len(t.split()) - k + 1)]
    df = spark.createDataFrame(rows, "kind string, template string, label string, words int, j int, gram array<string>")
    df = df.withColumn(name, F.xxhash64(*(F.col("gram")[i] for i in range(k))))
    return df.groupBy(name).agg(F.collect_list(F.struct("kind", "template", "label", "words", "j")).alias(f"{name}_at"))


def license_scan(docs: DataFrame, p: Params = Params()) -> DataFrame:  # noqa: B008
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans lists (label, kind, start, end, coverage) of verified places, words
    from 0. A null text is empty; an empty text has no words, empty labels and
    score 0. Rows with equal or null doc_id are scanned each on its own. Other
    columns of docs are not read. score is the best coverage, 1 for a phrase.
    A very long text is scanned whole; its words are one row's array, its
    grams go straight into the join, and only hits are shuffled.
    Words are lower-cased by the JVM; the phrases have no letter that any
    non-ASCII letter lower-cases to, so this equals lower-casing A-Z alone.
    """
    spark = docs.sparkSession
    pos2 = _positions(spark, p.phrases.items(), 2, "phrase", "g2")
    posk = _positions(spark, [(t, label) for label, t in p.templates.items()], p.k, "template", "gk")
    words = docs.select(
        F.monotonically_increasing_id().alias("rk"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.array_remove(F.split(F.lower(text_of(docs)), BREAK), "").alias("w"),
    )
    # Shifted copies of the words side by side: no lambda, so the grams are hashed in generated code.
    shifted = F.arrays_zip(*(F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(p.k)))
    at = words.select("rk", "doc_id", F.size("w").cast("bigint").alias("n_words"), F.posexplode_outer(shifted).alias("pos", "x"))
    gram = lambda k: F.when(F.col("pos") + k <= F.col("n_words"), F.xxhash64(*(F.col("x")[f"w{i}"] for i in range(k))))
    grams = at.select("rk", "doc_id", "n_words", "pos", gram(2).alias("g2"), gram(p.k).alias("gk"))
    joined = grams.join(F.broadcast(pos2), "g2", "left").join(F.broadcast(posk), "gk", "left")
    # One row of each document stays even without a hit, to carry its word count.
    some = joined.filter(F.col("pos").isNull() | (F.col("pos") == 0) | F.col("g2_at").isNotNull() | F.col("gk_at").isNotNull())
    none = F.array().cast(posk.schema["gk_at"].dataType)
    votes = (
        some.select("rk", "doc_id", "n_words", "pos", F.explode_outer(F.concat(F.coalesce("g2_at", none), F.coalesce("gk_at", none))).alias("t"))
        .select("rk", "doc_id", "n_words", "t.*", (F.col("pos") - F.col("t.j")).alias("diagonal"))
        .groupBy("rk", "doc_id", "n_words", "kind", "template", "label", "words", "diagonal")
        .agg(F.collect_set("j").alias("js"))
    )
    wide = F.floor(F.col("words") * p.wide).cast("int")
    votes = votes.withColumn("gap", F.explode(F.when(F.col("kind") == "phrase", F.array(F.lit(0))).otherwise(F.array_distinct(F.array(F.lit(p.gap), F.greatest(F.lit(p.gap), wide))))))
    along = Window.partitionBy("rk", "doc_id", "n_words", "kind", "template", "label", "words", "gap").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("gap"), F.lit(True))
    spans = (
        votes.withColumn("far", far.cast("int"))
        .withColumn("span", F.sum("far").over(along))
        .groupBy("rk", "doc_id", "n_words", "kind", "template", "label", "words", "gap", "span")
        .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"))
    )
    k = F.when(F.col("kind") == "phrase", 2).otherwise(p.k)
    spans = spans.withColumn("coverage", F.size("js") / (F.col("words") - k + 1)).withColumn("start", F.col("low") + F.array_min("js")).withColumn("end", F.col("high") + F.array_max("js") + k)
    whole = (F.col("kind") == "phrase") & (F.col("coverage") >= 1)
    near = (F.col("kind") == "template") & (F.col("coverage") >= p.coverage) & (F.col("end") - F.col("start") <= 2 * F.col("words"))
    start = F.when(whole, F.col("start").cast("bigint"))
    found = spans.groupBy("rk", "doc_id", "n_words").agg(
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        join_sorted(F.collect_set(F.when(whole, F.col("label")))).alias("base_labels"),
        join_sorted(F.collect_set(F.when(whole | near, F.col("label")))).alias("labels"),
        F.coalesce(F.round(F.max(F.when(whole | near, F.col("coverage"))), 6), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(whole | near, F.struct("label", "kind", "start", "end", "coverage")))).alias("spans"),
    )
    return found.drop("rk")


def op1_license_scan(spark, sf_dir):
    """The scan over all documents, in the contract's columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs).drop("spans")


_P = ", ".join(f"('phrase', {i}, '{label}', '{t}')" for i, (t, label) in enumerate(PHRASES.items()))
_T = ", ".join(f"('template', {i}, '{label}', '{t}')" for i, (label, t) in enumerate(TEMPLATES.items()))
_G = "w[i] || ' ' || w[i + 1] || CASE WHEN k = 4 THEN ' ' || w[i + 2] || ' ' || w[i + 3] ELSE '' END"
SQL = rf"""
WITH templates AS (SELECT kind, id, label, string_split(t, ' ') AS w, CASE kind WHEN 'phrase' THEN 2 ELSE 4 END AS k FROM (VALUES {_P}, {_T}) v(kind, id, label, t)),
tg AS (SELECT kind, id, label, len(w) AS words, k, i - 1 AS j, {_G} AS g FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM templates)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (VALUES (2), (4)) ks(k) WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i - 1 AS p, {_G} AS g FROM places),
votes AS (SELECT DISTINCT doc_id, kind, id, label, words, tg.k, p - j AS diagonal, j FROM dg JOIN tg ON dg.g = tg.g AND dg.k = tg.k),
gaps AS (SELECT DISTINCT doc_id, kind, id, label, words, k, diagonal, unnest(CASE kind WHEN 'phrase' THEN [0] ELSE list_distinct([3, greatest(3, CAST(floor(words * 0.2::DOUBLE) AS INT))]) END) AS gap FROM votes),
diagonals AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER a <= gap THEN 0 ELSE 1 END AS far FROM gaps WINDOW a AS (PARTITION BY doc_id, kind, id, gap ORDER BY diagonal)),
numbered AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, kind, id, gap ORDER BY diagonal) AS span FROM diagonals),
spans AS (SELECT n.doc_id, n.kind, n.id, n.label, n.words, n.k, n.gap, n.span, count(DISTINCT v.j) * 1.0::DOUBLE / (n.words - n.k + 1) AS coverage, min(n.diagonal) + min(v.j) AS s, max(n.diagonal) + max(v.j) + n.k AS e
  FROM numbered n JOIN votes v ON n.doc_id = v.doc_id AND n.kind = v.kind AND n.id = v.id AND n.diagonal = v.diagonal GROUP BY n.doc_id, n.kind, n.id, n.label, n.words, n.k, n.gap, n.span),
ok AS (SELECT *, kind = 'phrase' AS base FROM spans WHERE kind = 'phrase' AND coverage >= 1 OR kind = 'template' AND coverage >= 0.6 AND e - s <= 2 * words),
f AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM ok GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(score, 6), 0.0::DOUBLE) AS score
FROM d LEFT JOIN f ON d.doc_id = f.doc_id"""
