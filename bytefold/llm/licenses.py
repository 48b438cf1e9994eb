"""License scans by diagonal voting, in DataFrame functions only.

Method: the hashes of all rolling word k-grams of every text are joined with those of the templates (a fixed list of
short texts, so broadcast); matches vote for their diagonal, document position less template position; neighbouring
diagonals of a template are merged into spans. A span is verified on both sides: matched grams must cover enough of the
template's words and enough of the document's words between the span's ends. Every gram match is compared word by word
before it votes, so that a hash collision never counts. The matches, few, are kept before they are counted, so that the
grams of a text are made once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
DRIFT = 4  # between neighbouring diagonals
WIDEST = 16  # diagonals that a span may take
COVER = 0.6  # of the template's words, and of the document's between the ends

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening sentences of widely used public licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}


def words_of(text: str) -> list[str]:
    """The driver's version of words(), for templates (ASCII)."""
    return [w for w in re.split(BREAK, text.lower()) if w]


def _low(text: Column) -> Column:
    """Lower-case A-Z alone; lower() does the same where every character is ASCII."""
    a, z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, a, z))


def words(text: Column) -> Column:
    return F.array_remove(F.split(_low(text), BREAK), "")


def template_grams(spark: SparkSession, templates: dict[str, str], k: int, phrases: bool) -> DataFrame:
    """One row per distinct gram: its hash and where it stands in templates; as many rows as the templates have words."""
    rows = []
    for label, text in templates.items():
        w = words_of(text)
        if phrases and len(w) != k:
            continue
        rows += [(label, i, w[i : i + k], len(w)) for i in range(len(w) - k + 1)]
    grams = spark.createDataFrame(rows, "label string, at int, gram array<string>, size int")
    key = F.xxhash64(*[F.col("gram")[i] for i in range(k)]).alias(f"h{k}")
    return grams.groupBy(key).agg(F.collect_list(F.struct("label", "at", "gram", "size")).alias(f"t{k}"))


def _stands(k: int):
    return lambda entry: entry["gram"] == F.array(*[f"w{i}" for i in range(k)])


def votes(docs: DataFrame, templates: dict[str, str], phrases: dict[str, str]) -> DataFrame:
    """(row_key, kind, label, diagonal, pos, at, size): every gram of every text that stands in a template or is a phrase."""
    spark = docs.sparkSession
    tables = {K: template_grams(spark, {**{f"t:{n}": t for n, t in templates.items()}, **{f"p:{v}": p for p, v in phrases.items() if len(words_of(p)) == K}}, K, False)}
    for k in {len(words_of(p)) for p in phrases} - {K}:
        tables[k] = template_grams(spark, {f"p:{v}": p for p, v in phrases.items()}, k, True)
    most = max(tables)
    w = docs.select("row_key", words(F.col("text")).alias("w"))
    parts = [F.col("w").alias("w0"), *[F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(1, most)]]
    rows = w.filter(F.size("w") > 0).select("row_key", F.posexplode(F.arrays_zip(*parts)).alias("pos", "g"))
    rows = rows.select("row_key", "pos", *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(most)])
    rows = rows.select("*", *[F.xxhash64(*[f"w{i}" for i in range(k)]).alias(f"h{k}") for k in tables])
    for k, t in tables.items():
        rows = rows.join(F.broadcast(t), f"h{k}", "left")
    found = rows.filter(F.coalesce(*[f"t{k}" for k in tables]).isNotNull())
    none = F.array().cast("array<struct<label:string,at:int,gram:array<string>,size:int>>")
    same = [F.filter(F.coalesce(f"t{k}", none), _stands(k)) for k in tables]
    each = found.select("row_key", "pos", F.explode(F.concat(*same)).alias("m")).select("row_key", "pos", "m.label", "m.at", "m.size")
    return each.select("row_key", F.substring("label", 1, 1).alias("kind"), F.expr("substring(label, 3)").alias("label"), "pos", "at", "size", (F.col("pos") - F.col("at")).alias("diagonal"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """All columns of `docs` (any with a `text`), and n_words, base (sorted array of struct<start, label>: the phrases'
    places) and spans (array of struct<label, first, last, cover>: merged template spans, word positions). These take
    the place of columns of their names.

    Null text is empty. Repeated rows each stay. Texts without words have no place and no span.
    """
    docs = docs.drop("n_words", "base", "spans")
    row, places, stretches = fresh(docs, "__row", "__places", "__stretches")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(row, F.xxhash64(text))
    seen = cut(votes(keyed.select(F.col(row).alias("row_key"), text.alias("text")), templates, phrases))
    base = seen.filter("kind = 'p'").groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct(F.col("pos").cast("long").alias("start"), "label"))).alias(places))
    diagonals = seen.filter("kind = 't'").groupBy("row_key", "label", "size", "diagonal").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("at"))
    line = Window.partitionBy("row_key", "label").orderBy("diagonal")
    begins = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= DRIFT, 0).otherwise(1)
    chained = diagonals.withColumn("begins", begins).withColumn("run", F.sum("begins").over(line))
    wide = F.floor((F.col("diagonal") - F.min("diagonal").over(Window.partitionBy("row_key", "label", "run"))) / WIDEST)
    both = [F.flatten(F.collect_list(F.transform("at", lambda a, c=c: a + c))) for c in (F.lit(0), F.col("diagonal"))]
    merged = chained.withColumn("part", wide).groupBy("row_key", "label", "size", "run", "part").agg(F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), both[0].alias("at"), both[1].alias("pos"))

    def covered(starts: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda a: F.sequence(a, a + K - 1)))))

    dense = covered("pos") >= COVER * (F.col("last") - F.col("first") + 1)
    good = merged.withColumn("cover", covered("at") / F.col("size")).filter((F.col("cover") >= COVER) & dense)
    spans = good.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("label", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "cover"))).alias(stretches))
    found = base.join(spans, "row_key", "full").withColumnRenamed("row_key", row)
    counted = keyed.withColumn("n_words", F.size(words(text)).cast("long")).join(found, row, "left")
    no_places, no_stretches = F.array().cast("array<struct<start:bigint,label:string>>"), F.array().cast("array<struct<label:string,first:bigint,last:bigint,cover:double>>")
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", F.coalesce(places, no_places).alias("base"), F.coalesce(stretches, no_stretches).alias("spans"))


def oracle(templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    grams = ", ".join(f"('{label}', {i}, '{' '.join(w[i : i + K])}', {len(w)})" for label, text in templates.items() for w in [words_of(text)] for i in range(len(w) - K + 1))
    places = " UNION ALL ".join(f"SELECT r, pos, '{label}' AS label FROM g WHERE array_to_string(w[pos + 1:pos + {len(words_of(p))}], ' ') = '{' '.join(words_of(p))}'" for p, label in phrases.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, i AS pos, w[i + 1:i + 3] AS w FROM d, unnest(range(len(w))) AS t(i)),
t(label, spot, gram, size) AS (VALUES {grams}),
base AS ({places.replace("w[pos + 1:pos + ", "w[1:")}),
v AS (SELECT r, label, size, pos, spot, pos - spot AS diagonal FROM g JOIN t ON array_to_string(w, ' ') = gram),
c AS (SELECT *, sum(begins) OVER (PARTITION BY r, label ORDER BY diagonal) AS run FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, label ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS begins FROM (SELECT DISTINCT r, label, diagonal FROM v))),
p AS (SELECT v.*, run, (v.diagonal - min(v.diagonal) OVER (PARTITION BY v.r, v.label, run)) // {WIDEST} AS part FROM v JOIN c USING (r, label, diagonal)),
m AS (SELECT r, label, list_unique(flatten(list(range(spot, spot + {K})))) / any_value(size) AS cover, list_unique(flatten(list(range(pos, pos + {K})))) AS dense, max(pos) + {K} - min(pos) AS long FROM p GROUP BY r, label, run, part),
s AS (SELECT r, label, cover FROM m WHERE cover >= {COVER} AND dense >= {COVER} * long),
b AS (SELECT r, count(*) AS n, min(pos) AS first, max(pos) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM s) GROUP BY r),
best AS (SELECT r, max(least(cover, 1.0)) AS cover FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END::DOUBLE AS score FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN best USING (r)"""
