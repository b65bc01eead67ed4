"""License scans: an exact set-similarity join of text blocks with license templates by containment.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. Blocks are windows of BLOCK words
that start at every STRIDE-th word, so a passage of up to BLOCK - STRIDE + 1 words lies whole within a block. A block
meets a template when it holds at least ceil(threshold * |T|) of the template's distinct words. Templates are a table (label, text) of any
size; the base phrases are templates with threshold 1 whose words must also stand consecutively.

1. Words of the templates are counted over the whole corpus and ranked rarest first; each template is a sequence in that order.
2. Prefix filter: a block that meets a template holds one of the template's first |T| - need + 1 words. Every word of every text is
   joined with the index of prefix words; most texts end here.
3. A hit gives the blocks around it. Length filter: a block has at least `need` distinct words. Positional filter: of several prefix words
   in a block the first in rank speaks for it; what is ranked before it is not shared, so the template must have `need` words left.
4. The survivors' overlap is counted exactly, from that word on.

The index is broadcast while template texts have at most SMALL_BYTES, so no text is moved; with more it meets the words by a
shuffle join, in which a block travels only with a prefix word. What is met is grouped by (id, text hash).

Edge cases: null text has no words, labels are empty strings and the score is 0; repeated rows are judged alike; a very long text is
cut into its blocks in one task, blocks being all that moves; a template without words meets nothing; an empty table on either side gives
no labels; ids keep their type; only the id and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspark.llm.common import ascii_lower, materialise, null_safe

BLOCK, STRIDE = 128, 64
THRESHOLD = 0.8
#: Bytes of template texts up to which their index is broadcast (it is some ten times as large).
SMALL_BYTES = 4_000_000
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices that identify licenses; a block with THRESHOLD of a template's distinct words gets the label.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit": "this software is released under the mit license",
    "apache-2-text": "licensed under the apache license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2": "licensed under the apache license version 2 0",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3": "this work is licensed under the gnu general public license version 3 or any later version",
    "mpl-2-text": "this source code form is subject to the terms of the mozilla public license if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by-text": "this work is licensed under a creative commons attribution international license",
    "cc-by-nc": "licensed under cc by nc 4 0 international",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-text": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved",
}


def split_words(text: Column) -> Column:
    """Words as an array; null and texts without words give an empty one."""
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SEPARATORS))
    return F.filter(F.split(trimmed, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(templates.items()), "label string, text string")


def template_index(words: DataFrame, templates: DataFrame, threshold: float, phrases: dict[str, str]) -> tuple[DataFrame, bool]:
    """One row per prefix word of a template, and whether that is small enough to broadcast.

    Columns: word, place (its rank within the template, from 0), ranked (all distinct words by rank), need, label, phrase (the words in
    order, null for a template). words: all words of the corpus (word)."""
    spark = words.sparkSession
    sides = templates.select("label", split_words(F.col("text")).alias("seq"), F.lit(float(threshold)).alias("least"), F.lit(False).alias("is_phrase"))
    own = spark.createDataFrame([(label, phrase) for phrase, label in phrases.items()], "label string, text string")
    sides = sides.unionByName(own.select("label", split_words(F.col("text")).alias("seq"), F.lit(1.0).alias("least"), F.lit(True).alias("is_phrase")))
    sides = materialise(sides.filter("size(seq) > 0").withColumn("tid", F.xxhash64("label", "seq", "is_phrase")), "license-templates")
    small = (sides.agg(F.sum(F.octet_length(F.array_join("seq", " ")))).first()[0] or 0) <= SMALL_BYTES
    each = sides.select("tid", F.explode(F.array_distinct("seq")).alias("word"))
    vocabulary = each.select("word").distinct()
    # a word that no text holds is rarest; equal counts fall to code points
    counted = words.join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "license-counts")
    ranked = each.join(counted, "word", "left").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("order"))
    ranked = ranked.select("tid", F.transform("order", lambda x: x["word"]).alias("ranked"))
    full = sides.join(ranked, "tid").withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("least") * F.size("ranked") - 1e-9)).cast("int"))
    prefix = F.slice("ranked", F.lit(1), F.size("ranked") - F.col("need") + 1)
    rows = full.select(F.posexplode(prefix).alias("place", "word"), "ranked", "need", "label", F.when(F.col("is_phrase"), F.col("seq")).alias("phrase"))
    return materialise(rows, "license-index"), small


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: DataFrame | dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_words, places (struct<label,start> of the base phrases), labels_met, score.

    templates: (label, text) as a table or a dict. labels_met: struct<label,score> per template label met, score the largest containment
    of any block. Phrases have up to BLOCK - STRIDE + 1 words."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    if isinstance(templates, dict):
        templates = template_table(docs.sparkSession, templates)
    if any(len(p.split()) > BLOCK - STRIDE + 1 for p in phrases):
        raise ValueError(f"phrases have at most {BLOCK - STRIDE + 1} words")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # the outer form: else the split would be done once more, to leave out empty arrays
    words = texts.select("id", "th", split_words(F.col("text")).alias("words")).select("id", "th", "words", F.posexplode_outer("words").alias("p", "word"))
    index, small = template_index(words.select("word"), templates, threshold, phrases)

    hits = words.join(F.broadcast(index), "word") if small else words.join(index.hint("shuffle_hash"), "word")
    b = F.floor(F.col("p") / STRIDE).cast("int")
    hits = hits.withColumn("b", F.explode(F.when(b > 0, F.array(b, b - 1)).otherwise(F.array(b))))
    hits = hits.withColumn("block", F.slice("words", F.col("b") * STRIDE + 1, BLOCK)).drop("words")
    left = F.size("ranked") - F.col("place")
    hits = hits.filter((F.size(F.array_distinct("block")) >= F.col("need")) & (left >= F.col("need")))
    hits = hits.filter(~F.arrays_overlap(F.slice("ranked", F.lit(1), F.col("place")), "block"))
    shared = F.size(F.array_intersect(F.slice("ranked", F.col("place") + 1, F.size("ranked")), "block"))
    hits = hits.withColumn("shared", shared).filter("shared >= need")

    own = F.sequence(F.lit(0), F.lit(STRIDE - 1))  # a place belongs to the block whose first STRIDE words it starts in
    starts = F.transform(F.filter(own, lambda j: F.slice("block", j + 1, F.size("phrase")) == F.col("phrase")), lambda j: (F.col("b") * STRIDE + j).cast("long"))
    found = hits.select("id", "th", "label", (F.col("shared") / F.size("ranked")).alias("score"), F.explode(F.when(F.col("phrase").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(starts)).alias("start"))
    found = found.groupBy("id", "th", "label", "start").agg(F.max("score").alias("score"))
    place, met = F.when(F.col("start") >= 0, F.struct("label", "start")), F.when(F.col("start") < 0, F.struct("label", "score"))
    found = found.groupBy("id", "th").agg(F.collect_list(place).alias("places"), F.collect_list(met).alias("labels_met"))
    found = materialise(found, "license-found")

    rows = texts.select("id", "th", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    rows = null_safe(rows, found.hint("shuffle_hash"), ["id", "th"], "left")
    rows = rows.withColumn("places", F.coalesce("places", F.array().cast("array<struct<label:string,start:bigint>>"))).withColumn("labels_met", F.coalesce("labels_met", F.array().cast("array<struct<label:string,score:double>>")))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("labels_met", lambda m: m["score"])), F.lit(0.0)))
    return rows.select("id", "n_words", "places", "labels_met", score.alias("score"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(base, F.transform("labels_met", lambda m: m["label"])))
    starts = F.transform("places", lambda p: p["start"])
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), "score")


def _sql() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {listed(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', {listed(sorted(set(t.split())))})" for label, t in TEMPLATES.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrase(label, q) AS (VALUES {phrases}),
template(label, q) AS (VALUES {templates}),
place AS (SELECT doc_id, label, p FROM (SELECT doc_id, w, label, q, unnest(range(0, len(w) - len(q) + 1)) AS p FROM d, phrase WHERE len(w) >= len(q)) WHERE w[p + 1:p + len(q)] = q),
base AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id),
block AS (SELECT doc_id, list_distinct(w[b + 1:b + {BLOCK}]) AS held FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) AS b FROM d)),
met AS (SELECT doc_id, label, max(len(list_intersect(q, held)) / CAST(len(q) AS DOUBLE)) AS score FROM block, template
        WHERE len(list_intersect(q, held)) >= ceil({THRESHOLD} * len(q) - 1e-9) GROUP BY doc_id, label),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id),
top AS (SELECT doc_id, max(score) AS score FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN top USING (doc_id)
"""


OP2_SQL = _sql()
