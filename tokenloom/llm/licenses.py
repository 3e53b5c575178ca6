"""License scan by diagonal voting.

All rolling word 3-gram hashes of every text are joined to the positions of the license templates.
A vote of text position p for template position q lies on the diagonal p - q; votes are summed by
diagonal, neighbouring diagonals (words put in or left out) are merged, and a merged span is
verified: grams are compared as text, the share of the template's grams that it covers must reach
``coverage``, and it must not be longer than the template by more than half.  A phrase that must
stand word for word is a template whose diagonal holds all its grams.

Only DataFrame functions.  The templates are a parameter of fixed size and are broadcast; the grams
are never shuffled, only votes and one row for each text.

Edge cases: null texts count as empty; a text under three words has no grams; repeated rows and rows
without an id give a row each; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that must stand word for word, and their labels (fixed values).
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Texts of license notices, found also with small changes.  At most 64 words each.
NOTICES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


#: Positions of a template that one mask holds; a notice of any length takes several masks.
MASK = 62


def template_grams(base=BASE, notices=NOTICES) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, whether it is a base phrase, its grams, position, gram)."""
    rows = []
    for number, (label, text) in enumerate([*base, *notices]):
        words = text.split()
        n = len(words) - K + 1
        if n < 1 or n > MASK and number < len(base):
            raise ValueError(f"template of {len(words)} words: {label}")
        rows += [(number, label, number < len(base), n, q, " ".join(words[q:q + K])) for q in range(n)]
    return rows


def lowered_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def scan_licenses(docs: DataFrame, base=BASE, notices=NOTICES, coverage: float = 0.75, slack: int = 2,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id``, ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start), ``base_labels`` and ``labels`` (comma-joined), ``score`` (the
    largest verified share of a template, 0 without one) and ``spans`` (label, first word, end, share)."""
    spark = docs.sparkSession
    # position 0 of every text is a row of its own, so that texts without a vote stay
    grams = spark.createDataFrame([(-1, "", False, 1, 0, ""), *template_grams(base, notices)],
                                  "template int, label string, base boolean, n_grams int, q int, gram string")
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        lowered_words(F.col(text_col)).alias("w"))
    rolling = F.expr(f"transform(sequence(0, greatest(size(w) - {K}, 0)), i -> concat_ws(' ', slice(w, i + 1, {K})))")
    each = words.select("row", "doc_id", F.size("w").cast("bigint").alias("n_words"),
                        F.posexplode(F.concat(F.array(F.lit("")), rolling)).alias("p", "gram"))
    # "" can only be the first row's gram or an empty text's, which no template position has
    votes = each.withColumn("h", F.xxhash64("gram")).join(
        F.broadcast(grams.withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "own")), "h").where(
        "gram = own AND (template >= 0 OR p = 0)").withColumn("diagonal", F.expr("CASE WHEN template >= 0 THEN p - 1 - q ELSE 0 END"))
    part = F.floor(F.col("q") / MASK).cast("int").alias("part")
    diagonals = votes.groupBy("row", "doc_id", "n_words", "template", "label", "base", "n_grams", "diagonal", part).agg(
        F.expr(f"bit_or(shiftleft(1L, q % {MASK}))").alias("mask"), F.min("p").alias("low"), F.max("p").alias("high"))
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    merged = diagonals.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > slack, F.lit(True)).cast("int")) \
        .withColumn("span", F.sum("new").over(own))
    whole = F.col("base") & (F.bit_count("mask") == F.col("n_grams"))
    masks = merged.groupBy("row", "doc_id", "n_words", "template", "label", "base", "n_grams", "span", "part").agg(
        F.bit_count(F.expr("bit_or(mask)")).alias("bits"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.when(whole, 1)).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"), F.max(F.when(whole, F.col("diagonal"))).alias("last"))
    spans = masks.groupBy("row", "doc_id", "n_words", "template", "label", "base", "n_grams", "span").agg(
        (F.sum("bits") / F.col("n_grams")).alias("share"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("places").alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    found = (F.col("template") >= 0) & ((F.col("base") & (F.col("places") > 0)) | (
        ~F.col("base") & (F.col("share") >= coverage) & (F.col("high") - F.col("low") + K <= 1.5 * (F.col("n_grams") + K - 1))))
    spans = spans.withColumn("found", found)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum("places"), F.lit(0)).cast("bigint").alias("n_base"),
        F.min("first").cast("bigint").alias("first_word"), F.max("last").cast("bigint").alias("last_word"),
        joined(F.col("base") & F.col("found")).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct(
            (F.col("low") - 1).cast("bigint").alias("start"), (F.col("high") - 1 + K).cast("bigint").alias("end"),
            "label", "share")))).alias("spans")).drop("row")


def oracle_sql(base=BASE, notices=NOTICES, coverage: float = 0.75, slack: int = 2) -> str:
    rows = ", ".join(f"({t}, '{label}', {str(b).lower()}, {n}, {q}, '{g}')" for t, label, b, n, q, g in template_grams(base, notices))
    return rf"""
WITH grams(template, label, base, n_grams, q, gram) AS (VALUES {rows}),
texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM texts),
rolled AS (SELECT doc_id, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
diagonals AS (SELECT doc_id, template, label, base, n_grams, p - q AS diagonal, bit_or(1::BIGINT << q) AS mask,
    min(p) AS low, max(p) AS high
  FROM rolled JOIN grams USING (gram) GROUP BY ALL),
marked AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > {slack}, true)::INT AS fresh
  FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
merged AS (SELECT *, base AND bit_count(mask) = n_grams AS whole,
    sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
spans AS (SELECT doc_id, template, label, base, n_grams, span, bit_count(bit_or(mask)) / n_grams AS share,
    min(low) AS low, max(high) AS high, count(*) FILTER (whole) AS places,
    min(diagonal) FILTER (whole) AS f, max(diagonal) FILTER (whole) AS l
  FROM merged GROUP BY doc_id, template, label, base, n_grams, span),
judged AS (SELECT *, CASE WHEN base THEN places > 0
    ELSE share >= {coverage} AND high - low + {K} <= 1.5 * (n_grams + {K - 1}) END AS found FROM spans)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(sum(places), 0)::BIGINT AS n_base, min(f)::BIGINT AS first_word,
  max(l)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND found), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found), '') AS labels,
  coalesce(max(share) FILTER (found), 0.0)::DOUBLE AS score
FROM texts t LEFT JOIN judged USING (doc_id) GROUP BY t.doc_id, t.w
"""
