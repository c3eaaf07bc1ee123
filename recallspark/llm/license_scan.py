"""License scan by diagonal voting, in DataFrame operations only.

Rolling two-word hashes of every text join the positions of the same hashes in a fixed list of
license notices. Hits with the same difference of positions lie on one diagonal; a notice that
stands in the text word by word puts all its votes on one. Neighbouring diagonals are merged (a word
put in or left out shifts the rest by one), and a span is accepted when its distinct, verified votes
cover enough of the notice and all of its numbers. The base phrases need all of theirs on a single
diagonal.

Defined cases: a null text is the empty text with no words; repeated rows get the same result each;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ascii_lower

#: Characters that separate words, the base phrases and the license notices.
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
SEPARATOR_PATTERN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE_PHRASES = [
    ("mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("released under the bsd 3 clause license", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]


def words(text: Column) -> Column:
    """The words of a text, in their own case."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_PATTERN))


def template_grams(spark: SparkSession, base: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """(hash, word1, word2, template, label, base, at, n_grams, must): a row per two-word gram of a notice;
    ``must`` has the bits of those with a number. The list is fixed, whatever the number of documents."""
    rows = []
    for k, (phrase, label) in enumerate([*base, *notices]):
        own = phrase.split()
        if not 2 <= len(own) <= 63:
            raise ValueError("a notice has 2 to 63 words")
        must = sum(1 << at for at, pair in enumerate(zip(own, own[1:])) if any(w.isdigit() for w in pair))
        for at, pair in enumerate(zip(own, own[1:])):
            rows.append(F.struct(F.lit(pair[0]).alias("word1"), F.lit(pair[1]).alias("word2"), F.lit(k).alias("template"),
                                 F.lit(label).alias("label"), F.lit(k < len(base)).alias("base"), F.lit(at).alias("at"),
                                 F.lit(len(own) - 1).alias("n_grams"), F.lit(must).cast("long").alias("must")))
    grams = spark.range(1).select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    return grams.withColumn("hash", F.xxhash64("word1", "word2"))


def spans(docs: DataFrame, id_col: str, text_col: str, base: list, notices: list, gap: int = 3) -> DataFrame:
    """(id, text_hash, template, label, base, first, last, coverage, numbers) for every merged diagonal."""
    grams = template_grams(docs.sparkSession, base, notices)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("words"))
    rows = rows.select("id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "one"))
    rows = rows.select("id", "text_hash", "pos", "one", F.get("words", F.col("pos") + 1).alias("two")).where("two is not null")
    rows = rows.withColumn("hash", F.xxhash64(F.lower("one"), F.lower("two")))
    hits = rows.join(F.broadcast(grams), "hash").where(
        (ascii_lower(F.col("one")) == F.col("word1")) & (ascii_lower(F.col("two")) == F.col("word2")))
    group = ["id", "text_hash", "template", "label", "base", "n_grams", "must"]
    votes = hits.groupBy(*group, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.expr("bit_or(shiftleft(1L, at))").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    w = Window.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > gap) | F.col("base"), F.lit(True))
    merged = votes.withColumn("__new", new.cast("int")).withColumn("cluster", F.sum("__new").over(w))
    merged = merged.groupBy(*group, "cluster").agg(
        F.expr("bit_or(votes)").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.withColumn("coverage", F.bit_count("votes") / F.col("n_grams")).withColumn(
        "numbers", F.col("votes").bitwiseAND(F.col("must")) == F.col("must"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list = BASE_PHRASES,
                  notices: list = NOTICES, min_coverage: float = 0.7, gap: int = 3) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(docs, id_col, text_col, base, notices, gap)
    at = F.when(F.col("base") & (F.col("coverage") == 1), F.col("first"))
    # a merged span may be longer than its notice by what was put in, never more than twice as long
    close = (F.col("last") - F.col("first") + 2) <= 2 * (F.col("n_grams") + 1)
    accepted = at.isNotNull() | (~F.col("base") & (F.col("coverage") >= min_coverage) & F.col("numbers") & close)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = found.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.count(at).alias("n_base"), F.min(at).cast("long").alias("first_word"), F.max(at).cast("long").alias("last_word"),
        joined(F.when(at.isNotNull(), F.col("label"))).alias("base_labels"),
        joined(F.when(accepted, F.col("label"))).alias("labels"), F.max(F.when(accepted, F.col("coverage"))).alias("score"))
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("__h"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(found, rows[id_col].eqNullSafe(found["__id"]) & (rows["__h"] == found["__hash"]), "left")
    return out.select(id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))
