"""License scans by diagonal voting, in DataFrame functions only.

The rolling word pairs of every document are hashed and joined to the positions at which the pairs stand
in license templates (a fixed table, broadcast). A hit at word p of a document and position t of a template
votes for the diagonal p - t: words copied together vote for the same one. A diagonal keeps the template
positions that voted for it as bits of one number, so votes are combined in hash aggregates before the
shuffle. Diagonals at most ``DRIFT`` apart are the same copy with words put in or left out, and are merged;
a merged span is verified by the share of the template's pairs that it holds. Before that, only diagonals with
fewer than ``FEWEST`` pairs are left out (a pair alone is often chance; in templates of few pairs, ``WEAKEST`` of
them are enough).

Base phrases are templates too: a place counts where all pairs of the phrase voted for one diagonal.

Defined results: null, empty and wordless texts have no words, places or labels and score 0; rows that agree
in id and text are counted once each and get one result row each; rows with the same id and different
texts are judged apart; a null id is an id of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import ALNUM_WORDS, lower_ascii

# Phrases and labels of the base, then phrases of common license notices.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in"
               " compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"
            " provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
            " general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
            " hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
            " associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("rights-reserved", "all rights reserved"),
)

DRIFT = 3
FEWEST = 2
WEAKEST = 0.2
LEAST_SHARE = 0.6
SHORT_NOTICE = 8  # notices of fewer pairs must be there in full
MOST_PAIRS = 63
EVERY_DOCUMENT = 0  # the hash that stands for "this document exists"


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """Rows gram, template, label, is_base, pairs, at: where each word pair stands."""
    rows = []
    for number, (label, phrase, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in notices]):
        words = phrase.split()
        if not 2 <= len(words) <= MOST_PAIRS + 1:
            raise ValueError(f"a template has 2 to {MOST_PAIRS + 1} words: {phrase}")
        rows += [(number, label, is_base, len(words) - 1, i, *words[i : i + 2]) for i in range(len(words) - 1)]
    table = spark.createDataFrame(
        rows, "template int, label string, is_base boolean, pairs int, at int, one string, two string"
    )
    places = table.select(F.xxhash64("one", "two").alias("gram"), "template", "label", "is_base", "pairs", "at")
    document = spark.createDataFrame(
        [(EVERY_DOCUMENT, -1, None, False, 0, 0)],
        "gram long, template int, label string, is_base boolean, pairs int, at int",
    )
    return places.unionByName(document)


def license_words(text: Column) -> Column:
    return F.coalesce(
        F.regexp_extract_all(lower_ascii(text), F.lit(f"({ALNUM_WORDS})"), F.lit(1)), F.array().cast("array<string>")
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    spark = docs.sparkSession
    worded = docs.select(
        F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"), license_words(F.col(text)).alias("w")
    )
    pairs = F.when(
        F.size("w") > 1,
        F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(
            F.element_at("w", i), F.element_at("w", i + 1))),
    ).otherwise(F.array().cast("array<bigint>"))
    who = ["id", "h", "n_words"]
    rolling = worded.select(
        "id", "h", F.size("w").cast("long").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit(EVERY_DOCUMENT).cast("long")), pairs)).alias("p", "gram"),
    )
    # The document marker stands at place 0, so word i stands at place i + 1.
    votes = rolling.join(F.broadcast(templates(spark, base, notices)), "gram").withColumn(
        "diagonal", F.col("p") - 1 - F.col("at"))
    kind = ["template", "label", "is_base", "pairs"]
    diagonals = votes.groupBy(*who, *kind, "diagonal").agg(
        F.expr("bit_or(shiftleft(1L, at))").alias("found"),
        F.min("p").alias("low"), F.max("p").alias("high"), F.count(F.lit(1)).alias("rows"),
    )
    strong = diagonals.filter(
        (F.col("template") < 0)
        | F.when(F.col("is_base"), F.bit_count("found") == F.col("pairs"))
        .otherwise(F.bit_count("found") >= F.least(WEAKEST * F.col("pairs"), F.lit(FEWEST)))
    )
    line = Window.partitionBy(*who, *kind).orderBy("diagonal")
    fresh = F.col("is_base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT, F.lit(True))
    spans = (
        strong.withColumn("span", F.sum(fresh.cast("int")).over(line))
        .groupBy(*who, *kind, "span")
        .agg(F.bit_or("found").alias("found"), F.min("diagonal").alias("start"), F.min("low").alias("low"),
             F.max("high").alias("high"), F.max("rows").alias("rows"))
        .withColumn("share", F.bit_count("found") / F.greatest("pairs", F.lit(1)))
        .filter((F.col("template") < 0) | F.col("is_base") | (
            F.col("share") >= F.when(F.col("pairs") < SHORT_NOTICE, 1.0).otherwise(LEAST_SHARE)))
    )
    is_base, is_span = F.col("is_base"), F.col("template") >= 0
    per_template = spans.groupBy(*who, "label", "is_base", is_span.alias("is_span")).agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("start").alias("last"),
        F.max("share").alias("share"), F.max("rows").alias("rows"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    result = per_template.groupBy(*who).agg(
        F.max(F.when(~F.col("is_span"), F.col("rows"))).alias("rows"),
        F.coalesce(F.sum(F.when(is_base, F.col("n"))), F.lit(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("last"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("is_span"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("is_span"), F.struct(
            (F.col("low") - 1).alias("start"), (F.col("high") + 1).alias("end"), "label", "share")))).alias("spans"),
    )
    return result.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        "id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"
    )
