"""License scans by diagonal voting, with DataFrame operations only.

All rolling hashes of ``K`` words of a text are joined with the places of the same hashes in license templates. A match
at word p of the text and word q of a template votes for the diagonal p - q. Votes are summed by diagonal,
diagonals at most ``SLIP`` apart are merged (an inserted or missing word shifts the rest), and a merged span counts if
it holds enough of its template in not too many words. The phrases that make up the base labels are templates too:
a diagonal with all their votes is one place of the phrase.

The template table has a fixed size (a row per template word), so it is broadcast; rows of the corpus leave the scan
only where they vote, with one row per text for texts without votes.

Defined cases: a null or empty text has 0 words, null first_word and last_word, empty labels and score 0. Rows that
repeat a doc_id are judged one by one. Columns besides doc_id and text are ignored, whatever their names. An empty table gives no
rows. A very long text is one array of words in one row. Labels are sets and places are smallest and largest ones, so ties change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import id_text

K = 3
SLIP = 2
#: A merged span counts with this share of its template's votes, in at most STRETCH times its words.
SHARE = 0.75
STRETCH = 1.5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices of common licenses, in words.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by", "creativecommons org licenses by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication"),
    ("cc0", "creativecommons org publicdomain zero 1 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0"),
    ("boost", "boost software license version 1 0"),
)


def templates() -> list[tuple[int, bool, str, list[str]]]:
    """number, whether it is a phrase of a base label, label, words."""
    rows = [(True, *x) for x in PHRASES] + [(False, *x) for x in NOTICES]
    return [(i, base, label, text.split()) for i, (base, label, text) in enumerate(rows)]


def template_rows() -> list[tuple]:
    """template, base, label, its words, its votes, place of the gram, the gram's words."""
    return [(i, base, label, len(w), len(w) - K + 1, q, *w[q : q + K]) for i, base, label, w in templates() for q in range(len(w) - K + 1)]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans for every row."""
    spark = docs.sparkSession
    table = spark.createDataFrame(template_rows(), "template int, base boolean, label string, length int, total int, place int, g0 string, g1 string, g2 string")
    table = F.broadcast(table.withColumn("gram", F.xxhash64("g0", "g1", "g2")).drop("g0", "g1", "g2"))

    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), CAPITALS, CAPITALS.lower()), SEPARATORS), "")
    w = id_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("w"))
    grams = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    # Place 0 stands for the text itself, so that it is there without votes too.
    g = w.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("long")), grams)).alias("p", "gram"))
    votes = g.join(table, "gram", "left").filter("p = 0 OR template IS NOT NULL")
    text = ["row", "doc_id", "n_words"]
    kind = ["template", "base", "label", "length", "total"]
    diagonals = votes.withColumn("diagonal", F.col("p") - 1 - F.col("place")).groupBy(*text, *kind, "diagonal")
    diagonals = diagonals.agg(F.count("*").alias("votes"), F.min(F.col("p") - 1).alias("first"), F.max(F.col("p") - 1).alias("last"))
    place = F.col("base") & (F.col("votes") == F.col("total"))
    diagonals = diagonals.withColumn("place", F.when(place, F.col("diagonal")))

    order = Window.partitionBy("row", "template").orderBy("diagonal")
    starts = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SLIP).cast("int"), F.lit(0))
    diagonals = diagonals.withColumn("new", starts)
    diagonals = diagonals.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = diagonals.groupBy(*text, *kind, "span").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.count("place").alias("places"), F.min("place").alias("first_place"), F.max("place").alias("last_place")
    )
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("total"))
    fits = ~F.col("base") & (cover >= SHARE) & (F.col("last") - F.col("first") + K <= STRETCH * F.col("length"))
    spans = spans.withColumn("found", F.when((F.col("places") > 0) | fits, F.col("label"))).withColumn("based", F.when(F.col("places") > 0, F.col("label")))
    joined = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    return spans.groupBy(*text).agg(
        F.sum("places").alias("n_base"),
        F.min("first_place").cast("long").alias("first_word"),
        F.max("last_place").cast("long").alias("last_word"),
        joined("based").alias("base_labels"),
        joined("found").alias("labels"),
        F.coalesce(F.max(F.when(F.col("found").isNotNull(), F.when(F.col("places") > 0, 1.0).otherwise(cover))), F.lit(0.0)).alias("score"),
        F.count("found").alias("n_spans"),
    ).drop("row")
