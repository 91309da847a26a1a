"""License scan by diagonal voting; DataFrame functions only.

Every rolling k-gram of words of every document is hashed and joined with the k-grams of the templates (a fixed list, so
the broadcast side has a fixed size). A hit at word p of a document and word t of a template whose words are equal, one by one,
votes for the diagonal p - t. Votes are counted by diagonal, neighbouring diagonals (a word more or less in between) are merged, and a merged
span counts if its votes, all verified on words, cover enough of the template. Templates of a phrase need every k-gram on one diagonal, which is
the same as the phrase standing there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare
from .linefreq import let

#: The phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening notices of public licences, as their authors ask to place them.
NOTICES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "either version 3 of the license or at your option any later version"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "either version 2 of the license or at your option any later version"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
GRAM = 3
#: Diagonals this near are one span; the share of a notice's k-grams that its votes must reach.
NEAR, COVER = 3, 0.75
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def grams_of(words, k: int):
    """Hashes of the k words from each place on; null where fewer follow."""
    return let(words, lambda ws: F.transform(ws, lambda w, i: F.when(i <= F.size(ws) - k, F.xxhash64(F.lit(k), w, *[F.get(ws, i + j) for j in range(1, k)]))))


def scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """Of each row of documents (doc_id, text): n_words, the phrases' places (n_base, first_word, last_word,
    base_labels), all labels, the score (best cover of a span; 1 for a phrase) and n_spans.

    A null or empty text has no words: counts of 0, null places, empty labels. Rows that repeat a doc_id are scanned as
    documents of their own. A null doc_id stays null. Other columns are left out.
    """
    spark = prepare(documents.sparkSession)
    listed = [(p, label, True) for p, label in phrases.items()] + [(n, label, False) for label, ns in notices.items() for n in ns]
    templates = spark.createDataFrame([(i, t, label, base, len(t.split()), min(GRAM, len(t.split()))) for i, (t, label, base) in enumerate(listed)], "template int, body string, label string, base boolean, length int, k int")
    k_grams = lambda k: templates.where(F.col("k") == k).select("template", "label", "base", (F.col("length") - k + 1).alias("grams"), F.split("body", " ").alias("own"), F.posexplode(grams_of(F.split("body", " "), k)).alias("t", "h")).where("h is not null").withColumn("own", F.slice("own", F.col("t") + 1, k)).groupBy("h").agg(F.collect_list(F.struct("template", "label", "base", "grams", "t", "own")).alias(f"in{k}")).withColumnRenamed("h", f"h{k}")
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(text, BREAK), lambda w: w != "")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).withColumn("row", F.monotonically_increasing_id())
    each = F.arrays_zip(grams_of(F.col("words"), 2).alias("h2"), grams_of(F.col("words"), GRAM).alias(f"h{GRAM}"), *[(F.slice("words", k + 1, F.size("words")) if k else F.col("words")).alias(f"w{k}") for k in range(GRAM)])
    each = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(each).alias("p", "g"))
    each = each.select("row", "doc_id", "n_words", "p", "g.*")
    for k in (2, GRAM):
        each = each.join(F.broadcast(k_grams(k)), f"h{k}", "left")
    # the first row of each document stays for its count of words
    each = each.where(f"coalesce(p, 0) = 0 or in2 is not null or in{GRAM} is not null").repartition("row")
    none = F.array().cast("array<struct<template:int,label:string,base:boolean,grams:int,t:int,own:array<string>>>")
    own = lambda x, k: F.filter(x, lambda y: F.array([F.col(f"w{i}") for i in range(k)]) == y["own"])
    each = each.withColumn("in2", own("in2", 2)).withColumn(f"in{GRAM}", own(f"in{GRAM}", GRAM))
    hits = each.select("row", "doc_id", "n_words", "p", F.explode_outer(F.concat(F.coalesce("in2", none), F.coalesce(f"in{GRAM}", none))).alias("x"))
    hits = hits.select("row", "doc_id", "n_words", "p", *[f"x.{c}" for c in ("template", "label", "base", "grams", "t")], (F.col("p") - F.col("x.t")).alias("diagonal"))
    same = ["row", "doc_id", "n_words", "template", "label", "base", "grams"]
    votes = hits.groupBy(*same, "diagonal").agg(F.count("t").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    votes = votes.withColumn("new", F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR), 1).otherwise(0))
    votes = votes.withColumn("span", F.sum("new").over(order))
    spans = votes.groupBy(*same, "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    # the votes of a span lie within the template's length, give or take the merged diagonals
    close = F.col("last") - F.col("first") < F.col("grams") + NEAR * 2
    spans = spans.withColumn("cover", F.when(F.col("base"), F.when(F.col("votes") == F.col("grams"), 1.0)).otherwise(F.when((cover >= COVER) & close, cover)))
    hit, base = F.col("cover").isNotNull(), F.col("base") & F.col("cover").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(hit).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
            F.count_if(hit & ~F.col("base")).alias("n_spans"),
        )
        .drop("row")
    )
