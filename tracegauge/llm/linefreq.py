"""Quality rules over whole texts, with cross-document line frequency; DataFrame functions only.

Lines are normalised and hashed; a line that more than LIMIT distinct documents of a host have is removed, and a document
that keeps too little of its words is rejected. Hosts are values of `source`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Documents of one host that may have a line; words a document must keep, and the least share (percent) of its words.
LIMIT, LEAST_WORDS, LEAST_PERCENT = 50, 10, 50
#: Common lines that are broadcast; beyond that, each host's are dealt over so many tasks.
BROADCAST_ROWS, SALT = 200_000, 32
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words that the text holds twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(hashes: Column) -> Column:
        # sorted (hash, place): neighbours with the same hash are repeats; then the union of the places' windows
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(o: Column) -> Column:
            hits = F.filter(F.transform(o, lambda x, j: F.when((x["h"] == F.get(o, j - 1)["h"]) | (x["h"] == F.get(o, j + 1)["h"]), x["i"])), lambda x: x.isNotNull())
            return let(F.array_sort(hits), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(order, places))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, covered))


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def marked(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The lines (host, line, ...) that are among common (host, line). Common lines are hot keys: where there are too many to be
    broadcast, each meets its lines in SALT tasks."""
    if common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(common), ["host", "line"])
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALT)).cast("int"))
    return salted.join(common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["host", "line", "salt"]).drop("salt")


def normal(line: Column) -> Column:
    """A line without case, digits and outer or repeated white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))


def without_common_lines(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, source and text of each row of documents without the lines that more than `limit` documents of its host have; lines
    that are left keep their order and form. Nulls, repeated rows and hosts are as in quality_rules; a null text stays null."""
    prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("host", F.coalesce("source", F.lit("\x00"))), "rows")
    lines = rows.select("row", "host", F.posexplode(F.transform(F.split("text", "\n", -1), lambda x: F.when(normal(x) != "", F.xxhash64(normal(x))))).alias("at", "line")).where("line is not null")
    common = materialize(lines.select("row", "host", "line").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("host", "line"), "common")
    lost = marked(lines, common).groupBy("row").agg(F.collect_set("at").alias("lost"))
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("lost", i), x)), lambda x: x.isNotNull())
    out = rows.join(lost, "row", "left")
    return out.select("doc_id", "source", F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def quality_rules(documents: DataFrame, limit: int = LIMIT, least_words: int = LEAST_WORDS, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """Of each row of documents (doc_id, text, source): its counts, base_failed, n_common_lines and n_left_words (lines
    above the limit and the words without them), kept.

    A null or empty text has no words and fails. Documents with a null source are a host of their own. Rows that repeat
    a doc_id are rows of their own with their own verdict (and count as documents of their host). A null doc_id stays
    null. Other columns are left out.
    """
    prepare(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("host"), text.alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("lines", F.split("text", "\n", -1)).withColumn("words", split_words(F.col("text")))
    # normalised lines' hashes and words
    norm = F.transform("lines", normal)
    each = let(norm, lambda ls: F.transform(F.filter(ls, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))))
    counts = rows.select(
        "row",
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("lines")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        each.alias("each"),
    )
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # counts and line hashes are a small part of the texts; texts are read once
    counts = materialize(counts, "lines")
    seen = counts.select("host", F.explode(F.array_distinct(F.transform("each", lambda x: x["line"]))).alias("line"))
    common = materialize(seen.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > limit).select("host", "line"), "common")
    lines = counts.select("row", "host", F.posexplode("each").alias("at", "x")).select("row", "host", "at", "x.line", "x.n")
    lost = marked(lines, common).groupBy("row").agg(F.count("*").alias("n_common_lines"), F.sum("n").alias("lost"))
    out = counts.drop("each", "host").join(lost, "row", "left")
    zero = F.lit(0).cast("long")
    out = out.select(*own, F.coalesce("n_common_lines", zero).alias("n_common_lines"), (F.col("n_words") - F.coalesce("lost", zero)).alias("n_left_words"))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    depleted = (F.col("n_left_words") < least_words) | (100 * F.col("n_left_words") < least_percent * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)
