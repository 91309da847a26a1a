"""Operators with state over ordered rows, in batch form: duplicates within a time to live, token budgets, lanes, failures.

Folds over one key's rows in order run in grouped pandas stages that hold one key at a time; a key's rows are those of
one span, service or evaluator. Where a window function says the same, it is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

CHARS_PER_TOKEN = 4
PLACE = "__place"


def repeats(df: DataFrame, keys: list[str], at: str, ttl_s: float) -> DataFrame:
    """Adds `duplicate`: the key was accepted less than ttl_s before (at is epoch seconds). A duplicate doesn't prolong the
    time, and an age of exactly ttl_s is accepted anew. The rows of a key arrive sorted and are read once, so a key may be
    as frequent as it likes; ties in time are duplicates of the first. Null keys are keys; a row without a time is no duplicate."""
    schema = StructType([*df.schema.fields, StructField("duplicate", BooleanType())])
    names = df.columns

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        until = float("-inf")
        for frame in frames:
            out = []
            for place, t in zip(frame[PLACE], frame[at], strict=True):
                if place == 1:
                    until = float("-inf")
                out.append(t < until)
                if t >= until:
                    until = t + ttl_s
            yield frame[names].assign(duplicate=out)

    return in_order(df, keys, [at]).mapInPandas(fold, schema)


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with the place (from 1) of each row among its key's, sorted by both within partitions that hold whole keys. Python needn't
    compare keys then, whose nulls would equal nothing there."""
    placed = df.withColumn(PLACE, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.sortWithinPartitions(*keys, PLACE)


def estimated_tokens(chars: Column, answer: int) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN) + answer


def interaction_tokens(answer: int) -> Column:
    """The estimate of a whole interaction: its instructions, context, input and output."""
    chars = [F.aggregate(c, F.lit(0), lambda a, m: a + F.coalesce(F.length(m["text"]), F.lit(0))) for c in ("system_instructions", "context_messages", "input_messages", "output_messages")]
    return estimated_tokens(sum(chars[1:], chars[0]), answer)


def tokens_used(call: Column) -> Column:
    """Tokens of a judge's call, or null if neither side was reported."""
    return F.coalesce(call["input_tokens"] + call["output_tokens"], call["input_tokens"], call["output_tokens"])


def within_budget(df: DataFrame, keys: list[str], at: str, tokens: str, used: str, per_minute: int) -> DataFrame:
    """Adds `accepted` and `left`: a token bucket for each key, refilled per second and capped at a minute's worth. A row's
    estimate is reserved if it fits, then settled with what was used, by which the bucket may fall below zero."""
    schema = StructType([*df.schema.fields, StructField("accepted", BooleanType()), StructField("left", LongType())])
    names = df.columns

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, seen = 0.0, 0.0
        for frame in frames:
            ok, left = [], []
            for place, t, need, spent in frame[[PLACE, at, tokens, used]].itertuples(index=False):
                if place == 1:
                    level, seen = float(per_minute), t
                level, seen = min(float(per_minute), level + (t - seen) * per_minute / 60), t
                fits = need <= level
                level -= spent if fits else 0
                ok.append(fits)
                left.append(int(level // 1))
            yield frame[names].assign(accepted=ok, left=left)

    return in_order(df, keys, [at, tokens]).mapInPandas(fold, schema)


def lane(df: DataFrame, keys: list[str], order: list[str], capacity: int) -> DataFrame:
    """Adds `drop_reason`: rows of a micro-batch beyond a lane's capacity are dropped as lane_full."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("drop_reason", F.when(F.row_number().over(w) > capacity, "lane_full"))


def dropped(df: DataFrame, names: str) -> DataFrame:
    """Dropped evaluations by evaluator and reason; each check of a batch counts."""
    return df.where("drop_reason is not null").select(F.explode(names).alias("evaluator_name"), "drop_reason").groupBy("evaluator_name", "drop_reason").agg(F.count("*").alias("n"))


def failing(df: DataFrame, keys: list[str], order: list[str], error: Column, least: int = 3) -> DataFrame:
    """Runs of errors in a row of at least `least`: key, first and last place, length, and whether they ended."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.select(*keys, *order, error.alias("bad"), F.row_number().over(w).alias("_n"))
    marked = marked.withColumn("island", F.col("_n") - F.sum(F.col("bad").cast("int")).over(w)).withColumn("last", F.max("_n").over(Window.partitionBy(*keys)))
    runs = marked.where("bad").groupBy(*keys, "island").agg(F.count("*").alias("errors"), F.min("_n").alias("first"), F.max("_n").alias("until"), F.max("last").alias("last"))
    return runs.where(F.col("errors") >= least).select(*keys, "first", "until", "errors", (F.col("until") < F.col("last")).alias("recovered"))
