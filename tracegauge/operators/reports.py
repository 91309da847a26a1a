"""Agreement of evaluators with labels and with each other; percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a group's range in which percentiles are looked for.
PARTS = 1024


def agreement(df: DataFrame, label: str, human: str, by: str) -> DataFrame:
    """Share of equal labels and the confusion counts, overall (a null group) and by one column."""
    same = lambda a, b: F.count_if((F.col(label) == a) & (F.col(human) == b)).alias(f"{a}_{b}")
    return df.rollup(by).agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(human)).alias("equal"), *(same(a, b) for a in ("pass", "fail") for b in ("pass", "fail")), F.grouping(by).alias("overall"))


def pairwise(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """How often two evaluators agree on the same items."""
    both = a.select(*keys, by, F.col("label").alias("x")).join(b.select(*keys, F.col("label").alias("y")), keys)
    return both.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("equal"))


def place(n: Column, q: float) -> Column:
    """Nearest rank (from 1) of a quantile among n: round half to even of q * n, at least 1, at most n."""
    return F.least(n, F.greatest(F.lit(1), F.bround(q * n).cast("int")))


def percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group. Values are counted in slices of PARTS parts of each group's range first; only the slices that
    hold a quantile are ranked, so a group with most of the rows is no task of its own."""
    some = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = some.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    with_ends = lambda x, y: x.alias("a").join(y.alias("b"), same).drop(*(F.col(f"b.{k}") for k in keys))
    width = F.col("_hi") - F.col("_lo")
    cut = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")
    counts = with_ends(some, ends).groupBy(*keys, cut.alias("_cut"), "_n").agg(F.count("*").alias("_c"))
    # at most PARTS rows of each group
    up_to = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cut"))
    listed = F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("_n"), q).alias("at")) for name, q in quantiles.items()))
    slices = counts.withColumn("_up", up_to).select(*keys, "_cut", (F.col("_up") - F.col("_c")).alias("_below"), F.filter(listed, lambda x: (x["at"] > F.col("_up") - F.col("_c")) & (x["at"] <= F.col("_up"))).alias("_at")).where(F.size("_at") > 0)
    cells = with_ends(some, ends).groupBy(*keys, cut.alias("_cut"), "_v").agg(F.count("*").alias("_c"))
    match = same & (F.col("a._cut") == F.col("b._cut"))
    own = cells.alias("a").join(slices.alias("b"), match).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a._cut").alias("_cut"), "_v", "_c", "_below", "_at")
    own = own.withColumn("_up", F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "_cut").orderBy("_v")))
    of = lambda name: F.max(F.when(F.exists("_at", lambda x: (x["name"] == name) & (x["at"] > F.col("_up") - F.col("_c")) & (x["at"] <= F.col("_up"))), F.col("_v")))
    return own.groupBy(*keys).agg(*(of(name).cast(df.schema[value].dataType).alias(name) for name in quantiles))


def calibration(df: DataFrame, by: str, price_per_million: float = 0.0) -> DataFrame:
    """Of evaluated, labelled items (score, human, confidence, seconds, tokens, model) by one column: the mean distance of scores, least and
    mean confidence, nearest-rank latencies, tokens, their price, and the number of models."""
    out = df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("score") - F.col("human"))).alias("distance"),
        F.min("confidence").alias("least_confidence"),
        F.avg("confidence").alias("mean_confidence"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") * price_per_million / 1e6).alias("cost"),
        F.count_distinct("model").alias("models"),
    )
    return out.join(percentiles(df, [by], "seconds", {"p50": 0.5, "p99": 0.99}), by, "left")


def spread(df: DataFrame, item: str, score: str) -> DataFrame:
    """Of each item: runs, and the distance between its highest and lowest score."""
    return df.groupBy(item).agg(F.count("*").alias("runs"), (F.max(score) - F.min(score)).alias("spread"))


def repeated(runs: DataFrame, by: str) -> DataFrame:
    """Of evaluations of labelled items, each several times (evaluator, item, run, label, human, score, error_type), by evaluator and one column: runs,
    errors, those that agree with the label, items with more than one score, those whose score changed, and the greatest spread."""
    ok = F.col("error_type").isNull()
    each = runs.groupBy("evaluator", by, "item").agg(
        F.count("*").alias("runs"), F.count_if(~ok).alias("errors"), F.count_if(ok & (F.col("label") == F.col("human"))).alias("agree"), F.count(F.when(ok, F.col("score"))).alias("scores"), (F.max(F.when(ok, F.col("score"))) - F.min(F.when(ok, F.col("score")))).alias("spread")
    )
    more = F.col("scores") > 1
    return each.groupBy("evaluator", by).agg(F.sum("runs").alias("runs"), F.sum("errors").alias("errors"), F.sum("agree").alias("agree"), F.count_if(more).alias("repeated"), F.count_if(more & (F.col("spread") > 0)).alias("changed"), F.coalesce(F.max(F.when(more, F.col("spread"))), F.lit(0.0)).alias("spread"))


def pairs_of_evaluators(runs: DataFrame, by: str) -> DataFrame:
    """Of each two evaluators, on the same item and run, both without an error: how often they agree, and how often only the first or the second
    passes, by one column. Evaluators of an item are few, so each run's rows meet as one array."""
    some = runs.where("error_type is null").groupBy("item", "run", by).agg(F.array_sort(F.collect_list(F.struct("evaluator", "label"))).alias("x"))
    both = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a["evaluator"].alias("first"), b["evaluator"].alias("second"), a["label"].alias("p"), b["label"].alias("q")))))
    each = some.select(by, F.explode(both).alias("y")).select(by, "y.*")
    return each.groupBy("first", "second", by).agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("q")).alias("equal"), F.count_if((F.col("p") == "pass") & (F.col("q") == "fail")).alias("first_only"), F.count_if((F.col("p") == "fail") & (F.col("q") == "pass")).alias("second_only"))
