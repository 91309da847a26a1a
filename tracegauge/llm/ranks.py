"""Places of rows within their groups, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize


def positioned(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `pos`, their place from 0 among the rows of their group by `order` (ascending, nulls first), and `width`, the rows of the group.

    Rows are dealt by ranges of (group, order) and sorted there, so that a group of any size lies in as many tasks as it fills; a
    window then runs over one row for each group and task. rows is read twice (its ranges are sampled first): give a materialised
    table. group must not be null. Rows equal in all of `order` get their places in any order; put a row number last where that matters.
    """
    at, part, first, before = (fresh(rows, n) for n in ("at", "part", "first", "before"))
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    sorted_ = materialize(sorted_.withColumn(at, F.monotonically_increasing_id()), "sorted").withColumn(part, F.shiftright(at, 33))
    runs = sorted_.groupBy(part, group).agg(F.min(at).alias(first), F.count("*").alias("n"))
    own = Window.partitionBy(group)
    runs = runs.select(part, group, first, F.coalesce(F.sum("n").over(own.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum("n").over(own).alias("width"))
    placed = sorted_.join(runs, [part, group])
    return placed.select(*rows.columns, (F.col(at) - F.col(first) + F.col(before)).alias("pos"), "width")
