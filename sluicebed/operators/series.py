"""Ordered series per key that stay spread over the cluster when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .sampling import positions_within

#: Positions of a series that one task adds up.
BLOCK = 100_000


def with_previous(df: DataFrame, by: list[str], order: list, value: str, name: str = "previous") -> DataFrame:
    """Adds the position in the series and the value of the row before (null for the first).

    The row before is found by an equi join on key and position, which hashes a long series over all
    partitions; a window would sort it in one task.
    """
    pos = settle(positions_within(df, by, order, "pos"), "positions")
    before = pos.select(*by, (F.col("pos") + 1).alias("pos"), F.col(value).alias(name))
    return pos.join(before, [*by, "pos"], "left")


def running_total(df: DataFrame, by: list[str], pos: str, value: str, name: str = "total") -> DataFrame:
    """Adds the sum of ``value`` up to and including each position of a series.

    Blocks of consecutive positions are added up on their own; the totals of the blocks before, one
    number per block, are added on top. Keys and values must not be null.
    """
    block = F.floor(F.col(pos) / BLOCK)
    marked = df.withColumn("_block", block)
    sums = marked.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_inside", F.sum(value).over(inside)).join(offsets, [*by, "_block"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_block", "_inside", "_before")


def reset_runs(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Adds ``run``: a new one starts where the value falls below that of the row before."""
    seen = with_previous(df, by, order, value)
    flagged = seen.withColumn("_reset", F.coalesce((F.col(value) < F.col("previous")).cast("bigint"), F.lit(0)))
    return running_total(flagged, by, "pos", "_reset", "run").drop("_reset", "previous")


def running_prefix(df: DataFrame, by: list[str], order: list, value: str, name: str = "history") -> DataFrame:
    """Adds all values before each row of its series, oldest first, as an array.

    The result holds every series once per row of it, so a series must fit a task.
    """
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.collect_list(F.struct(F.col(value).alias("_v"))).over(window)).withColumn(name, F.transform(name, lambda x: x["_v"]))
