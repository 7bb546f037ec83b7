"""Lookups, overlays, sibling picks and other joins with fixed tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import ranked


def lookup(df: DataFrame, context: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left lookup of context columns with a ``context_missing`` flag."""
    side = context.select(key, *columns, F.lit(False).alias("_found"))
    return df.join(side, key, "left").withColumn("context_missing", F.col("_found").isNull()).drop("_found")


def overlay(base: DataFrame, changes: DataFrame, key: str, label: str) -> DataFrame:
    """Apply a change table (key, new_label, drop) to a base table.

    Dropped rows go; a changed label replaces the old one and marks the row as stale; rows without a
    change stay. Applying the same changes again changes nothing but the mark. One change per key.
    """
    joined = base.join(changes.select(F.col(key), F.col("new_label").alias("_new"), F.col("drop").alias("_drop")), key, "left")
    kept = joined.where(~F.coalesce("_drop", F.lit(False)))
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(label))
    return kept.withColumn("stale", changed).withColumn(label, F.when(changed, F.col("_new")).otherwise(F.col(label))).drop("_new", "_drop")


def sibling_pick(df: DataFrame, group: str, key: str, preferred: Column, usable: Column, order: list[Column]) -> DataFrame:
    """For every row a usable sibling of its group: the preferred one first, then in order; never itself.

    The two best usable rows of a group are enough, since at most one of them is the row itself; so
    no pair of siblings is formed, however large the group.
    """
    best = ranked(df.where(usable).select(group, key, preferred.alias("_p"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]), [group], [F.col("_p").desc(), *[F.col(f"_o{i}") for i in range(len(order))]])
    two = best.where("rn <= 2").groupBy(group).agg(F.max(F.when(F.col("rn") == 1, F.col(key))).alias("_first"), F.max(F.when(F.col("rn") == 2, F.col(key))).alias("_second"))
    return df.join(two, group, "left").withColumn("sibling", F.when(F.col("_first") == F.col(key), F.col("_second")).otherwise(F.col("_first"))).drop("_first", "_second")


def all_present(items: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """One row: whether every item has a record, and how many lack one."""
    missing = items.join(recorded.select(key).distinct(), key, "left_anti")
    return missing.agg((F.count("*") == 0).alias("complete"), F.count("*").alias("n_missing"))
