"""Caps, quotas, stratified picks and splits, all by row numbers over a portable hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import portable_hash


def ranked(df: DataFrame, by: list[str | Column], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def hash_order(key: str, seed: str) -> list[Column]:
    """Order by the hash of seed and key, then key."""
    return [portable_hash(seed, F.col(key)), F.col(key)]


def cap_per_class(df: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each class; filter before, so that only kept rows count."""
    return ranked(df, by, order).where(F.col("rn") <= cap).drop("rn")


def downsample(df: DataFrame, by: str, key: str, seed: str, cap: int | None = None) -> DataFrame:
    """Each class down to the size of the smallest one (and to ``cap``), in hash order.

    A class may hold most of the rows, so positions come from a range sort over all partitions.
    """
    pos = positions_within(df.withColumn("_h", hash_order(key, seed)[0]), [by], [F.col("_h"), F.col(key)], "_pos").drop("_h")
    least = pos.groupBy(by).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    target = least.select(F.least("least", F.lit(cap)).alias("least")) if cap else least
    return pos.join(F.broadcast(target), F.col("_pos") < F.col("least")).drop("_pos", "least")  # one row


def round_robin(df: DataFrame, by: str, cells: list[str], key: str, seed: str, quota: int) -> DataFrame:
    """Per class, one row of each cell in turn until the quota is full; cells in hash order.

    A cell gives at most one row per turn, so rows after turn ``quota`` cannot be picked and are cut
    off before the shuffle.
    """
    inside = ranked(df, [by, *cells], hash_order(key, seed), "turn").where(F.col("turn") <= quota)
    cell_hash = portable_hash(seed, *(F.col(c) for c in [by, *cells]))
    return ranked(inside, [by], [F.col("turn"), cell_hash, F.col(key)], "pick").where(F.col("pick") <= quota).drop("turn", "pick")


def global_rank(df: DataFrame, key: str, seed: str, name: str = "pos") -> DataFrame:
    """A 0-based position in hash order, by a range sort and per-partition offsets.

    A window without partitioning would put all rows into one task; here every partition numbers its
    own rows and adds the counts of the partitions before it, one number per partition.
    """
    return ordered_positions(df.withColumn("_h", hash_order(key, seed)[0]), [F.col("_h"), F.col(key)], name).drop("_h")


def ordered_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """A 0-based position in the given total order without a single-task sort."""
    return positions_within(df, [], order, name)


def positions_within(df: DataFrame, by: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """A 0-based position within each class, however many rows a class has.

    Rows are range partitioned by class and order; every partition numbers its own rows and adds the
    rows of the class in the partitions before it, one number per class and partition.
    """
    from ..plans.lineage import settle

    # Settled, so that both uses below see the same split into partitions.
    keys = [F.col(c) for c in by]
    cut = settle(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = cut.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1)
    side = before.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), "_before")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    # One row per partition without classes; with them as many as classes and partitions, so Spark decides.
    joined = numbered.join(side if by else F.broadcast(side), same)
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before", "_p", *(f"_b{i}" for i in range(len(by))))


def three_way_split(df: DataFrame, key: str, seed: str) -> DataFrame:
    """80/10/10 in hash order; with 3 rows or more validation and test get at least one each."""
    pos = global_rank(df, key, seed)
    n = pos.agg(F.count("*").alias("n"))
    train0, valid0 = F.floor(F.col("n") * 8 / 10), F.floor(F.col("n") / 10)
    enough = F.col("n") >= 3
    valid = F.when(enough, F.greatest(valid0, F.lit(1))).otherwise(valid0)
    train = F.when(enough, F.least(train0, F.col("n") - valid - 1)).otherwise(train0)
    bounds = n.select("n", train.alias("n_train"), valid.alias("n_valid"))
    split = F.when(F.col("pos") < F.col("n_train"), "train").when(F.col("pos") < F.col("n_train") + F.col("n_valid"), "valid").otherwise("test")
    return pos.crossJoin(F.broadcast(bounds)).withColumn("split", split).drop("pos", "n", "n_train", "n_valid")  # one row


def ceil_chunks(df: DataFrame, order: list[Column], chunks: int) -> DataFrame:
    """``batch`` = position // ceil(n / chunks); trailing chunks may be missing."""
    pos = ordered_positions(df, order)
    per = pos.agg(F.ceil(F.count("*") / chunks).alias("per"))
    return pos.crossJoin(F.broadcast(per)).withColumn("batch", F.floor(F.col("pos") / F.col("per")).cast("bigint")).drop("pos", "per")  # one row
