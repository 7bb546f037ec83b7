"""Majorities, consensus and agreement over votes in long form (id, model, vote)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.verdicts import LEAKS, VERDICTS, is_leak, is_valid


def _order(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), label)


def top_votes(votes: DataFrame, key: str, label: str) -> DataFrame:
    """(key, top, top_n, n_valid): the valid label with most votes, ties by the order of the verdicts."""
    counted = votes.where(is_valid(F.col(label))).groupBy(key, label).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-_order(F.col(label))).alias("o"), F.col(label).alias("l")))
    return counted.groupBy(key).agg(best.alias("b"), F.sum("n").alias("n_valid")).select(key, F.col("b.l").alias("top"), F.col("b.n").alias("top_n"), "n_valid")


def strict_consensus(votes: DataFrame, current: DataFrame, key: str, label: str, n_models: int | None = None) -> DataFrame:
    """(key, current, majority, n_agree, n_models, category).

    More than half of the ``n_models`` that were asked make a consensus, by default of all votes that the
    item has, unusable ones included: CONFIRM if it is the current label, CHANGE if not; else NO_CONSENSUS.
    """
    cast = votes.groupBy(key).agg((F.count("*") if n_models is None else F.lit(n_models).cast("bigint")).alias("n_models"))
    joined = current.join(cast, key, "left").join(top_votes(votes, key, label), key, "left")
    n, models = F.coalesce("top_n", F.lit(0)), F.coalesce("n_models", F.lit(n_models or 0).cast("bigint"))
    category = F.when(n * 2 > models, F.when(F.col("top") == F.col("current"), "CONFIRM").otherwise("CHANGE")).otherwise("NO_CONSENSUS")
    return joined.select(key, "current", F.col("top").alias("majority"), n.alias("n_agree"), models.alias("n_models"), category.alias("category"))


def consistency_tiers(votes: DataFrame, key: str, label: str) -> DataFrame:
    """2 all valid votes agree, 1 more than half do, 0 else or without valid votes."""
    keys = votes.select(key).distinct()
    t = keys.join(top_votes(votes, key, label), key, "left")
    return t.select(key, F.when(F.col("n_valid").isNull(), 0).when(F.col("top_n") == F.col("n_valid"), 2).when(F.col("top_n") * 2 > F.col("n_valid"), 1).otherwise(0).alias("tier"))


def threshold_sweep(samples: DataFrame, label: str, keep: list[str], ks: list[int]) -> DataFrame:
    """For every threshold m the verdict of an item from its array of sampled labels.

    At least m leak votes make a leak, of the kind with more votes (a tie is the key step); else the
    most frequent label that is no leak, ties by the order of the verdicts; else the most frequent one.
    """
    count = lambda name: F.size(F.filter(label, lambda s: s == F.lit(name)))
    final, step = count(LEAKS[0]), count(LEAKS[1])
    best = lambda names: F.array_max(F.array(*(F.struct(count(v).alias("n"), F.lit(-i).alias("o"), F.lit(v).alias("l")) for i, v in enumerate(VERDICTS) if v in names)))
    safe, anything = best([v for v in VERDICTS if v not in LEAKS]), best(VERDICTS)
    kind = F.when(step >= final, F.lit(LEAKS[1])).otherwise(F.lit(LEAKS[0]))
    rows = samples.withColumn("m", F.explode(F.array(*map(F.lit, ks))))
    verdict = F.when(final + step >= F.col("m"), kind).when(safe["n"] > 0, safe["l"]).when(anything["n"] > 0, anything["l"])
    return rows.select(*keep, "m", verdict.alias("pred"))


def any_leak(votes: DataFrame, key: list[str], label: str) -> DataFrame:
    """Whether any member calls an item a leak."""
    return votes.groupBy(*key).agg(F.bool_or(is_leak(F.col(label))).alias("leak"))


def mean_ranks(ranks: DataFrame, name: str) -> DataFrame:
    return ranks.groupBy(name).agg(F.sum("rank").alias("rank_sum"), F.count("*").alias("n")).select(name, (F.col("rank_sum") / F.col("n")).alias("mean_rank"), "n")


def win_rates(ranks: DataFrame, item: str, name: str, rival: str) -> DataFrame:
    """Share of items on which a candidate ranks before ``rival``; a tie counts a half."""
    per = ranks.groupBy(item, name).agg((F.sum("rank") / F.count("*")).alias("r"))
    other = per.where(F.col(name) == rival).select(item, F.col("r").alias("ro"))
    both = per.where(F.col(name) != rival).join(other, item)
    points = F.sum(F.when(F.col("r") < F.col("ro"), 2).when(F.col("r") == F.col("ro"), 1).otherwise(0))
    return both.groupBy(name).agg((points / (F.count("*") * 2)).alias("win_rate"), F.count("*").alias("n"))


def most_common(df: DataFrame, by: list[str], label: str, position: str) -> DataFrame:
    """The most frequent label of a group, the one seen first on ties."""
    counted = df.groupBy(*by, label).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("first"))
    return counted.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*by, label, "n")
