"""Evaluation metrics as single-pass aggregates over (gold, pred) rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import portable_hash
from ..functions.verdicts import VERDICTS, binary, is_leak, is_valid, threeway

#: Standard deviations around its mean within which a binomial number is looked for.
SPREAD = 10


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def distribution(df: DataFrame, by: Column, name: str, default: str) -> DataFrame:
    return df.groupBy(F.coalesce(by, F.lit(default)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def axis_marginals(df: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value, n) of every axis in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))
    return df.select(F.explode(pairs).alias("x")).groupBy("x.axis", "x.value").agg(F.count(F.lit(1)).alias("n"))


def leak_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of the two-class view; a null prediction is no leak, null equals null."""
    g, p = is_leak(F.col("gold")), is_leak(F.col("pred"))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(g & p).alias("tp"),
        count_where(~g & p).alias("fp"),
        count_where(g & ~p).alias("fn"),
        count_where(g == p).alias("same"),
        count_where(F.col("pred").eqNullSafe(F.col("gold"))).alias("exact"),
        count_where(is_valid(F.col("pred"))).alias("parsed"),
    )
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    return base.select(*by, "n", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (F.col("same") / n).alias("binary_accuracy"), (F.col("exact") / n).alias("accuracy"), (F.col("parsed") / n).alias("parse_rate"))


def rescored_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """5-way, 3-way and binary accuracy where a null prediction is wrong unless gold is null too."""
    g, p = F.col("gold"), F.col("pred")
    gb, pb = binary(g), binary(p)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(p.eqNullSafe(g)).alias("v5"),
        count_where(threeway(p).eqNullSafe(threeway(g))).alias("v3"),
        count_where(pb.eqNullSafe(gb)).alias("v2"),
        count_where((gb == "leak") & (pb == "leak")).alias("tp"),
        count_where((gb == "safe") & (pb == "leak")).alias("fp"),
        count_where((gb == "leak") & ~pb.eqNullSafe(F.lit("leak"))).alias("fn"),
    )
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    return base.select(*by, "n", (F.col("v5") / n).alias("five_way"), (F.col("v3") / n).alias("three_way"), (F.col("v2") / n).alias("two_way"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def dense_confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of every gold and predicted verdict, zeros included; unknown predictions are not counted."""
    cells = df.where(is_valid(F.col("gold")) & is_valid(F.col("pred"))).groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    labels = F.array(*map(F.lit, VERDICTS))
    grid = df.select(*by).distinct().withColumn("gold", F.explode(labels)).withColumn("pred", F.explode(labels))
    return grid.join(cells, [*by, "gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kappa(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns over the rows where both are set; 1 if chance agreement is total."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_where(F.col(a) == F.col(b)).alias("same"))
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("label")), F.struct(F.lit("b").alias("side"), F.col(b).alias("label")))
    marginal = both.select(*by, F.explode(sides).alias("x")).groupBy(*by, F.col("x.label").alias("label")).agg(count_where(F.col("x.side") == "a").alias("na"), count_where(F.col("x.side") == "b").alias("nb"))
    chance = marginal.groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    # In whole numbers: (n * same - products) / (n * n - products), one division.
    top, low = F.col("n") * F.col("same") - F.col("products"), F.col("n") * F.col("n") - F.col("products")
    return n.join(chance, by).select(*by, "n", (F.col("same") / F.col("n")).alias("agreement"), F.when(low == 0, F.lit(1.0)).otherwise(top / low).alias("kappa"))


def pair_calibration(df: DataFrame, key: Column) -> DataFrame:
    """(pair, members, tier): 2 all right, 0 one prediction for all, 1 some right; singles 2 or 0.

    A null prediction is a prediction of its own, and equals a null gold label.
    """
    g = df.groupBy(key.alias("pair")).agg(F.count(F.lit(1)).alias("members"), count_where(F.col("pred").eqNullSafe(F.col("gold"))).alias("right"), F.countDistinct(F.coalesce("pred", F.lit("\0"))).alias("kinds"))
    tier = F.when(F.col("right") == F.col("members"), 2).when(F.col("members") == 1, 0).when(F.col("kinds") == 1, 0).when(F.col("right") > 0, 1).otherwise(0)
    return g.select("pair", "members", tier.alias("tier"))


def tier_breakdown(df: DataFrame, by: list[str], tier: str) -> DataFrame:
    """Counts of tiers 0, 1, 2 and of rows without one, and the mean tier (null if none)."""
    t = F.col(tier)
    return df.groupBy(*by).agg(count_where(t == 0).alias("n0"), count_where(t == 1).alias("n1"), count_where(t == 2).alias("n2"), count_where(t.isNull()).alias("n_missing"), F.try_divide(F.sum(t), F.count(t)).alias("mean"))


def binomial_quantiles(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """The smallest k with P(Binomial(n, p) <= k) >= u, for each u, from the probabilities around the mean."""
    if p <= 0 or n <= 0:
        return np.zeros(len(u), np.int64)
    if p >= 1:
        return np.full(len(u), n, np.int64)
    reach = SPREAD * math.sqrt(n * p * (1 - p)) + 2
    low, high, mode = max(0, math.floor(n * p - reach)), min(n, math.ceil(n * p + reach)), min(n, math.floor((n + 1) * p))
    up, down = np.arange(mode, high, dtype=float), np.arange(mode, low, -1, dtype=float)
    above = np.cumprod((n - up) / (up + 1) * (p / (1 - p)))
    below = np.cumprod(down / (n - down + 1) * ((1 - p) / p))
    cdf = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return np.minimum(low + np.searchsorted(cdf, u * cdf[-1]), high)


def resampled_totals(values: np.ndarray, counts: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The sum of every resample: how often each value is picked is binomial given the picks before it.

    ``draws`` has a row of uniform numbers per resample, one for each value but the last.
    """
    left = np.full(len(draws), int(counts.sum()), np.int64)
    rest, total = int(counts.sum()), np.zeros(len(draws))
    for j, (value, n) in enumerate(zip(values[:-1], counts[:-1])):
        picked = np.zeros(len(draws), np.int64)
        for k in np.unique(left):
            rows = left == k
            picked[rows] = binomial_quantiles(int(k), n / rest, draws[rows, j])
        total, left, rest = total + value * picked, left - picked, rest - int(n)
    return total + values[-1] * left


def bootstrap_interval(counts: DataFrame, value: str, replicates: int, seed: str) -> DataFrame:
    """(mean, low, high, n) of the mean of ``value`` over ``replicates`` resamples, given (value, n).

    Only the counts of the few distinct values matter: a resample is a multinomial draw of them, made of
    one binomial number per value from a hash of seed, replicate and value, so its cost does not depend
    on the number of rows. The bounds are the replicates at positions int(.025 B) and int(.975 B) of the
    sorted means. ``counts`` must have few rows, as tiers and hits do; null values are left out. No rows
    give nulls and n 0.
    """
    spark = counts.sparkSession
    kept = counts.where(F.col(value).isNotNull() & (F.col("n") > 0)).groupBy(F.col(value).cast("double").alias("v")).agg(F.sum("n").alias("n"))
    vs = kept.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("vs"))
    uniform = F.transform(F.sequence(F.lit(1), F.size("vs")), lambda j: (portable_hash(seed, F.col("id"), j) + 0.5) / F.lit(2.0**32))
    rows = spark.range(replicates).crossJoin(F.broadcast(vs)).where("size(vs) > 0").select("vs", uniform.alias("us"))  # one row

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cells = pdf["vs"].iloc[0]
                values, sizes = np.array([x["v"] for x in cells], float), np.array([x["n"] for x in cells], np.int64)
                yield pd.DataFrame({"m": resampled_totals(values, sizes, np.stack(pdf["us"].to_numpy())) / sizes.sum()})

    ranked = rows.mapInPandas(draw, "m double").withColumn("rn", F.row_number().over(Window.orderBy("m")))  # B rows, a fixed number
    low, high = int(0.025 * replicates) + 1, int(0.975 * replicates) + 1
    bounds = ranked.agg(F.max(F.when(F.col("rn") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("rn") == high, F.col("m"))).alias("high"))
    n = F.aggregate("vs", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    mean = F.try_divide(F.aggregate("vs", F.lit(0.0), lambda a, x: a + x["v"] * x["n"]), n)
    return vs.select(mean.alias("mean"), n.alias("n")).crossJoin(bounds).select("mean", "low", "high", "n")
