"""Deterministic rows for smoke runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cycle(spark: SparkSession, n: int, topics: DataFrame, order: str, labels: list[str], keep: Column | None = None) -> DataFrame:
    """``n`` rows that cycle through the topics and the labels, filtered by ``keep``.

    ``topics`` is a short list; row i has topic i mod (number of topics) and label i mod (number of
    labels). If ``keep`` rejects rows, the count falls short of ``n`` by at most what a full cycle lacks.
    """
    count = topics.count()
    numbered = topics.withColumn("_k", F.expr(f"row_number() over (order by {order}) - 1"))
    rows = spark.range(n).withColumn("_k", F.col("id") % count).join(F.broadcast(numbered), "_k").drop("_k")  # the short list
    rows = rows.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), (F.col("id") % len(labels) + 1).cast("int")))
    return rows.where(keep) if keep is not None else rows
