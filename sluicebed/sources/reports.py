"""Small aggregates as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(c: Column, digits: int = 1) -> Column:
    """A share as a percentage; n/a for null. Halves go to the even digit, here and below."""
    return F.coalesce(F.format_string(f"%.{digits}f%%", F.bround(c * 100, digits)), F.lit("n/a"))


def signed(c: Column, digits: int = 3) -> Column:
    return F.coalesce(F.format_string(f"%+.{digits}f", F.bround(c, digits)), F.lit("n/a"))


def interval_cell(mean: Column, low: Column, high: Column) -> Column:
    """``mean [low,high]`` with two digits; n/a if there is no mean."""
    return F.when(mean.isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f [%.2f,%.2f]", *(F.bround(x, 2) for x in (mean, low, high))))


def markdown_table(df: DataFrame, order: list[str], limit: int = 1000) -> str:
    """A table of at most ``limit`` rows as Markdown; meant for aggregates."""
    rows = df.orderBy(*order).limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return head + "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"


def exemplar_pack(df: DataFrame, label: str, key: str, text: Column, per_label: int) -> DataFrame:
    """(label, pack): the texts of the first records of every label, joined in order."""
    from ..operators.sampling import cap_per_class

    few = cap_per_class(df.withColumn("_t", text), [label], [F.col(key)], per_label)
    return few.groupBy(label).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_t").alias("t")))).alias("x")).select(label, F.array_join(F.transform("x", lambda e: e["t"]), "\n---\n").alias("pack"))
