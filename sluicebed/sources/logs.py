"""Training logs as series of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import reset_runs


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """(file, run, kind, iteration, loss) of lines like ``Iter 10: Train loss 1.25``; ``file`` is the path.

    A run starts where the iteration falls back. Lines keep their order by the block of the file they
    stand in and their place in it, so a large file is read and numbered by many tasks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    hit = r"Iter (\d+): (Train|Val) loss ([\d.]+)"
    rows = lines.where(F.regexp_like("value", F.lit(hit))).select("file", "block", "line", F.regexp_extract("value", hit, 2).alias("kind"), F.regexp_extract("value", hit, 1).cast("int").alias("iteration"), F.regexp_extract("value", hit, 3).cast("double").alias("loss"))
    return reset_runs(rows, ["file"], [F.col("block"), F.col("line")], "iteration").select("file", "run", "kind", "iteration", "loss")


def longest_run(losses: DataFrame) -> DataFrame:
    """The rows of the run with most lines of each file, the first on ties."""
    sizes = losses.groupBy("file", "run").agg(F.count("*").alias("n"))
    best = sizes.groupBy("file").agg(F.max(F.struct("n", (-F.col("run")).alias("r"))).alias("b")).select("file", (-F.col("b.r")).alias("run"))
    return losses.join(best, ["file", "run"])
