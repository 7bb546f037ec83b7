"""JSON-lines tables: strict and tolerant reads, shards, overwrites with backup, appends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..operators.dedup import one_per_key


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A strict read: blank lines are skipped, a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All shards of a folder with ``_shard``: the row's own value, else the name of its file."""
    full = StructType(list(schema.fields)).add("_shard", StringType()) if "_shard" not in schema.names else schema
    return read_jsonl(spark, path, full).withColumn("_shard", F.coalesce("_shard", F.col("_metadata.file_name")))


def read_tolerant(spark: SparkSession, path: str, schema: StructType, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the last valid row of every key, and one row with the number of bad lines.

    A line is bad if it does not parse or ``valid`` does not hold. Last means the greatest (file name,
    position in the file).
    """
    full = StructType(list(schema.fields)).add("_corrupt_record", StringType())
    raw = spark.read.schema(full).option("mode", "PERMISSIVE").json(path).withColumns({"_file": F.col("_metadata.file_name"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
    ok = F.col("_corrupt_record").isNull() & F.col(key).isNotNull() & F.coalesce(valid, F.lit(False))
    # Within a file block, ids rise with the lines; between blocks the block start decides.
    rows = one_per_key(raw.where(ok), [F.col(key)], [F.col("_file").desc(), F.col("_block").desc(), F.col("_row").desc()])
    bad = raw.agg(F.count_if(~ok).alias("n_bad"))
    return rows.select(*schema.names), bad


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one of the same schema if there is none at the path."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_existing(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """The union of those paths that exist."""
    found = [p for p in paths if exists(spark, p)]
    return read_jsonl(spark, found, schema) if found else spark.createDataFrame([], schema)


def newest(spark: SparkSession, folder: str, suffix: str = "") -> str | None:
    """The path in a folder that was modified last; null if there is none."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    found = [s for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix)]
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().getName())).getPath().toString() if found else None


def replace_with_backup(df: DataFrame, path: str, backup: str) -> None:
    """Overwrite a table that ``df`` may be reading.

    The old table becomes the backup unless there is one already; the new one is written beside it and
    swapped in by renames, so a failure leaves either the old or the new table.
    """
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    write_jsonl(df, staged)
    fs, target = _fs(spark, path)
    new, kept = _fs(spark, staged)[1], _fs(spark, backup)[1]
    if fs.exists(target):
        if fs.exists(kept):
            fs.delete(target, True)
        else:
            fs.rename(target, kept)
    fs.rename(new, target)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log with their time of arrival in ``ts`` (epoch seconds)."""
    stamped = df.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6)
    write_jsonl(stamped, path, "append")


def write_once(df: DataFrame, path: str, force: bool = False) -> bool:
    """Write unless the table is there already; whether it was written."""
    if exists(df.sparkSession, path) and not force:
        return False
    write_jsonl(df, path)
    return True


def write_chunks(df: DataFrame, path: str, chunks: int, order: list[Column]) -> None:
    """Ceil-sized chunks in order, one folder per chunk."""
    from ..operators.sampling import ceil_chunks

    ceil_chunks(df, order, chunks).write.mode("overwrite").partitionBy("batch").option("ignoreNullFields", "false").json(path)


def result_items(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(id, pred) of result files that are a list, or hold one under ``items`` or ``per_item``.

    A file is one result, or with ``one_per_line`` each of its lines is.
    """
    v = F.try_parse_json(F.col("value"))
    as_list = F.coalesce(F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), v), F.try_variant_get(v, "$.items", "variant"), F.try_variant_get(v, "$.per_item", "variant"))
    rows = spark.read.text(path, wholetext=not one_per_line).select(F.try_variant_get(as_list, "$", "array<struct<id:string,pred:string>>").alias("items"))
    return rows.select(F.explode("items").alias("x")).select("x.id", "x.pred")
