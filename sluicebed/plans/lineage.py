"""Cutting lineage with tables in the folder that all executors share.

Iterative operators and plans whose intermediate result feeds several branches write that result
once and read it back, so a lost executor costs a re-read and never a recomputation of the past.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named, a local session gets a temporary one; on a cluster that would be a folder only
    the driver sees, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sluicebed-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table read back.

    The table stays until ``release`` or ``drop_settled``, or until the ``settled_scope`` around it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the folder's owner cleans up then
        pass


def release(df: DataFrame) -> None:
    """Delete the table of a result of ``settle`` that nothing reads any more."""
    path = getattr(df, "settled_path", None)
    for entry in [x for x in _WRITTEN if x[1] == path]:
        _WRITTEN.remove(entry)
        _delete(*entry)


@contextmanager
def settled_scope() -> Iterator[None]:
    """Delete, at the end, the tables settled inside; for a query whose result is stored before that."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        while len(_WRITTEN) > before:
            _delete(*_WRITTEN.pop())


def drop_settled() -> None:
    """Delete the tables that ``settle`` wrote; results that still read them can no longer run."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


atexit.register(drop_settled)
