"""Structured Streaming over append-only feedback: counts, windows, deduplication, queues, first hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def feedback_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Counts per event-time window and kind; later events than the watermark are left out."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n"))


def first_reviews(events: DataFrame, key: str, ts: str, lateness: str = "60 days") -> DataFrame:
    """One event per key within the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def live_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, exactly once per checkpoint, into a parquet table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_available_totals(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The same for totals, in update mode: every batch adds a folder with the totals it changed.

    A batch that is run again replaces its own folder and no other, so a crash loses nothing; state
    past the watermark is dropped. ``latest_totals`` reads the table.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def latest_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The totals of the last batch that changed them, by ``keys``."""
    rows = spark.read.parquet(path)
    rest = [name for name in rows.columns if name not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def maintain_reviewed(stream: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """Keep the table of reviewed ids, one folder per batch, so that a repeated batch replaces itself.

    A stream cannot be the right side of an anti join; the queue of open items is the batch anti join
    of the items with this table.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def open_items(items: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    return items.join(reviewed.select(key).distinct(), key, "left_anti")


class StopAtFirstHit(StatefulProcessor):
    """Turns of a key in the order of arrival until the first hit; what comes after it is not counted.

    The state is (turns seen, turn of the first hit or 0, most turns), one row per key whatever its
    number of turns. Every batch that changes a key gives its new state.
    """

    def __init__(self, key: str, order: str, hit: str, most: int):
        self.key, self.order, self.hit, self.most = key, order, hit, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("turns", "turns int, first_hit int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        turns, first = self.state.get() if self.state.exists() else (0, 0)
        for pdf in rows:
            if first or turns >= self.most:
                continue
            hits = pdf.sort_values(self.order, kind="stable")[self.hit].fillna(False).to_numpy(bool)[: self.most - turns]
            at = int(hits.argmax()) + 1 if hits.any() else 0
            first = turns + at if at else 0
            turns += at or len(hits)
        self.state.update((turns, first))
        yield pd.DataFrame({self.key: [key[0]], "turns": [turns], "first_hit": [first or None]}).astype({"first_hit": "Int32"})

    def close(self) -> None:
        pass


def first_hits(events: DataFrame, key: str, order: str, hit: str, most: int = 15) -> DataFrame:
    """(key, turns, first_hit) of every key: the turns up to the first hit, at most ``most``, and its number.

    Null hits are no hits. The rows of a batch are taken in the order of ``order``, batches in theirs.
    Needs the RocksDB state store.
    """
    kind = events.schema[key].dataType.simpleString()
    return events.select(key, order, hit).groupBy(key).transformWithStateInPandas(StopAtFirstHit(key, order, hit, most), f"{key} {kind}, turns int, first_hit int", "Update", "None")
