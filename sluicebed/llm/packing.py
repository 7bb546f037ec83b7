"""Filling fixed-capacity containers with items of varying length.

Method: best-fit decreasing. Items go largest first into the open container with the least room that
still holds them, found in logarithmic time by a segment tree over the remaining capacities. The
items, and the parts of divided ones, are spread over groups of bounded size by a hash, so that any
number of them is packed in parallel; a group leaves only its last few containers partly filled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .tokens import count_tokens

#: Items of a group: large enough that its last, partly filled containers do not matter.
GROUP_ITEMS = 50_000


class OpenContainers:
    """The open containers by remaining capacity; a segment tree holds which capacities occur."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = bytearray(2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, container: int) -> None:
        self.held[room].append(container)
        i = self.size + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest occurring capacity of at least ``least``."""
        i = self.size + least
        if not self.any[i]:
            while i > 1 and not (i & 1 == 0 and self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, room: int) -> int:
        container = self.held[room].pop()
        i = self.size + room
        if not self.held[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return container


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item; ``sizes`` must fall and lie between 0 and ``capacity``."""
    opened, tree, out = 0, OpenContainers(capacity), []
    for size in sizes:
        room = tree.tightest(size)
        if room is None:
            container, room, opened = opened, capacity, opened + 1
        else:
            container = tree.take(room)
        tree.put(room - size, container)
        out.append(container)
    return out


def token_sizes(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n_tokens) with one row per id; null and empty texts have 0 tokens, null ids are left out."""
    kind = df.select(F.col(f"`{id_column}`")).schema[0].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count_tokens(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["id", "n_tokens"])

    sizes = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).where("id is not null").mapInArrow(scan, f"id {kind}, n_tokens bigint")
    return sizes.groupBy("id").agg(F.max("n_tokens").alias("n_tokens"))


def part_count(capacity: int) -> Column:
    """The parts that an item of ``n_tokens`` is divided into: one, unless it is larger than the capacity."""
    return F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")


def pack(sizes: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The container of every item of (id, n_tokens): (id, part, n_parts, n_tokens, container_id).

    An item is divided only if it is larger than the capacity: into full parts and a rest. No container
    holds more than the capacity. Items of size 0 go where there is an open container. Equal input
    gives equal output. Empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sizes = settle(sizes.select("id", "n_tokens"), "sizes")  # counted first, then packed
    kind = sizes.schema["id"].dataType.simpleString()
    parts = sizes.select("id", "n_tokens", part_count(capacity).alias("n_parts")).select("id", "n_parts", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    parts = parts.select("id", "part", "n_parts", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("n_tokens"))
    n_items = sizes.agg(F.sum(part_count(capacity))).first()[0] or 0
    n_groups = max(1, -(-n_items // group_items))
    grouped = parts.withColumn("grp", F.pmod(F.xxhash64("id", "part"), F.lit(n_groups)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "part"], ascending=[False, True, True], kind="stable")
        number = np.array(best_fit_decreasing(pdf["n_tokens"].tolist(), capacity), np.int64)
        return pd.DataFrame({"id": pdf["id"], "part": pdf["part"], "n_parts": pdf["n_parts"], "n_tokens": pdf["n_tokens"], "container_id": (np.int64(pdf["grp"].iloc[0]) << 32) + number})

    return grouped.groupBy("grp").applyInPandas(fill, f"id {kind}, part int, n_parts int, n_tokens int, container_id bigint")


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least number of containers any packing needs, share filled."""
    total = packed.agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("id").alias("n_items"))
    return total.select("n_items", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "n_containers", F.ceil(F.coalesce("n_tokens", F.lit(0)) / capacity).alias("least_containers"), F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity).alias("share_filled"))
