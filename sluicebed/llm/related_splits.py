"""Train, validation and test splits that keep related records together.

Method: records are linked through the problem they tell and through the conversation, dialogue, pair
or original that their id names; hash-to-min finds the components and weighted rendezvous hashing
gives each component its split.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .components import component_labels
from .problem_key import problem_key
from .words import text_hash

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}

# The forms of ids that name something shared by several records.
_ORIGIN = [(re.compile(r"^(mrb-.+)-[^-]+$"), 1), (re.compile(r"^(mathdial-.+)-[^-]+$"), 1), (re.compile(r"^(.*adv-\d+)[a-z]$"), 1)]
_REMADE = re.compile(r"(?:-r\d+)+$")


def id_origin(key: str) -> str:
    """The conversation, dialogue, pair or original that an id names; for other ids the id itself."""
    key = _REMADE.sub("", key.strip())
    for pattern, group in _ORIGIN:
        m = pattern.match(key)
        if m:
            return m.group(group)
    return key


def link_keys(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, problem, pkey, origin) of every row with an id; rows without a problem have a key of their own."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            pkeys, origins = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                origin = text_hash(id_origin(key), 2)
                pkey = seen.get(text) if text else None
                if pkey is None:
                    canonical = problem_key(text) if text else ""
                    pkey = text_hash(canonical, 1) if canonical else text_hash(str(origin), 3)
                    if canonical and len(seen) < 100_000:
                        seen[text] = pkey
                pkeys.append(pkey)
                origins.append(origin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pkeys, pa.int64()), pa.array(origins, pa.int64())], names=["id", "problem", "pkey", "origin"])

    return df.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{text_column}`").cast("string").alias("problem")).where("id is not null").mapInArrow(scan, "id string, problem string, pkey bigint, origin bigint")


def related_groups(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, group_id, n_problems): group_id is the smallest id of the record's component.

    ``n_problems`` is 2 if the component holds at least two different problem strings, else 1 (0 if it
    holds none). Records are related if they tell the same problem, if their ids name the same
    conversation, dialogue, pair or original, or through others. A null or blank problem relates no
    records; null ids are left out; repeated rows count once; an empty table gives no rows.
    """
    keyed = settle(link_keys(df, id_column, text_column), "keys")
    # The graph joins problems through origins. An origin with one problem joins nothing, which leaves
    # out nearly all records; one popular problem is one node, however many records tell it.
    links = keyed.groupBy("origin").agg(F.min("pkey").alias("first"), F.max("pkey").alias("last")).where("first < last")
    edges = keyed.select("origin", "pkey").join(links, "origin").select(F.col("first").alias("u"), F.col("pkey").alias("v")).where("u <> v").distinct()
    labels = component_labels(edges).withColumnRenamed("node", "pkey")
    # Group facts by problem first: a handful of rows per component then meet in one place.
    by_problem = keyed.groupBy("pkey").agg(F.min("id").alias("id_min"), F.min("problem").alias("p_min"), F.max("problem").alias("p_max"))
    labelled = settle(by_problem.join(labels, "pkey", "left").withColumn("label", F.coalesce("label", "pkey")), "labels")
    facts = labelled.groupBy("label").agg(F.min("id_min").alias("group_id"), F.min("p_min").alias("p_min"), F.max("p_max").alias("p_max"))
    n = F.when(F.col("p_min").isNull(), 0).when(F.col("p_min") < F.col("p_max"), 2).otherwise(1)
    groups = labelled.select("pkey", "label").join(facts, "label").select("pkey", "group_id", n.alias("n_problems"))
    return keyed.select("id", "pkey").join(groups, "pkey").select("id", "group_id", "n_problems").distinct()


def rendezvous_split(group: F.Column, shares: dict[str, float] = SPLITS, seed: str = "") -> F.Column:
    """The split of a group: each split draws a number from the group's hash, weighted by its share.

    A group keeps its split when other groups come or go, and few move when a share changes.
    """
    best = None
    for name, share in shares.items():
        if share <= 0:
            continue
        u = (F.shiftrightunsigned(F.xxhash64(group, F.lit(name), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        draw = F.struct((-F.log(u) / F.lit(float(share))).alias("score"), F.lit(name).alias("split"))
        best = draw if best is None else F.least(best, draw)
    return best["split"]


def assign_splits(df: DataFrame, id_column: str, text_column: str, shares: dict[str, float] = SPLITS, seed: str = "") -> DataFrame:
    """(id, group_id, split) for every id, all records of a group in one split."""
    return related_groups(df, id_column, text_column).select("id", "group_id", rendezvous_split(F.col("group_id"), shares, seed).alias("split"))


def split_report(assigned: DataFrame, shares: dict[str, float] = SPLITS) -> DataFrame:
    """(split, target_share, n_records, n_groups, share) for every split, unused ones included."""
    spark = assigned.sparkSession
    counts = assigned.groupBy("split", "group_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_groups"))
    total = counts.agg(F.sum("n_records").alias("total"))
    target = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "split string, target_share double")
    joined = target.join(counts, "split", "left").crossJoin(F.broadcast(total))  # ``total`` is one row
    return joined.select("split", "target_share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce(F.try_divide("n_records", "total"), F.lit(0.0)).alias("share"))
