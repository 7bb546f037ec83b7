"""The registered queries of this subpackage; each reads whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .calibrated_sample import draw, plan_table, sampling_plan
from .consensus import consensus, contradicted_majorities
from .cross_split import cross_split_pairs, overlap_report
from .defects import FIELDS as P6_FIELDS
from .defects import defect_report, find_defects
from .leakage import leaked_items, leaked_spans
from .near_duplicates import near_duplicate_groups, near_duplicate_pairs, stacked_texts
from .packing import pack, packing_report, part_count, token_sizes
from .pieces import split_oversized
from .related_splits import assign_splits, related_groups, split_report
from .verdicts import named_label

P4_FIELDS = ["v1_b.candidate_message", "human_boundary.leaky_candidate", "human_boundary.safe_rewrite"]
P5_FIELDS = ["candidate_message", "problem"]


P2_NAMES = ["slice", "gold_verdict"]
P2_SHARE = 0.2


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "train_flagged")
    items, _ = consensus(df, "id", "votes", strict=False)  # its rows do not depend on the weights
    return contradicted_majorities(df, "id", "majority", items)


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return consensus(table(spark, d, "train_flagged"), "id", "votes")[0]


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return p1_items(spark, d).select("id", "n_votes", "agreement", "plurality", "plurality_votes")


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus(table(spark, d, "train_flagged"), "id", "votes")[1]


def _p2_plan(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    return sampling_plan(table(spark, d, "v1_test"), "id", {"slice": F.col("slice"), "gold_verdict": named_label(F.col("gold_verdict"))}, table(spark, d, "sample_targets"), P2_SHARE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return plan_table(*_p2_plan(spark, d), P2_NAMES).where("gap > 0").select(*P2_NAMES)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return plan_table(*_p2_plan(spark, d), P2_NAMES)


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return draw(*_p2_plan(spark, d), P2_NAMES)


def _p4_texts(spark: SparkSession, d: str) -> DataFrame:
    b, h = table(spark, d, "v1_b"), table(spark, d, "human_boundary")
    return stacked_texts([(0, 0, b, "id", "candidate_message"), (0, 1, h, "id", "leaky_candidate"), (0, 2, h, "id", "safe_rewrite")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(_p4_texts(spark, d), P4_FIELDS)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_p4_texts(spark, d), P4_FIELDS)


def _p5_texts(spark: SparkSession, d: str) -> DataFrame:
    t, b = table(spark, d, "v1_test"), table(spark, d, "v1_b")
    return stacked_texts([(side, k, df, "id", name) for side, df in enumerate((t, b)) for k, name in enumerate(P5_FIELDS)])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(_p5_texts(spark, d), P5_FIELDS)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    splits = table(spark, d, "v1_test").select(F.lit("test").alias("split"), "id", F.col("slice").alias("source")).unionByName(table(spark, d, "v1_b").select(F.lit("train").alias("split"), "id", F.col("slice").alias("source")))
    return overlap_report(p5_found(spark, d), splits)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return related_groups(table(spark, d, "v1_b"), "id", "problem").where("n_problems > 1").select("id", "group_id")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(table(spark, d, "v1_b"), "id", "problem")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return split_report(p3_splits(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_defects(table(spark, d, "v1_b"), "id", P6_FIELDS, "problem", "conversation_history", "candidate_message", "verdict")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return defect_report(p6_found(spark, d))


def _limits(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "token_limits").where(F.col("purpose") == purpose).agg(F.min("max_tokens").alias("m"), F.min("overlap_tokens").alias("o")).first()
    return row.m, row.o or 0


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = pack(token_sizes(table(spark, d, "documents"), "doc_id", "text"), _limits(spark, d, "container")[0])
    return packed.withColumnRenamed("id", "doc_id")


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    capacity = _limits(spark, d, "container")[0]
    return token_sizes(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "n_tokens", part_count(capacity).alias("n_parts"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p7_containers(spark, d).withColumnRenamed("doc_id", "id"), _limits(spark, d, "container")[0])


def _p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "gives_away_probe"), "id", ["problem", "correct_solution", "candidate_message"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return _p8_spans(spark, d)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_p8_spans(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limits(spark, d, "piece")
    return split_oversized(table(spark, d, "documents"), "doc_id", "text", limit, overlap, with_text=False).select(F.col("id").alias("doc_id")).distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limits(spark, d, "piece")
    return split_oversized(table(spark, d, "documents"), "doc_id", "text", limit, overlap).withColumnRenamed("id", "doc_id")


_NAMES = """p1_found p1_items p1_agreement p1_annotators p2_found p2_report p2_sample
p3_found p3_splits p3_report p4_found p4_groups p5_found p5_report
p6_found p6_report p7_containers p7_sizes p7_report p8_found p8_spans p8_items p9_found p9_pieces""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as statements

    return statements()
