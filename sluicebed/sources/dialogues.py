"""Nested conversation documents and dialogue strings as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import problem_in, split_turns, tagged_turns

NESTED = """conversation_id string, conversation_history string, ground_truth string,
responses map<string, struct<response: string, annotation: map<string, string>>>"""


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of conversations, one row per model response in the order of the file."""
    return nested_rows(spark.read.schema(NESTED).option("multiLine", "true").json(path))


def nested_rows(docs: DataFrame) -> DataFrame:
    """One row per response of conversation documents."""
    turns = split_turns(F.col("conversation_history"))
    rows = docs.select("conversation_id", "ground_truth", turns.alias("turns"), F.posexplode(F.map_entries("responses")).alias("pos", "e"))
    return rows.select("conversation_id", "pos", F.col("e.key").alias("model"), F.col("e.value.response").alias("response"), F.col("e.value.annotation").alias("annotation"), problem_in(F.col("turns")).alias("problem"), "turns", "ground_truth")


def guided_turns(df: DataFrame, key: str, dialogue: str, moves: list[str], least: int) -> DataFrame:
    """(key, pos, move, text, history) of the teacher turns with one of the moves, enough text and context."""
    parsed = df.select(F.col(key), tagged_turns(F.col(dialogue)).alias("turns"))
    rows = parsed.select(key, "turns", F.posexplode("turns").alias("pos", "t"))
    kept = rows.where((F.col("t.role") == "Teacher") & F.col("t.move").isin(moves) & (F.col("pos") > 0) & (F.length("t.text") >= least))
    history = F.transform(F.slice("turns", F.lit(1), F.col("pos")), lambda t: F.concat_ws(": ", t["role"], t["text"]))
    return kept.select(key, "pos", "t.move", "t.text", history.alias("history"))
