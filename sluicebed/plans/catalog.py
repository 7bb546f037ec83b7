"""The catalogue of core queries: name, function and, where SQL can say it, the DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import portable_hash
from ..functions.verdicts import VERDICTS, plain_verdict
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its DuckDB statement if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- pieces of SQL shared by the statements -------------------------------------------------------

VERDICT_LIST = "['" + "', '".join(VERDICTS) + "']"
LEAK_LIST = "('gives_final_answer', 'gives_away_key_step')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def sql_verdict(x: str) -> str:
    t = f"regexp_replace(lower({sql_strip(x)}), '[\\s\\-]+', '_', 'g')"
    return f"CASE WHEN list_contains({VERDICT_LIST}, {t}) THEN {t} END"


def sql_hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::BIGINT"


def sql_words(x: str, least: int, stop: list[str] = ()) -> str:
    found = f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]{{{least},}}'))"
    if not stop:
        return found
    return f"list_filter({found}, lambda w: NOT list_contains(['" + "', '".join(stop) + "'], w))"


def sql_literal(text: str, literal: str) -> str:
    return f"coalesce({literal} <> '' AND regexp_matches(coalesce({text}, ''), '(^|[^0-9])' || regexp_escape({literal}) || '([^0-9]|$)'), false)"


def sql_covered(key: str, text: str) -> str:
    both = f"len(list_intersect({key}, {text}))"
    return f"({both} >= 3 AND {both} * 4 >= len({key}) * 3)"


_COLUMNS = "problem correct_solution final_answer key_step candidate_message gold_reasoning gold_rewrite slice".split()
GOLD = f"gold AS (SELECT id, min({sql_verdict('gold_verdict')}) AS gold, {', '.join(f'min({c}) AS {c}' for c in _COLUMNS)} FROM v1_test GROUP BY id)"
MODELS = ["m1", "m2", "m3", "m4", "m5"]
_H = sql_hash("id", "model")
_MODELS = " UNION ALL ".join(f"SELECT '{m}'" for m in MODELS)
PREDS = f"""h AS (SELECT id, gold, slice, candidate_message, model, {_H} AS h FROM gold CROSS JOIN (SELECT * FROM ({_MODELS}) t(model)) m),
preds AS (SELECT id, gold, slice, candidate_message, model, h, CASE WHEN h % 100 < 60 THEN gold WHEN h % 100 < 65 THEN NULL WHEN h % 100 < 68 THEN 'unknown' ELSE {VERDICT_LIST}[(h // 100) % 5 + 1] END AS pred FROM h)"""
WITH_PREDS = f"WITH {GOLD},\n{PREDS}"


# -- the same pieces as tables --------------------------------------------------------------------


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation items, one row per id, with the verdict in the plain spelling."""
    df = table(spark, d, "v1_test")
    return df.groupBy("id").agg(F.min(plain_verdict(F.col("gold_verdict"))).alias("gold"), *(F.min(c).alias(c) for c in _COLUMNS))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Recorded outputs of five models, a fixed function of id and model; some null, some unknown labels."""
    h = portable_hash(F.col("id"), F.col("model"))
    items = gold(spark, d).select("id", "gold", "slice", "candidate_message", F.explode(F.array(*map(F.lit, MODELS))).alias("model")).withColumn("h", h)
    r = F.col("h") % 100
    other = F.element_at(F.array(*map(F.lit, VERDICTS)), (F.floor(F.col("h") / 100) % 5 + 1).cast("int"))
    return items.withColumn("pred", F.when(r < 60, F.col("gold")).when(r < 65, None).when(r < 68, F.lit("unknown")).otherwise(other))
