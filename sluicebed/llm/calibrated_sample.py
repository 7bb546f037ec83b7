"""Samples whose category shares follow targets.

Method: calibration. Inclusion probabilities are an exponential tilting of equal ones, found by Newton
iterations on the dual from category counts that are added up distributedly; the pivotal method then
draws exactly the wanted numbers. Categories too small for their target are taken whole and reported.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle

#: Rows of a block in which the pivotal method runs on its own; each leaves at most one open row.
BLOCK = 20_000
#: The targets are a small table of categories that the driver solves for; more are refused.
MAX_CATEGORIES = 10_000


def newton_tilt(counts: np.ndarray, targets: np.ndarray, base: float, features: np.ndarray | None = None, steps: int = 100) -> np.ndarray:
    """Inclusion probabilities base * exp(features @ lambda) per category that meet the target sums.

    Minimises the dual sum(counts * base * exp(A l)) - t l by damped Newton steps. ``features`` are
    indicator columns, ``targets`` sums per feature. By default there is one per category; the Hessian
    is diagonal then and a step costs no more than the number of categories. With others, such as the
    margins of the categories, it is a matrix of their number squared.
    """
    lam = np.zeros(len(targets))
    tilt = (lambda x: x) if features is None else (lambda x: features @ x)

    def dual(x: np.ndarray) -> float:
        with np.errstate(over="ignore"):
            return float((counts * base * np.exp(tilt(x))).sum() - targets @ x)

    for _ in range(steps):
        expected = counts * base * np.exp(tilt(lam))
        gap = (expected if features is None else features.T @ expected) - targets
        if np.abs(gap).max(initial=0) < 1e-12 * max(1.0, targets.sum()):
            break
        if features is None:  # the categories are independent of each other, so each is damped on its own
            lam = lam - np.clip(gap / np.maximum(expected, 1e-300), -2, 2)
            continue
        step = np.linalg.solve((features.T * expected) @ features + 1e-12 * np.eye(len(lam)), gap)
        size = 1.0
        while size > 1e-8 and not dual(lam - size * step) <= dual(lam):
            size /= 2
        lam = lam - size * step
    return base * np.exp(tilt(lam))


def sampling_plan(df: DataFrame, id_column: str, categories: dict[str, Column], targets: DataFrame, share: float) -> tuple[DataFrame, list[dict]]:
    """(records, plan): the distinct ids with their categories, and one entry per target category.

    ``categories`` gives, for each category column of ``targets``, the expression over ``df`` that
    matches it; ``targets`` also has ``target_share`` and ``min_rows``, further columns are ignored. The
    sample has ``ceil(share * ids)`` records; a category wants the larger of its minimum and its share
    of that, rounded up. An entry has ``wanted``, ``available``, ``taken`` (the smaller of the two),
    ``probability`` and ``gap``. Records with a null in a category column belong to no category; null
    ids are left out; an id that occurs with several categories counts in the smallest. Repeated target
    rows count once, null shares and minimums as 0. Empty tables give an empty plan or empty categories.
    """
    names = list(categories)
    keyed = df.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.struct(*(c.alias(n) for n, c in categories.items())).alias("k")).where("id is not null")
    records = settle(keyed.groupBy("id").agg(F.min("k").alias("k")).select("id", "k.*"), "records")
    goal = targets.groupBy(*names).agg(F.max("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"))
    counts = records.groupBy(*names).agg(F.count("*").alias("available"))
    rows = goal.join(counts, names, "left").select(*names, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), F.coalesce("available", F.lit(0)).alias("available")).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} target categories")
    size = math.ceil(round(records.count() * share, 9))
    plan = [r.asDict() | {"wanted": max(r.min_rows, math.ceil(round(r.target_share * size, 9)))} for r in rows]
    for p in plan:
        p["taken"], p["probability"] = 0, 0.0
    asked = [p for p in plan if p["wanted"] > 0 and p["available"] > 0]
    # A probability above 1 is a target that the category cannot fill: it is taken whole and the rest reported.
    tilted = newton_tilt(np.array([p["available"] for p in asked], float), np.array([p["wanted"] for p in asked], float), share) if asked else []
    for p, q in zip(asked, tilted):
        p["taken"] = min(p["available"], round(float(q) * p["available"]))
        p["probability"] = 1.0 if p["taken"] == p["available"] else float(q)
    for p in plan:
        p["gap"] = p["wanted"] - p["taken"]
    return records, sorted(plan, key=lambda p: [str(p[n]) for n in names])


def pivotal(probabilities: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The pivotal method in order: duels decide all entries to 0 or 1, save at most one."""
    out = probabilities.astype(float).copy()
    held = -1
    for i, q in enumerate(probabilities):
        if q <= 0 or q >= 1:
            continue
        if held < 0:
            held = i
            continue
        p, q = out[held], out[i]
        s = p + q
        if s < 1:
            if draws[i] * s < q:
                out[held], out[i], held = 0.0, s, i
            else:
                out[held], out[i] = s, 0.0
        else:
            if draws[i] * (2 - s) < 1 - q:
                out[held], out[i], held = 1.0, s - 1, i
            else:
                out[i], out[held] = 1.0, s - 1
        if held >= 0 and (out[held] < 1e-9 or out[held] > 1 - 1e-9):
            out[held], held = round(out[held]), -1
    return out


def draw(records: DataFrame, plan: list[dict], names: list[str], seed: str = "", block: int = BLOCK) -> DataFrame:
    """The sampled records (id and category columns): exactly ``taken`` of every category."""
    spark = records.sparkSession
    rows = [(*(p[n] for n in names), p["probability"], max(1, -(-p["available"] // block))) for p in plan if p["taken"]]
    schema = records.select(*names).schema.add("_pi", "double").add("_blocks", "integer")
    chances = spark.createDataFrame(rows, schema)
    unit = lambda tag: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed + tag)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    # the order of the records, their block and each of the two rounds of duels have randomness of their own
    work = records.join(F.broadcast(chances), names).withColumns({"_u": unit(""), "_first": unit("first"), "_last": unit("last")}).withColumn("_block", F.pmod(F.xxhash64("id", F.lit(seed + "#")), F.col("_blocks")).cast("int"))
    schema = work.schema

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "id"], kind="stable")
        return pdf.assign(_pi=pivotal(pdf["_pi"].to_numpy(), pdf["_first"].to_numpy()))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "id"], kind="stable")
        out = pivotal(pdf["_pi"].to_numpy(), pdf["_last"].to_numpy())
        return pdf.assign(_pi=np.round(out))  # the wanted number is whole, so what is left is rounding noise

    whole = work.where("_pi >= 1")
    first = settle(work.where("_pi < 1").groupBy(*names, "_block").applyInPandas(decide, schema), "duels")
    left = first.where("_pi > 0 and _pi < 1").groupBy(*names).applyInPandas(finish, schema)  # one row per block at most
    return whole.unionByName(first.where("_pi >= 1")).unionByName(left.where("_pi >= 1")).select("id", *names)


def plan_table(records: DataFrame, plan: list[dict], names: list[str]) -> DataFrame:
    """The plan as a table: category, target_share, min_rows, wanted, available, taken, gap, probability."""
    fields = ["target_share", "min_rows", "wanted", "available", "taken", "gap", "probability"]
    schema = records.select(*names).schema
    for f in fields:
        schema = schema.add(f, "double" if f in ("target_share", "probability") else "long")
    return records.sparkSession.createDataFrame([tuple(round(p[n], 9) if n == "probability" else p[n] for n in [*names, *fields]) for p in plan], schema)
