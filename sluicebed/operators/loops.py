"""Bounded loops with recorded scores, and the scorer protocol."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A scorer takes a batch of rows and returns one value per row, null where it cannot tell.
Scorer = Callable[[pd.DataFrame], pd.Series]
#: A registry of models is sent whole to every executor; a larger one is refused.
MOST_MODELS = 10_000


def score(df: DataFrame, scorer: Scorer, kind: str, name: str, default: object = None, retries: int = 0, wait: float = 0.5) -> DataFrame:
    """Add a column computed batch by batch; a failing batch is scored row by row, a failing row gets
    ``default``: False to fail closed, True to fail open, None for unknown. A call that fails is made
    up to ``retries`` times more, after ``wait`` seconds at first and twice as long each time."""
    schema = StructType(list(df.schema.fields)).add(name, kind)
    columns = df.columns

    def call(rows: pd.DataFrame) -> pd.Series:
        for attempt in range(retries):
            try:
                return scorer(rows)
            except Exception:
                time.sleep(wait * 2**attempt)
        return scorer(rows)

    def one(row: pd.DataFrame) -> object:
        try:
            value = call(row).iloc[0]
            return default if value is None or value != value else value
        except Exception:
            return default

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                values = call(pdf[columns]).astype(object)
                values = values.where(values.notna(), default)
            except Exception:
                values = pd.Series([one(pdf[columns].iloc[i : i + 1]) for i in range(len(pdf))], index=pdf.index, dtype=object)
            yield pdf.assign(**{name: values})

    return df.mapInPandas(run, schema)


def tier_or_null(value: Column) -> Column:
    """A grade of 0, 1 or 2; null for anything else."""
    v = value.cast("int")
    return F.when(v.isin(0, 1, 2), v)


def refine(first: Column, rewrites: list[Column], verdicts: list[Column], original: Column, fallback: str, known: list[str]) -> Column:
    """The judge and rewrite loop over recorded rewrites and their verdicts: struct (message, iters, how).

    An adequate or unknown first verdict passes the original. Then each rewrite in turn is used if it
    is adequate; a blank one, or none adequate, gives the fallback. The number of rounds is the number
    of recorded rewrites, so the loop unrolls into one expression.
    """
    row = lambda m, i, how: F.struct(m.alias("message"), F.lit(i).alias("iters"), F.lit(how).alias("how"))
    out = row(F.lit(fallback), len(rewrites), "maxiter_fallback")
    for i in range(len(rewrites), 0, -1):
        blank = F.trim(F.coalesce(rewrites[i - 1], F.lit(""))) == ""
        out = F.when(blank, row(F.lit(fallback), i, "empty_fallback")).when(F.coalesce(verdicts[i - 1] == "adequate", F.lit(False)), row(rewrites[i - 1], i, "judge_passed")).otherwise(out)
    passes = (first == "adequate") | ~F.coalesce(first.isin(known), F.lit(False))
    return F.when(F.coalesce(passes, F.lit(True)), row(original, 0, "passed_original")).otherwise(out)


def guarded(hint: Column, leaks: Column, fallback: str) -> Column:
    """The hint, or the fallback where it leaks."""
    return F.when(F.coalesce(leaks, F.lit(False)), F.lit(fallback)).otherwise(hint)


def dispatch(items: DataFrame, registry: DataFrame, kind: str, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run every item against every registered model, by the branch of the model's kind.

    ``registry`` is a short table of models with a ``kind`` column, of at most ``MOST_MODELS`` rows; a
    kind without a branch gives no rows. All branches must return the same columns.
    """
    if registry.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    tasks = items.crossJoin(F.broadcast(registry))
    parts = [f(tasks.where(F.col(kind) == name)) for name, f in branches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def climb(propose: Callable[[int], object], accepted: Callable[[object], bool], halted: Callable[[], bool], max_dry: int = 2, max_rounds: int = 100) -> list[dict]:
    """Propose and keep or revert, round by round, until ``halted`` or ``max_dry`` reverts in a row."""
    history: list[dict] = []
    dry = 0
    for i in range(max_rounds):
        if halted() or dry >= max_dry:
            break
        candidate = propose(i)
        ok = accepted(candidate)
        dry = 0 if ok else dry + 1
        history.append({"round": i, "candidate": candidate, "accepted": ok})
    return history
