"""Row gates with error lists, artefact filters and the accounting of first failing reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import holds_literal, is_malformed, last_role, strip, text_or_empty
from ..functions.verdicts import VERDICTS, context_text

GATED = ["problem", "correct_solution", "candidate_message", "verdict", "reasoning"]


def blank(c: Column) -> Column:
    return strip(text_or_empty(c)) == ""


def _compact(*errors: Column) -> Column:
    return F.array_compact(F.array(*errors))


def history_ok(history: Column) -> Column:
    return history.isNotNull() & ~F.exists(F.coalesce(history, F.array().cast("array<string>")), lambda t: t.isNull())


def input_errors() -> Column:
    """Errors of an input record: blank required texts, a history that is no list of texts."""
    texts = [F.when(blank(F.col(k)), F.lit(f"{k} missing or empty")) for k in GATED[:3]]
    return _compact(*texts, F.when(~history_ok(F.col("conversation_history")), F.lit("bad history")))


def gate_errors() -> Column:
    """Errors of a labelled record; empty for one that passes."""
    c = F.col
    adequate = F.coalesce(c("verdict") == "adequate", F.lit(False))
    answer = F.lower(strip(text_or_empty(c("final_answer"))))
    context = F.lower(context_text(c("problem"), c("conversation_history")))
    leak = holds_literal(F.lower(c("rewritten_message")), answer) & ~holds_literal(context, answer)
    return _compact(
        *(F.when(blank(c(k)), F.lit(f"{k} missing or empty")) for k in GATED),
        F.when(~history_ok(c("conversation_history")), F.lit("bad history")),
        F.when(~F.coalesce(c("verdict").isin(VERDICTS), F.lit(False)), F.lit("invalid verdict")),
        F.when(adequate & c("rewritten_message").isNotNull(), F.lit("rewrite of an adequate message")),
        F.when(~adequate & blank(c("rewritten_message")), F.lit("no rewrite")),
        F.when(leak, F.lit("rewrite leaks answer")),
    )


def ends_on_tutor(history: Column) -> Column:
    return last_role(history) == "tutor"


def artefact(message: Column, history: Column) -> Column:
    return is_malformed(message) | ends_on_tutor(history)


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does. Null conditions do not hold."""
    out = None
    for name, cond in rules:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, n): every row counted once, passing rows as 'kept'."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
