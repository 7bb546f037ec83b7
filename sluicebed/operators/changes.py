"""Label changes: classification of edits and rulings, application with audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verdicts import is_valid


def edit_tier(source: Column, old: Column, new: Column, second: Column) -> Column:
    """USER for a reviewer's edit; else by an independent second read: CONFIRMED if it gives the new
    label, SUPPORTED if it gives another than the old one, TENTATIVE otherwise."""
    other = second.isNotNull() & (second != "") & ~second.eqNullSafe(old)
    return F.when(source == "reviewer", "USER").when(second.eqNullSafe(new), "CONFIRMED").when(other, "SUPPORTED").otherwise("TENTATIVE")


def ruling_class(drop: Column, ruling: Column, current: Column) -> Column:
    """drop, change, keep or unruled, in this order of precedence."""
    ruled = ruling.isNotNull() & (ruling != "")
    changed = ruled & is_valid(ruling) & ~ruling.eqNullSafe(current)
    return F.when(F.coalesce(drop, F.lit(False)), "drop").when(changed, "change").when(ruled, "keep").otherwise("unruled")


def assemble(base: DataFrame, flips: DataFrame, regenerated: DataFrame, key: str, leaks) -> DataFrame:
    """(key, outcome, verdict, rewrite) of a relabelling pass.

    Rows without a flip are kept; a flip to adequate clears the rewrite; other flips need a
    regenerated rewrite that ``leaks(rewrite)`` does not reject, or the row is dropped with its reason.
    """
    j = base.join(flips.select(key, F.col("label").alias("_new")), key, "left").join(regenerated.select(key, F.col("rewrite").alias("_rw")), key, "left")
    blank = F.trim(F.coalesce("_rw", F.lit(""))) == ""
    outcome = F.when(F.col("_new").isNull(), "kept").when(F.col("_new") == "adequate", "to_adequate").when(blank, "dropped: no rewrite").when(leaks(F.col("_rw")), "dropped: rewrite leaks").otherwise("regenerated")
    verdict = F.coalesce("_new", "verdict")
    rewrite = F.when(outcome == "kept", F.col("rewritten_message")).when(outcome == "regenerated", F.col("_rw"))
    return j.select(key, outcome.alias("outcome"), verdict.alias("verdict"), rewrite.alias("rewrite"))


def change_log(base: DataFrame, changes: DataFrame, key: str, label: str) -> DataFrame:
    """(key, old, new, kind) of the changes that apply to the base table: relabel or drop."""
    j = base.select(key, F.col(label).alias("old")).join(changes, key)
    kind = F.when(F.coalesce("drop", F.lit(False)), "drop").when(~F.col("new_label").eqNullSafe(F.col("old")), "relabel")
    return j.select(key, "old", F.when(kind == "relabel", F.col("new_label")).alias("new"), kind.alias("kind")).where("kind is not null")
