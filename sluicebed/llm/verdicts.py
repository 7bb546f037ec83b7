"""Reading a label out of freely spelled and wrapped text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.verdicts import VERDICTS


def named_label(text: Column, labels: list[str] = VERDICTS) -> Column:
    """The one label that a text names, in whatever spelling or wrapping; null if none or several."""
    flat = F.concat(F.lit("_"), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    hits = [F.contains(flat, F.lit(f"_{name}_")) for name in labels]
    count = reduce(lambda a, b: a + b, [h.cast("int") for h in hits])
    chosen = F.coalesce(*(F.when(h, F.lit(name)) for h, name in zip(hits, labels)))
    return F.when(count == 1, chosen)
