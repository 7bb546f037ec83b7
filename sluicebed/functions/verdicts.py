"""Verdicts, their families and the 0/1/2 tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import holds_literal, mostly_covered, normalize, numbers, strip, text_or_empty, words_a, words_b, words_c

# The verdicts in their usual order and those that give something away.
VERDICTS = ["adequate", "gives_final_answer", "gives_away_key_step", "mismatched_calibration", "vague_unhelpful"]
LEAKS = ["gives_final_answer", "gives_away_key_step"]


def plain_verdict(c: Column) -> Column:
    """A verdict in the plain spelling; null for anything else."""
    t = F.regexp_replace(F.lower(strip(c)), r"[\s\-]+", "_")
    return F.when(t.isin(VERDICTS), t)


def is_valid(c: Column) -> Column:
    return F.coalesce(c.isin(VERDICTS), F.lit(False))


def is_leak(c: Column) -> Column:
    """Null counts as no leak."""
    return F.coalesce(c.isin(LEAKS), F.lit(False))


def binary(c: Column) -> Column:
    """leak, safe, or null for null and ''."""
    return F.when(c.isin(LEAKS), F.lit("leak")).when(c != "", F.lit("safe"))


def threeway(c: Column) -> Column:
    """The leak verdicts themselves, safe for others, null for null and ''."""
    return F.when(c.isin(LEAKS), c).when(c != "", F.lit("safe"))


def family(c: Column) -> Column:
    return F.when(is_leak(c), F.lit("leak")).when(is_valid(c), F.lit("nonleak")).otherwise(F.lit("invalid"))


def verdict_tier(gold: Column, pred: Column) -> Column:
    """2 exact, 1 same family, 0 the other family or invalid."""
    return F.when(is_valid(gold) & F.coalesce(pred == gold, F.lit(False)), 2).when((family(pred) != "invalid") & (family(gold) == family(pred)), 1).otherwise(0)


def context_text(*columns: Column) -> Column:
    """Texts and arrays of texts joined by spaces; nulls count as ''."""
    return F.concat_ws(" ", *columns)


def grounded_a(reasoning: Column, source: Column) -> Column:
    """Shares a number or a significant word (3 letters and more) with the source."""
    return F.arrays_overlap(numbers(reasoning), numbers(source)) | F.arrays_overlap(words_a(reasoning), words_a(source))


def leaks_plain(rewrite: Column, answer: Column, key_step: Column) -> Column:
    """The tier variant: answer as written, words of 3 letters and more."""
    return holds_literal(rewrite, strip(text_or_empty(answer))) | mostly_covered(words_a(key_step), words_a(rewrite))


def leaks_normalized(rewrite: Column, answer: Column, key_step: Column) -> Column:
    """The harness variant: both normalized, words of 4 letters and more."""
    return holds_literal(normalize(rewrite), normalize(answer)) | mostly_covered(words_b(key_step), words_b(rewrite))


def leaks_in_context(rewrite: Column, answer: Column, key_step: Column, context: Column) -> Column:
    """The gate variant: an answer that the context gives already is no leak; '' leaks nothing."""
    low, literal = F.lower(text_or_empty(rewrite)), F.lower(strip(text_or_empty(answer)))
    new = holds_literal(low, literal) & ~holds_literal(F.lower(text_or_empty(context)), literal)
    return (strip(low) != "") & (new | mostly_covered(words_c(key_step), words_c(low)))


def grounded_tier(external: Column, reasoning: Column, source: Column) -> Column:
    """An external grade if there is one, else 2 if grounded and 0 if not; 0 without reasoning."""
    return F.when(reasoning.isNull(), 0).otherwise(F.coalesce(external, F.when(grounded_a(reasoning, source), 2).otherwise(0)))


def safety_tier(external: Column, verdict: Column, rewrite: Column, answer: Column, key_step: Column) -> Column:
    """Null for adequate records and blank rewrites; else the external grade or 2 safe, 0 leaking."""
    absent = F.coalesce(verdict == "adequate", F.lit(False)) | (strip(text_or_empty(rewrite)) == "")
    return F.when(~absent, F.coalesce(external, F.when(leaks_plain(rewrite, answer, key_step), 0).otherwise(2)))


def iteration_count(n: Column, batch: int, epochs: int, floor: int) -> Column:
    """max(floor, epochs * ceil(n / batch))."""
    return F.greatest(F.lit(floor), F.lit(epochs) * F.ceil(n / F.lit(batch)).cast("int"))


def bounded_half(n: Column, low: int, high: int) -> Column:
    """min(high, max(low, n // 2))."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(n / 2).cast("int")))

