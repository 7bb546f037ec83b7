"""Salvaging JSON objects and labels from model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, strip_think, text_or_empty
from .verdicts import VERDICTS

OUTPUT_KEYS = ["verdict", "reasoning", "rewritten_message"]
_SCHEMA = "verdict string, reasoning string, rewritten_message string"


def object_text(raw: Column) -> Column:
    """From the first brace on, think blocks removed; the JSON parsers ignore what follows the object."""
    t = strip_think(text_or_empty(raw))
    at = F.instr(t, "{")
    return F.when(at > 0, F.substring(t, at, F.length(t)))


def parsed_variant(raw: Column) -> Column:
    """The first JSON object as a VARIANT; null if there is none, it is broken or not an object."""
    v = F.try_parse_json(object_text(raw))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def field_text(v: Column, name: str) -> Column:
    """A string field of a parsed object; null if absent or of another type."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def object_keys(raw: Column) -> Column:
    return F.json_object_keys(object_text(raw))


def output_errors(raw: Column) -> Column:
    """What is wrong with an output: an empty array for a valid one."""
    v = parsed_variant(raw)
    verdict, reasoning, rewrite = (field_text(v, k) for k in OUTPUT_KEYS)
    keys = F.coalesce(object_keys(raw), F.array().cast("array<string>"))
    has = F.array_contains(keys, "rewritten_message")
    null_rewrite = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.rewritten_message", "variant")), F.lit("VOID")) == "VOID"
    adequate = F.coalesce(verdict == "adequate", F.lit(False))
    extra = F.size(F.array_except(keys, F.array(*map(F.lit, OUTPUT_KEYS)))) > 0
    errors = F.array(
        F.when(~F.coalesce(verdict.isin(VERDICTS), F.lit(False)), F.lit("invalid verdict")),
        F.when(strip(text_or_empty(reasoning)) == "", F.lit("no reasoning")),
        F.when(~has, F.lit("no rewrite key")),
        F.when(has & adequate & ~null_rewrite, F.lit("rewrite of an adequate message")),
        F.when(has & ~adequate & (strip(text_or_empty(rewrite)) == ""), F.lit("no rewrite")),
        F.when(extra, F.lit("unexpected keys")),
    )
    return F.when(v.isNull(), F.array(F.lit("not an object"))).otherwise(F.array_compact(errors))


def schema_tier(raw: Column) -> Column:
    """2 valid, bare and without think block; 1 a valid verdict with slips; 0 none."""
    verdict = field_text(parsed_variant(raw), "verdict")
    t = strip(text_or_empty(raw))
    bare = F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")) & ~F.contains(t, F.lit("<think>"))
    return F.when(~F.coalesce(verdict.isin(VERDICTS), F.lit(False)), 0).when((F.size(output_errors(raw)) == 0) & bare, 2).otherwise(1)


def verdict_or_pattern(raw: Column) -> Column:
    """The JSON verdict if valid, else a quoted verdict field anywhere in the text if valid."""
    v = field_text(parsed_variant(raw), "verdict")
    quoted = F.regexp_extract(strip_think(text_or_empty(raw)), r'"verdict"\s*:\s*"([a-z_]+)"', 1)
    return F.coalesce(F.when(v.isin(VERDICTS), v), F.when(quoted.isin(VERDICTS), quoted))


def verdict_or_first_label(raw: Column) -> Column:
    """The JSON verdict if valid, else the label that occurs first in the text, else the JSON value."""
    v = field_text(parsed_variant(raw), "verdict")
    return F.coalesce(F.when(v.isin(VERDICTS), v), first_label(strip_think(text_or_empty(raw))), v)


def first_label(text: Column) -> Column:
    """The label that occurs first in a text; null if none does."""
    return F.nullif(F.regexp_extract(text_or_empty(text), f"({'|'.join(VERDICTS)})", 1), F.lit(""))


def output_json(verdict: Column, reasoning: Column, rewrite: Column) -> Column:
    """The JSON text of an output, nulls kept."""
    return F.to_json(F.struct(verdict.alias("verdict"), reasoning.alias("reasoning"), rewrite.alias("rewritten_message")), {"ignoreNullFields": "false"})


def letter_ranks(reply: Column, n: int) -> Column:
    """The candidates' letters in the order of a reply; letters it left out follow in their own order."""
    letters = F.array(*(F.lit(chr(65 + i)) for i in range(n)))
    said = F.filter(F.split(F.upper(text_or_empty(reply)), ""), lambda c: F.array_contains(letters, c))
    said = F.array_distinct(said)
    return F.concat(said, F.array_except(letters, said))
