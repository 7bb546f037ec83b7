"""First-wins and last-wins deduplication and exclusion joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize


def one_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order. Ties in the order must be equal rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def excluded_by_either(df: DataFrame, other: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows whose id and whose normalized text both do not occur in ``other``.

    Two equi anti joins in a row; one join on id or text would compare all pairs.
    """
    ids = other.select(F.col(id_column).alias("_i")).distinct()
    texts = other.select(normalize(F.col(text_column)).alias("_t")).distinct()
    kept = df.join(ids, df[id_column] == F.col("_i"), "left_anti")
    return kept.join(texts, normalize(kept[text_column]) == F.col("_t"), "left_anti")


def contained_texts(needles: DataFrame, haystack: DataFrame, key: str, needle: str, hay_key: str, hay: str) -> DataFrame:
    """(key, hay_key) of every needle that occurs word for word inside a hay text.

    Filter and verify: a needle with an inner word can only stand in texts that hold its longest inner
    word as a whole word. Words are joined as (word, hay key) rows without the texts; each candidate
    then fetches its text once and is checked. A needle of one or two words has no inner word: the
    hay words that hold its longest word are found through their character runs first. Nulls and blank
    needles match nothing; repeated rows count once; a hay key with several texts matches if one does.
    """
    n = needles.select(F.col(key).alias("k"), F.col(needle).alias("n")).where("n is not null and trim(n) <> ''").distinct()
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    words = F.split("n", r"\s+")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    probes = n.withColumn("probe", F.nullif(longest(inner), F.lit("")))
    h = haystack.select(F.col(hay_key).alias("hk"), F.col(hay).alias("h")).where("h is not null")
    tokens = h.select("hk", F.explode(F.array_distinct(F.split("h", r"\s+"))).alias("probe"))
    candidates = probes.where("probe is not null").select("k", "n", "probe").join(tokens, "probe").select("k", "n", "hk")
    short = probes.where("probe is null").select("k", "n", longest(words).alias("w"))
    if not short.isEmpty():
        candidates = candidates.unionByName(_words_holding(short, tokens).join(tokens, "probe").select("k", "n", "hk"))
    found = candidates.distinct().join(h, "hk").where(F.contains("h", "n"))
    return found.select(F.col("k").alias(key), F.col("hk").alias(hay_key)).distinct()


def _words_holding(short: DataFrame, tokens: DataFrame) -> DataFrame:
    """(k, n, probe): the words of ``tokens`` that hold the word ``w`` of ``short`` (k, n, w).

    Both meet in the first three characters of ``w``, fewer if it is shorter; only the distinct words
    are cut into such runs, not the texts.
    """
    keyed = short.withColumn("g", F.substring("w", 1, 3))
    lengths = keyed.select(F.length("g").alias("size")).distinct()  # 1, 2 and 3 at most
    vocabulary = tokens.select("probe").distinct().crossJoin(F.broadcast(lengths)).where(F.length("probe") >= F.col("size"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("probe") - F.col("size") + 1), lambda i: F.substring(F.col("probe"), i, F.col("size"))))
    cut = vocabulary.select("probe", F.explode(runs).alias("g"))
    return keyed.join(cut, "g").where(F.contains("probe", "w")).select("k", "n", "probe")
