"""Records of evaluation splits that stand, exactly or almost, in a training split.

Method: minwise hashes of the words of each text (word order plays no part in the likeness, so a
shingle is one word with its occurrence number) are banded into buckets; pairs of an evaluation and a
training text that meet in buckets are candidates, their exact Jaccard similarity is computed, and
the confirmed pairs are listed or counted per split and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_duplicates import MIN_LIKENESS, MIN_WORDS, find_links, member_pairs


def cross_split_pairs(texts: DataFrame, field_names: list[str], min_words: int = MIN_WORDS, min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """(test_id, train_id, field_name) of side 0 (evaluation) and side 1 (training) of ``texts``.

    Null ids and texts under ``min_words`` words match nothing; repeated rows count once.
    """
    members, links = find_links(texts, min_words, min_likeness, cross=True)
    test, train = members.where("side = 0"), members.where("side = 1")
    equal = test.select("cls").intersect(train.select("cls")).select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    cells = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(equal)
    name = F.element_at(F.array(*map(F.lit, field_names)), F.col("field") + 1)
    return member_pairs(cells, test, train, False).select(F.col("x").alias("test_id"), F.col("y").alias("train_id"), name.alias("field_name")).distinct()


def overlap_report(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """Overlap counts per field, split and source: pairs, records of that split, records in all.

    ``splits`` has (split, id, source) with split ``test`` or ``train``; null sources are reported
    as null. A split and source without overlap has zero counts.
    """
    splits = splits.groupBy("split", "id").agg(F.min("source").alias("source"))
    total = splits.groupBy("split", "source").agg(F.count("*").alias("n_records"))
    fields = pairs.select("field_name").distinct()
    ends = pairs.select("field_name", F.lit("test").alias("split"), F.col("test_id").alias("id")).unionByName(pairs.select("field_name", F.lit("train").alias("split"), F.col("train_id").alias("id")))
    per_id = ends.groupBy("field_name", "split", "id").agg(F.count("*").alias("n"))
    hits = per_id.join(splits, ["split", "id"]).groupBy("field_name", "split", "source").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_overlapping"))
    grid = total.crossJoin(F.broadcast(fields))  # one row per field name, of which there is a fixed list
    return (
        grid.alias("g")
        .join(hits.alias("h"), (F.col("g.field_name") == F.col("h.field_name")) & (F.col("g.split") == F.col("h.split")) & F.col("g.source").eqNullSafe(F.col("h.source")), "left")
        .select("g.field_name", "g.split", "g.source", "g.n_records", F.coalesce("h.n_overlapping", F.lit(0)).alias("n_overlapping"), F.coalesce("h.n_pairs", F.lit(0)).alias("n_pairs"))
    )
