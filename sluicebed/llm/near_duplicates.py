"""Groups of records whose texts differ by small edits, insertions or reordering.

Method: an inverted join on signature coordinates. Every distinct text is posted under each of its
coordinate values, the posting lists are merged with skips over long lists, pairs that agree in
enough coordinates are retained, and an exact likeness check follows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import release, settle
from .components import component_labels
from .signatures import class_texts, keyed_texts, layout, long_list_pairs, merge_lists, merge_postings, postings
from .words import likeness, word_bytes

MIN_WORDS, MIN_LIKENESS = 12, 0.7
#: Records of one class that are paired at once; see ``member_pairs``.
PART = 1000

_LINKS = "a bigint, b bigint, likeness double"
_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float64())])


def stacked_texts(sources: list[tuple[int, int, DataFrame, str, str]]) -> DataFrame:
    """The union (side, field, id, text) of (side, field number, table, id column, text column)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(side).alias("side"), F.lit(field).alias("field"), F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text")) for side, field, df, key, text in sources])


def verified_links(classes: DataFrame, candidates: DataFrame, min_likeness: float) -> DataFrame:
    """Candidates (a, b), numbers of classes (no, cls, text), whose texts have the likeness.

    (a, b, likeness): the ids ``cls`` of the classes, a < b.
    """
    a = classes.select(F.col("no").alias("a"), F.col("cls").alias("cls_a"), F.col("text").alias("text_a"))
    b = classes.select(F.col("no").alias("b"), F.col("cls").alias("cls_b"), F.col("text").alias("text_b"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: dict[str, list[bytes]] = {}

        def tokens(text: str) -> list[bytes]:
            if len(split) >= 2_000:
                split.clear()
            found = split.get(text)
            if found is None:
                found = split[text] = word_bytes(text)
            return found

        for batch in batches:
            out: list[tuple] = []
            for x, y, s, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                value = likeness(tokens(s), tokens(t))
                if value >= min_likeness:
                    out.append((min(x, y), max(x, y), value))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_LINKS_ARROW)], schema=_LINKS_ARROW)

    return candidates.join(a, "a").join(b, "b").select("cls_a", "cls_b", "text_a", "text_b").mapInArrow(scan, _LINKS)


def read_classes(texts: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of a table (side, field, id, text).

    ``members`` (side, field, id, cls) gives the class of every text with at least ``min_words`` words;
    texts with the same bag of words in the same field share a class. ``classes`` (no, cls, field, sides,
    text) has one text of each. Null ids, null and short texts belong to no class; repeated rows count
    once; an empty table gives empty results. Two 64-bit class ids could coincide by chance: about once
    in 10^4 collections of 10^8 distinct texts.
    """
    keyed = settle(keyed_texts(texts, min_words), "keyed")
    classes, members = settle(class_texts(keyed), "classes"), settle(keyed.select("side", "field", "id", "cls").distinct(), "members")
    release(keyed)
    return members, classes


def find_links(texts: DataFrame, min_words: int = MIN_WORDS, min_likeness: float = MIN_LIKENESS, cross: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): the classes of ``read_classes`` and (a, b, likeness) of different classes of one
    field with at least ``min_likeness``, a < b; with ``cross`` only if a record of side 0 and one of
    side 1 are linked by it."""
    members, classes = read_classes(texts, min_words)
    candidates = settle(merge_postings(postings(classes, *layout(classes.count(), min_likeness)), cross, min_likeness), "candidates")
    links = settle(verified_links(classes, candidates, min_likeness), "links")
    release(candidates)
    release(classes)
    return members, links


def member_pairs(cells: DataFrame, left: DataFrame, right: DataFrame, one_table: bool) -> DataFrame:
    """(field, x, y): every pair of an id of class a of ``left`` and one of class b of ``right``, (a, b) in ``cells``.

    With ``one_table`` both are the same records, and ``cells`` has every pair of classes in one order
    only; then each pair of ids comes out once, and none of an id with itself. A class of more than
    ``PART`` records is cut into parts by a hash of the id and the parts meet one by one, so no task
    pairs a large class alone.
    """

    def cut(members: DataFrame, cls: str, n: str) -> DataFrame:
        return members.groupBy(F.col("cls").alias(cls)).agg(F.count("*").alias(n)).where(F.col(n) > PART).select(cls, F.ceil(F.col(n) / PART).alias(n))

    parts_a, parts_b = settle(cut(left, "a", "na"), "parts"), settle(cut(right, "b", "nb"), "parts")
    if parts_a.isEmpty() and parts_b.isEmpty():
        cells = cells.select("a", "b").withColumns({"i": F.lit(0).cast("bigint"), "j": F.lit(0).cast("bigint")})
        one, two = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    else:
        cells = cells.select("a", "b").join(parts_a, "a", "left").join(parts_b, "b", "left").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("na", F.lit(1)) - 1)))
        from_ = F.when((F.col("a") == F.col("b")) & F.lit(one_table), F.col("i")).otherwise(0)
        cells = cells.withColumn("j", F.explode(F.sequence(from_, F.coalesce("nb", F.lit(1)) - 1))).select("a", "b", "i", "j")
        one, two = (F.coalesce(F.pmod(F.xxhash64("id"), F.col(n)), F.lit(0).cast("bigint")) for n in ("na", "nb"))
        left, right = left.withColumn("a", F.col("cls")).join(parts_a, "a", "left"), right.withColumn("b", F.col("cls")).join(parts_b, "b", "left")
    x = left.select(F.col("cls").alias("a"), one.alias("i"), "field", F.col("id").alias("x"))
    y = right.select(F.col("cls").alias("b"), two.alias("j"), F.col("id").alias("y"))
    pairs = cells.join(x, ["a", "i"]).join(y, ["b", "j"])
    if one_table:
        pairs = pairs.where(F.when((F.col("a") == F.col("b")) & (F.col("i") == F.col("j")), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return pairs.select("field", "x", "y")


def near_duplicate_pairs(texts: DataFrame, field_names: list[str], min_words: int = MIN_WORDS, min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """Every pair of different ids with alike texts in a field: (field_name, id_a, id_b), id_a < id_b.

    That holds at every size, so the rows grow as the square of a class of equal texts; groups without
    its pairs come from ``near_duplicate_groups``.
    """
    members, links = find_links(texts, min_words, min_likeness)
    shared = members.groupBy(F.col("cls").alias("a")).agg(F.count("*").alias("n")).where("n > 1").select("a", F.col("a").alias("b"))
    pairs = member_pairs(links.select("a", "b").unionByName(shared), members, members, True)
    name = F.element_at(F.array(*map(F.lit, field_names)), F.col("field") + 1)
    return pairs.select(name.alias("field_name"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(texts: DataFrame, field_names: list[str], min_words: int = MIN_WORDS, min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """One row per record and field of every group of alike or equal texts.

    (field_name, id, group_id, n_copies): ``group_id`` is the smallest id of the group, ``n_copies`` the
    records with the same bag of words. Groups are those of all pairs of ``near_duplicate_pairs``, but
    neither copies nor long posting lists are expanded into pairs: the classes of a long list are linked
    to its smallest one first, and only classes that this leaves apart meet the others of their lists.
    """
    members, classes = read_classes(texts, min_words)
    pairs, long = merge_lists(postings(classes, *layout(classes.count(), min_likeness)), False, min_likeness)
    if long.isEmpty():
        links = settle(verified_links(classes, pairs, min_likeness), "links")
    else:
        star = long.join(long.groupBy("v").agg(F.min("cls").alias("a")), "v").where("a < cls").select("a", F.col("cls").alias("b"))
        links = settle(verified_links(classes, pairs.unionByName(star).distinct(), min_likeness), "links")
        labels = classes.select("no", "cls").join(_labels(links).withColumnRenamed("node", "cls"), "cls").select(F.col("no").alias("cls"), "label")
        apart = long_list_pairs(long, False, min_likeness, labels)
        links = links.unionByName(settle(verified_links(classes, apart, min_likeness), "links"))
    release(classes)
    copies = members.groupBy("cls").agg(F.count("*").alias("n_copies"))
    rows = members.join(copies, "cls").join(_labels(links).withColumnRenamed("node", "cls"), "cls", "left").where("n_copies > 1 or label is not null").withColumn("label", F.coalesce("label", "cls"))
    smallest = rows.groupBy("field", "label").agg(F.min("id").alias("group_id"))
    name = F.element_at(F.array(*map(F.lit, field_names)), F.col("field") + 1)
    return rows.join(smallest, ["field", "label"]).select(name.alias("field_name"), "id", "group_id", "n_copies")


def _labels(links: DataFrame) -> DataFrame:
    return component_labels(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
