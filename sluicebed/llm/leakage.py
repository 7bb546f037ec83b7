"""Evaluation texts that leak, fully or partly, into a corpus.

Method: winnowing. Of the hashes of all runs of ``K`` words, the smallest of every ``WINDOW``
neighbouring ones is kept as a fingerprint, on both sides by the same rule, so any shared span of
``K + WINDOW - 1`` = 12 words shares a fingerprint. Corpus and evaluation fingerprints are joined, and
every hit is extended word by word to the full shared span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .words import WordHashes, word_bytes

SPAN = 12
K, WINDOW = 8, 5
#: Fingerprints of the evaluation side, and bytes of its texts, that are sent whole to every executor; beyond
#: either, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 100_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(tokens: list[bytes], hashes: WordHashes, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed runs of ``k`` words; none if there are fewer than ``k`` words."""
    n = len(tokens) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in tokens], np.uint64)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        run = run * _BASE + h[j : j + n]
    run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(32)
    if n <= window:
        at = np.array([n - 1 - int(run[::-1].argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(run, window)[:, ::-1]
        at = np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))
    return at, run[at]


def _fingerprint_rows(texts: DataFrame, key: str) -> DataFrame:
    """(key columns, pos, hash) of a table (key, text)."""
    kind = texts.select(key).schema[0].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, at, value = [], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            sizes = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                p, h = fingerprints(word_bytes(text), hashes)
                if len(p):
                    rows.append(i)
                    sizes.append(len(p))
                    at.append(p)
                    value.append(h)
            take = pa.array(np.repeat(np.array(rows, np.int64), np.array(sizes, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(value).view(np.int64))], names=[key, "pos", "hash"])

    return texts.select(key, "text").mapInArrow(scan, f"{key} {kind}, pos int, hash bigint")


def longest_span(doc: list[bytes], item: list[bytes], shift: int) -> tuple[int, int]:
    """(length, start in ``doc``) of the longest run of equal words where doc position = item position + shift."""
    best = start = run = 0
    for i in range(max(0, shift), min(len(doc), len(item) + shift)):
        run = run + 1 if doc[i] == item[i - shift] else 0
        if run > best:
            best, start = run, i - run + 1
    return best, start


def _span_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string, field string, n_words int, start_word int"


def _spans_in_one_pass(docs: DataFrame, test: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """Spans of every hit, found and extended while the documents are read, so that none of them is shuffled."""
    marks, named = test.select("hash", "part", "item_pos").toArrow(), texts.toArrow().to_pylist()
    number = {r["part"]: i for i, r in enumerate(named)}
    order = np.argsort(marks["hash"].to_numpy(), kind="stable")
    items = [(r["item_id"], r["field"], word_bytes(r["item_text"])) for r in named]
    sent = docs.sparkSession.sparkContext.broadcast((marks["hash"].to_numpy()[order], np.array([number[p] for p in marks["part"].to_pylist()], np.int32)[order], marks["item_pos"].to_numpy()[order], items))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, parts, places, held = sent.value
        hashes = WordHashes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                doc = word_bytes(text)
                at, h = fingerprints(doc, hashes)
                h = h.view(np.int64)
                first, last = np.searchsorted(values, h), np.searchsorted(values, h, side="right")
                # Hits of one shared passage lie on one diagonal; a document's diagonals with one item text are few.
                hits = {(int(parts[k]), int(at[j] - places[k])) for j in np.flatnonzero(last > first) for k in range(first[j], last[j])}
                for part, shift in sorted(hits):
                    item_id, field, item = held[part]
                    n, start = longest_span(doc, item, shift)
                    if n >= span:
                        for column, value in zip(rows, (i, item_id, field, n, start)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int32())],
                names=["doc_id", "item_id", "field", "n_words", "start_word"],
            )

    return docs.mapInArrow(scan, _span_schema(docs))


def _spans_by_join(docs: DataFrame, test: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """The same for any number of evaluation fingerprints: hits by an equi join, their texts fetched after it."""
    found = _fingerprint_rows(docs, "doc_id").join(test, "hash")
    hits = settle(found.select("doc_id", "part", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "hits")
    rows = hits.join(texts, "part").join(docs, "doc_id").select("doc_id", "item_id", "field", "shift", "text", "item_text")

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, length, start = [], [], []
            last, doc = None, []
            for i, (shift, text, item) in enumerate(zip(*(batch.column(j).to_pylist() for j in (3, 4, 5)))):
                if text != last:
                    last, doc = text, word_bytes(text)
                n, at = longest_span(doc, word_bytes(item), shift)
                if n >= span:
                    keep.append(i)
                    length.append(n)
                    start.append(at)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(take) for j in range(3)), pa.array(length, pa.int32()), pa.array(start, pa.int32())], names=["doc_id", "item_id", "field", "n_words", "start_word"])

    return rows.mapInArrow(extend, _span_schema(docs))


def leaked_spans(corpus: DataFrame, id_column: str, text_column: str, items: DataFrame, item_id: str, fields: list[str], span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, field, n_words, start_word): the longest shared span of at least ``span`` words.

    One row per corpus document, evaluation item and field that share such a span. Null ids, null and
    shorter texts share nothing; repeated rows count once. ``span`` must be at least ``K + WINDOW - 1``,
    below which winnowing guarantees nothing.
    """
    if span < K + WINDOW - 1:
        raise ValueError(f"spans under {K + WINDOW - 1} words are not guaranteed to be found")
    docs = corpus.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")).where("doc_id is not null and text is not null")
    named = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), *(F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(fields)))
    stacked = named.select("item_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"f{i}").alias("text")) for i, c in enumerate(fields)))).alias("x")).select("item_id", "x.*").where("item_id is not null and text is not null").distinct()
    keyed = stacked.withColumn("part", F.xxhash64("item_id", "field", "text"))
    test = settle(_fingerprint_rows(keyed, "part").withColumnRenamed("pos", "item_pos"), "fingerprints")
    texts = keyed.join(test.select("part").distinct(), "part", "left_semi").select("part", "item_id", "field", F.col("text").alias("item_text"))
    small = test.count() <= BROADCAST_ROWS and (texts.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) <= BROADCAST_BYTES
    spans = (_spans_in_one_pass if small else _spans_by_join)(docs, test, texts, span)
    best = spans.groupBy("doc_id", "item_id", "field").agg(F.max(F.struct("n_words", (-F.col("start_word")).alias("s"))).alias("m"))
    return best.select("doc_id", "item_id", "field", F.col("m.n_words").alias("n_words"), (-F.col("m.s")).alias("start_word"))


def leaked_items(spans: DataFrame) -> DataFrame:
    """Per evaluation item that leaked: (item_id, n_docs, longest_words, fields)."""
    return spans.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest_words"), F.concat_ws(",", F.array_sort(F.collect_set("field"))).alias("fields"))
