"""Minwise signatures of word bags and the merging of their posting lists.

Each text is the set of its (word, occurrence) elements, all of the same weight, so that the chance
to find a pair follows from its likeness alone, however many texts of the collection share its words.
A coordinate of a signature is a hash of ``rows`` minwise values; ``layout`` gives their numbers. The
coordinates draw on a common stock of minwise values, each on different ones, as most of the work is in these.
Texts with the same bag of words are one class, which is signed and posted once.
README.md has the measured recall.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .words import WordHashes, bag_hash, word_bytes

#: Coordinates in which a candidate pair agrees.
MATCHES = 2
#: By ``layout``: the chance to miss a pair of the least likeness, were all coordinates independent; the
#: likeness of texts that have nothing to do with each other; the minwise values of a coordinate.
MISSED, UNLIKE, FEWEST, MOST = 0.015, 0.11, 6, 10
#: Minwise values computed of a text for each one of a coordinate, unless its coordinates need fewer.
BASES = 40
#: Texts to sign and their postings, which are several times as large, have so many times the usual partitions.
SPREAD = 3
#: A posting list longer than this is not merged in one go but in cells; see ``merge_postings``.
LONG_LIST = 256
#: Classes of either side of a cell, on the average.
CELL = 1024
#: Classes of long lists that are sent whole to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Low bits of a posted value that hold the number of its coordinate.
_TAG_BITS = 8
#: Texts signed at once, elements whose scores are kept, elements looked up at once.
_SLICE, _ELEMENTS, _BLOCK = 2_000, 50_000, 2_000

_KEYED = "side int, field int, id string, cls bigint, text string"
_KEYED_ARROW = pa.schema([("side", pa.int32()), ("field", pa.int32()), ("id", pa.string()), ("cls", pa.int64()), ("text", pa.string())])
_POSTING = "v bigint, cls bigint, shape int"
_POSTING_ARROW = pa.schema([("v", pa.int64()), ("cls", pa.int64()), ("shape", pa.int32())])
_MOST_WORDS = (1 << 29) - 1
_MERGED = "kind int, a bigint, b bigint"
_MERGED_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
_PAIRS = "a bigint, b bigint"
_PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def layout(n: int, least: float) -> tuple[int, int]:
    """(coordinates, rows) for ``n`` classes and pairs of a likeness of at least ``least``.

    More rows let fewer unlike texts collide, but need more coordinates for the same chance to miss a
    pair, ``MISSED``. A class is posted once per coordinate and collides with n * ``UNLIKE`` ** rows / 2
    others in each; the sum of both is least. So the work per text grows with the logarithm of n.
    """

    def coordinates(rows: int) -> int:
        p = min(least, 0.999) ** rows
        return next(m for m in range(MATCHES, 1 << _TAG_BITS) if (1 - p) ** m + m * p * (1 - p) ** (m - 1) <= MISSED or m + 1 == 1 << _TAG_BITS)

    return min((coordinates(rows) * (1 + n * UNLIKE**rows / 2), coordinates(rows), rows) for rows in range(FEWEST, MOST + 1))[1:]


def keyed_texts(texts: DataFrame, min_words: int) -> DataFrame:
    """(side, field, id, cls, text) of a scan of ``texts`` (side, field, id, text).

    Equal bags of words of a field are one class. Texts under ``min_words`` words and null ids are left
    out. Of the texts of a class only the first one met in a partition goes along, the rest are null.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        read: dict[tuple, int] = {}  # texts met lately, so that repeated ones are not even split into words
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for side, field, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key is None or not text:
                    continue
                cls = read.get((field, text))
                if cls is None:
                    tokens = word_bytes(text)
                    if len(tokens) < max(1, min_words):
                        continue
                    if len(read) >= 5_000:
                        read.clear()
                    cls = read[field, text] = bag_hash(tokens, field)
                if (cls, side) in sent:
                    text = None
                else:
                    if len(sent) >= 500_000:
                        sent.clear()
                    sent.add((cls, side))
                for x, value in zip(rows, (side, field, key, cls, text)):
                    x.append(value)
            yield pa.RecordBatch.from_pydict(dict(zip(_KEYED_ARROW.names, rows)), schema=_KEYED_ARROW)

    return texts.select("side", "field", "id", "text").mapInArrow(scan, _KEYED)


def class_texts(keyed: DataFrame) -> DataFrame:
    """(no, cls, field, sides, text), a text of every class; ``sides`` has bit 1 for side 0 and bit 2 for side 1.

    ``no`` numbers the classes; classes of one partition have numbers of the same high bits, so that
    postings and pairs of numbers take less room than those of hashes. The result must be settled.
    """
    # The number of partitions is given, as signing takes far more time than the size of the texts suggests.
    n = SPREAD * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.where("text is not null").repartition(n, "cls").groupBy("cls").agg(F.min("field").alias("field"), F.bit_or(F.col("side") + 1).alias("sides"), F.max("text").alias("text")).withColumn("no", F.monotonically_increasing_id())


def _picked(coordinates: int, rows: int) -> np.ndarray:
    """(coordinates, rows): the minwise values that each coordinate is made of, all of a row different."""
    bases = BASES * rows
    if coordinates * rows <= bases:
        return np.arange(coordinates * rows).reshape(coordinates, rows)
    each = bases // rows
    shuffles = [np.argsort(_mix(np.arange(bases, dtype=np.uint64) + np.uint64((k + 1) << 20)), kind="stable") for k in range(-(-coordinates // each))]
    return np.concatenate([x[: each * rows].reshape(each, rows) for x in shuffles])[:coordinates]


class Signer:
    """Signatures of word lists of one field; keeps the scores of the elements seen lately."""

    def __init__(self, field: int, coordinates: int, rows: int):
        if coordinates > 1 << _TAG_BITS:
            raise ValueError(f"more than {1 << _TAG_BITS} coordinates")
        self.m, self.r = coordinates, rows
        self.picked = _picked(coordinates, rows)
        self.bases = int(self.picked.max()) + 1
        self.seeds = _mix(np.arange(1, self.bases + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.tags = _mix(np.arange(coordinates, dtype=np.uint64) + np.uint64((field + 1) << 32))
        self.hashes, self.index = WordHashes(), {}
        self.scores = np.empty((_ELEMENTS, self.bases), np.uint32)
        self.buffer = np.empty((_BLOCK, self.bases), np.uint32)

    def _add(self, new: list[tuple[bytes, int]]) -> None:
        base = np.array([self.hashes[w] for w, _ in new], dtype=np.uint64)
        h = _mix(base + np.array([o for _, o in new], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        w, o = new[0]
        first = self.index[w if o == 0 else (w, o)]
        for at in range(0, len(new), 1000):
            part = h[at : at + 1000]
            self.scores[first + at : first + at + len(part)] = _mix(part[:, None] ^ self.seeds[None, :]) >> np.uint64(32)

    def sign(self, texts: list[list[bytes]]) -> np.ndarray:
        """An array (texts, coordinates) of signed 64-bit values; every text needs at least one word.

        The low ``_TAG_BITS`` bits of a value are the number of its coordinate.

        Elements go through in blocks of bounded size, so a text of any length takes no more memory.
        """
        low = np.full((len(texts), self.bases), 0xFFFFFFFF, np.uint32)
        ids: list[int] = []
        starts: list[int] = []
        owners: list[int] = []
        new: list[tuple[bytes, int]] = []

        def flush() -> None:
            if new:
                self._add(new)
            if ids:
                found = self.buffer[: len(ids)]  # small enough to stay in the processor's cache
                np.take(self.scores, np.array(ids), axis=0, out=found, mode="clip")
                part = np.minimum.reduceat(found, np.array(starts), axis=0)
                at = np.array(owners)
                low[at] = np.minimum(low[at], part)
            ids.clear(), starts.clear(), owners.clear(), new.clear()

        lookup = self.index.get
        for t, tokens in enumerate(texts):
            seen: dict[bytes, int] = {}
            starts.append(len(ids))
            owners.append(t)
            for w in tokens:
                o = seen.get(w, 0)
                seen[w] = o + 1
                k = lookup(w if o == 0 else (w, o))
                if k is None:
                    if len(self.index) >= len(self.scores):
                        if starts[-1] == len(ids):
                            starts.pop(), owners.pop()
                        flush()
                        self.index.clear()
                        starts.append(0)
                        owners.append(t)
                    k = self.index[w if o == 0 else (w, o)] = len(self.index)
                    new.append((w, o))
                ids.append(k)
                if len(ids) >= _BLOCK:
                    flush()
                    starts.append(0)
                    owners.append(t)
            if starts[-1] == len(ids):  # nothing of this text is left in the block
                starts.pop(), owners.pop()
        flush()
        value = np.broadcast_to(self.tags, (len(texts), self.m)).copy()
        bits = low.astype(np.uint64)
        for j in range(self.r):
            value = _mix(value ^ bits[:, self.picked[:, j]])
        value = (value >> np.uint64(_TAG_BITS) << np.uint64(_TAG_BITS)) | np.arange(self.m, dtype=np.uint64)
        return value.view(np.int64)


def postings(texts: DataFrame, coordinates: int, rows: int) -> DataFrame:
    """Post every class of (no, field, sides, text) under each of its coordinate values: (v, cls, shape).

    ``cls`` is its number and ``shape`` four times the number of words plus the sides.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signers: dict[int, Signer] = {}

        def flush(field: int, todo: list) -> pa.RecordBatch:
            if field not in signers:
                signers[field] = Signer(field, coordinates, rows)
            values = signers[field].sign([x[0] for x in todo])
            return pa.RecordBatch.from_arrays(
                [pa.array(values.ravel()), pa.array(np.repeat(np.array([x[1] for x in todo], np.int64), coordinates)), pa.array(np.repeat(np.array([x[2] for x in todo], np.int32), coordinates))],
                schema=_POSTING_ARROW,
            )

        waiting: dict[int, list] = {}
        for batch in batches:
            for cls, field, sides, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                todo = waiting.setdefault(field, [])
                tokens = word_bytes(text)
                todo.append((tokens, cls, 4 * min(len(tokens), _MOST_WORDS) + sides))
                if len(todo) >= _SLICE:
                    yield flush(field, waiting.pop(field))
        for field, todo in waiting.items():
            yield flush(field, todo)

    return texts.select("no", "field", "sides", "text").mapInArrow(scan, _POSTING)


def _may_match(x: np.ndarray, y: np.ndarray, cross: bool, least: float) -> np.ndarray:
    """Whether classes of these shapes may be a pair: no likeness is above the ratio of the word counts.

    With ``cross`` one of them must be on side 0 and the other on side 1.
    """
    n, m = x >> 2, y >> 2
    ok = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
    return ok & (((x & 1 != 0) & (y & 2 != 0)) | ((x & 2 != 0) & (y & 1 != 0))) if cross else ok


def _pairs(v: np.ndarray, c: np.ndarray, s: np.ndarray, cross: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of sorted postings: (0, a, b) pairs of short lists and (shape, v, cls) rows of long lists."""
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    v, c, s = v[keep], c[keep], s[keep]
    if not len(v):
        return
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    size = np.diff(np.r_[starts, len(v)])
    rank = np.arange(len(v)) - np.repeat(starts, size)
    total = np.repeat(size, size)
    long = total > LONG_LIST
    if long.any():
        yield s[long], v[long], c[long]
        v, c, s, rank, total = v[~long], c[~long], s[~long], rank[~long], total[~long]
    for step in range(1, int(total.max(initial=1))):  # each posting meets the one ``step`` places after it
        first = np.flatnonzero(rank + step < total)
        first = first[_may_match(s[first], s[first + step], cross, least)]
        if len(first):
            yield np.zeros(len(first), np.int32), c[first], c[first + step]  # sorted by class, so a < b


def _merge(sorted_postings: DataFrame, cross: bool, least: float) -> DataFrame:
    """Stream over postings sorted by value; no more than a few short lists are kept in memory."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        passed: int | None = None  # the value of a long list whose first part went out already

        def out(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a), pa.array(b)], schema=_MERGED_ARROW)

        def merged(columns: list[tuple]) -> Iterator[pa.RecordBatch]:
            v, c, s = (np.concatenate(x) for x in zip(*columns))
            order = np.lexsort((c, v))  # Spark sorts by the value alone, which it does much faster
            for kind, a, b in _pairs(v[order], c[order], s[order], cross, least):
                yield out(kind, a, b)

        for batch in batches:
            v, c, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if passed is not None and len(v):
                end = int(np.searchsorted(v, passed, side="right"))
                if end:
                    yield out(s[:end], v[:end], c[:end])
                v, c, s = v[end:], c[end:], s[end:]
            if not len(v):
                continue
            passed = None
            cut = int(np.searchsorted(v, v[-1]))  # the last list may go on in the next batch
            if cut:
                yield from merged([*held, (v[:cut], c[:cut], s[:cut])])
                held = []
            held.append((v[cut:], c[cut:], s[cut:]))
            if sum(len(x[0]) for x in held) > 64 * LONG_LIST:
                v, c, s = (np.concatenate(x) for x in zip(*held))
                if v[0] != v[-1]:
                    cut = int(np.searchsorted(v, v[-1]))
                    yield from merged([(v[:cut], c[:cut], s[:cut])])
                    v, c, s = v[cut:], c[cut:], s[cut:]
                new = np.unique(c, return_index=True)[1]
                held = [(v[new], c[new], s[new])]
                if len(new) > LONG_LIST:
                    yield out(s[new], v[new], c[new])
                    held, passed = [], int(v[-1])
        if held:
            yield from merged(held)

    return sorted_postings.mapInArrow(scan, _MERGED)


def _cell_pairs(cells: DataFrame, cross: bool, least: float) -> DataFrame:
    """(a, b) of the sorted rows (v, i, j, diagonal, right, cls, shape, label, vs) of cells.

    In each cell every left class meets every right one. A pair that shares ``MATCHES`` long values
    comes out of the list of the first of them, unless both have the same label. Of a diagonal cell, in
    which both sides are the same classes, each pair comes out once.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []

        def aligned(rows: list[tuple]) -> tuple[np.ndarray, ...]:
            values = np.zeros((len(rows), 1 << _TAG_BITS), np.int64)
            for k, row in enumerate(rows):
                x = np.array(row[-1], np.int64)
                values[k, x & ((1 << _TAG_BITS) - 1)] = x
            return *(np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3)), values

        def close() -> Iterator[pa.RecordBatch]:
            left, right = [r for r in held if not r[0]], [r for r in held if r[0]]
            if not left or not right:
                return
            at = key[0] & ((1 << _TAG_BITS) - 1)
            (lc, ls, ll, lv), (rc, rs, rl, rv) = aligned(left), aligned(right)
            width = int(max(np.flatnonzero(lv.any(axis=0)).max(), np.flatnonzero(rv.any(axis=0)).max())) + 1
            lv, rv = lv[:, :width], rv[:, :width]
            step = max(1, 4_000_000 // (len(rc) * width))
            for k in range(0, len(lc), step):
                same = (lv[k : k + step, None, :] == rv[None, :, :]) & (rv != 0)[None, :, :]
                ok = (same.argmax(axis=2) == at) & (same.sum(axis=2) >= MATCHES) & (ll[k : k + step, None] != rl[None, :]) & (lc[k : k + step, None] != rc[None, :])
                ok &= _may_match(ls[k : k + step, None], rs[None, :], cross, least)
                if key[3]:
                    ok &= lc[k : k + step, None] < rc[None, :]
                x, y = np.nonzero(ok)
                if len(x):
                    a, b = lc[k + x], rc[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIRS_ARROW)

        for batch in batches:
            for v, i, j, diagonal, *row in zip(*(batch.column(n).to_pylist() for n in range(9))):
                if (v, i, j, diagonal) != key:
                    if held:
                        yield from close()
                    key, held = (v, i, j, diagonal), []
                held.append(row)
        if held:
            yield from close()

    return cells.select("v", "i", "j", "diagonal", "right", "cls", "shape", "label", "vs").mapInArrow(scan, _PAIRS)


def long_list_pairs(long: DataFrame, cross: bool, least: float, labels: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: the pairs of classes that share ``MATCHES`` or more of the long lists (v, cls, shape).

    A list is cut into blocks by a hash of the class and any two blocks meet in a cell of their own,
    so that a list of any length is spread over many tasks; with ``cross`` the blocks of side 0 meet
    those of side 1 only. ``labels`` (cls, label) leaves out pairs within one label and lists of one label;
    a class without a label has one of its own.
    """
    # A class has at most one value per coordinate, so the collected list is bounded by their number.
    lists = long.groupBy("cls").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    rows = long.select("v", "cls", "shape")
    if labels is None:
        rows = rows.withColumn("label", F.col("cls"))
    else:
        rows = rows.join(labels, "cls", "left").withColumn("label", F.coalesce("label", -1 - F.col("cls")))
        mixed = rows.groupBy("v").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("v")
        rows = rows.join(mixed, "v", "left_semi")
    one, two = (F.col("shape").bitwiseAND(1) != 0, F.col("shape").bitwiseAND(2) != 0) if cross else (F.lit(True), F.lit(True))
    blocks = lambda cond: F.greatest(F.lit(1), F.ceil(F.count_if(cond) / CELL)).cast("int")
    sizes = rows.groupBy("v").agg(blocks(one).alias("nl"), blocks(two).alias("nr"))
    sized = rows.join(sizes, "v").join(lists, "cls")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    zero = F.lit(0)
    left = sized.where(one).withColumn("i", block("nl")).withColumn("j", F.explode(F.sequence(zero if cross else F.col("i"), F.col("nr") - 1))).withColumn("right", F.lit(False))
    right = sized.where(two).withColumn("j", block("nr")).withColumn("i", F.explode(F.sequence(zero, F.col("nl") - 1 if cross else F.col("j")))).withColumn("right", F.lit(True))
    cells = left.unionByName(right).withColumn("diagonal", F.lit(not cross) & (F.col("i") == F.col("j")))
    return _cell_pairs(cells.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j"), cross, least)


def merge_lists(posted: DataFrame, cross: bool, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, long): candidate pairs (a, b) of the lists merged at once, and the rows (v, cls, shape) of
    the long ones, which are empty as a rule.

    Candidates agree in ``MATCHES`` = 2 short lists, or in one if both classes stand in long lists, where
    they may agree a second time.
    """
    n = SPREAD * int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = settle(_merge(posted.repartition(n, "v").sortWithinPartitions("v"), cross, least), "merged")
    pairs = merged.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("n"))
    long = merged.where("kind > 0").select(F.col("a").alias("v"), F.col("b").alias("cls"), F.col("kind").alias("shape")).distinct()
    if long.isEmpty():
        return pairs.where(F.col("n") >= MATCHES).select("a", "b"), long
    hot = settle(long.select("cls").distinct(), "hot")
    mark = F.broadcast if hot.count() <= BROADCAST_ROWS else (lambda df: df)
    marked = pairs.join(mark(hot.select(F.col("cls").alias("a"), F.lit(True).alias("hot_a"))), "a", "left").join(mark(hot.select(F.col("cls").alias("b"), F.lit(True).alias("hot_b"))), "b", "left")
    return marked.where((F.col("n") >= MATCHES) | (F.col("hot_a") & F.col("hot_b"))).select("a", "b"), long


def merge_postings(posted: DataFrame, cross: bool, least: float) -> DataFrame:
    """Candidate pairs of classes (a, b), a < b, with all that agree in at least ``MATCHES`` = 2 coordinates.

    The lists are merged value by value in sorted order. A list longer than ``LONG_LIST`` is skipped
    in that merge and gone through in cells (``long_list_pairs``). No pair with two agreements is lost.
    Pairs whose word counts rule out a likeness of ``least`` are left out, and with ``cross`` all but
    those of side 0 and side 1.
    """
    pairs, long = merge_lists(posted, cross, least)
    if not long.isEmpty():
        pairs = pairs.unionByName(long_list_pairs(long, cross, least)).distinct()
    return pairs
