"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method: balanced targets. The smallest piece count that can hold the text gives equal-length targets;
each inner cut is snapped to the strongest boundary near its target, and a piece is added whenever the
limit keeps a cut from such a boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKEN, count_tokens

#: A cut may move by this share of the limit to reach a boundary.
REACH = 1 / 8
_PARAGRAPH = re.compile(r"\n\s*\n")
_CLOSERS = "\"')]}”’»*_"

_PIECES = "id {id}, piece_no int, n_pieces int, start_token int, end_token int, n_tokens int, start_char int, end_char int, text string"


def boundary_strength(text: str, spans: list[tuple[int, int]], at: int) -> int:
    """How natural a cut before token ``at`` is: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 space, 0 none."""
    gap = text[spans[at - 1][1] : spans[at][0]]
    if "\n" in gap:
        return 5 if _PARAGRAPH.search(gap) else 4
    if not gap:
        return 0
    k = at - 1
    while k > 0 and at - k < 4 and text[spans[k][0]] in _CLOSERS and spans[k - 1][1] == spans[k][0]:
        k -= 1
    last = text[spans[k][1] - 1]
    return 3 if last in ".!?…" else 2 if last in ",;:" else 1


def cut_points(text: str, spans: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges [start, end) of the pieces of a text; neighbours share ``overlap`` tokens.

    A cut is snapped within ``REACH`` of its target, but never beyond the limit from the start of its
    piece nor so early that the pieces left could not hold the rest. If that keeps a cut from a
    sentence end or better that stands within its reach, there is a piece more, at most an eighth of
    the least number more, and two.
    """
    n = len(spans)
    if n <= limit:
        return [(0, n)]
    step, reach = limit - overlap, int(limit * REACH)
    least = -(-(n - overlap) // step)
    known: dict[int, int] = {}

    def strength(at: int) -> int:
        if at not in known:
            known[at] = boundary_strength(text, spans, at)
        return known[at]

    ends: list[int] = []
    for k in range(least, min(least + least // 8 + 2, n - overlap) + 1):
        ends, natural = [], True
        for i in range(1, k):
            target = overlap + (i * (n - overlap)) // k
            before = ends[-1] if ends else overlap
            first, last = max(before + 1, n - (k - i) * step), min(n - 1, before + step)
            low, high = max(first, target - reach), min(last, target + reach)
            if low > high:  # the reach ends before the cut may begin, or begins after it must have been made
                low = high = first if target + reach < first else last
            cut = max(range(low, high + 1), key=lambda e: (strength(e), -abs(e - target)))
            if strength(cut) < 3 and any(strength(e) >= 3 for e in range(max(before + 1, target - reach), min(n - 1, target + reach) + 1)):
                natural = False
            ends.append(cut)
        if natural:
            break
    ends.append(n)
    return list(zip([0] + [e - overlap for e in ends[:-1]], ends))


def split_oversized(df: DataFrame, id_column: str, text_column: str, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens.

    (id, piece_no, n_pieces, start_token, end_token, n_tokens, start_char, end_char, text): no piece is
    over the limit, neighbours share exactly ``overlap`` tokens, and ``start_char``/``end_char`` tile
    the text, white space included. Null, empty and smaller texts give no rows; repeated rows count
    once by id. ``with_text`` false leaves ``text`` null. Needs ``0 <= overlap < limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    kind = df.select(F.col(f"`{id_column}`")).schema[0].dataType
    schema = _PIECES.format(id=kind.simpleString())
    arrow = pa.schema([("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_token", pa.int32()), ("end_token", pa.int32()), ("n_tokens", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("text", pa.string())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text or len(text) <= limit or count_tokens(text) <= limit:
                    continue
                spans = [m.span() for m in TOKEN.finditer(text)]
                cuts = cut_points(text, spans, limit, overlap)
                for k, (s, e) in enumerate(cuts):
                    a, b = spans[s][0] if k else 0, spans[e][0] if e < len(spans) else len(text)
                    ids.append(i)
                    rows.append((k, len(cuts), s, e, e - s, a, b, text[a:b] if with_text else None))
            columns = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)]
            key = batch.column(0).take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([key, *columns], names=["id", *arrow.names])

    pieces = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).where("id is not null").mapInArrow(scan, schema)
    return pieces.dropDuplicates(["id", "piece_no"]) if with_text else pieces
