"""Words, bags of words and their stable hashes, shared by the operators of this subpackage.

A word is a run of letters or digits after lower-casing. The likeness of two texts is the number of
words they share, repeated words counted as often as both have them, divided by the words of the one
plus the words of the other minus the shared words; that is the Jaccard similarity of the two sets of
(word, occurrence) elements.
"""

from __future__ import annotations

import re

import xxhash

_WORD = re.compile(r"[^\W_]+")
MASK = (1 << 64) - 1
_CACHE_LIMIT = 500_000


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null."""
    return _WORD.findall(text.lower()) if text else []


_LETTERS = bytes(b if chr(b).isalnum() else 32 for b in range(128)) + bytes(128)
_TO_WORDS = _LETTERS.lower()


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a text in order as UTF-8; ASCII texts, nearly all of them, take a much faster way."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_TO_WORDS).split()
    return [w.encode() for w in _WORD.findall(text.lower())]


def signed(value: int) -> int:
    """An unsigned 64-bit value as Spark's signed bigint."""
    return value - (1 << 64) if value >> 63 else value


def text_hash(text: str | bytes, seed: int = 0) -> int:
    """A stable signed 64-bit hash of a string."""
    return signed(xxhash.xxh3_64_intdigest(text, seed))


class WordHashes(dict):
    """Word to unsigned 64-bit hash, kept for the words seen lately; emptied when it grows too large."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def bag_hash(tokens: list[bytes], field: int = 0) -> int:
    """One signed 64-bit hash of a bag of words: equal for all orders of the same words."""
    return text_hash(b" ".join(sorted(tokens)), field)


def likeness(a: list, b: list) -> float:
    """The likeness of two word lists; 1.0 if both are empty."""
    if not a and not b:
        return 1.0
    counts: dict = {}
    for w in a:
        counts[w] = counts.get(w, 0) + 1
    shared = 0
    for w in b:
        n = counts.get(w, 0)
        if n:
            shared += 1
            counts[w] = n - 1
    return shared / (len(a) + len(b) - shared)
