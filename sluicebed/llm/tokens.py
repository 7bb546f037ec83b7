"""Token counts: a token is a run of letters or digits, or any single other character but white space."""

from __future__ import annotations

import re

TOKEN = re.compile(r"[^\W_]+|[^\s]")

_LATIN = [chr(b) for b in range(256)]
_LETTER = re.compile(r"[^\W_]")
_TO_RUNS = bytes(ord(c) if _LETTER.match(c) else 32 for c in _LATIN)
_NO_MARKS = "".join(c for c in _LATIN if _LETTER.match(c) or c.isspace()).encode("latin-1")


def count_tokens(text: str | None) -> int:
    """The number of tokens; 0 for null. Latin-1 texts are counted as bytes, which is much faster."""
    if not text:
        return 0
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return len(TOKEN.findall(text))
    return len(raw.translate(_TO_RUNS).split()) + len(raw.translate(None, _NO_MARKS))
