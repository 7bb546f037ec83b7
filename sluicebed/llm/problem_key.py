"""A key that is equal for all typings, spellings and labels of the same word problem."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# English number words, spelled-out units and the labels that introduce a problem.
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_VALUE = {w: i for i, w in enumerate(_UNITS)} | {w: 10 * (i + 2) for i, w in enumerate(_TENS)}
_SCALE = {"hundred": 100, "thousand": 1000, "million": 1_000_000}
_MEASURES = {"centimetre": "cm", "centimeter": "cm", "millimetre": "mm", "millimeter": "mm", "kilometre": "km", "kilometer": "km", "metre": "m", "meter": "m", "kilogram": "kg", "kilogramme": "kg", "gram": "g", "gramme": "g", "litre": "l", "liter": "l", "millilitre": "ml", "milliliter": "ml"}
_MEASURES |= {w + "s": m for w, m in _MEASURES.items()}
_LABEL = re.compile(r"^\W*(?:(?:(?:the|this|my|our)\s+)?(?:(?:word|math|maths|story)\s+)?(?:problem|question|exercise|task|q|ex|prob|quest)\b(?:\s+(?:is|no|nr|number))?\W*(?:\d+\W+)?|\d+\s*[.):\]]\s+)")

_GLUED = re.compile(rf"\b({'|'.join(sorted(_VALUE, key=len, reverse=True))})(cm|mm|km|kg|ml|m|g|l)\b")
_THOUSANDS = re.compile(r"(?<=\d)[,  ](?=\d{3}(?!\d))")
_PERCENT = re.compile(r"per\s*-?\s*cent|%|per\s+cents?\b")
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)?|[+*/=^×÷]|(?<=[\d)])\s*[-−–]|[-−–](?=\s*[\d(])|(?<=\s)[-−–](?=\s)")


@lru_cache(maxsize=200_000)
def _plain(word: str) -> str:
    """First letter and the others sorted: swapped letters inside a word make no difference."""
    return word if len(word) < 4 else word[0] + "".join(sorted(word[1:]))


# Number words and units are known with swapped letters too; "there" is a word of its own and no "three".
_SPELLED = {_plain(w): w for w in [*_VALUE, *_SCALE, *_MEASURES] if w != "three"}


def problem_key(text: str) -> str:
    """The canonical form of a problem text; empty if it has no letters or digits."""
    t = unicodedata.normalize("NFKC", text).lower().replace("’", "'").replace("​", "")
    for _ in range(3):
        stripped = _LABEL.sub("", t, count=1)
        if stripped == t or not stripped.strip():
            break
        t = stripped
    t = _THOUSANDS.sub("", _PERCENT.sub(" percent ", t.replace("%age", "percentage").replace("per centage", "percentage").replace("percentage", "pctage")).replace("pctage", " percentage "))
    t = _GLUED.sub(r"\1 \2", t)
    out: list[str] = []
    number: int | None = None  # the value of the number words read last
    part = 0

    def close() -> None:
        nonlocal number, part
        if number is not None:
            out.append(str(number + part))
            number, part = None, 0

    tokens = [_SPELLED.get(_plain(w), w) for w in (w.strip() for w in _TOKEN.findall(t))]
    for i, w in enumerate(tokens):
        v = _VALUE.get(w)
        if v is not None:
            if number is not None and part % 100 == 0 and part and v < 100 or number is not None and part == 0 and number and v < 1000:
                part += v
            elif number is not None and part % 100 >= 20 and part % 10 == 0 and 0 < v < 10:
                part += v
            else:
                close()
                number, part = 0, v
        elif w in _SCALE and number is not None:
            if w == "hundred":
                part *= 100
            else:
                number, part = (number + part) * _SCALE[w], 0
        elif w == "and" and number is not None and (part >= 100 or number) and i + 1 < len(tokens) and tokens[i + 1] in _VALUE:
            continue
        else:
            close()
            if w[0].isdigit():
                out.append(w.rstrip("0").rstrip(".") if "." in w else w.lstrip("0") or "0")
            elif w in "×*":
                out.append("x")
            elif w in "-−–":
                out.append("-")
            else:
                out.append(_plain(_MEASURES.get(w, w)))
    close()
    return " ".join(out)
