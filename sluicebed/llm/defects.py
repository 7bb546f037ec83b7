"""Unusable answers in prompt and response records, each with its kind of defect.

Method: placeholders are recognised by what is left of a text without marks; copies by greedy string
tiling against the record's own texts; refusals by a grammar of declining clauses; other languages
by the script and the function words; truncation by a pushdown parser that follows fences, brackets,
quotations, formulas, lists and markup to the end of the text. A text has at most one defect, the first of:
empty, copy, refusal, other_language, truncated.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["candidate_message", "rewritten_message", "reasoning"]
#: A text is a copy if tiles cover this share of the longer of the two texts.
COPY_SHARE, SHORTEST_TILE = 0.65, 2

# Placeholders, as lower-case letters and digits with single spaces.
PLACEHOLDERS = set("null|none|nil|nan|na|n a|tbd|tba|tbc|todo|to do|empty|blank|missing|undefined|unknown|placeholder|pending|deleted|removed|no response|no answer|no reply|no text|no message|no output|no content|not available|not applicable|to be determined|to be done|left blank|insert text here|your text here|response|answer|text|xxx|x".split("|"))

#: Longer texts that begin with a letter or digit are no placeholders: a few marks around a few words.
_LONGEST_PLACEHOLDER = 60

# The words of declining sentences. A sentence of the first person declines if it holds a
# word of unwillingness and after it a task that was asked for; a few set phrases decline by themselves.
_FIRST = re.compile(r"\b(?:i|me|my|we|us|our)\b")
_OTHERS = re.compile(r"\b(?:you|he|she|they|students?|teachers?|tutors?)\b")
_CLAUSE = re.compile(r"\s*;\s*|\s*[,:—–]\s+(?=(?:so|but|and|because|since|though|although|while|when|if|then|or|which)\b)|\s+(?=(?:because|although|whereas)\b)")
#: Words that make a task a thing instead: "my answer", "the comment".
_THING = "".join(f"(?<!\\b{w} )" for w in "my your his her our their the a an this that its earlier final first last next whole right wrong correct".split())
_TASK = r"(?:assist|help|answer|answering|respond|reply|comment|complete|continue|judge|assess|evaluate|grade|rate|review|write|rewrite|give|giving|provide|offer|produce|generate|create|discuss|discussing|engage|fulfil+|do (?:this|that|so|it)|take part|process|carry (?:on|out)|comply|say more|proceed|handle|address|deal with|work on|look at|go on|go further)"
_UNWILLING = r"(?:n['’]t|\b(?:not|cant|wont|never|cannot|unable|unwilling|declin\w*|refus\w*|refrain\w*|abstain\w*|pass on|skip\w*|avoid\w*|uncomfortable|inappropriate|improper|barred|forbidden|prohibited|impossible|reluctant|hesitant|outside|beyond|against|rather leave|sit this))"
_UNSURE = r"(?! (?:\w+ )?(?:sure|certain|clear|convinced|positive|aware)\b)"
_DECLINES = re.compile(rf"(?P<neg>{_UNWILLING})\b{_UNSURE}[^.?!]{{0,60}}?{_THING}\b{_TASK}\b")
_SET_PHRASES = re.compile(r"\bno comment\b|\bi (?:\w+ )?(?:decline|refuse|abstain)\b|\bi (?:must|have to|will|would|shall|may|can) (?:\w+ )?(?:decline|refuse|pass on|abstain)\b|\b(?:as an? (?:ai|language|large language|assistant)\b[^.?!]{0,40}?)(?:can|could|will|would|wo|do|am|may|must)\s?(?:n['’]t|not|decline|unable)|\bcount me out\b|\bi['’]ll pass\b")
_KEEPS_ANSWER = re.compile(rf"\b(?:give|giving|provide|offer|say)\b[^.?!]{{0,20}}\b(?:answer|solution|result|away)\b")
#: Grounds and referrals that go with declining; one ground or two referrals are enough.
_GROUNDS = re.compile(r"\b(?:guidelines?|polic(?:y|ies)|rules?|terms|instructions)\b[^.?!]{0,60}\b(?:not (?:allow|permit)|n['’]t (?:allow|permit)|forbid|prohibit|prevent)|\b(?:outside|beyond|not (?:part of|within)) (?:of )?(?:my|our) (?:role|remit|scope|job|task|competence|purview|abilities|capabilities)|\bbeyond what (?:i|we) (?:may|can|could|am|are)\b|\black the (?:information|knowledge|context|authority)\b[^.?!]{0,60}\bto do (?:so|that|this)|\brisk in discussing\b")
_REFERRALS = re.compile(r"\bplease (?:ask|contact|consult|see|turn to|speak (?:to|with))\b[^.?!]{0,60}\binstead\b|\byou (?:may|can|could|might) (?:contact|ask|consult)\b[^.?!]{0,60}\bfor help\b|\bperhaps (?:a|an|another|your) (?:teacher|adult|parent|tutor)\b")
#: What a declining text cannot do without, in lower case; looked for before the grammar is tried. Every
#: branch of the grammar needs one of these single words or all words of one of the sets. Words stay whole when
#: quotations and white space are taken out, phrases may only then come about.
_HINTS = ("not", "n't", "n’t", "cant", "wont", "never", "unable", "unwilling", "declin", "refus", "refrain", "abstain", "pass", "skip", "avoid", "comfortable", "appropriate", "improper", "barred", "forbid", "prohibit", "prevent", "impossible", "reluctant", "hesitant", "outside", "beyond", "against", "comment", "lack", "discussing", "perhaps")
_HINT_SETS = (("rather", "leave"), ("sit", "this"), ("count", "me", "out"), ("please", "instead"), ("you", "for", "help", "contact"), ("you", "for", "help", "ask"), ("you", "for", "help", "consult"))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_QUOTED = re.compile(r"(?<!\w)(?:'(?:[^'\n]|(?<=\w)'(?=\w)){2,400}?'(?!\w)|‘[^’\n]{2,400}’|\"[^\"\n]{2,400}\"|“[^”\n]{2,400}”)")

# Frequent function words of English and of the other languages in use.
_ENGLISH = set("the a an and or of to in on at by for from with without is are was were be been it its this that these those there then than he she they you your we our i my me him her his their what which who when where why how does do did has have had not no if so as but can could would will should about into out up down over after before all some any each more most one two".split())
_FOREIGN = {
    "es": "el la los las un una unos unas y o de del al en con por para que qué se su sus es son está están muy bien pero todavía tu más como cómo cuando porque sin sobre entre hay ya lo le no te dice este esta eso donde cual quién fue ser hasta desde".split(),
    "fr": "le la les un une des et ou de du au aux en avec par pour que qui se sa son ses est sont très bien mais encore ton ta tes plus comme comment quand parce sans sur entre il elle y où ce cette ne pas dans sous vous tu qu l d".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder von vom zu zum zur in im mit für auf aus bei nach über unter ist sind war sehr gut aber noch dein deine mehr wie wenn weil ohne zwischen es sie er nicht dass man du dir was warum pro wo noch einmal wer wird werden am beim ihr hat haben".split(),
    "pt": "o a os as um uma uns umas e ou de do da dos das ao à em no na nos nas com por para que se seu sua é são muito bem mas ainda mais como quando porque sem sobre entre há já abaixo não te te você este esta".split(),
    "it": "il lo la i gli le un uno una e o di del della dei delle al alla in nel nella con per che si suo sua è sono molto bene ma ancora tuo tua più come quando perché senza su sulla sulle sotto tra fra ci non ti questo questa cosa nei".split(),
    "nl": "de het een en of van in op met voor door uit bij naar over onder is zijn was zeer goed maar nog jouw je meer hoe als omdat zonder tussen er hij zij niet dat dit wat waarom per die om te aan heeft".split(),
}
# Words of English exercises, among them some that look like function words elsewhere.
_EXERCISE = set("plus minus times per son die add subtract multiply divide compute solve find show write draw count check compare explain try look think read number numbers answer question problem step steps equation sum total correct right wrong first next last each left".split())
_FOREIGN_ONLY = [frozenset(w for w in v if len(w) > 1) - _ENGLISH - _EXERCISE for v in _FOREIGN.values()]
_ENGLISH_ONLY = frozenset(_ENGLISH).difference(*_FOREIGN.values()) | _EXERCISE

_WORD = re.compile(r"[^\W\d_]+|\d+")
_SPACE = re.compile(r"\s+")
_ROLE = re.compile(r"^\W*(?:you asked|question|problem|student|tutor|teacher|q|a|answer|message|the (?:question|problem) is)\s*[:\-.)]\s*", re.I)
_EMOTICON = re.compile(r"(?:\s|^)(?:[:;=]-?[)(DPp]|<3)\s*$")
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
_FACES = (")", "(", "D", "P", "p", "3")
_CLOSING = "\"')]}”’»*_`>"
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}


def _visible(text: str) -> str:
    return text if text.isascii() else text.translate(_INVISIBLE)


def is_empty(text: str | None) -> bool:
    """Null, blank or a mere placeholder."""
    if text is None:
        return True
    text = _visible(text).strip()
    if len(text) > _LONGEST_PLACEHOLDER and any(c.isalnum() for c in text[:8]):
        return False
    bare = " ".join(_WORD.findall(text.lower()))
    return not bare or bare in PLACEHOLDERS


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _runs(prefix: np.ndarray, powers: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs of ``n`` words that no tile has touched; ``free`` counts free words."""
    at = np.flatnonzero(free[n:] - free[:-n] == n)
    return at, prefix[at + n] - prefix[at] * powers[n]


def tiled_words(a: list[str], b: list[str], shortest: int = SHORTEST_TILE, enough: int | None = None) -> int:
    """Words of ``a`` covered by greedy string tiling with ``b``: longest common runs first, no overlaps.

    Runs are compared by their hashes. Each length is gone through once, the longest that is left is
    found by halving, and tiles of k different lengths have at least k * (k + 1) / 2 words: n words cost
    at most about sqrt(2 n) * n * log(n) steps, however repetitive they are. With ``enough`` it stops
    as soon as that many words are covered or can no longer be.
    """
    number: dict[str, int] = {}
    sides = []
    for words in (a, b):
        x = np.array([number.setdefault(w, len(number) + 1) for w in words], np.uint64)
        x = (x ^ (x >> np.uint64(3))) * np.uint64(0xBF58476D1CE4E5B9)
        prefix = np.zeros(len(x) + 1, np.uint64)
        h = 0
        for i, v in enumerate(x.tolist()):
            h = (h * int(_BASE) + v) & 0xFFFFFFFFFFFFFFFF
            prefix[i + 1] = h
        sides.append((prefix, np.ones(len(x), bool)))
    (pa_, ma), (pb, mb) = sides
    powers = np.ones(max(len(a), len(b)) + 1, np.uint64)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, _BASE))
    covered, most = 0, min(len(a), len(b))
    while most >= shortest:
        fa, fb = np.r_[0, np.cumsum(ma)], np.r_[0, np.cumsum(mb)]
        if enough is not None and (covered >= enough or covered + min(fa[-1], fb[-1]) < enough):
            break

        def common(n: int) -> bool:
            return bool(np.isin(_runs(pa_, powers, fa, n)[1], _runs(pb, powers, fb, n)[1]).any())

        low, high = shortest - 1, most  # the longest common run lies above the one and not above the other
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        if low < shortest:
            break
        places: dict[int, list[int]] = {}
        at, h = _runs(pb, powers, fb, low)
        for j, v in zip(at[::-1].tolist(), h[::-1].tolist()):
            places.setdefault(v, []).append(j)
        end = 0
        for i, v in zip(*(x.tolist() for x in _runs(pa_, powers, fa, low))):
            while i >= end and places.get(v):
                j = places[v].pop()
                if mb[j] and mb[j + low - 1]:  # tiles are never shorter, so a run is free if both its ends are
                    ma[i : i + low] = mb[j : j + low] = False
                    covered, end = covered + low, i + low
        most = low - 1
    return covered


def copied_share(a: list[str], b: list[str]) -> float:
    """The share of the longer text that tiles cover, as far as is needed to tell a copy; 0 if lengths or words rule one out."""
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if not shorter or shorter < COPY_SHARE * longer:
        return 0.0
    if a == b:
        return 1.0
    counts: dict[str, int] = {}
    for w in a:
        counts[w] = counts.get(w, 0) + 1
    shared = 0
    for w in b:
        k = counts.get(w, 0)
        if k:
            counts[w] = k - 1
            shared += 1
    if shared < COPY_SHARE * longer:
        return 0.0
    return tiled_words(a, b, min(SHORTEST_TILE, shorter), math.ceil(COPY_SHARE * longer)) / longer


def may_decline(low: str) -> bool:
    """Whether a lower-case text holds what any branch of the grammar needs."""
    return any(h in low for h in _HINTS) or any(all(h in low for h in words) for words in _HINT_SETS)


def declines(text: str) -> bool:
    """Whether the text, quotations aside, declines its task."""
    low = text.lower()
    return may_decline(low) and _grammar_declines(low)


def _grammar_declines(low: str) -> bool:
    low = _SPACE.sub(" ", _QUOTED.sub(" ", low.strip().strip("\"“”")))
    if _SET_PHRASES.search(low) or _GROUNDS.search(low) or len(_REFERRALS.findall(low)) > 1:
        return True
    for sentence in _SENTENCE.split(low):
        if sentence.endswith("?") or not _FIRST.search(sentence):
            continue
        for clause in _CLAUSE.split(sentence):
            m = _DECLINES.search(clause)
            if m and _speaks_for_itself(clause, m.start("neg")) and not _KEEPS_ANSWER.search(clause, m.start("neg")):
                return True
    return False


def _speaks_for_itself(clause: str, at: int) -> bool:
    """Whether the one unwilling at a place of a clause is its speaker: no other subject is nearer before it."""
    own = [m.start() for m in _FIRST.finditer(clause, 0, at)]
    others = [m.start() for m in _OTHERS.finditer(clause, 0, at)]
    return own[-1] > others[-1] if own and others else not others


def other_language(tokens: list[str], text: str) -> bool:
    """Not in English: mostly another script, or function words of another language prevail.

    Single letters are no words here: they are the variables of a formula more often than not.
    """
    if text.isascii():
        if sum(map(_ENGLISH_ONLY.__contains__, tokens)) * 5 > len(tokens):
            return False
    else:
        letters = [c for c in text if c.isalpha()]
        if 2 * sum(c < "ɐ" or unicodedata.name(c, "").startswith("LATIN") for c in letters) < len(letters):
            return True
    found = [w for w in tokens if len(w) > 1 and not w.isdigit()]
    english = sum(map(_ENGLISH_ONLY.__contains__, found))
    if english * 5 > len(found):
        return False
    best = max(sum(map(s.__contains__, found)) for s in _FOREIGN_ONLY)
    if english == 0:
        return best >= 2 or best == 1 and (len(found) >= 6 or not text.isascii())
    return best >= 2 and best > 1.5 * english


# Markup elements that enclose text, and words that a sentence does not end with.
_ELEMENTS = "b i u em strong p ul ol li div span code pre table tr td th h1 h2 h3 h4 h5 h6 a sub sup blockquote".split()
_DANGLING = set("the a an and or of to in on at by for from with than is are was were be if so but your our my their his her its that which who because then into as".split())

_STRUCTURE = re.compile(rf"(?P<fence>```)|<(?P<end>/?)(?P<tag>{'|'.join(_ELEMENTS)})(?:\s[^<>]*)?>|(?P<math>\$\$|\\[\[\]()])|\\(?P<env>begin|end)\{{(?P<name>\w+\*?)\}}|(?P<mark>[()\[\]{{}}“”«»\"])|^[ \t]*(?P<item>[-*•+]|\d+[.)])[ \t]+(?=\S)|(?P<gap>\n[ \t]*\n)", re.M | re.I)
#: What any structure needs; looked for first, as most texts have none of it.
_MAY_OPEN = re.compile(r"[`<$\\()\[\]{}“”«»\"\n]|^[ \t]*(?:[-*•+]|\d+[.)])[ \t]")
_CUT_TAG = re.compile(rf"<(?:/|/?(?:{'|'.join(_ELEMENTS)})(?:\s[^<>]*)?)$", re.I)
_MATH_ENDS = {"\\)": "\\(", "\\]": "\\["}


class Structure:
    """What is still open at the end of a text, innermost last: (kind, mark).

    The kinds are fence, tag, math, bracket, quote and list. Inside a fence nothing but its end counts.
    A mark that closes something closes all that was opened inside it; one that closes nothing is
    ignored. ``items`` are the starts of the items of the list that is open, if one is.
    """

    def __init__(self, text: str):
        self.stack: list[tuple[str, str]] = []
        self.items: list[int] = []
        if _MAY_OPEN.search(text):
            for m in _STRUCTURE.finditer(text):
                self._read(m)

    def _close(self, frame: tuple[str, str]) -> bool:
        if frame not in self.stack:
            return False
        while self.stack.pop() != frame:
            pass
        return True

    def _read(self, m: re.Match) -> None:
        if m["fence"]:
            self._close(("fence", "```")) or self.stack.append(("fence", "```"))
        elif ("fence", "```") in self.stack:
            return
        elif m["tag"]:
            frame = ("tag", m["tag"].lower())
            self._close(frame) if m["end"] else self.stack.append(frame)
        elif m["env"]:
            frame = ("math", m["name"])
            self._close(frame) if m["env"].lower() == "end" else self.stack.append(frame)
        elif m["math"]:
            frame = ("math", _MATH_ENDS.get(m["math"], m["math"]))
            if m["math"] in _MATH_ENDS:
                self._close(frame)
            elif m["math"] != "$$" or not self._close(frame):
                self.stack.append(frame)
        elif m["item"]:
            if ("list", "") not in self.stack:
                self.stack.append(("list", ""))
                self.items = []
            self.items.append(m.end())
        elif m["gap"]:
            if self.stack and self.stack[-1] == ("list", "") and not _ITEM.match(m.string, m.end()):
                self.stack.pop()
        elif m["mark"] == '"':
            self._close(("quote", '"')) or self.stack.append(("quote", '"'))
        elif m["mark"] in _PAIRS:
            self._close(("quote" if m["mark"] in "”»" else "bracket", _PAIRS[m["mark"]]))
        else:
            self.stack.append(("quote" if m["mark"] in "“«" else "bracket", m["mark"]))

    def holds(self, *kinds: str) -> bool:
        return any(kind in kinds for kind, _ in self.stack)


_ITEM = re.compile(r"[ \t]*(?:[-*•+]|\d+[.)])[ \t]+\S")


def open_structure(text: str) -> list[str]:
    """The marks of what is still open at the end of a text, lists aside."""
    return [mark for kind, mark in Structure(text).stack if kind != "list"]


def breaks_off(text: str) -> bool:
    """Whether the text ends inside a sentence, as a pushdown parser over its structure sees it."""
    text = _visible(text).rstrip()
    if text.endswith(_FACES):
        text = _EMOTICON.sub("", text).rstrip()
    if "<" in text and _CUT_TAG.search(text):
        return True
    end = len(text)
    while end and (text[end - 1] in _CLOSING or text[end - 1].isspace()):
        if text[end - 1] == ">" and (tag := re.search(r"<[^<>]*>$", text[:end])):
            end = tag.start()
        else:
            end -= 1
    if not end:
        return False
    structure = Structure(text)
    if structure.holds("fence", "tag", "math"):
        return True
    last = text[end - 1]
    if last == "…" or last == "." and end > 1 and text[end - 2] == ".":
        return True
    if last in ".?!。！？":
        # a sentence that ends in an open bracket goes on, unless a quotation cut that bracket off
        return structure.holds("bracket") and Structure(_QUOTED.sub(" ", text)).holds("bracket")
    if structure.holds("list") and structure.items[-1] < end:
        return _item_breaks_off(text[:end], structure.items)
    line = text[text.rfind("\n", 0, end) + 1 : end].lstrip()
    if re.match(r"#{1,6}\s", line) or line.startswith("|") and last == "|":
        return False
    return True


def _item_breaks_off(text: str, items: list[int]) -> bool:
    """Of a text whose last item has no full stop: such items need none if the others of the list have none."""
    words = _WORD.findall(text[items[-1] :].lower())
    if not text[-1].isalnum() or not words or words[-1] in _DANGLING:
        return True
    before = [text[s:e].rstrip().splitlines()[:-1] for s, e in zip(items, items[1:])]
    ended = [lines[-1].rstrip().endswith((".", "!", "?", ";")) if lines else False for lines in before]
    if ended:
        return all(ended)
    return text.count("\n") < 2


@lru_cache(maxsize=64)  # the texts of a record are compared with each of its fields in turn
def _bare(text: str) -> list[str]:
    if ":" in text[:40] or "-" in text[:40] or "." in text[:12] or ")" in text[:12]:
        for _ in range(3):
            short = _ROLE.sub("", text, count=1)
            if short == text:
                break
            text = short
    return _WORD.findall(text.lower())


def defect_of(text: str | None, own_texts: list[str | None]) -> str | None:
    """The defect of a text, given the texts of its record that it must not merely repeat."""
    if is_empty(text):
        return "empty"
    tokens = _bare(text)
    if any(own and copied_share(tokens, _bare(own)) >= COPY_SHARE for own in own_texts):
        return "copy"
    if declines(text):
        return "refusal"
    if other_language(tokens, text):
        return "other_language"
    return "truncated" if breaks_off(text) else None


def find_defects(df: DataFrame, id_column: str, fields: list[str], problem: str, history: str, message: str, verdict: str) -> DataFrame:
    """(id, field_name, defect), one row per unusable text.

    ``fields`` are checked in turn; ``message`` is the field that answers the problem, the others may
    copy it too. A null ``rewritten_message`` of a record with verdict ``adequate`` is no case. Null
    problems, histories, turns and messages copy nothing; null ids are left out; repeated rows count
    once.
    """
    chosen = df.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{problem}`").cast("string").alias("p"), F.col(f"`{history}`").alias("h"), F.col(f"`{message}`").cast("string").alias("m"), F.col(f"`{verdict}`").cast("string").alias("v"), *(F.col(f"`{c}`").cast("string").alias(f"t{i}") for i, c in enumerate(fields))).where("id is not null")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, kinds = [], [], []
            for key, p, h, m, v, *texts in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                own = [p, *(h or [])]
                for name, text in zip(fields, texts):
                    if text is None and name == "rewritten_message" and v is not None and v.strip().lower() == "adequate":
                        continue
                    kind = defect_of(text, own if name == message else [*own, m])
                    if kind:
                        ids.append(key)
                        names.append(name)
                        kinds.append(kind)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "field_name": pa.array(names, pa.string()), "defect": pa.array(kinds, pa.string())})

    return chosen.mapInArrow(scan, "id string, field_name string, defect string").distinct()


def defect_report(found: DataFrame) -> DataFrame:
    """(field_name, defect, n) of the rows of ``find_defects``."""
    return found.groupBy("field_name", "defect").agg(F.count("*").alias("n"))
