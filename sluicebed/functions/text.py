"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of the significant words, two variants.
STOP_A = "the a an is are to of and or in on it this that you your for with what how so if".split()
STOP_B = """the a an and or but if then so to of in on for with your you that this is are was were be it as at by
from how what why which do does did can could would should have has student message answer problem solution hint
tutor""".split()

# Topics by the first group with a keyword in the text; other texts are arithmetic.
TOPICS = [
    ("geometry", ["area", "perimeter", "angle", "triangle", "rectangle", "square ", "circle", "volume", "radius", "diameter", "cm", "meter"]),
    ("fraction", ["fraction", "numerator", "denominator", "/2", "/3", "/4", "/5", "/6", "/8", "1/", "2/", "3/"]),
    ("percent", ["percent", "%", "discount", "% off"]),
    ("ratio_rate", ["ratio", "proportion", "per ", "rate", "miles per", "for every"]),
    ("money", ["$", "cost", "price", "dollar", "cents", "change"]),
    ("algebra", ["solve for", "equation", "variable", "slope", "x =", "2x", "3x", "x^2", "y ="]),
    ("time_measure", ["hour", "minute", "o'clock", "how long", "weigh", "ounce", "pound", "liter"]),
]

# Cues of corrective framing, as plain substrings and as whole words.
CUES = ["not quite", "you're close", "you are close", "actually", "remember", "should be", "the mistake", "you made", "incorrect", "wrong", "instead of", "you forgot"]
CUE_PATTERN = r"(?i)\b(not quite|actually|remember|instead|isn'?t|should be|the mistake|incorrect)\b"

NUMBER, SIGNED, THOUSANDS = r"\d+(?:\.\d+)?", r"-?\d+(?:\.\d+)?", r"-?\d[\d,]*(?:\.\d+)?"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends; Spark's trim removes only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Lower case, white space collapsed to single spaces and stripped; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), r"\s+", " "))


def first_truthy(*columns: Column) -> Column:
    """The first value that is neither null nor empty; '' if there is none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern; none for null."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(0))


def significant_words(c: Column, least: int, stop: list[str] = ()) -> Column:
    """Distinct lower-case runs of at least ``least`` letters that are not stop words."""
    found = F.array_distinct(matches(F.lower(c), f"[a-z]{{{least},}}"))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def words_a(c: Column) -> Column:
    return significant_words(c, 3, STOP_A)


def words_b(c: Column) -> Column:
    return significant_words(c, 4, STOP_B)


def words_c(c: Column) -> Column:
    return significant_words(c, 4)


def numbers(c: Column, pattern: str = NUMBER) -> Column:
    """The distinct numbers of a text as strings."""
    return F.array_distinct(matches(c, pattern))


def last_number(c: Column) -> Column:
    """The last number of a text without thousands commas; '' if there is none."""
    found = matches(c, THOUSANDS)
    return F.replace(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")), F.lit(","), F.lit(""))


def holds_literal(text: Column, literal: Column) -> Column:
    """Whether the literal occurs without a digit right before or after it; false for '' and null."""
    quoted = F.regexp_replace(literal, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    pattern = F.concat(F.lit(r"(?<!\d)"), quoted, F.lit(r"(?!\d)"))
    return F.coalesce((literal != "") & F.regexp_like(text_or_empty(text), pattern), F.lit(False))


def mostly_covered(key: Column, text: Column) -> Column:
    """Whether at least 3 words and three quarters of the word array ``key`` are in ``text``."""
    both = F.size(F.array_intersect(key, text))
    return (both >= 3) & (both * 4 >= F.size(key) * 3)


def strip_think(c: Column) -> Column:
    """Remove closed and unclosed <think> blocks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")


def clean_hint(c: Column) -> Column:
    """Strip think blocks, code fences, a leading label and matching quotes."""
    t = strip(strip_think(text_or_empty(c)))
    t = strip(F.regexp_replace(t, r"^```[a-zA-Z]*\n?|\n?```$", ""))
    t = strip(F.regexp_replace(t, r"(?i)^(tutor|rewrite|rewritten message|hint)\s*:\s*", ""))
    quoted = (F.length(t) >= 2) & F.substring(t, 1, 1).isin('"', "'") & (F.substring(t, 1, 1) == F.substring(t, -1, 1))
    return F.when(quoted, strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def word_count(c: Column) -> Column:
    """Words separated by white space."""
    return F.size(F.filter(F.split(text_or_empty(c), r"\s+"), lambda w: w != ""))


def topic_of(c: Column) -> Column:
    """The first topic with a keyword in the text, else arithmetic."""
    low = F.lower(text_or_empty(c))
    out = F.lit("arithmetic")
    for name, keys in reversed(TOPICS):
        hit = F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(low, k))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def has_cue(c: Column) -> Column:
    low = F.lower(text_or_empty(c))
    return F.exists(F.array(*map(F.lit, CUES)), lambda k: F.contains(low, k))


def has_cue_word(c: Column) -> Column:
    return F.regexp_like(text_or_empty(c), F.lit(CUE_PATTERN))


def pair_key(c: Column) -> Column:
    """The id without the letter that tells the members of an adversarial pair apart."""
    return first_truthy(F.regexp_extract(text_or_empty(c), r"^(.*-adv-\d+)[a-z]?$", 1), text_or_empty(c))


def conversation_of(c: Column) -> Column:
    """The id without its prefix and its last part: the conversation of ``mrb-<conversation>-<model>``."""
    return F.regexp_extract(c, r"^mrb-(.*)-[^-]*$", 1)


def split_turns(c: Column) -> Column:
    """The turns of one string of ``Tutor:`` and ``Student:`` turns, white space collapsed."""
    parts = F.split(F.replace(text_or_empty(c), F.lit(" "), F.lit(" ")), r"(?=(?:Tutor:|Student:))")
    return F.filter(F.transform(parts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")


def problem_in(turns: Column) -> Column:
    """What follows 'The question is:' in the first turn; ''."""
    return F.trim(F.regexp_extract(text_or_empty(F.try_element_at(turns, F.lit(1))), r"The question is:\s*(.*)", 1))


def tagged_turns(c: Column) -> Column:
    """Turns (role, move, text) of a string like ``Student: ..|EOM|Teacher: (probing) ..``."""
    raw = F.transform(F.split(text_or_empty(c), r"\|EOM\|"), strip)
    kept = F.filter(raw, lambda t: F.startswith(t, F.lit("Teacher:")) | F.startswith(t, F.lit("Student:")))

    def turn(t: Column) -> Column:
        body = strip(F.substring(t, F.lit(9), F.length(t)))
        move = F.regexp_extract(body, r"(?s)^\(([a-z]+)\)\s*(.*)", 1)
        teacher = F.startswith(t, F.lit("Teacher:"))
        tagged = teacher & (move != "")
        return F.struct(
            F.when(teacher, F.lit("Teacher")).otherwise(F.lit("Student")).alias("role"),
            F.when(tagged, move).alias("move"),
            F.when(tagged, strip(F.regexp_extract(body, r"(?s)^\(([a-z]+)\)\s*(.*)", 2))).otherwise(body).alias("text"),
        )

    return F.transform(kept, turn)


def last_role(history: Column) -> Column:
    """Role of the last turn: tutor, student, other, or none without history."""
    role = F.lower(F.regexp_extract(text_or_empty(F.try_element_at(history, F.lit(-1))), r"(?i)^\s*[-*]?\s*(student|tutor)\s*:", 1))
    return F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, F.lit("none")).when(role == "", F.lit("other")).otherwise(role)


def is_malformed(c: Column) -> Column:
    """A single message that holds a heading or at least two role markers."""
    t = text_or_empty(c)
    return F.contains(t, F.lit("### ")) | (F.regexp_count(t, F.lit(r"(?i)(?:^|\n|###)\s*(?:Student|Assistant|Tutor)\s*:")) >= 2)


def last_turns(history: Column, n: int) -> Column:
    """The last ``n`` turns; all of a shorter history."""
    return F.slice(history, F.greatest(F.size(history) - (n - 1), F.lit(1)), F.lit(n))


def user_prompt(problem: Column, solution: Column, history: Column, message: Column) -> Column:
    """The prompt of one record; an empty or null history reads (none yet)."""
    bullets = F.array_join(F.transform(history, lambda t: F.concat(F.lit("- "), t)), "\n")
    shown = F.when(F.coalesce(F.size(history), F.lit(0)) > 0, bullets).otherwise(F.lit("(none yet)"))
    return F.concat(F.lit("PROBLEM:\n"), text_or_empty(problem), F.lit("\n\nCORRECT SOLUTION:\n"), text_or_empty(solution), F.lit("\n\nCONVERSATION SO FAR:\n"), shown, F.lit("\n\nCANDIDATE MESSAGE:\n"), text_or_empty(message))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by bisection: each step compares two prefixes as a whole."""
    n = F.least(F.length(a), F.length(b))
    steps = F.array(*(F.lit(1 << k) for k in range(29, -1, -1)))

    def longer(low: Column, step: Column) -> Column:
        same = F.substring(a, F.lit(1), low + step) == F.substring(b, F.lit(1), low + step)
        return F.when((low + step <= n) & same, low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), longer)


def portable_hash(*parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 from the md5 of the parts joined by '-', the same in other engines."""
    joined = F.concat_ws("-", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")
