"""Text and JSON functions over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, text as T, verdicts as V
from ..session import table
from .catalog import VERDICT_LIST, query, sql_covered, sql_literal, sql_norm, sql_strip, sql_words


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "v1_b").dropDuplicates(["id"])


_REC = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM v1_b) WHERE rn = 1)"


@query(f"SELECT doc_id, {sql_norm('text')} AS normalized FROM documents")
def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


def _words_sql(expr: str) -> str:
    return f"WITH {_REC} SELECT id, array_to_string(list_sort({expr}), ' ') AS words FROM r"


def _words_query(spark, d, f):
    return _records(spark, d).select("id", F.array_join(F.array_sort(f(F.col("key_step"))), " ").alias("words"))


@query(_words_sql(sql_words("key_step", 3, T.STOP_A)))
def significant_words_a(spark, d):
    return _words_query(spark, d, T.words_a)


@query(_words_sql(sql_words("key_step", 4, T.STOP_B)))
def significant_words_b(spark, d):
    return _words_query(spark, d, T.words_b)


@query(_words_sql(sql_words("key_step", 4)))
def significant_words_c(spark, d):
    return _words_query(spark, d, T.words_c)


@query(rf"""WITH {_REC} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(problem, '\d+(?:\.\d+)?'))), ' ') AS plain,
array_to_string(list_sort(list_distinct(regexp_extract_all(problem, '-?\d+(?:\.\d+)?'))), ' ') AS signed FROM r""")
def number_sets(spark, d):
    return _records(spark, d).select("id", F.array_join(F.array_sort(T.numbers(F.col("problem"))), " ").alias("plain"), F.array_join(F.array_sort(T.numbers(F.col("problem"), T.SIGNED)), " ").alias("signed"))


@query(rf"WITH {_REC} SELECT id, replace(coalesce(list_last(regexp_extract_all(coalesce(correct_solution, ''), '-?\d[\d,]*(?:\.\d+)?')), ''), ',', '') AS answer FROM r")
def final_number(spark, d):
    return _records(spark, d).select("id", T.last_number(F.col("correct_solution")).alias("answer"))


_STRIPPED = sql_strip("coalesce(final_answer, '')")
_CTX = "concat_ws(' ', problem, array_to_string(list_filter(coalesce(conversation_history, []), lambda t: t IS NOT NULL), ' '))"
_LOW = "lower(coalesce(rewritten_message, ''))"


@query(f"""WITH {_REC} SELECT id,
{sql_literal('rewritten_message', _STRIPPED)} OR {sql_covered(sql_words('key_step', 3, T.STOP_A), sql_words('rewritten_message', 3, T.STOP_A))} AS plain,
{sql_literal(sql_norm('rewritten_message'), sql_norm('final_answer'))} OR {sql_covered(sql_words('key_step', 4, T.STOP_B), sql_words('rewritten_message', 4, T.STOP_B))} AS normalized,
{sql_strip(_LOW)} <> '' AND (({sql_literal(_LOW, f'lower({_STRIPPED})')} AND NOT {sql_literal(f'lower({_CTX})', f'lower({_STRIPPED})')}) OR {sql_covered(sql_words('key_step', 4), sql_words('rewritten_message', 4))}) AS in_context
FROM r""")
def rewrite_leak_variants(spark, d):
    c = F.col
    context = V.context_text(c("problem"), c("conversation_history"))
    args = (c("rewritten_message"), c("final_answer"), c("key_step"))
    return _records(spark, d).select("id", V.leaks_plain(*args).alias("plain"), V.leaks_normalized(*args).alias("normalized"), V.leaks_in_context(*args, context).alias("in_context"))


_SRC = "concat_ws(' ', problem, correct_solution, candidate_message, array_to_string(list_filter(coalesce(conversation_history, []), lambda t: t IS NOT NULL), ' '))"


@query(rf"""WITH {_REC} SELECT id, list_has_any(list_distinct(regexp_extract_all(coalesce(reasoning, ''), '\d+(?:\.\d+)?')), list_distinct(regexp_extract_all({_SRC}, '\d+(?:\.\d+)?')))
OR list_has_any({sql_words('reasoning', 3, T.STOP_A)}, {sql_words(_SRC, 3, T.STOP_A)}) AS grounded FROM r""")
def grounded_reasoning(spark, d):
    c = F.col
    source = V.context_text(c("problem"), c("correct_solution"), c("candidate_message"), c("conversation_history"))
    return _records(spark, d).select("id", V.grounded_a(c("reasoning"), source).alias("grounded"))


_WRAPPED = "CASE WHEN substr(md5(id), 1, 1) < '5' THEN '<think>plan</think>' || coalesce(candidate_message, '') WHEN substr(md5(id), 1, 1) < '9' THEN coalesce(candidate_message, '') || '<think>cut' ELSE 'Hint: \"' || coalesce(candidate_message, '') || '\"' END"


@query(rf"""WITH {_REC}, w AS (SELECT id, {_WRAPPED} AS t FROM r)
SELECT id, regexp_replace(regexp_replace(t, '<think>.*?</think>', '', 'gs'), '<think>.*$', '', 'gs') AS bare FROM w""")
def think_blocks_removed(spark, d):
    w = _wrapped(spark, d)
    return w.select("id", T.strip_think(F.col("t")).alias("bare"))


def _wrapped(spark, d):
    first, m = F.substring(F.md5("id"), 1, 1), T.text_or_empty(F.col("candidate_message"))
    t = F.when(first < "5", F.concat(F.lit("<think>plan</think>"), m)).when(first < "9", F.concat(m, F.lit("<think>cut"))).otherwise(F.concat(F.lit('Hint: "'), m, F.lit('"')))
    return _records(spark, d).select("id", t.alias("t"))


_T0 = sql_strip("regexp_replace(regexp_replace(t, '<think>.*?</think>', '', 'gs'), '<think>.*$', '', 'gs')")


@query(rf"""WITH {_REC}, w AS (SELECT id, {_WRAPPED} AS t FROM r), a AS (SELECT id, {_T0} AS t FROM w),
b AS (SELECT id, {sql_strip("regexp_replace(t, '(?i)^(tutor|rewrite|rewritten message|hint)\\s*:\\s*', '')")} AS t FROM a)
SELECT id, CASE WHEN length(t) >= 2 AND left(t, 1) IN ('"', '''') AND left(t, 1) = right(t, 1) THEN {sql_strip("substr(t, 2, length(t) - 2)")} ELSE t END AS hint FROM b""")
def cleaned_hints(spark, d):
    return _wrapped(spark, d).select("id", T.clean_hint(F.col("t")).alias("hint"))


def _topic_sql(x: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({x}, '{k.replace(chr(39), chr(39) * 2)}')" for k in keys) + f" THEN '{name}'" for name, keys in T.TOPICS)
    return f"CASE {cases} ELSE 'arithmetic' END"


_WORDS = "len(list_filter(regexp_split_to_array(coalesce(candidate_message, ''), '\\s+'), lambda w: w <> ''))"
_NUMS = r"len(regexp_extract_all(coalesce(problem, ''), '-?\d+(?:\.\d+)?'))"
FEATURES_SQL = f"""{_topic_sql("lower(coalesce(problem, ''))")} AS topic, coalesce(nullif(band, ''), '?') AS band,
CASE WHEN {_WORDS} < 15 THEN 'short' WHEN {_WORDS} <= 35 THEN 'medium' ELSE 'long' END AS length,
CASE WHEN coalesce(len(conversation_history), 0) <= 1 THEN 't<=1' WHEN len(conversation_history) <= 3 THEN 't2-3' ELSE 't4+' END AS turns,
CASE WHEN {_NUMS} <= 2 THEN 'n<=2' WHEN {_NUMS} <= 4 THEN 'n3-4' ELSE 'n5+' END AS numbers"""


def features(df: DataFrame) -> DataFrame:
    """Adds the axes topic, band, length, turns and numbers."""
    c = F.col
    words, turns, nums = T.word_count(c("candidate_message")), F.coalesce(F.size("conversation_history"), F.lit(0)), F.size(T.matches(c("problem"), T.SIGNED))
    return df.withColumns({
        "topic": T.topic_of(c("problem")),
        "band": F.coalesce(F.nullif(c("band"), F.lit("")), F.lit("?")),
        "length": F.when(words < 15, "short").when(words <= 35, "medium").otherwise("long"),
        "turns": F.when(turns <= 1, "t<=1").when(turns <= 3, "t2-3").otherwise("t4+"),
        "numbers": F.when(nums <= 2, "n<=2").when(nums <= 4, "n3-4").otherwise("n5+"),
    })


@query(f"WITH {_REC} SELECT id, {_topic_sql('lower(problem)')} AS topic FROM r")
def topic_buckets(spark, d):
    return _records(spark, d).select("id", T.topic_of(F.col("problem")).alias("topic"))


@query(f"WITH {_REC} SELECT id, {FEATURES_SQL} FROM r")
def feature_buckets(spark, d):
    return features(_records(spark, d)).select("id", "topic", "band", "length", "turns", "numbers")


_FZ_CTX = "lower(concat_ws(' ', problem, array_to_string(list_filter(coalesce(conversation_history, []), lambda t: t IS NOT NULL), ' ')))"


def _leak_sql(rw: str) -> str:
    low = f"lower(coalesce({rw}, ''))"
    return f"({sql_strip(low)} <> '' AND (({sql_literal(low, f'lower({_STRIPPED})')} AND NOT {sql_literal(_FZ_CTX, f'lower({_STRIPPED})')}) OR {sql_covered(sql_words('key_step', 4), sql_words(rw, 4))}))"


def _nw(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '\\s+'), lambda w: w <> ''))"


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\\s+'), lambda w: w <> ''))"


def _points(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE CASE WHEN {_leak_sql(x)} THEN 3 ELSE 0 END + CASE WHEN {_nw(x)} < 8 OR {_nw(x)} > 32 THEN 1 ELSE 0 END END"


@query(f"""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, decision) AS rn FROM human_boundary) WHERE rn = 1),
s AS (SELECT id, ts, {_points('safe_rewrite')} + {_points('leaky_candidate')} AS points, len(list_intersect({_tok('safe_rewrite')}, {_tok('leaky_candidate')})) AS shared,
len(list_distinct(list_concat({_tok('safe_rewrite')}, {_tok('leaky_candidate')}))) AS together FROM h)
SELECT id, points + CASE WHEN together > 0 THEN (1 - shared / together) * 2 ELSE 0 END AS score FROM s""")
def fuzzy_feed(spark, d):
    h = table(spark, d, "human_boundary").withColumn("rn", F.row_number().over(_first("id", "ts", "decision"))).where("rn = 1")
    return h.select("id", fuzzy_score(h).alias("score"))


def _first(key, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def fuzzy_score(df: DataFrame):
    """How much a pair of rewrites deserves review: leaks, outlying lengths and disagreement."""
    c = F.col
    context = V.context_text(c("problem"), c("conversation_history"))

    def points(x):
        leak = F.when(V.leaks_in_context(x, c("final_answer"), c("key_step"), context), 3).otherwise(0)
        n = T.word_count(x)
        return F.when(T.text_or_empty(x) == "", 0).otherwise(leak + F.when((n < 8) | (n > 32), 1).otherwise(0))

    def tokens(x):
        return F.array_distinct(F.filter(F.split(F.lower(T.text_or_empty(x)), r"\s+"), lambda w: w != ""))

    a, b = tokens(c("safe_rewrite")), tokens(c("leaky_candidate"))
    together = F.size(F.array_union(a, b))
    apart = F.when(together > 0, (1 - F.size(F.array_intersect(a, b)) / together) * 2).otherwise(F.lit(0.0))
    return points(c("safe_rewrite")) + points(c("leaky_candidate")) + apart


_DIALOG = "'The question is: ' || coalesce(problem, '') || ' ' || array_to_string(list_filter(coalesce(conversation_history, []), lambda t: t IS NOT NULL), '  ')"


@query(rf"""WITH {_REC}, c AS (SELECT id, 'Tutor: ' || {_DIALOG} AS t FROM r),
s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(replace(t, chr(160), ' '), '(Tutor:|Student:)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS turns FROM c)
SELECT id, len(turns) AS n_turns, array_to_string(turns, '|') AS turns, trim(regexp_extract(turns[1], 'The question is:\s*(.*)', 1)) AS problem FROM s""")
def split_dialogues(spark, d):
    joined = F.concat(F.lit("Tutor: The question is: "), T.text_or_empty(F.col("problem")), F.lit(" "), F.array_join(F.coalesce("conversation_history", F.array()), "  "))
    t = _records(spark, d).select("id", T.split_turns(joined).alias("turns"))
    return t.select("id", F.size("turns").cast("bigint").alias("n_turns"), F.array_join("turns", "|").alias("turns"), T.problem_in(F.col("turns")).alias("problem"))


@query(r"""WITH e AS (SELECT event_id, 'Teacher: (' || event_type || ') step ' || event_id || '|EOM| Student: ok |EOM|Teacher: plain ' || user_id AS t FROM events),
x AS (SELECT event_id, unnest(list_filter(list_transform(string_split(t, '|EOM|'), lambda s: trim(s)), lambda s: s <> '')) AS s, generate_subscripts(list_filter(string_split(t, '|EOM|'), lambda s: s <> ''), 1) AS pos FROM e)
SELECT event_id, pos - 1 AS pos, CASE WHEN starts_with(s, 'Teacher:') THEN 'Teacher' ELSE 'Student' END AS role, nullif(regexp_extract(s, '^Teacher: \(([a-z]+)\)', 1), '') AS move,
CASE WHEN regexp_matches(s, '^Teacher: \([a-z]+\)') THEN regexp_extract(s, '^Teacher: \([a-z]+\)\s*(.*)', 1) ELSE substr(s, 10) END AS text FROM x""")
def tagged_turn_rows(spark, d):
    c = F.col
    t = F.concat(F.lit("Teacher: ("), c("event_type"), F.lit(") step "), c("event_id"), F.lit("|EOM| Student: ok |EOM|Teacher: plain "), c("user_id"))
    rows = table(spark, d, "events").select("event_id", F.posexplode(T.tagged_turns(t)).alias("pos", "turn"))
    return rows.select("event_id", c("pos").cast("bigint").alias("pos"), "turn.role", "turn.move", "turn.text")


@query(f"SELECT doc_id, {_nw('text')}::BIGINT AS n_words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n_words"))


@query(r"SELECT DISTINCT id, coalesce(nullif(regexp_extract(id, '^(.*-adv-\d+)[a-z]?$', 1), ''), id) AS pair, regexp_extract(id, '^mrb-(.*)-[^-]*$', 1) AS conversation, split_part(id, '-', 1) AS family FROM v1_b")
def id_keys(spark, d):
    c = F.col("id")
    return table(spark, d, "v1_b").select("id", T.pair_key(c).alias("pair"), T.conversation_of(c).alias("conversation"), F.substring_index(c, "-", 1).alias("family")).distinct()


@query(f"""WITH {_REC} SELECT id, md5('PROBLEM:' || chr(10) || coalesce(problem, '') || chr(10) || chr(10) || 'CORRECT SOLUTION:' || chr(10) || coalesce(correct_solution, '') || chr(10) || chr(10) || 'CONVERSATION SO FAR:' || chr(10) ||
CASE WHEN coalesce(len(conversation_history), 0) > 0 THEN array_to_string(list_transform(conversation_history, lambda t: '- ' || t), chr(10)) ELSE '(none yet)' END || chr(10) || chr(10) || 'CANDIDATE MESSAGE:' || chr(10) || coalesce(candidate_message, '')) AS prompt_md5 FROM r""")
def prompt_texts(spark, d):
    c = F.col
    return _records(spark, d).select("id", F.md5(T.user_prompt(c("problem"), c("correct_solution"), c("conversation_history"), c("candidate_message"))).alias("prompt_md5"))


@query("""WITH h AS (SELECT DISTINCT id, leaky_candidate AS a, safe_rewrite AS b FROM human_boundary WHERE leaky_candidate IS NOT NULL AND safe_rewrite IS NOT NULL),
n AS (SELECT id, a, b, coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) - 1, least(length(a), length(b))) AS n FROM h)
SELECT id, left(a, n) AS prompt, substr(a, n + 1) AS rejected, substr(b, n + 1) AS chosen FROM n WHERE substr(a, n + 1) <> substr(b, n + 1)""")
def common_prefix_split(spark, d):
    c = F.col
    h = table(spark, d, "human_boundary").select("id", c("leaky_candidate").alias("a"), c("safe_rewrite").alias("b")).where("a is not null and b is not null").distinct()
    n = h.withColumn("n", T.common_prefix_length(c("a"), c("b")))
    out = n.select("id", F.substring("a", F.lit(1), c("n")).alias("prompt"), F.substring("a", c("n") + 1, F.length("a")).alias("rejected"), F.substring("b", c("n") + 1, F.length("b")).alias("chosen"))
    return out.where("rejected <> chosen")


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END))"


@query(f"""WITH t AS (SELECT {_CRC_TABLE} AS tab), b AS (SELECT DISTINCT id, list_transform(string_split('0-' || id, ''), lambda ch: unicode(ch)::BIGINT) AS bytes FROM v1_test)
SELECT id, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(tab[xor(c, x) % 256 + 1], c // 256)), 4294967295::BIGINT) AS crc FROM b, t""")
def checksum_seeds(spark, d):
    """crc32 of seed and id; the statement works it out byte by byte for ASCII ids."""
    return table(spark, d, "v1_test").select("id", F.crc32(F.concat(F.lit("0-"), "id").cast("binary")).alias("crc")).distinct()


@query("SELECT event_id, round_even(event_id % 1000 / 8.0::DOUBLE, 2) AS rounded FROM events")
def half_even_rounding(spark, d):
    """Halves go to the even digit, as reports have it."""
    return table(spark, d, "events").select("event_id", F.bround((F.col("event_id") % 1000) / 8, 2).alias("rounded"))


# -- model outputs: recorded texts made from the records by a fixed rule ---------------------------

_FORM = "substr(md5(id || '-out'), 1, 1)"


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """(id, raw): outputs with prose around the object, think blocks, broken and missing objects."""
    c = F.col
    obj = jsonx.output_json(c("verdict"), T.text_or_empty(c("reasoning")), c("rewritten_message"))
    form = F.substring(F.md5(F.concat("id", F.lit("-out"))), 1, 1)
    raw = (
        F.when(form < "4", obj)
        .when(form < "6", F.concat(F.lit("<think>so</think> Sure: "), obj, F.lit(" done")))
        .when(form < "8", F.concat(F.lit('I say "verdict": "'), c("verdict"), F.lit('" {broken')))
        .when(form < "a", F.concat(F.lit("It is "), c("verdict"), F.lit(".")))
        .when(form < "c", F.lit("[1, 2]"))
        .when(form < "e", F.lit('{"verdict": "other", "reasoning": 5}'))
        .otherwise(F.lit(None).cast("string"))
    )
    return _records(spark, d).select("id", "verdict", raw.alias("raw"))


@query(f"WITH {_REC} SELECT id, CASE WHEN {_FORM} < '8' THEN verdict END AS verdict FROM r")
def verdict_json_or_pattern(spark, d):
    return outputs(spark, d).select("id", jsonx.verdict_or_pattern(F.col("raw")).alias("verdict"))


@query(f"WITH {_REC} SELECT id, CASE WHEN {_FORM} < 'a' THEN verdict WHEN {_FORM} >= 'c' AND {_FORM} < 'e' THEN 'other' END AS verdict FROM r")
def verdict_json_or_first_label(spark, d):
    return outputs(spark, d).select("id", jsonx.verdict_or_first_label(F.col("raw")).alias("verdict"))


@query(f"WITH {_REC} SELECT id, CASE WHEN {_FORM} < 'a' AND {_FORM} >= '6' THEN verdict END AS verdict FROM r WHERE {_FORM} >= '6'")
def verdict_first_label(spark, d):
    form = F.substring(F.md5(F.concat("id", F.lit("-out"))), 1, 1)
    return outputs(spark, d).where(form >= "6").select("id", jsonx.first_label(F.lower("raw")).alias("verdict"))


@query(f"""WITH {_REC}, t AS (SELECT id, {_FORM} AS f, coalesce(reasoning, '') AS reasoning, {sql_strip("coalesce(reasoning, '')")} = '' AS no_reason, verdict, rewritten_message AS rw, {sql_strip("coalesce(rewritten_message, '')")} = '' AS no_rw FROM r)
SELECT id, CASE WHEN f >= 'c' AND f < 'e' THEN 0 WHEN f >= '6' THEN 0 WHEN f < '4' AND NOT no_reason AND ((verdict = 'adequate' AND rw IS NULL) OR (verdict <> 'adequate' AND NOT no_rw)) AND NOT contains(reasoning || coalesce(rw, ''), '<think>') THEN 2 ELSE 1 END AS tier FROM t""")
def schema_tiers(spark, d):
    return outputs(spark, d).select("id", jsonx.schema_tier(F.col("raw")).alias("tier"))


@query(f"""WITH {_REC}, t AS (SELECT id, {_FORM} AS f, {sql_strip("coalesce(reasoning, '')")} = '' AS no_reason, verdict, rewritten_message AS rw, {sql_strip("coalesce(rewritten_message, '')")} = '' AS no_rw FROM r),
e AS (SELECT id, CASE WHEN f >= 'c' AND f < 'e' THEN ['invalid verdict', 'no reasoning', 'no rewrite key'] WHEN f >= '6' THEN ['not an object'] ELSE
list_filter([CASE WHEN no_reason THEN 'no reasoning' END, CASE WHEN verdict = 'adequate' AND rw IS NOT NULL THEN 'rewrite of an adequate message' END, CASE WHEN verdict <> 'adequate' AND no_rw THEN 'no rewrite' END], lambda x: x IS NOT NULL) END AS errs FROM t)
SELECT id, array_to_string(errs, '; ') AS errors FROM e""")
def output_schema_errors(spark, d):
    return outputs(spark, d).select("id", F.array_join(jsonx.output_errors(F.col("raw")), "; ").alias("errors"))


@query(f"WITH {_REC} SELECT id, CASE WHEN {_FORM} < '6' THEN coalesce(reasoning, '') END AS reasoning, CASE WHEN {_FORM} < '6' THEN rewritten_message END AS rewritten_message FROM r WHERE {_FORM} < '6' OR {_FORM} >= 'c' AND {_FORM} < 'e'")
def output_round_trip(spark, d):
    """Serialized outputs parsed again; nulls survive."""
    v = jsonx.parsed_variant(F.col("raw"))
    df = outputs(spark, d).withColumn("v", v).where("v is not null")
    return df.select("id", *(jsonx.field_text(F.col("v"), k).alias(k) for k in ("reasoning", "rewritten_message")))


@query(r"""WITH v AS (SELECT event_id, user_id, upper(substr(md5('r' || event_id), 1, 5)) AS reply FROM events),
s AS (SELECT event_id, list_filter(string_split(reply, ''), lambda c: list_contains(['A', 'B', 'C', 'D'], c)) AS l FROM v),
u AS (SELECT event_id, list_filter(l, lambda c, i: list_position(l, c) = i) AS l FROM s)
SELECT event_id, array_to_string(list_concat(l, list_filter(['A', 'B', 'C', 'D'], lambda c: NOT list_contains(l, c))), '') AS ranking FROM u""")
def jury_letter_ranks(spark, d):
    reply = F.substring(F.md5(F.concat(F.lit("r"), F.col("event_id").cast("string"))), 1, 5)
    return table(spark, d, "events").select("event_id", F.array_join(jsonx.letter_ranks(reply, 4), "").alias("ranking"))


@query(f"""WITH a AS (SELECT DISTINCT doc_id, {_tok('text')} AS w FROM documents), b AS (SELECT doc_id + 1 AS doc_id, w FROM a)
SELECT a.doc_id, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS jaccard FROM a JOIN b USING (doc_id)""")
def word_jaccard(spark, d):
    """Jaccard similarity of the words of documents with neighbouring ids."""
    w = F.array_distinct(F.filter(F.split(F.lower(T.text_or_empty(F.col("text"))), r"\s+"), lambda x: x != ""))
    a = table(spark, d, "documents").select("doc_id", w.alias("a")).distinct()
    b = a.select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("b"))
    union = F.size(F.array_union("a", "b"))
    return a.join(b, "doc_id").select("doc_id", F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("a", "b")) / union).alias("jaccard"))
