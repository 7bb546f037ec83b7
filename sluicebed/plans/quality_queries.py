"""Gates, artefacts, reasons and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, quality as Q
from ..session import table
from .catalog import query, sql_hash, sql_literal, sql_norm, sql_strip
from .text_queries import _REC, _records

_BLANK = lambda c: f"{sql_strip(f'coalesce({c}, {chr(39) * 2})')} = ''"
_HIST = "conversation_history IS NOT NULL AND len(list_filter(conversation_history, lambda t: t IS NULL)) = 0"
_CTX = "lower(concat_ws(' ', problem, array_to_string(list_filter(coalesce(conversation_history, []), lambda t: t IS NOT NULL), ' ')))"
_ANS = f"lower({sql_strip(chr(99) + 'oalesce(final_answer, ' + chr(39) * 2 + ')')})"
_VALID = "verdict IN ('adequate', 'gives_final_answer', 'gives_away_key_step', 'mismatched_calibration', 'vague_unhelpful')"
_GATE = "list_filter([" + ", ".join(
    [f"CASE WHEN {_BLANK(k)} THEN '{k} missing or empty' END" for k in Q.GATED]
    + [
        f"CASE WHEN NOT ({_HIST}) THEN 'bad history' END",
        f"CASE WHEN NOT coalesce({_VALID}, false) THEN 'invalid verdict' END",
        "CASE WHEN coalesce(verdict = 'adequate', false) AND rewritten_message IS NOT NULL THEN 'rewrite of an adequate message' END",
        f"CASE WHEN NOT coalesce(verdict = 'adequate', false) AND {_BLANK('rewritten_message')} THEN 'no rewrite' END",
        f"CASE WHEN {sql_literal('lower(rewritten_message)', _ANS)} AND NOT {sql_literal(_CTX, _ANS)} THEN 'rewrite leaks answer' END",
    ]
) + "], lambda e: e IS NOT NULL)"
_ROLE = r"lower(regexp_extract(coalesce(list_last(conversation_history), ''), '(?i)^\s*[-*]?\s*(student|tutor)\s*:', 1))"
_LAST = f"CASE WHEN coalesce(len(conversation_history), 0) = 0 THEN 'none' WHEN {_ROLE} = '' THEN 'other' ELSE {_ROLE} END"
_MALFORMED = r"(contains(coalesce(candidate_message, ''), '### ') OR len(regexp_extract_all(coalesce(candidate_message, ''), '(?i)(?:^|\n|###)\s*(?:Student|Assistant|Tutor)\s*:')) >= 2)"


@query(f"WITH {_REC} SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_BLANK(k)} THEN '{k} missing or empty' END" for k in Q.GATED[:3]) + f", CASE WHEN NOT ({_HIST}) THEN 'bad history' END], lambda e: e IS NOT NULL), '; ') AS errors FROM r")
def input_schema_errors(spark, d):
    return _records(spark, d).select("id", F.array_join(Q.input_errors(), "; ").alias("errors"))


@query(f"WITH {_REC} SELECT id, array_to_string({_GATE}, '; ') AS errors FROM r")
def quality_gate_errors(spark, d):
    return _records(spark, d).select("id", F.array_join(Q.gate_errors(), "; ").alias("errors"))


@query(f"WITH {_REC}, g AS (SELECT {_GATE} AS e FROM r) SELECT count(*) AS n, count(*) FILTER (WHERE len(e) = 0) AS n_passed, count(*) FILTER (WHERE len(e) = 0) / count(*) AS pass_rate FROM g")
def gate_pass_rate(spark, d):
    e = _records(spark, d).select(F.size(Q.gate_errors()).alias("e"))
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("e") == 0).alias("n_passed")).withColumn("pass_rate", F.col("n_passed") / F.col("n"))


@query(f"WITH {_REC}, g AS (SELECT unnest({_GATE}) AS error FROM r) SELECT error, count(*) AS n FROM g GROUP BY error")
def gate_error_counts(spark, d):
    return _records(spark, d).select(F.explode(Q.gate_errors()).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query(f"WITH {_REC} SELECT id, {_MALFORMED} AS malformed, {_LAST} AS last_role FROM r")
def turn_artefacts(spark, d):
    return _records(spark, d).select("id", T.is_malformed(F.col("candidate_message")).alias("malformed"), T.last_role(F.col("conversation_history")).alias("last_role"))


_CUE = " OR ".join(f"contains(lower(coalesce(leaky_candidate, '')), '{k.replace(chr(39), chr(39) * 2)}')" for k in T.CUES)


@query(rf"SELECT DISTINCT id, ({_CUE}) AS cue, regexp_matches(coalesce(leaky_candidate, ''), '(?i)\b(not quite|actually|remember|instead|isn''?t|should be|the mistake|incorrect)\b') AS cue_word FROM human_boundary")
def corrective_cues(spark, d):
    c = F.col("leaky_candidate")
    return table(spark, d, "human_boundary").select("id", T.has_cue(c).alias("cue"), T.has_cue_word(c).alias("cue_word")).distinct()


@query("SELECT event_id, event_type, length(props) AS n FROM events WHERE event_type IN ('click', 'view') AND event_id > 0 AND length(props) >= 8")
def length_and_kind_filter(spark, d):
    e = table(spark, d, "events")
    return e.where(F.col("event_type").isin("click", "view") & (F.col("event_id") > 0) & (F.length("props") >= 8)).select("event_id", "event_type", F.length("props").cast("bigint").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag LIKE 'A%' THEN 'gives_final_answer' WHEN l_linestatus = 'O' AND l_quantity >= 25 THEN 'adequate'
WHEN l_linestatus = 'O' THEN 'mismatched_calibration' WHEN l_quantity >= 45 THEN NULL ELSE 'vague_unhelpful' END AS label, l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity >= 25 AS clean FROM lineitem""")
def annotation_case_map(spark, d):
    """Annotations to a label by ordered rules, with the clean-response predicate beside it."""
    c = F.col
    label = F.when(F.startswith("l_returnflag", F.lit("A")), "gives_final_answer").when((c("l_linestatus") == "O") & (c("l_quantity") >= 25), "adequate").when(c("l_linestatus") == "O", "mismatched_calibration").when(c("l_quantity") >= 45, None).otherwise("vague_unhelpful")
    clean = (c("l_returnflag") == "N") & (c("l_linestatus") == "O") & (c("l_quantity") >= 25)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), clean.alias("clean"))


_HELD = f"EXISTS (SELECT 1 FROM v1_test t WHERE t.id = r.id) OR {sql_norm('candidate_message')} IN (SELECT {sql_norm('candidate_message')} FROM v1_test)"


@query(f"""WITH {_REC} SELECT CASE WHEN {_HELD} THEN 'held out' WHEN len({_GATE}) > 0 THEN 'gate' WHEN {_MALFORMED} OR {_ROLE} = 'tutor' THEN 'artefact' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY ALL""")
def first_failing_reason(spark, d):
    r = _records(spark, d)
    held = table(spark, d, "v1_test").select(T.normalize(F.col("candidate_message")).alias("t"), F.lit(True).alias("held")).distinct()
    ids = table(spark, d, "v1_test").select(F.col("id"), F.lit(True).alias("held_id")).distinct()
    joined = r.withColumn("t", T.normalize(F.col("candidate_message"))).join(held, "t", "left").join(ids, "id", "left")
    reason = Q.first_reason(("held out", F.col("held") | F.col("held_id")), ("gate", F.size(Q.gate_errors()) > 0), ("artefact", Q.artefact(F.col("candidate_message"), F.col("conversation_history"))))
    return Q.reason_counts(joined, reason)


@query(f"""WITH {_REC} SELECT id, ({_GATE})[1] IS NULL AS ok, array_to_string(list_slice(coalesce(conversation_history, []), greatest(len(coalesce(conversation_history, [])) - 3, 1), len(coalesce(conversation_history, []))), ' | ') AS recent, left(candidate_message, 160) AS shown FROM r""")
def last_turns_slice(spark, d):
    h = F.coalesce("conversation_history", F.array().cast("array<string>"))
    return _records(spark, d).select("id", (F.size(Q.gate_errors()) == 0).alias("ok"), F.array_join(T.last_turns(h, 4), " | ").alias("recent"), F.substring("candidate_message", 1, 160).alias("shown"))


@query(f"""WITH {_REC}, x AS (SELECT id, problem, correct_solution, coalesce(conversation_history, []) AS conversation_history, candidate_message FROM r) SELECT id, problem, correct_solution, array_to_string(conversation_history, '|') AS history, candidate_message FROM x""")
def input_projection(spark, d):
    h = F.coalesce("conversation_history", F.array().cast("array<string>"))
    return _records(spark, d).select("id", "problem", "correct_solution", F.array_join(h, "|").alias("history"), "candidate_message")


@query(f"WITH {_REC} SELECT id, verdict AS gold_verdict, reasoning AS gold_reasoning, rewritten_message AS gold_rewrite, coalesce(slice, 'core') AS slice FROM r")
def gold_projection(spark, d):
    c = F.col
    return _records(spark, d).select("id", c("verdict").alias("gold_verdict"), c("reasoning").alias("gold_reasoning"), c("rewritten_message").alias("gold_rewrite"), F.coalesce("slice", F.lit("core")).alias("slice"))


@query(f"WITH {_REC} SELECT id, coalesce(nullif(rewritten_message, ''), nullif(key_step, ''), '') AS text FROM r")
def falsy_coalesce(spark, d):
    return _records(spark, d).select("id", T.first_truthy(F.col("rewritten_message"), F.col("key_step")).alias("text"))


@query("SELECT doc_id, split_part(coalesce(source, ''), '-', 1) AS family FROM documents")
def source_family(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring_index(T.text_or_empty(F.col("source")), "-", 1).alias("family"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal IS NULL OR (n_name IS NOT NULL AND s_nationkey % 3 = 0) THEN 'contested' ELSE 'spotcheck' END AS section FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def review_sections(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")  # nation has 25 rows by definition
    return j.select("s_suppkey", F.when(F.col("s_acctbal").isNull() | (F.col("n_name").isNotNull() & (F.col("s_nationkey") % 3 == 0)), "contested").otherwise("spotcheck").alias("section"))


_FLAG = f"""d AS (SELECT doc_id, text, kind, {sql_norm('text')} AS t FROM documents WHERE text IS NOT NULL AND {sql_norm('text')} <> ''),
clean AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM gives_away_probe p WHERE contains(d.text, p.problem))),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rn FROM clean) WHERE rn = 1),
least AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM one GROUP BY kind)),
pick AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {sql_hash("'0'", 'doc_id')}, doc_id) AS k FROM one)"""


@query(f"WITH {_FLAG} SELECT kind, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM pick, least WHERE k <= least.n GROUP BY kind")
def curated_class_counts(spark, d):
    """The flagship: decontaminate, deduplicate, balance to the smallest class, count."""
    from ..operators.sampling import downsample

    docs = table(spark, d, "documents").select("doc_id", "text", "kind").withColumn("t", T.normalize(F.col("text"))).where("text is not null and t <> ''")
    probes = table(spark, d, "gives_away_probe").select("id", "problem").distinct()
    dirty = dedup.contained_texts(probes, docs, "id", "problem", "doc_id", "text").select("doc_id").distinct()
    clean = docs.join(dirty, "doc_id", "left_anti").drop("text")
    one = dedup.one_per_key(clean, [F.col("t")], [F.col("doc_id")]).drop("t")
    return downsample(one, "kind", "doc_id", "0").groupBy("kind").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))

