"""Edits, rulings, overlays and bounded loops."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..functions.text import portable_hash
from ..operators import changes as C, joins, loops
from ..operators.sampling import ranked
from ..session import table
from ..sources import jsonl
from .catalog import VERDICT_LIST, WITH_PREDS, gold, predictions, query, sql_hash
from .lineage import shared_dir
from .text_queries import _leak_sql
from .vote_queries import _WIDE, wide

c = F.col


@query(f"{WITH_PREDS}, {_WIDE} SELECT id, gold AS old, m1 AS new, CASE WHEN m3 = 'adequate' THEN 'USER' WHEN m2 IS NOT DISTINCT FROM m1 THEN 'CONFIRMED' WHEN m2 IS NOT NULL AND m2 IS DISTINCT FROM gold THEN 'SUPPORTED' ELSE 'TENTATIVE' END AS tier FROM w WHERE m1 IS NOT NULL AND m1 <> gold")
def edit_tiers(spark, d):
    w = wide(spark, d).where("m1 is not null and m1 <> gold")
    source = F.when(c("m3") == "adequate", "reviewer").otherwise("judge")
    return w.select("id", c("gold").alias("old"), c("m1").alias("new"), C.edit_tier(source, c("gold"), c("m1"), c("m2")).alias("tier"))


_RULE = f"ru AS (SELECT id, gold AS current, model AS bucket, pred AS ruling, h % 13 = 0 AS dropped FROM preds WHERE model IN ('m1', 'm2'))"
_CLASS = f"CASE WHEN dropped THEN 'drop' WHEN list_contains({VERDICT_LIST}, ruling) AND ruling IS DISTINCT FROM current THEN 'change' WHEN ruling IS NOT NULL AND ruling <> '' THEN 'keep' ELSE 'unruled' END"


def rulings(spark, d):
    p = predictions(spark, d).where(c("model").isin("m1", "m2"))
    return p.select("id", c("gold").alias("current"), c("model").alias("bucket"), c("pred").alias("ruling"), (c("h") % 13 == 0).alias("dropped"))


@query(f"{WITH_PREDS}, {_RULE} SELECT bucket, {_CLASS} AS class, count(*) AS n FROM ru GROUP BY ALL")
def ruling_classes(spark, d):
    return rulings(spark, d).groupBy("bucket", C.ruling_class(c("dropped"), c("ruling"), c("current")).alias("class")).agg(F.count("*").alias("n"))


_CHG = f"ch AS (SELECT id, CASE WHEN {_CLASS} = 'change' THEN ruling END AS new_label, dropped FROM ru WHERE bucket = 'm1' AND {_CLASS} IN ('drop', 'change'))"


def change_table(spark, d):
    r = rulings(spark, d).where("bucket = 'm1'").withColumn("class", C.ruling_class(c("dropped"), c("ruling"), c("current")))
    return r.where(c("class").isin("drop", "change")).select("id", F.when(c("class") == "change", c("ruling")).alias("new_label"), c("dropped").alias("drop"))


@query(f"{WITH_PREDS}, {_RULE}, {_CHG} SELECT g.id, coalesce(new_label, gold) AS gold, new_label IS NOT NULL AND new_label IS DISTINCT FROM gold AS stale FROM gold g LEFT JOIN ch USING (id) WHERE NOT coalesce(dropped, false)")
def applied_changes(spark, d):
    return joins.overlay(gold(spark, d).select("id", "gold"), change_table(spark, d), "id", "gold")


@query(f"{WITH_PREDS}, {_RULE}, {_CHG} SELECT g.id, gold AS old, CASE WHEN NOT dropped THEN new_label END AS new, CASE WHEN dropped THEN 'drop' ELSE 'relabel' END AS kind FROM gold g JOIN ch USING (id) WHERE dropped OR new_label IS DISTINCT FROM gold")
def change_log(spark, d):
    return C.change_log(gold(spark, d).select("id", "gold"), change_table(spark, d), "id", "gold")


@query(f"{WITH_PREDS}, {_RULE}, {_CHG} SELECT h.id FROM (SELECT DISTINCT id FROM human_boundary) h WHERE h.id NOT IN (SELECT id FROM ch)")
def unmatched_change_ids(spark, d):
    return table(spark, d, "human_boundary").select("id").distinct().join(change_table(spark, d), "id", "left_anti")


_FLIP = f"""b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM v1_b) WHERE rn = 1),
f AS (SELECT id, min(current_label) AS label FROM train_flagged GROUP BY id), g AS (SELECT * FROM (SELECT id, safe_rewrite AS rw, row_number() OVER (PARTITION BY id ORDER BY ts DESC, decision) AS rn FROM human_boundary) WHERE rn = 1),
j AS (SELECT b.*, f.label, g.rw FROM b LEFT JOIN f USING (id) LEFT JOIN g USING (id))"""
_OUT = f"CASE WHEN label IS NULL THEN 'kept' WHEN label = 'adequate' THEN 'to_adequate' WHEN trim(coalesce(rw, '')) = '' THEN 'dropped: no rewrite' WHEN {_leak_sql('rw')} THEN 'dropped: rewrite leaks' ELSE 'regenerated' END"


@query(f"WITH {_FLIP} SELECT id, {_OUT} AS outcome, coalesce(label, verdict) AS verdict, CASE {_OUT} WHEN 'kept' THEN rewritten_message WHEN 'regenerated' THEN rw END AS rewrite FROM j")
def relabel_outcomes(spark, d):
    b = table(spark, d, "v1_b").dropDuplicates(["id"])
    flips = table(spark, d, "train_flagged").groupBy("id").agg(F.min("current_label").alias("label"))
    regen = ranked(table(spark, d, "human_boundary").select("id", "safe_rewrite", "ts", "decision"), ["id"], [c("ts").desc(), c("decision")]).where("rn = 1").select("id", c("safe_rewrite").alias("rewrite"))
    context = V.context_text(c("problem"), c("conversation_history"))
    return C.assemble(b, flips, regen, "id", lambda rw: V.leaks_in_context(rw, c("final_answer"), c("key_step"), context))


@query(f"WITH {_FLIP} SELECT {_OUT} AS outcome, count(*) AS n FROM j GROUP BY ALL")
def relabel_outcome_counts(spark, d):
    return relabel_outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


_REF = f"""SELECT id, CASE WHEN m1 = 'adequate' OR NOT coalesce(list_contains({VERDICT_LIST}, m1), false) THEN 'passed_original' WHEN m2 = 'adequate' THEN 'judge_passed' WHEN m3 = 'adequate' THEN 'judge_passed' WHEN m4 = 'adequate' THEN 'judge_passed' ELSE 'maxiter_fallback' END AS how,
CASE WHEN m1 = 'adequate' OR NOT coalesce(list_contains({VERDICT_LIST}, m1), false) THEN 0 WHEN m2 = 'adequate' THEN 1 WHEN m3 = 'adequate' THEN 2 ELSE 3 END AS iters FROM w"""


def _refined(spark, d):
    w = wide(spark, d)
    return w.withColumn("x", loops.refine(c("m1"), [F.lit(f"rewrite {i}") for i in (1, 2, 3)], [c("m2"), c("m3"), c("m4")], F.lit("original"), "What could you try first?", V.VERDICTS))


@query(f"{WITH_PREDS}, {_WIDE} {_REF}")
def refinement_loop(spark, d):
    return _refined(spark, d).select("id", "x.how", "x.iters")


@query(f"{WITH_PREDS}, {_WIDE}, r AS ({_REF}) SELECT how, count(*) AS n, sum(iters) / count(*) AS mean_iters FROM r GROUP BY how")
def refinement_outcomes(spark, d):
    return refinement_loop(spark, d).groupBy("how").agg(F.count("*").alias("n"), (F.sum("iters") / F.count("*")).alias("mean_iters"))


@query(f"WITH h AS (SELECT DISTINCT id, problem, conversation_history, final_answer, key_step, safe_rewrite FROM human_boundary) SELECT id, CASE WHEN {_leak_sql('safe_rewrite')} THEN 'What could you try first?' ELSE safe_rewrite END AS shown FROM h")
def guarded_hints(spark, d):
    context = V.context_text(c("problem"), c("conversation_history"))
    h = table(spark, d, "human_boundary").select("id", "problem", "conversation_history", "final_answer", "key_step", "safe_rewrite").distinct()
    return h.select("id", loops.guarded(c("safe_rewrite"), V.leaks_in_context(c("safe_rewrite"), c("final_answer"), c("key_step"), context), "What could you try first?").alias("shown"))


@query(f"WITH h AS (SELECT DISTINCT id, problem, conversation_history, final_answer, key_step, leaky_candidate, safe_rewrite FROM human_boundary) SELECT id FROM h WHERE trim(coalesce(leaky_candidate, '')) <> '' AND trim(coalesce(safe_rewrite, '')) <> '' AND {_leak_sql('leaky_candidate')} AND NOT {_leak_sql('safe_rewrite')}")
def validated_pairs(spark, d):
    """Pairs whose leaky side trips the detector and whose safe side does not."""
    h = table(spark, d, "human_boundary").select("id", "problem", "conversation_history", "final_answer", "key_step", "leaky_candidate", "safe_rewrite").distinct()
    context = V.context_text(c("problem"), c("conversation_history"))
    trips = lambda text: V.leaks_in_context(c(text), c("final_answer"), c("key_step"), context)
    filled = (F.trim(F.coalesce("leaky_candidate", F.lit(""))) != "") & (F.trim(F.coalesce("safe_rewrite", F.lit(""))) != "")
    return h.where(filled & trips("leaky_candidate") & ~trips("safe_rewrite")).select("id")


_FLAGS = {name: sql_hash("id", f"'{name}'") for name in ("broad", "sharp", "crisp")}
_FLAG_SQL = ", ".join(f"{h} % {m} = 0 AS {name}" for (name, h), m in zip(_FLAGS.items(), (2, 3, 5)))


@query(f"WITH f AS (SELECT id, source, {_FLAG_SQL} FROM (SELECT DISTINCT id, source FROM human_boundary)), u AS (UNPIVOT f ON broad, sharp, crisp INTO NAME detector VALUE leak) SELECT source, detector, count(*) AS n, count(*) FILTER (WHERE leak) AS n_leaks, count(*) FILTER (WHERE leak) / count(*) AS leak_rate FROM u GROUP BY ALL")
def detector_rates(spark, d):
    """Leak rates by source under three detectors, whose answers are recorded as boolean columns."""
    h = table(spark, d, "human_boundary").select("id", "source").distinct()
    recorded = F.array(*(F.struct(F.lit(name).alias("detector"), (portable_hash(c("id"), name) % m == 0).alias("leak")) for name, m in zip(_FLAGS, (2, 3, 5))))
    rows = h.select("source", F.explode(recorded).alias("x")).groupBy("source", "x.detector")
    return rows.agg(F.count("*").alias("n"), F.count_if("x.leak").alias("n_leaks")).withColumn("leak_rate", c("n_leaks") / c("n"))


@query(f"""{WITH_PREDS.replace("WITH ", "WITH RECURSIVE ", 1)}, a AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS i, count(*) FILTER (WHERE pred = gold) / count(*) AS accuracy FROM preds GROUP BY model),
hist AS (SELECT i AS round, model, true AS accepted, accuracy AS best, 0 AS dry FROM a WHERE i = 0 UNION ALL SELECT a.i, a.model, accuracy > best, greatest(best, accuracy), CASE WHEN accuracy > best THEN 0 ELSE dry + 1 END FROM hist JOIN a ON a.i = hist.round + 1 WHERE dry < 2)
SELECT round::INT AS round, model, accepted FROM hist""")
def climb_history(spark, d):
    """Models in turn, each kept if it beats the best so far, until two in a row do not or a flag file says halt."""
    p = predictions(spark, d)
    scores = p.groupBy("model").agg((F.count_if(c("pred") == c("gold")) / F.count("*")).alias("accuracy")).orderBy("model").limit(100).collect()  # a row per model
    flag, best = f"{shared_dir(spark)}/halt/{uuid.uuid4().hex}", [-1.0]

    def accepted(row) -> bool:
        better = row.accuracy > best[0]
        best[0] = max(best[0], row.accuracy)
        return better

    history = loops.climb(lambda i: scores[i], accepted, lambda: jsonl.exists(spark, flag), max_rounds=len(scores))
    return spark.createDataFrame([(x["round"], x["candidate"].model, x["accepted"]) for x in history], "round int, model string, accepted boolean")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE length(text) % 3 END AS tier FROM documents")
def scored_tiers(spark, d):
    """The scorer protocol with a stand-in scorer, tried again on failure; grades outside 0..2 become null."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = loops.score(docs, lambda pdf: pdf["text"].map(lambda t: None if t is None else len(t) % 3), "double", "raw", retries=2)
    return scored.select("doc_id", loops.tier_or_null(c("raw")).cast("bigint").alias("tier"))


@query(f"WITH t AS (SELECT c_custkey AS n FROM customer) SELECT n, greatest(405, 3 * ceil(n / 4)::INT) AS steps, least(700, greatest(120, n // 2)) AS bounded FROM t")
def iteration_formulas(spark, d):
    n = table(spark, d, "customer").select(c("c_custkey").alias("n"))
    return n.select("n", V.iteration_count(c("n"), 4, 3, 405).alias("steps"), V.bounded_half(c("n"), 120, 700).alias("bounded"))




@query(f"""{WITH_PREDS} SELECT p.id, r.model, CASE r.kind WHEN 'local' THEN p.pred WHEN 'gateway' THEN coalesce(p.pred, 'unknown') ELSE CASE WHEN p.pred = 'adequate' THEN p.pred ELSE 'rewritten' END END AS output
FROM preds p JOIN (SELECT unnest(['m1', 'm2', 'm3']) AS model, unnest(['local', 'gateway', 'pipeline']) AS kind) r USING (model)""")
def registry_dispatch(spark, d):
    """Recorded outputs by the kind of their model: as they are, with a default, or through a second step."""
    registry = spark.createDataFrame([("m1", "local"), ("m2", "gateway"), ("m3", "pipeline")], "model string, kind string")
    recorded = predictions(spark, d).select("id", c("model").alias("_m"), "pred")
    items = gold(spark, d).select("id")
    outputs = lambda t: t.join(recorded, (t["id"] == recorded["id"]) & (t["model"] == recorded["_m"])).select(t["id"], "model", "pred")
    return loops.dispatch(items, registry, "kind", {
        "local": lambda t: outputs(t).withColumnRenamed("pred", "output"),
        "gateway": lambda t: outputs(t).select("id", "model", F.coalesce("pred", F.lit("unknown")).alias("output")),
        "pipeline": lambda t: outputs(t).select("id", "model", F.when(c("pred") == "adequate", c("pred")).otherwise("rewritten").alias("output")),
    })
