"""Joins and bag operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, joins
from ..operators.sampling import ordered_positions, ranked
from ..session import table
from .catalog import GOLD, MODELS, WITH_PREDS, gold, predictions, query, sql_hash, sql_norm, sql_strip
from .text_queries import _REC, _records

c = F.col


@query(f"WITH {GOLD} SELECT DISTINCT h.id, h.decision, h.source, b.slice, b.id IS NULL AS context_missing FROM human_boundary h LEFT JOIN (SELECT id, min(slice) AS slice FROM v1_b WHERE verdict <> 'adequate' GROUP BY id) b ON b.id = h.id")
def context_lookup(spark, d):
    b = table(spark, d, "v1_b").where("verdict <> 'adequate'").groupBy("id").agg(F.min("slice").alias("slice"))
    return joins.lookup(table(spark, d, "human_boundary").select("id", "decision", "source").distinct(), b, "id", ["slice"])


@query(f"{WITH_PREDS} SELECT id, model, gold, pred FROM preds WHERE pred IS NOT NULL AND gold IS NOT NULL")
def gold_predictions(spark, d):
    return predictions(spark, d).where("pred is not null and gold is not null").select("id", "model", "gold", "pred")


@query(f"{WITH_PREDS} SELECT g.id, g.gold, p.pred, p.pred IS NOT DISTINCT FROM g.gold AS correct FROM gold g LEFT JOIN (SELECT * FROM preds WHERE model = 'm1' AND h % 7 <> 0) p USING (id)")
def gold_left_predictions(spark, d):
    p = predictions(spark, d).where((c("model") == "m1") & (c("h") % 7 != 0)).select("id", "pred")
    return gold(spark, d).select("id", "gold").join(p, "id", "left").select("id", "gold", "pred", c("pred").eqNullSafe(c("gold")).alias("correct"))


@query("SELECT count(*) AS n FROM (SELECT id FROM v1_b INTERSECT SELECT id FROM human_boundary INTERSECT SELECT id FROM train_flagged)")
def three_way_intersection(spark, d):
    ids = [table(spark, d, t).select("id") for t in ("v1_b", "human_boundary", "train_flagged")]
    return ids[0].intersect(ids[1]).intersect(ids[2]).agg(F.count("*").alias("n"))


@query(f"{WITH_PREDS} SELECT a.id, a.gold, a.pred AS first, b.pred AS second FROM preds a JOIN preds b USING (id) WHERE a.model = 'm1' AND b.model = 'm2' AND a.pred <> b.pred")
def version_disagreements(spark, d):
    p = predictions(spark, d)
    a = p.where("model = 'm1'").select("id", "gold", c("pred").alias("first"))
    return a.join(p.where("model = 'm2'").select("id", c("pred").alias("second")), "id").where("first <> second")


@query(f"{WITH_PREDS}, s AS (SELECT id, model, CASE WHEN pred = gold THEN 2 WHEN pred IS NULL THEN NULL ELSE 0 END AS v FROM preds) SELECT a.id, b.v - a.v AS diff FROM s a JOIN s b USING (id) WHERE a.model = 'm1' AND b.model = 'm2' AND a.v IS NOT NULL AND b.v IS NOT NULL")
def paired_differences(spark, d):
    s = predictions(spark, d).select("id", "model", F.when(c("pred") == c("gold"), 2).when(c("pred").isNull(), None).otherwise(0).alias("v")).where("v is not null")
    a, b = s.where("model = 'm1'").select("id", c("v").alias("a")), s.where("model = 'm2'").select("id", c("v").alias("b"))
    return a.join(b, "id").select("id", (c("b") - c("a")).alias("diff"))


@query("SELECT DISTINCT id, verdict FROM v1_b WHERE id IN (SELECT id FROM human_boundary WHERE decision = 'approve')")
def kept_ids(spark, d):
    approved = table(spark, d, "human_boundary").where("decision = 'approve'").select("id")
    return table(spark, d, "v1_b").join(approved, "id", "left_semi").select("id", "verdict").distinct()


@query("SELECT DISTINCT id, verdict FROM v1_b WHERE NOT EXISTS (SELECT 1 FROM human_boundary h WHERE h.id = v1_b.id AND decision IS NOT NULL)")
def unreviewed_ids(spark, d):
    done = table(spark, d, "human_boundary").where("decision is not null").select("id")
    return table(spark, d, "v1_b").join(done, "id", "left_anti").select("id", "verdict").distinct()


@query(f"WITH {_REC} SELECT id FROM r WHERE id NOT IN (SELECT id FROM train_flagged) AND {sql_norm('candidate_message')} NOT IN (SELECT {sql_norm('candidate_message')} FROM v1_test)")
def excluded_by_id_or_text(spark, d):
    flagged = table(spark, d, "train_flagged").select("id", F.lit(None).cast("string").alias("candidate_message"))
    tests = table(spark, d, "v1_test").select(F.lit(None).cast("string").alias("id"), "candidate_message")
    ids, texts = flagged.select("id").distinct(), tests.select(T.normalize(c("candidate_message")).alias("_t")).distinct()
    kept = _records(spark, d).join(ids, "id", "left_anti")
    return kept.join(texts, T.normalize(kept["candidate_message"]) == c("_t"), "left_anti").select("id")


@query(f"WITH {_REC} SELECT id FROM r WHERE id NOT IN (SELECT id FROM v1_test) AND {sql_norm('candidate_message')} NOT IN (SELECT {sql_norm('candidate_message')} FROM v1_test)")
def disjunctive_exclusion(spark, d):
    return dedup.excluded_by_either(_records(spark, d).select("id", "candidate_message"), table(spark, d, "v1_test"), "id", "candidate_message").select("id")


@query(f"WITH {_REC} SELECT id FROM r WHERE NOT EXISTS (SELECT 1 FROM gives_away_probe p WHERE {sql_strip('p.candidate_message')} = {sql_strip('r.candidate_message')})")
def exact_text_exclusion(spark, d):
    probes = table(spark, d, "gives_away_probe").select(T.strip(c("candidate_message")).alias("t")).where("t is not null").distinct()
    return _records(spark, d).withColumn("t", T.strip(c("candidate_message"))).join(probes, "t", "left_anti").select("id")


@query("SELECT DISTINCT p.id, d.doc_id FROM gives_away_probe p JOIN documents d ON contains(d.text, p.problem)")
def contained_probe_texts(spark, d):
    probes, docs = table(spark, d, "gives_away_probe"), table(spark, d, "documents")
    return dedup.contained_texts(probes, docs, "id", "problem", "doc_id", "text")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM gives_away_probe p WHERE contains(d.text, p.problem) OR contains(d.text, p.candidate_message))")
def decontaminated_documents(spark, d):
    probes, docs = table(spark, d, "gives_away_probe"), table(spark, d, "documents")
    both = probes.select("id", F.explode(F.array("problem", "candidate_message")).alias("t"))
    dirty = dedup.contained_texts(both, docs, "id", "t", "doc_id", "text").select("doc_id").distinct()
    return docs.select("doc_id").join(dirty, "doc_id", "left_anti")


_CONV = "regexp_extract(id, '^mrb-(.*)-[^-]*$', 1)"


@query(f"SELECT DISTINCT id FROM v1_b WHERE {_CONV} <> '' AND {_CONV} NOT IN (SELECT {_CONV} FROM human_boundary)")
def conversation_exclusion(spark, d):
    seen = table(spark, d, "human_boundary").select(T.conversation_of(c("id")).alias("conv")).distinct()
    rows = table(spark, d, "v1_b").select("id", T.conversation_of(c("id")).alias("conv")).where("conv <> ''").distinct()
    return rows.join(seen, "conv", "left_anti").select("id")


@query(f"SELECT DISTINCT id, CASE WHEN id LIKE '%-Novice' THEN 'novice' WHEN {_CONV} <> '' AND EXISTS (SELECT 1 FROM human_boundary h WHERE starts_with({_CONV.replace('(id', '(h.id')}, {_CONV.replace('(id', '(v1_b.id')})) THEN 'prefix' ELSE 'other' END AS kind FROM v1_b")
def prefix_classes(spark, d):
    """The conversation of an id, whole, against every prefix of the known conversations."""
    conv = T.conversation_of(c("id"))
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("conv")), lambda n: F.substring(c("conv"), F.lit(1), n)))
    known = table(spark, d, "human_boundary").select(conv.alias("conv")).where("conv <> ''").distinct().select(prefixes.alias("k")).distinct().withColumn("known", F.lit(True))
    rows = table(spark, d, "v1_b").select("id", F.nullif(conv, F.lit("")).alias("k")).distinct()
    kind = F.when(F.endswith("id", F.lit("-Novice")), "novice").when(F.coalesce("known", F.lit(False)), "prefix").otherwise("other")
    return rows.join(known, "k", "left").select("id", kind.alias("kind"))


@query(f"""WITH m AS (SELECT DISTINCT id, {_CONV} AS conv, verdict, id LIKE '%-Expert' AS expert FROM v1_b WHERE {_CONV} <> ''),
p AS (SELECT a.id, b.id AS sib, row_number() OVER (PARTITION BY a.id ORDER BY b.expert DESC, b.id) AS rn FROM m a JOIN m b ON a.conv = b.conv AND a.id <> b.id AND b.verdict = 'adequate')
SELECT m.id, p.sib AS sibling FROM m LEFT JOIN p ON p.id = m.id AND rn = 1""")
def sibling_picks(spark, d):
    m = table(spark, d, "v1_b").select("id", T.conversation_of(c("id")).alias("conv"), "verdict", F.endswith("id", F.lit("-Expert")).alias("expert")).where("conv <> ''").distinct()
    return joins.sibling_pick(m, "conv", "id", c("expert"), c("verdict") == "adequate", [c("id")]).select("id", "sibling")


@query("""WITH h AS (SELECT * FROM (SELECT id, safe_rewrite, row_number() OVER (PARTITION BY id ORDER BY ts DESC, decision) AS rn FROM human_boundary WHERE decision IN ('approve', 'edit_safe')) WHERE rn = 1)
SELECT DISTINCT b.id, coalesce(nullif(h.safe_rewrite, ''), nullif(b.rewritten_message, ''), '') AS rewrite, h.id IS NOT NULL AS human FROM v1_b b LEFT JOIN h USING (id)""")
def human_over_synthetic(spark, d):
    h = ranked(table(spark, d, "human_boundary").where(c("decision").isin("approve", "edit_safe")), ["id"], [c("ts").desc(), c("decision")]).where("rn = 1").select("id", "safe_rewrite", F.lit(True).alias("human"))
    b = table(spark, d, "v1_b").select("id", "rewritten_message").distinct().join(h, "id", "left")
    return b.select("id", T.first_truthy(c("safe_rewrite"), c("rewritten_message")).alias("rewrite"), F.coalesce("human", F.lit(False)).alias("human"))


@query(f"WITH {GOLD} SELECT id, model FROM gold CROSS JOIN (SELECT unnest({MODELS}) AS model)")
def item_model_tasks(spark, d):
    """One task per item and model of a short fixed list."""
    return gold(spark, d).select("id", F.explode(F.array(*map(F.lit, MODELS))).alias("model"))


@query("SELECT DISTINCT b.id, coalesce(nullif(h.safe, ''), b.reasoning, '') AS trace FROM v1_b b LEFT JOIN (SELECT id, min(safe_rewrite) AS safe FROM human_boundary GROUP BY id) h USING (id)")
def trace_with_fallback(spark, d):
    h = table(spark, d, "human_boundary").groupBy("id").agg(F.min("safe_rewrite").alias("safe"))
    return table(spark, d, "v1_b").select("id", "reasoning").distinct().join(h, "id", "left").select("id", T.first_truthy(c("safe"), c("reasoning")).alias("trace"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents), b AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events) SELECT doc_id, event_id, event_type FROM a LEFT JOIN b USING (n)")
def joined_by_ordinal(spark, d):
    a = ordered_positions(table(spark, d, "documents").select("doc_id"), [c("doc_id")], "n")
    b = ordered_positions(table(spark, d, "events").select("event_id", "event_type"), [c("event_id")], "n")
    return a.join(b, "n", "left").select("doc_id", "event_id", "event_type")


@query(f"{WITH_PREDS}, s AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(chr(39) + '0' + chr(39), 'id')}, id) AS rn FROM gold), k AS (SELECT s.id FROM s JOIN preds p USING (id) WHERE rn <= 150 AND p.model = 'm1' AND p.pred IN ('adequate', 'gives_final_answer', 'gives_away_key_step', 'mismatched_calibration', 'vague_unhelpful') AND p.pred <> p.gold) SELECT id, gold FROM gold WHERE id NOT IN (SELECT id FROM k)")
def disagreement_prune(spark, d):
    """Of 150 checked records those with another valid label are dropped; the rest stay."""
    from ..functions.verdicts import is_valid

    p = predictions(spark, d).where("model = 'm1'")
    checked = p.withColumn("_h", T.portable_hash("0", c("id"))).orderBy("_h", "id").limit(150)
    drop = checked.where(is_valid(c("pred")) & (c("pred") != c("gold"))).select("id")
    return gold(spark, d).select("id", "gold").join(drop, "id", "left_anti")


@query(f"{WITH_PREDS} SELECT id, model AS tag, pred FROM preds WHERE model IN ('m1', 'm2') UNION ALL SELECT id, 'new', pred FROM preds WHERE model = 'm3'")
def merged_result_columns(spark, d):
    p = predictions(spark, d)
    return p.where(c("model").isin("m1", "m2")).select("id", c("model").alias("tag"), "pred").unionByName(p.where("model = 'm3'").select("id", F.lit("new").alias("tag"), "pred"))


@query(f"{WITH_PREDS} SELECT count(*) = 0 AS complete, count(*) AS n_missing FROM gold WHERE id NOT IN (SELECT id FROM preds WHERE model = 'm1' AND pred IS NOT NULL)")
def all_ids_present(spark, d):
    return joins.all_present(gold(spark, d).select("id"), predictions(spark, d).where("model = 'm1' and pred is not null"), "id")


@query("SELECT id, slice, NULL AS source FROM v1_test UNION ALL SELECT id, slice, source FROM gives_away_probe")
def appended_tables(spark, d):
    a, b = table(spark, d, "v1_test").select("id", "slice"), table(spark, d, "gives_away_probe").select("id", "slice", "source")
    return a.unionByName(b, allowMissingColumns=True)


@query(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {sql_norm('candidate_message')}, {sql_norm('problem')} ORDER BY id) AS rn FROM v1_b) WHERE rn = 1")
def normalized_key_distinct(spark, d):
    df = table(spark, d, "v1_b").select("id", T.normalize(c("candidate_message")).alias("m"), T.normalize(c("problem")).alias("p"))
    return df.groupBy("m", "p").agg(F.min("id").alias("id")).select("id")


@query("SELECT id FROM human_boundary EXCEPT SELECT id FROM train_flagged")
def id_set_difference(spark, d):
    return table(spark, d, "human_boundary").select("id").subtract(table(spark, d, "train_flagged").select("id"))


@query("SELECT DISTINCT id, copy FROM human_boundary, (SELECT unnest([1, 2, 3]) AS copy) WHERE safe_rewrite IS NOT NULL")
def replicated_rows(spark, d):
    return table(spark, d, "human_boundary").where("safe_rewrite is not null").select("id").distinct().select("id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("copy"))


@query("SELECT DISTINCT id || '-leaky' AS id, leaky_candidate AS message, 'gives_away_key_step' AS verdict FROM human_boundary UNION SELECT DISTINCT id || '-safe', safe_rewrite, 'adequate' FROM human_boundary")
def pair_expansion(spark, d):
    row = lambda tag, text, v: F.struct(F.concat("id", F.lit(tag)).alias("id"), c(text).alias("message"), F.lit(v).alias("verdict"))
    pairs = F.array(row("-leaky", "leaky_candidate", "gives_away_key_step"), row("-safe", "safe_rewrite", "adequate"))
    return table(spark, d, "human_boundary").select(F.explode(pairs).alias("x")).select("x.*").distinct()


@query("SELECT id, min(candidate_message) AS candidate_message FROM (SELECT id, candidate_message FROM v1_b UNION ALL SELECT id, candidate_message FROM v1_test UNION ALL SELECT id, candidate_message FROM gives_away_probe) GROUP BY id")
def corpus_union(spark, d):
    parts = [table(spark, d, t).select("id", "candidate_message") for t in ("v1_b", "v1_test", "gives_away_probe")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(F.min("candidate_message").alias("candidate_message"))


@query(f"""{WITH_PREDS}, w AS (SELECT id, max(CASE WHEN model = 'm1' THEN pred END) AS a, max(CASE WHEN model = 'm2' THEN pred END) AS b FROM preds GROUP BY id)
SELECT id FROM w WHERE a IN ('gives_final_answer', 'gives_away_key_step') AND b IN ('gives_final_answer', 'gives_away_key_step')""")
def dual_arbiter_pairs(spark, d):
    from ..functions.verdicts import is_leak

    w = predictions(spark, d).groupBy("id").agg(F.max(F.when(c("model") == "m1", c("pred"))).alias("a"), F.max(F.when(c("model") == "m2", c("pred"))).alias("b"))
    return w.where(is_leak(c("a")) & is_leak(c("b"))).select("id")


@query(f"{WITH_PREDS}, w AS (SELECT id, gold, max(CASE WHEN model = 'm1' THEN pred END) AS g, max(CASE WHEN model = 'm2' THEN pred END) AS v FROM preds GROUP BY id, gold) SELECT id, CASE WHEN g IS NOT NULL AND g <> gold AND v = g THEN g ELSE gold END AS label FROM w")
def confirmed_flips(spark, d):
    w = predictions(spark, d).groupBy("id", "gold").agg(F.max(F.when(c("model") == "m1", c("pred"))).alias("g"), F.max(F.when(c("model") == "m2", c("pred"))).alias("v"))
    return w.select("id", F.when(c("g").isNotNull() & (c("g") != c("gold")) & c("v").eqNullSafe(c("g")), c("g")).otherwise(c("gold")).alias("label"))


@query(f"{WITH_PREDS} SELECT id, CASE WHEN gold NOT IN ('gives_final_answer', 'gives_away_key_step') AND pred IS NOT NULL THEN pred ELSE gold END AS label FROM preds WHERE model = 'm1'")
def quality_axis_relabel(spark, d):
    from ..functions.verdicts import LEAKS

    p = predictions(spark, d).where("model = 'm1'")
    return p.select("id", F.when(~c("gold").isin(LEAKS) & c("pred").isNotNull(), c("pred")).otherwise(c("gold")).alias("label"))


@query("SELECT DISTINCT h.id, h.decision FROM human_boundary h JOIN (SELECT DISTINCT id FROM v1_b) b USING (id) WHERE h.decision <> 'skip'")
def reviewed_records(spark, d):
    h = table(spark, d, "human_boundary").where("decision <> 'skip'").select("id", "decision")
    return h.join(table(spark, d, "v1_b").select("id"), "id", "left_semi").distinct()
