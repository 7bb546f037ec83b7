"""Distributions, metrics, tiers, intervals and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T, verdicts as V
from ..operators import metrics as M
from ..session import table
from .catalog import GOLD, LEAK_LIST, VERDICT_LIST, WITH_PREDS, gold, predictions, query, sql_hash
from .text_queries import FEATURES_SQL, _REC, _records, features

c = F.col
_PL, _GL = f"coalesce(pred IN {LEAK_LIST}, false)", f"coalesce(gold IN {LEAK_LIST}, false)"
_FAM = lambda x: f"CASE WHEN {x} IN {LEAK_LIST} THEN 'leak' WHEN list_contains({VERDICT_LIST}, {x}) THEN 'nonleak' ELSE 'invalid' END"
_TIER = f"CASE WHEN list_contains({VERDICT_LIST}, gold) AND pred = gold THEN 2 WHEN {_FAM('pred')} <> 'invalid' AND {_FAM('pred')} = {_FAM('gold')} THEN 1 ELSE 0 END"
_BIN = lambda x: f"CASE WHEN {x} IN {LEAK_LIST} THEN 'leak' WHEN {x} <> '' THEN 'safe' END"
_TRI = lambda x: f"CASE WHEN {x} IN {LEAK_LIST} THEN {x} WHEN {x} <> '' THEN 'safe' END"


@query("SELECT coalesce(slice, '?') AS slice, count(*) AS n FROM v1_b GROUP BY ALL")
def slice_distribution(spark, d):
    return M.distribution(table(spark, d, "v1_b"), c("slice"), "slice", "?")


_AXES = ["band", "topic", "length", "turns", "numbers"]


@query(f"WITH {_REC}, f AS (SELECT {FEATURES_SQL} FROM r) " + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS value, count(*) AS n FROM f GROUP BY {a}" for a in _AXES))
def axis_marginals(spark, d):
    return M.axis_marginals(features(_records(spark, d)), _AXES)


@query("SELECT id, count(*) AS n FROM v1_b GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "v1_b").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""{WITH_PREDS}, b AS (SELECT gold AS v, count(*) AS before FROM gold GROUP BY gold), a AS (SELECT coalesce(pred, gold) AS v, count(*) AS after FROM preds WHERE model = 'm1' GROUP BY ALL)
SELECT coalesce(b.v, a.v) AS verdict, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM b FULL JOIN a USING (v)""")
def before_after_delta(spark, d):
    p = predictions(spark, d).where("model = 'm1'")
    pairs = F.array(F.struct(c("gold").alias("verdict"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.coalesce("pred", "gold").alias("verdict"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    s = p.select(F.explode(pairs).alias("x")).groupBy("x.verdict").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))
    return s.withColumn("delta", c("after") - c("before"))


@query(f"{WITH_PREDS} SELECT gold AS old, pred AS new, count(*) AS n FROM preds WHERE model = 'm1' AND pred <> gold GROUP BY ALL")
def transitions(spark, d):
    p = predictions(spark, d).where("model = 'm1' and pred <> gold")
    return p.groupBy(c("gold").alias("old"), c("pred").alias("new")).agg(F.count("*").alias("n"))


@query(f"""{WITH_PREDS} SELECT model, count(*) AS n, count(*) FILTER (WHERE pred = gold) / count(*) AS accuracy, count(*) FILTER (WHERE list_contains({VERDICT_LIST}, pred)) / count(*) AS valid_rate,
CASE WHEN count(*) FILTER (WHERE slice = 'calibration_adversarial') > 0 THEN count(*) FILTER (WHERE slice = 'calibration_adversarial' AND pred IS NOT DISTINCT FROM gold) / count(*) FILTER (WHERE slice = 'calibration_adversarial') END AS calibration,
CASE WHEN count(*) FILTER (WHERE pred <> 'adequate') > 0 THEN count(*) FILTER (WHERE pred <> 'adequate' AND gold <> 'adequate') / count(*) FILTER (WHERE pred <> 'adequate') END AS flag_precision FROM preds GROUP BY model""")
def one_pass_metrics(spark, d):
    adv = c("slice") == "calibration_adversarial"
    w, n = M.count_where, F.count("*")
    return predictions(spark, d).groupBy("model").agg(
        n.alias("n"), (w(c("pred") == c("gold")) / n).alias("accuracy"), (w(V.is_valid(c("pred"))) / n).alias("valid_rate"),
        F.try_divide(w(adv & c("pred").eqNullSafe(c("gold"))), w(adv)).alias("calibration"),
        F.try_divide(w((c("pred") != "adequate") & (c("gold") != "adequate")), w(c("pred") != "adequate")).alias("flag_precision"),
    )


@query(f"""{WITH_PREDS} SELECT m.model, g.v AS gold, p.v AS pred, coalesce(n, 0) AS n FROM (SELECT DISTINCT model FROM preds) m CROSS JOIN (SELECT unnest({VERDICT_LIST}) AS v) g CROSS JOIN (SELECT unnest({VERDICT_LIST}) AS v) p
LEFT JOIN (SELECT model, gold, pred, count(*) AS n FROM preds GROUP BY ALL) k ON k.model = m.model AND k.gold = g.v AND k.pred = p.v""")
def confusion_dense(spark, d):
    return M.dense_confusion(predictions(spark, d), ["model"])


_LEAK_SQL = f"""l AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE {_GL} AND {_PL}) AS tp, count(*) FILTER (WHERE NOT {_GL} AND {_PL}) AS fp, count(*) FILTER (WHERE {_GL} AND NOT {_PL}) AS fn,
count(*) FILTER (WHERE {_GL} = {_PL}) AS same, count(*) FILTER (WHERE pred IS NOT DISTINCT FROM gold) AS exact, count(*) FILTER (WHERE list_contains({VERDICT_LIST}, pred)) AS parsed FROM preds GROUP BY model)"""
_DIV = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END"
_LEAK_COLS = f"n, tp, fp, fn, {_DIV('tp', 'tp + fp')} AS precision, {_DIV('tp', 'tp + fn')} AS recall, {_DIV('2 * tp', '2 * tp + fp + fn')} AS f1, same / n AS binary_accuracy, exact / n AS accuracy, parsed / n AS parse_rate"


@query(f"{WITH_PREDS}, {_LEAK_SQL} SELECT model, {_LEAK_COLS} FROM l")
def binary_prf(spark, d):
    return M.leak_metrics(predictions(spark, d), ["model"])


@query(f"""{WITH_PREDS}, l AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE pred IS NOT DISTINCT FROM gold) AS v5, count(*) FILTER (WHERE ({_TRI('pred')}) IS NOT DISTINCT FROM ({_TRI('gold')})) AS v3,
count(*) FILTER (WHERE ({_BIN('pred')}) IS NOT DISTINCT FROM ({_BIN('gold')})) AS v2, count(*) FILTER (WHERE ({_BIN('gold')}) = 'leak' AND ({_BIN('pred')}) = 'leak') AS tp, count(*) FILTER (WHERE ({_BIN('gold')}) = 'safe' AND ({_BIN('pred')}) = 'leak') AS fp,
count(*) FILTER (WHERE ({_BIN('gold')}) = 'leak' AND ({_BIN('pred')}) IS DISTINCT FROM 'leak') AS fn FROM preds GROUP BY model) SELECT model, n, v5 / n AS five_way, v3 / n AS three_way, v2 / n AS two_way, {_DIV('tp', 'tp + fp')} AS precision, {_DIV('tp', 'tp + fn')} AS recall FROM l""")
def rescored_three_way(spark, d):
    return M.rescored_metrics(predictions(spark, d), ["model"])


@query(f"{WITH_PREDS} SELECT model, count(*) FILTER (WHERE {_GL} = {_PL}) / count(*) AS null_is_safe, count(*) FILTER (WHERE ({_BIN('pred')}) IS NOT DISTINCT FROM ({_BIN('gold')})) / count(*) AS null_is_wrong FROM preds GROUP BY model")
def null_prediction_views(spark, d):
    """The two readings of a null prediction side by side."""
    p, n = predictions(spark, d), F.count("*")
    return p.groupBy("model").agg((M.count_where(V.is_leak(c("gold")) == V.is_leak(c("pred"))) / n).alias("null_is_safe"), (M.count_where(V.binary(c("pred")).eqNullSafe(V.binary(c("gold")))) / n).alias("null_is_wrong"))


@query(f"{WITH_PREDS} SELECT id, model, {_TIER} AS tier FROM preds")
def verdict_tiers(spark, d):
    return predictions(spark, d).select("id", "model", V.verdict_tier(c("gold"), c("pred")).alias("tier"))


@query(f"{WITH_PREDS}, t AS (SELECT model, CASE WHEN h % 11 = 0 THEN NULL ELSE {_TIER} END AS tier FROM preds) SELECT model, count(*) FILTER (WHERE tier = 0) AS n0, count(*) FILTER (WHERE tier = 1) AS n1, count(*) FILTER (WHERE tier = 2) AS n2, count(*) FILTER (WHERE tier IS NULL) AS n_missing, sum(tier) / count(tier) AS mean FROM t GROUP BY model")
def tier_breakdown(spark, d):
    p = predictions(spark, d).withColumn("tier", F.when(c("h") % 11 != 0, V.verdict_tier(c("gold"), c("pred"))))
    return M.tier_breakdown(p, ["model"], "tier")


_CRIT = f"t AS (SELECT model, {_TIER} AS verdict, CASE WHEN h % 2 = 0 THEN 2 ELSE 1 END AS schema, (h % 3)::INT AS grounded, CASE WHEN gold <> 'adequate' THEN (h // 5 % 3)::INT END AS rewrite FROM preds), u AS (UNPIVOT t ON verdict, schema, grounded, rewrite INTO NAME criterion VALUE tier), m AS (SELECT model, criterion, sum(tier) / count(tier) AS mean FROM u GROUP BY ALL)"


def criteria(spark, d):
    """(id, model, criterion, tier) in long form."""
    p = predictions(spark, d)
    tiers = {"verdict": V.verdict_tier(c("gold"), c("pred")), "schema": F.when(c("h") % 2 == 0, 2).otherwise(1), "grounded": (c("h") % 3).cast("int"), "rewrite": F.when(c("gold") != "adequate", (F.floor(c("h") / 5) % 3).cast("int"))}
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("criterion"), v.alias("tier")) for i, (k, v) in enumerate(tiers.items())))
    return p.select("id", "model", F.explode(pairs).alias("x")).select("id", "model", "x.*")


@query(f"{WITH_PREDS}, {_CRIT} SELECT model, CASE WHEN criterion IN ('verdict', 'schema') THEN 'adherence' ELSE 'quality' END AS dimension, CASE WHEN count(*) = 2 THEN (max(mean) + min(mean)) / 2 ELSE max(mean) END AS score FROM m GROUP BY ALL")
def dimension_rollup(spark, d):
    """Criterion means averaged into dimensions; criteria without a mean are skipped."""
    m = criteria(spark, d).groupBy("model", "criterion").agg(F.try_divide(F.sum("tier"), F.count("tier")).alias("mean")).where("mean is not null")
    dim = F.when(c("criterion").isin("verdict", "schema"), "adherence").otherwise("quality")
    return m.groupBy("model", dim.alias("dimension")).agg(((F.max("mean") + F.min("mean")) / 2).alias("score"))


@query(f"{WITH_PREDS}, {_CRIT} SELECT model, arg_min(criterion, mean) AS weakest, min(mean) AS mean FROM m GROUP BY model")
def weakest_criterion(spark, d):
    m = criteria(spark, d).groupBy("model", "criterion", "ord").agg(F.try_divide(F.sum("tier"), F.count("tier")).alias("mean")).where("mean is not null")
    return m.groupBy("model").agg(F.min(F.struct("mean", "ord", "criterion")).alias("x")).select("model", c("x.criterion").alias("weakest"), "x.mean")


@query(f"{WITH_PREDS}, {_CRIT}, k AS (SELECT model, criterion, sum(tier) / count(tier) AS mean, count(*) FILTER (WHERE tier = 0) AS n0, count(*) FILTER (WHERE tier = 1) AS n1 FROM u GROUP BY ALL) SELECT * FROM k WHERE mean < 2")
def weak_cells(spark, d):
    k = criteria(spark, d).groupBy("model", "criterion").agg(F.try_divide(F.sum("tier"), F.count("tier")).alias("mean"), M.count_where(c("tier") == 0).alias("n0"), M.count_where(c("tier") == 1).alias("n1"))
    return k.where("mean < 2")


_PAIR = r"coalesce(nullif(regexp_extract(id, '^(.*-adv-\d+)[a-z]?$', 1), ''), id)"
_BPRED = f"b AS (SELECT id, min(verdict) AS gold, {sql_hash('id', chr(39) + 'q' + chr(39))} AS h FROM v1_b GROUP BY id), q AS (SELECT id, gold, CASE WHEN h % 10 < 6 THEN gold WHEN h % 10 = 6 THEN NULL ELSE {VERDICT_LIST}[(h // 100) % 5 + 1] END AS pred FROM b)"


def record_predictions(spark, d):
    """A prediction for every training record, a fixed function of its id."""
    b = table(spark, d, "v1_b").groupBy("id").agg(F.min("verdict").alias("gold")).withColumn("h", T.portable_hash(c("id"), "q"))
    other = F.element_at(F.array(*map(F.lit, V.VERDICTS)), (F.floor(c("h") / 100) % 5 + 1).cast("int"))
    return b.withColumn("pred", F.when(c("h") % 10 < 6, c("gold")).when(c("h") % 10 == 6, None).otherwise(other))


@query(f"WITH {_BPRED}, g AS (SELECT {_PAIR} AS pair, count(*) AS members, count(*) FILTER (WHERE pred IS NOT DISTINCT FROM gold) AS r, count(DISTINCT coalesce(pred, '-')) AS kinds FROM q GROUP BY ALL) SELECT pair, members, CASE WHEN r = members THEN 2 WHEN members = 1 THEN 0 WHEN kinds = 1 THEN 0 WHEN r > 0 THEN 1 ELSE 0 END AS tier FROM g")
def calibration_pairs(spark, d):
    return M.pair_calibration(record_predictions(spark, d), T.pair_key(c("id")))


#: Resamples of a report and of a decision in the loop.
REPORT_B, LOOP_B = 4000, 2000


def _bootstrap_sql(rows: str, values: list[int], b: int) -> str:
    """CTEs ``ci(mean, low, high, n)`` of ``s`` (v): per value a binomial number by its distribution function."""
    cells = ", ".join(f"count(*) FILTER (WHERE v = {v}) AS c{i}" for i, v in enumerate(values))
    present = " + ".join(f"(c{i} > 0)::INT" for i in range(len(values)))
    out = f"{rows}, cnt AS (SELECT count(*) AS n, sum(v)::DOUBLE AS t, {cells} FROM s WHERE v IS NOT NULL), r0 AS (SELECT unnest(range({b})) AS b, n, n AS rem, n AS rest, 0 AS t, 0 AS j FROM cnt)"
    for i, v in enumerate(values):
        out += f""", q{i} AS (SELECT r.b, r.n, r.rem, r.rest, r.t, r.j + (c{i} > 0)::INT AS j, c{i} AS c, c{i} / r.rest AS p, ({present}) AS kinds, ({sql_hash("'0'", "r.b", f"(r.j + (c{i} > 0)::INT)")} + 0.5::DOUBLE) / 4294967296 AS u FROM r{i} r, cnt),
w{i} AS (SELECT b, u, unnest(range(greatest(0, floor(rem * p - 10 * sqrt(rem * p * (1 - p)) - 2))::BIGINT, least(rem, ceil(rem * p + 10 * sqrt(rem * p * (1 - p)) + 2))::BIGINT + 1)) AS k, rem, p FROM q{i} WHERE p > 0 AND p < 1 AND rem > 0),
d{i} AS (SELECT b, u, k, sum(exp(lgamma(rem + 1) - lgamma(k + 1) - lgamma(rem - k + 1) + k * ln(p) + (rem - k) * ln(1 - p))) OVER (PARTITION BY b ORDER BY k) AS cdf FROM w{i}),
k{i} AS (SELECT b, min(k) FILTER (WHERE cdf >= u) AS k FROM d{i} GROUP BY b),
r{i + 1} AS (SELECT b, n, rem - x AS rem, rest - c AS rest, t + x * ({v}) AS t, j FROM (SELECT q.*, CASE WHEN c = 0 OR rem <= 0 THEN 0 WHEN p >= 1 THEN rem ELSE k.k END AS x FROM q{i} q LEFT JOIN k{i} k USING (b)))"""
    low, high = int(0.025 * b) + 1, int(0.975 * b) + 1
    return out + f""", o AS (SELECT t::DOUBLE / n AS m, row_number() OVER (ORDER BY t) AS rn FROM r{len(values)}),
ci AS (SELECT (SELECT t / n FROM cnt) AS mean, max(m) FILTER (WHERE rn = {low}) AS low, max(m) FILTER (WHERE rn = {high}) AS high, (SELECT n FROM cnt) AS n FROM o)"""


_HIT_CI = _bootstrap_sql("s AS (SELECT CASE WHEN pred = gold THEN 1 ELSE 0 END AS v FROM preds WHERE model = 'm1')", [0, 1], REPORT_B)
_DIFF_CI = _bootstrap_sql(f"x AS (SELECT id, max(CASE WHEN model = 'm1' THEN {_TIER} END) AS a, max(CASE WHEN model = 'm2' THEN {_TIER} END) AS b FROM preds GROUP BY id), s AS (SELECT b - a AS v FROM x)", [-2, -1, 0, 1, 2], LOOP_B)


@query(f"{WITH_PREDS}, {_HIT_CI} SELECT mean, low, high, n FROM ci")
def bootstrap_ci(spark, d):
    p = predictions(spark, d).where("model = 'm1'")
    counts = p.groupBy(F.coalesce((c("pred") == c("gold")).cast("int"), F.lit(0)).alias("v")).agg(F.count("*").alias("n"))
    return M.bootstrap_interval(counts, "v", REPORT_B, "0")


def _diff_counts(spark, d):
    s = predictions(spark, d).withColumn("t", V.verdict_tier(c("gold"), c("pred")))
    w = s.groupBy("id").agg(F.max(F.when(c("model") == "m1", c("t"))).alias("a"), F.max(F.when(c("model") == "m2", c("t"))).alias("b"))
    return w.groupBy((c("b") - c("a")).alias("v")).agg(F.count("*").alias("n"))


@query(f"{WITH_PREDS}, {_DIFF_CI} SELECT mean, low, high, n FROM ci")
def paired_bootstrap(spark, d):
    return M.bootstrap_interval(_diff_counts(spark, d), "v", LOOP_B, "0")


@query(f"{WITH_PREDS}, {_DIFF_CI} SELECT low > 0 AS improved, high < 0 AS regressed, low > 0 AND NOT high < 0 AS accepted FROM ci")
def accept_decision(spark, d):
    """Accept if the interval of the focus differences lies above 0 and none lies below."""
    ci = M.bootstrap_interval(_diff_counts(spark, d), "v", LOOP_B, "0")
    return ci.select((c("low") > 0).alias("improved"), (c("high") < 0).alias("regressed"), ((c("low") > 0) & ~(c("high") < 0)).alias("accepted"))


@query(f"WITH {_REC}, f AS (SELECT {FEATURES_SQL} FROM r) SELECT band, topic, count(*) AS n FROM f GROUP BY ALL HAVING count(*) < 30")
def thin_cells(spark, d):
    return features(_records(spark, d)).groupBy("band", "topic").agg(F.count("*").alias("n")).where("n < 30")


@query(f"{WITH_PREDS} SELECT model, gold, pred AS called, count(*) AS n FROM preds WHERE {_GL} AND NOT {_PL} GROUP BY ALL")
def missed_positives(spark, d):
    return predictions(spark, d).where(V.is_leak(c("gold")) & ~V.is_leak(c("pred"))).groupBy("model", "gold", c("pred").alias("called")).agg(F.count("*").alias("n"))


@query(rf"{WITH_PREDS}, s AS (SELECT * FROM preds WHERE gold IS NOT NULL AND NOT {_GL} AND regexp_matches(candidate_message, '(?i)\b(not quite|actually|remember|instead|isn''?t|should be|the mistake|incorrect)\b')) SELECT model, count(*) AS n, count(*) FILTER (WHERE {_PL}) / count(*) AS fp_rate FROM s GROUP BY model")
def canary_false_positives(spark, d):
    s = predictions(spark, d).where(c("gold").isNotNull() & ~V.is_leak(c("gold")) & T.has_cue_word(c("candidate_message")))
    return s.groupBy("model").agg(F.count("*").alias("n"), (M.count_where(V.is_leak(c("pred"))) / F.count("*")).alias("fp_rate"))


@query(f"{WITH_PREDS}, x AS (SELECT model, count(*) FILTER (WHERE pred = gold) AS r, count(*) FILTER (WHERE list_contains({VERDICT_LIST}, pred)) AS ok FROM preds GROUP BY model) SELECT model, CASE WHEN ok = 0 THEN 0 ELSE r / ok END AS accuracy FROM x")
def accuracy_among_parseable(spark, d):
    return predictions(spark, d).groupBy("model").agg(M.ratio(M.count_where(c("pred") == c("gold")), M.count_where(V.is_valid(c("pred")))).alias("accuracy"))


@query("SELECT min(n) AS least FROM (SELECT count(*) AS n FROM v1_b GROUP BY verdict)")
def minority_count(spark, d):
    return table(spark, d, "v1_b").groupBy("verdict").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))


_NW = "len(list_filter(regexp_split_to_array(coalesce(candidate_message, ''), '\\s+'), lambda w: w <> ''))"


@query(f"WITH {_REC}, w AS (SELECT least({_NW} // 5, 19) AS bucket FROM r) SELECT bucket, count(*) AS n FROM w GROUP BY bucket")
def length_histogram(spark, d):
    b = F.least(F.floor(T.word_count(c("candidate_message")) / 5), F.lit(19))
    return _records(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_REC}, w AS (SELECT verdict, {_NW} AS n FROM r), o AS (SELECT verdict, n, row_number() OVER (PARTITION BY verdict ORDER BY n) AS rn, count(*) OVER (PARTITION BY verdict) AS k FROM w) SELECT verdict, n AS upper_median FROM o WHERE rn = k // 2 + 1")
def upper_median_length(spark, d):
    """The element at position n // 2 of the sorted lengths, from counts of equal lengths."""
    counts = _records(spark, d).groupBy("verdict", T.word_count(c("candidate_message")).alias("n")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("verdict").orderBy("n")
    cum = counts.withColumn("upto", F.sum("k").over(w)).withColumn("total", F.sum("k").over(Window.partitionBy("verdict")))
    return cum.where("upto > floor(total / 2)").groupBy("verdict").agg(F.min("n").alias("upper_median"))


@query("SELECT count(DISTINCT id) FILTER (WHERE decision IN ('approve', 'edit_safe')) AS kept, count(DISTINCT id) AS total, count(DISTINCT id) FILTER (WHERE decision IN ('approve', 'edit_safe')) / count(DISTINCT id) AS yield FROM human_boundary")
def pair_yield(spark, d):
    h = table(spark, d, "human_boundary").groupBy("id").agg(F.bool_or(F.coalesce(c("decision").isin("approve", "edit_safe"), F.lit(False))).alias("ok"))
    return h.agg(F.count_if("ok").alias("kept"), F.count("*").alias("total")).withColumn("yield", c("kept") / c("total"))


@query("SELECT source, count(*) FILTER (WHERE decision = 'approve') AS agreed, count(*) FILTER (WHERE decision <> 'approve') AS overturned FROM (SELECT DISTINCT id, decision, ts, source FROM human_boundary) GROUP BY source")
def reviewer_tendencies(spark, d):
    h = table(spark, d, "human_boundary").select("id", "decision", "ts", "source").distinct()
    return h.groupBy("source").agg(M.count_where(c("decision") == "approve").alias("agreed"), M.count_where(c("decision") != "approve").alias("overturned"))


@query(f"{WITH_PREDS}, {_LEAK_SQL}, w AS (SELECT max(CASE WHEN model = 'm1' THEN exact / n END) AS first, max(CASE WHEN model = 'm2' THEN exact / n END) AS second FROM l) SELECT first, second, second - first AS delta FROM w")
def metric_deltas(spark, d):
    m = M.leak_metrics(predictions(spark, d), ["model"])
    w = m.agg(F.max(F.when(c("model") == "m1", c("accuracy"))).alias("first"), F.max(F.when(c("model") == "m2", c("accuracy"))).alias("second"))
    return w.withColumn("delta", c("second") - c("first"))


@query("SELECT user_id, coalesce(min(CASE WHEN value > 90 THEN n END), 16) AS first_turn FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 15 GROUP BY user_id")
def first_leak_turn(spark, d):
    """The first of up to 15 turns that trips the detector, 16 if none does."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    turns = table(spark, d, "events").select("user_id", "value", F.row_number().over(w).alias("n")).where("n <= 15")
    return turns.groupBy("user_id").agg(F.coalesce(F.min(F.when(c("value") > 90, c("n"))), F.lit(16)).alias("first_turn"))


@query("WITH t AS (SELECT user_id, coalesce(min(CASE WHEN value > 90 THEN n END), 16) AS f FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 15 GROUP BY user_id) SELECT count(*) AS n, count(*) FILTER (WHERE f = 16) AS held, sum(f) / count(*) AS mean_turns FROM t")
def hold_statistics(spark, d):
    t = first_leak_turn(spark, d)
    return t.agg(F.count("*").alias("n"), M.count_where(c("first_turn") == 16).alias("held"), (F.sum("first_turn") / F.count("*")).alias("mean_turns"))


@query(f"WITH {GOLD} SELECT g.gold, count(*) AS n, min(t.target_share) AS least_share FROM gold g LEFT JOIN sample_targets t ON t.gold_verdict = g.gold AND t.slice = g.slice GROUP BY g.gold")
def joined_class_counts(spark, d):
    t = table(spark, d, "sample_targets").select(c("gold_verdict").alias("gold"), "slice", "target_share")
    return gold(spark, d).join(t, ["gold", "slice"], "left").groupBy("gold").agg(F.count("*").alias("n"), F.min("target_share").alias("least_share"))


_CAN = r"cn AS (SELECT model, count(*) FILTER (WHERE " + _PL + r") / count(*) AS fp FROM preds WHERE gold IS NOT NULL AND NOT " + _GL + r" AND regexp_matches(candidate_message, '(?i)\b(not quite|actually|remember|instead|isn''?t|should be|the mistake|incorrect)\b') GROUP BY model)"


@query(f"""{WITH_PREDS}, {_LEAK_SQL}, {_CAN}, x AS (SELECT model, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, same / n AS safety, coalesce(fp_, 0) AS canary FROM (SELECT l.*, cn.fp AS fp_ FROM l LEFT JOIN cn USING (model)))
SELECT b.model, b.recall > a.recall AND b.safety - a.safety >= -0.005 AND b.canary - a.canary <= 0.02 AS accepted FROM x b, x a WHERE a.model = 'm1' AND b.model <> 'm1'""")
def recall_gate(spark, d):
    """A model is accepted over m1 if it finds more leaks without losing safety or tripping the canary."""
    m = M.leak_metrics(predictions(spark, d), ["model"]).join(canary_false_positives(spark, d).select("model", "fp_rate"), "model", "left")
    m = m.select("model", "recall", c("binary_accuracy").alias("safety"), F.coalesce("fp_rate", F.lit(0.0)).alias("canary"))
    old = m.where("model = 'm1'").select(c("recall").alias("r"), c("safety").alias("s"), c("canary").alias("k"))
    new = m.where("model <> 'm1'").crossJoin(F.broadcast(old))  # one row
    return new.select("model", ((c("recall") > c("r")) & (c("safety") - c("s") >= -0.005) & (c("canary") - c("k") <= 0.02)).alias("accepted"))
