"""Consensus, agreement, ensembles and juries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T, verdicts as V
from ..operators import metrics as M, votes as O
from ..operators.sampling import ranked
from ..session import table
from .catalog import LEAK_LIST, VERDICT_LIST, WITH_PREDS, predictions, query, sql_hash, sql_verdict

c = F.col
_VOTES = f"""v AS (SELECT id, e.key AS model, {sql_verdict('e.value')} AS vote FROM (SELECT id, unnest(map_entries(votes)) AS e FROM (SELECT DISTINCT id, votes FROM train_flagged))),
cur AS (SELECT id, min({sql_verdict('current_label')}) AS current FROM train_flagged GROUP BY id),
k AS (SELECT id, vote, count(*) AS n, -list_position({VERDICT_LIST}, vote) AS o FROM v WHERE vote IS NOT NULL GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, o DESC) AS rn, sum(n) OVER (PARTITION BY id) AS n_valid FROM k) WHERE rn = 1),
cast_ AS (SELECT id, count(*) AS n_models FROM v GROUP BY id)"""


def votes(spark, d):
    """(id, model, vote) with every annotator of the recorded maps; unusable votes are null."""
    t = table(spark, d, "train_flagged").select("id", F.explode("votes").alias("model", "vote")).distinct()
    return t.select("id", "model", V.plain_verdict(c("vote")).alias("vote"))


def current(spark, d):
    return table(spark, d, "train_flagged").groupBy("id").agg(F.min(V.plain_verdict(c("current_label"))).alias("current"))


@query(f"""WITH {_VOTES} SELECT id, current, vote AS majority, coalesce(n, 0) AS n_agree, coalesce(n_models, 0) AS n_models,
CASE WHEN coalesce(n, 0) * 2 > coalesce(n_models, 0) THEN CASE WHEN vote = current THEN 'CONFIRM' ELSE 'CHANGE' END ELSE 'NO_CONSENSUS' END AS category FROM cur LEFT JOIN cast_ USING (id) LEFT JOIN top USING (id)""")
def strict_consensus(spark, d):
    return O.strict_consensus(votes(spark, d), current(spark, d), "id", "vote")


@query(f"WITH {_VOTES} SELECT count(*) AS n_items, sum(n / n_valid) / count(*) > 0.5 AS mostly_consistent, sum(n)::BIGINT AS n_majority_votes, sum(n_valid)::BIGINT AS n_votes FROM top")
def majority_self_consistency(spark, d):
    t = O.top_votes(votes(spark, d), "id", "vote")
    return t.agg(F.count("*").alias("n_items"), (F.sum(c("top_n") / c("n_valid")) / F.count("*") > 0.5).alias("mostly_consistent"), F.sum("top_n").alias("n_majority_votes"), F.sum("n_valid").alias("n_votes"))


@query(f"WITH {_VOTES} SELECT id, CASE WHEN n_valid IS NULL THEN 0 WHEN n = n_valid THEN 2 WHEN n * 2 > n_valid THEN 1 ELSE 0 END AS tier FROM (SELECT DISTINCT id FROM v) i LEFT JOIN top USING (id)")
def consistency_tiers(spark, d):
    return O.consistency_tiers(votes(spark, d), "id", "vote")


_CNT = lambda v: f"len(list_filter(s, lambda x: x = '{v}'))"
_SAFE = ["adequate", "mismatched_calibration", "vague_unhelpful"]
_FN, _KS = _CNT("gives_final_answer"), _CNT("gives_away_key_step")
_SWEEP = f"""s AS (SELECT id, gold, list(pred) FILTER (WHERE pred IS NOT NULL) AS s FROM preds GROUP BY ALL), m AS (SELECT s.*, m FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
x AS (SELECT id, gold, m, {_FN} AS f, {_KS} AS k, {_CNT('adequate')} AS a, {_CNT('mismatched_calibration')} AS b, {_CNT('vague_unhelpful')} AS c FROM m),
sw AS (SELECT id, gold, m, CASE WHEN f + k >= m THEN CASE WHEN k >= f THEN 'gives_away_key_step' ELSE 'gives_final_answer' END WHEN greatest(a, b, c) > 0 THEN CASE WHEN a >= greatest(b, c) THEN 'adequate' WHEN b >= c THEN 'mismatched_calibration' ELSE 'vague_unhelpful' END
WHEN f + k > 0 THEN CASE WHEN f >= k THEN 'gives_final_answer' ELSE 'gives_away_key_step' END END AS pred FROM x)"""


@query(f"""{WITH_PREDS}, {_SWEEP}, l AS (SELECT m, count(*) AS n, count(*) FILTER (WHERE coalesce(gold IN {LEAK_LIST}, false) AND coalesce(pred IN {LEAK_LIST}, false)) AS tp, count(*) FILTER (WHERE NOT coalesce(gold IN {LEAK_LIST}, false) AND coalesce(pred IN {LEAK_LIST}, false)) AS fp,
count(*) FILTER (WHERE coalesce(gold IN {LEAK_LIST}, false) AND NOT coalesce(pred IN {LEAK_LIST}, false)) AS fn, count(*) FILTER (WHERE pred IS NOT DISTINCT FROM gold) AS exact FROM sw GROUP BY m)
SELECT m, n, tp, fp, fn, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, exact / n AS accuracy FROM l""")
def vote_threshold_sweep(spark, d):
    s = predictions(spark, d).groupBy("id", "gold").agg(F.collect_list("pred").alias("s"))  # one entry per model of a fixed list
    return M.leak_metrics(O.threshold_sweep(s, c("s"), ["id", "gold"], [1, 2, 3, 4, 5]), ["m"]).select("m", "n", "tp", "fp", "fn", "recall", "accuracy")


@query(f"""{WITH_PREDS}, e AS (SELECT id, gold IN {LEAK_LIST} AS g, bool_or(coalesce(pred IN {LEAK_LIST}, false)) AS p FROM preds WHERE model IN ('m1', 'm2') GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(g, false) AND p) AS tp, count(*) FILTER (WHERE NOT coalesce(g, false) AND p) AS fp, count(*) FILTER (WHERE coalesce(g, false) AND NOT p) AS fn FROM e""")
def union_ensemble(spark, d):
    e = O.any_leak(predictions(spark, d).where(c("model").isin("m1", "m2")), ["id", "gold"], "pred")
    g, p = V.is_leak(c("gold")), c("leak")
    return e.agg(F.count("*").alias("n"), M.count_where(g & p).alias("tp"), M.count_where(~g & p).alias("fp"), M.count_where(g & ~p).alias("fn"))


_WIDE = "w AS (SELECT id, gold, " + ", ".join(f"max(CASE WHEN model = 'm{i}' THEN pred END) AS m{i}" for i in range(1, 6)) + " FROM preds GROUP BY id, gold)"


def wide(spark, d):
    return predictions(spark, d).groupBy("id", "gold").agg(*(F.max(F.when(c("model") == f"m{i}", c("pred"))).alias(f"m{i}") for i in range(1, 6)))


@query(f"""{WITH_PREDS}, {_WIDE}, j AS (SELECT *, CASE WHEN m3 = m4 THEN m3 END AS jury FROM w WHERE m1 <> m2)
SELECT grp, count(*) AS n, count(*) FILTER (WHERE jury = m1) AS jury_first, count(*) FILTER (WHERE jury = m2) AS jury_second, count(*) FILTER (WHERE jury = gold) AS jury_gold FROM
(SELECT 'all' AS grp, * FROM j WHERE jury IS NOT NULL UNION ALL SELECT 'lost', * FROM j WHERE jury IS NOT NULL AND gold = m1 UNION ALL SELECT 'won', * FROM j WHERE jury IS NOT NULL AND gold = m2) GROUP BY grp""")
def two_arbiter_tallies(spark, d):
    j = wide(spark, d).where("m1 <> m2").withColumn("jury", F.when(c("m3") == c("m4"), c("m3"))).where("jury is not null")
    groups = F.array_compact(F.array(F.lit("all"), F.when(c("gold") == c("m1"), "lost"), F.when(c("gold") == c("m2"), "won")))
    return j.withColumn("grp", F.explode(groups)).groupBy("grp").agg(F.count("*").alias("n"), M.count_where(c("jury") == c("m1")).alias("jury_first"), M.count_where(c("jury") == c("m2")).alias("jury_second"), M.count_where(c("jury") == c("gold")).alias("jury_gold"))


@query(f"{WITH_PREDS}, {_WIDE} SELECT count(*) AS n, count(*) FILTER (WHERE m1 IN {LEAK_LIST} AND m2 IN {LEAK_LIST}) AS both_leak, count(*) FILTER (WHERE m1 = 'gives_away_key_step' AND m2 = 'gives_away_key_step') AS both_step, count(*) FILTER (WHERE m1 IN {LEAK_LIST} AND m2 IN {LEAK_LIST}) / count(*) AS share FROM w")
def both_leak_agreement(spark, d):
    both = V.is_leak(c("m1")) & V.is_leak(c("m2"))
    step = (c("m1") == V.LEAKS[1]) & (c("m2") == V.LEAKS[1])
    return wide(spark, d).agg(F.count("*").alias("n"), M.count_where(both).alias("both_leak"), M.count_where(step).alias("both_step")).withColumn("share", c("both_leak") / c("n"))


@query(f"""{WITH_PREDS}, b AS (SELECT model, gold, pred FROM preds WHERE gold IS NOT NULL AND pred IS NOT NULL), n AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS same FROM b GROUP BY model),
x AS (SELECT model, gold AS l, 1 AS a, 0 AS b FROM b UNION ALL SELECT model, pred, 0, 1 FROM b), m AS (SELECT model, l, sum(a)::BIGINT AS na, sum(b)::BIGINT AS nb FROM x GROUP BY ALL), p AS (SELECT model, sum(na * nb)::BIGINT AS pr FROM m GROUP BY model)
SELECT model, n, same / n AS agreement, CASE WHEN n * n - pr = 0 THEN 1 ELSE (n * same - pr) / (n * n - pr) END AS kappa FROM n JOIN p USING (model)""")
def cohen_kappa(spark, d):
    return M.kappa(predictions(spark, d), ["model"], "gold", "pred")


@query(f"{WITH_PREDS} SELECT model, gold, count(*) AS n, count(*) FILTER (WHERE gold = pred) / count(*) AS agreement, count(*) FILTER (WHERE coalesce(gold IN {LEAK_LIST}, false) = coalesce(pred IN {LEAK_LIST}, false)) / count(*) AS binary_agreement FROM preds GROUP BY ALL")
def agreement_by_class(spark, d):
    p, n = predictions(spark, d), F.count("*")
    return p.groupBy("model", "gold").agg(n.alias("n"), (M.count_where(c("gold") == c("pred")) / n).alias("agreement"), (M.count_where(V.is_leak(c("gold")) == V.is_leak(c("pred"))) / n).alias("binary_agreement"))


_RANKS = f"rk AS (SELECT id, model, juror, row_number() OVER (PARTITION BY id, juror ORDER BY {sql_hash('juror', 'id', 'model')}, model) AS rank FROM preds, (SELECT unnest(['a', 'b']) AS juror))"


def ranks(spark, d):
    p = predictions(spark, d).select("id", "model", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("juror"))
    return ranked(p, ["id", "juror"], [T.portable_hash(c("juror"), c("id"), c("model")), c("model")], "rank")


@query(f"{WITH_PREDS}, {_RANKS} SELECT model, sum(rank) / count(*) AS mean_rank, count(*) AS n FROM rk GROUP BY model")
def jury_mean_ranks(spark, d):
    return O.mean_ranks(ranks(spark, d), "model")


@query(f"{WITH_PREDS}, {_RANKS}, p AS (SELECT id, model, sum(rank) / count(*) AS r FROM rk GROUP BY ALL) SELECT a.model, sum(CASE WHEN a.r < b.r THEN 2 WHEN a.r = b.r THEN 1 ELSE 0 END) / (count(*) * 2) AS win_rate, count(*) AS n FROM p a JOIN p b USING (id) WHERE a.model <> 'm1' AND b.model = 'm1' GROUP BY a.model")
def win_rates(spark, d):
    return O.win_rates(ranks(spark, d), "id", "model", "m1")


@query(f"{WITH_PREDS}, {_RANKS}, s AS (SELECT model, sum(rank) / count(*) AS mean_rank FROM rk GROUP BY model) SELECT arg_min(model, mean_rank) AS winner FROM s")
def jury_winner(spark, d):
    return O.mean_ranks(ranks(spark, d), "model").agg(F.min(F.struct("mean_rank", "model")).alias("x")).select(c("x.model").alias("winner"))


@query(f"{WITH_PREDS} SELECT id, model, chr((64 + row_number() OVER (PARTITION BY id ORDER BY {sql_hash(chr(39) + '0' + chr(39), 'id', 'model')}, model))::INT) AS letter FROM preds")
def shuffled_letters(spark, d):
    p = ranked(predictions(spark, d), ["id"], [T.portable_hash("0", c("id"), c("model")), c("model")])
    return p.select("id", "model", F.char(c("rn") + 64).alias("letter"))


@query("WITH k AS (SELECT s_nationkey, s_suppkey % 4 AS kind, count(*) AS n, min(s_suppkey) AS f FROM supplier GROUP BY ALL) SELECT s_nationkey, kind AS top_kind, n FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, f) AS rn FROM k) WHERE rn = 1")
def most_common_first_seen(spark, d):
    s = table(spark, d, "supplier").withColumn("kind", c("s_suppkey") % 4)
    return O.most_common(s, ["s_nationkey"], "kind", "s_suppkey").withColumnRenamed("kind", "top_kind")


@query(f"{WITH_PREDS}, x AS (SELECT DISTINCT id, pred, candidate_message AS m FROM preds WHERE model = 'm1') SELECT model, count(*) FILTER (WHERE coalesce(p.pred IN {LEAK_LIST}, false)) / count(*) AS leak_rate, sum(len(list_filter(regexp_split_to_array(coalesce(p.candidate_message, ''), '\\s+'), lambda w: w <> ''))) / count(p.candidate_message) AS mean_words, count(p.candidate_message) AS n FROM preds p GROUP BY model")
def leak_rate_and_words(spark, d):
    p, n = predictions(spark, d), F.count("*")
    return p.groupBy("model").agg((M.count_where(V.is_leak(c("pred"))) / n).alias("leak_rate"), (F.sum(T.word_count(c("candidate_message"))) / F.count("candidate_message")).alias("mean_words"), F.count("candidate_message").alias("n"))


@query(f"{WITH_PREDS}, {_RANKS}, w AS (SELECT arg_min(model, r) AS winner FROM (SELECT model, sum(rank) / count(*) AS r FROM rk GROUP BY model)) SELECT juror, CASE WHEN juror = winner THEN 'm5' ELSE juror END AS used FROM (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS juror), w")
def juror_exclusion(spark, d):
    """A juror that is the winner itself is replaced by its alternate."""
    jurors = spark.createDataFrame([(f"m{i}",) for i in range(1, 5)], "juror string")
    return jurors.crossJoin(F.broadcast(jury_winner(spark, d))).select("juror", F.when(c("juror") == c("winner"), "m5").otherwise(c("juror")).alias("used"))  # one row

