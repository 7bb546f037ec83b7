"""Caps, samples, splits, chunks and ordinal operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling as S
from ..operators.series import reset_runs, running_prefix
from ..session import table
from .catalog import query, sql_hash
from .text_queries import FEATURES_SQL, _REC, _records, features

c = F.col
_H0 = sql_hash("'0'", "id")
_N = "n AS (SELECT count(*) AS n FROM r)"


@query(f"WITH {_REC} SELECT id, verdict FROM (SELECT id, verdict, row_number() OVER (PARTITION BY verdict ORDER BY id) AS k FROM r WHERE slice IS NOT NULL) WHERE k <= 230")
def class_cap(spark, d):
    return S.cap_per_class(_records(spark, d).where("slice is not null").select("id", "verdict"), ["verdict"], [c("id")], 230)


@query("SELECT id, parent FROM (SELECT *, row_number() OVER (ORDER BY id) AS g FROM (SELECT * FROM (SELECT id, problem AS parent, row_number() OVER (PARTITION BY problem ORDER BY id) AS k FROM (SELECT DISTINCT id, problem FROM v1_b)) WHERE k <= 2)) WHERE g <= 500")
def per_parent_limit(spark, d):
    rows = table(spark, d, "v1_b").select("id", c("problem").alias("parent")).distinct()
    return S.cap_per_class(rows, ["parent"], [c("id")], 2).orderBy("id").limit(500)


@query(f"WITH {_REC}, m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM r GROUP BY verdict)), k AS (SELECT id, verdict, row_number() OVER (PARTITION BY verdict ORDER BY {_H0}, id) AS k FROM r) SELECT id, verdict FROM k, m WHERE k <= m.n")
def minority_downsample(spark, d):
    return S.downsample(_records(spark, d).select("id", "verdict"), "verdict", "id", "0")


_CELLS = ["band", "topic", "length", "turns", "numbers"]
_CELL_HASH = sql_hash("'0'", "verdict", *_CELLS)


@query(f"""WITH {_REC}, f AS (SELECT id, verdict, {FEATURES_SQL} FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY verdict, {', '.join(_CELLS)} ORDER BY {_H0}, id) AS turn FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY turn, {_CELL_HASH}, id) AS pick FROM t) SELECT id, verdict, {', '.join(_CELLS)} FROM p WHERE pick <= 145""")
def round_robin_stratified(spark, d):
    f = features(_records(spark, d)).select("id", "verdict", *_CELLS)
    return S.round_robin(f, "verdict", _CELLS, "id", "0", 145)


@query(f"WITH {_REC}, q AS (SELECT unnest(['adequate', 'mismatched_calibration', 'vague_unhelpful', 'gives_final_answer', 'gives_away_key_step']) AS verdict, unnest([72, 84, 72, 36, 36]) AS quota), k AS (SELECT id, verdict, row_number() OVER (PARTITION BY verdict ORDER BY {_H0}, id) AS k FROM r) SELECT id, verdict FROM k JOIN q USING (verdict) WHERE k <= quota")
def quota_sample(spark, d):
    """Quotas are the rounded shares of 300 rows, at most what a class has."""
    shares = {"adequate": 0.24, "mismatched_calibration": 0.28, "vague_unhelpful": 0.24, "gives_final_answer": 0.12, "gives_away_key_step": 0.12}
    quota = spark.createDataFrame([(k, round(300 * v)) for k, v in shares.items()], "verdict string, quota int")
    k = S.ranked(_records(spark, d).select("id", "verdict"), ["verdict"], S.hash_order("id", "0")).where("rn <= 300")  # no quota is larger
    return k.join(F.broadcast(quota), "verdict").where("rn <= quota").select("id", "verdict")  # a row per verdict


@query(f"""WITH {_REC}, {_N}, p AS (SELECT id, row_number() OVER (ORDER BY {_H0}, id) - 1 AS pos FROM r), b AS (SELECT n, CASE WHEN n >= 3 THEN greatest(n // 10, 1) ELSE n // 10 END AS nv FROM n)
SELECT id, CASE WHEN pos < CASE WHEN n >= 3 THEN least(n * 8 // 10, n - nv - 1) ELSE n * 8 // 10 END THEN 'train' WHEN pos < CASE WHEN n >= 3 THEN least(n * 8 // 10, n - nv - 1) ELSE n * 8 // 10 END + nv THEN 'valid' ELSE 'test' END AS split FROM p, b""")
def split_train_valid_test(spark, d):
    return S.three_way_split(_records(spark, d).select("id"), "id", "0")


@query(f"WITH {_REC}, {_N}, p AS (SELECT id, row_number() OVER (ORDER BY {_H0}, id) - 1 AS pos FROM r) SELECT id, CASE WHEN pos < greatest(1, n // 10) THEN 'valid' ELSE 'train' END AS split FROM p, n")
def split_valid_first(spark, d):
    pos = S.global_rank(_records(spark, d).select("id"), "id", "0")
    n = pos.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("nv"))
    return pos.crossJoin(F.broadcast(n)).select("id", F.when(c("pos") < c("nv"), "valid").otherwise("train").alias("split"))  # one row


@query(f"WITH {_REC}, {_N}, p AS (SELECT id, row_number() OVER (ORDER BY {_H0}, id) - 1 AS pos FROM r) SELECT id FROM p, n WHERE pos < least(60, n // 4)")
def bounded_holdout(spark, d):
    df = _records(spark, d).select("id").withColumn("_h", T.portable_hash("0", c("id")))
    n = df.count()
    return df.orderBy("_h", "id").limit(min(60, n // 4)).select("id")


@query(f"WITH {_REC} SELECT verdict, id FROM (SELECT verdict, id, row_number() OVER (PARTITION BY verdict ORDER BY id) AS k FROM r) WHERE k <= 3")
def exemplars_per_class(spark, d):
    return S.cap_per_class(_records(spark, d).select("verdict", "id"), ["verdict"], [c("id")], 3)


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_discount > 0.05 DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def exemplar_per_transition(spark, d):
    """One row per pair of states, those with a note first."""
    order = [(c("l_discount") > 0.05).desc(), c("l_orderkey"), c("l_linenumber")]
    return S.cap_per_class(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_discount"), ["l_returnflag", "l_linestatus"], order, 1).drop("l_discount")


@query("""WITH r AS (SELECT *, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS reset FROM events),
k AS (SELECT user_id, sum(reset) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM r), n AS (SELECT user_id, run, count(*) AS n FROM k GROUP BY ALL)
SELECT user_id, run, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, run) AS rn FROM n) WHERE rn = 1""")
def longest_runs(spark, d):
    """A new run starts where the value falls; the longest run of each user."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    runs = reset_runs(e, ["user_id"], [c("ts"), c("event_id")], "value").groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return S.cap_per_class(runs, ["user_id"], [c("n").desc(), c("run")], 1)


@query("SELECT user_id, event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ' ') AS history FROM events")
def history_prefixes(spark, d):
    """All events before each event."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    h = running_prefix(e, ["user_id"], [c("ts"), c("event_id")], "event_type")
    return h.select("user_id", "event_id", F.nullif(F.array_join("history", " "), F.lit("")).alias("history"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents")
def ordinals(spark, d):
    return S.ordered_positions(table(spark, d, "documents").select("doc_id"), [c("doc_id")], "n")


@query("WITH u AS (SELECT DISTINCT id FROM v1_b WHERE id NOT IN (SELECT id FROM human_boundary WHERE decision IS NOT NULL)) SELECT id FROM u ORDER BY id LIMIT 25")
def next_unreviewed(spark, d):
    from .join_queries import unreviewed_ids

    return unreviewed_ids(spark, d).select("id").orderBy("id").limit(25)


@query("SELECT (SELECT count(DISTINCT id) FROM v1_b) AS total, (SELECT count(DISTINCT id) FROM human_boundary WHERE decision IS NOT NULL) AS reviewed, (SELECT count(DISTINCT id) FROM v1_b WHERE id NOT IN (SELECT id FROM human_boundary WHERE decision IS NOT NULL)) AS remaining")
def review_progress(spark, d):
    done = table(spark, d, "human_boundary").where("decision is not null").select("id").distinct().withColumn("done", F.lit(True))
    b = table(spark, d, "v1_b").select("id").distinct().join(done, "id", "full")
    return b.agg(F.count("*").alias("total"), F.count("done").alias("reviewed"), F.count_if(c("done").isNull()).alias("remaining"))


@query("SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 50")
def priority_feed(spark, d):
    return table(spark, d, "events").orderBy(c("value").desc(), "event_id").select("event_id").limit(50)


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), n AS (SELECT greatest(1, count(*) // 30) AS step FROM p) SELECT doc_id FROM p, n WHERE pos % step = 0 AND pos // step < 30")
def stride_sample(spark, d):
    pos = S.ordered_positions(table(spark, d, "documents").select("doc_id"), [c("doc_id")])
    step = pos.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 30)).alias("step"))
    return pos.crossJoin(F.broadcast(step)).where("pos % step = 0 and floor(pos / step) < 30").select("doc_id")  # one row


@query(f"WITH {_REC}, p AS (SELECT id FROM r ORDER BY {_H0}, id LIMIT 30) SELECT id FROM p")
def seeded_sample(spark, d):
    return _records(spark, d).select("id").withColumn("_h", T.portable_hash("0", c("id"))).orderBy("_h", "id").limit(30).select("id")


@query("WITH p AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (SELECT DISTINCT id FROM human_boundary)), s AS (SELECT unnest([0, 50, 100, 200, 400]) AS step) SELECT step, 'base' AS part, id FROM (SELECT DISTINCT id FROM train_flagged), s UNION ALL SELECT step, 'added', id FROM p, s WHERE rn <= step")
def growth_prefixes(spark, d):
    """Training sets that grow: the base with the first 0, 50, 100, 200 and 400 pairs."""
    steps = F.explode(F.array(*map(F.lit, (0, 50, 100, 200, 400)))).alias("step")
    base = table(spark, d, "train_flagged").select("id").distinct().select("id", steps)
    first = table(spark, d, "human_boundary").select("id").distinct().orderBy("id").limit(400)
    ranked = first.withColumn("rn", F.row_number().over(Window.orderBy("id")))  # at most 400 rows
    added = ranked.select("id", "rn", steps).where("rn <= step")
    return base.select("step", F.lit("base").alias("part"), "id").unionByName(added.select("step", F.lit("added").alias("part"), "id"))


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, ceil(count(*) OVER () / 7)::BIGINT AS per FROM documents) SELECT doc_id, pos // per AS batch FROM p")
def ceil_chunks(spark, d):
    return S.ceil_chunks(table(spark, d, "documents").select("doc_id"), [c("doc_id")], 7)


@query("SELECT l_returnflag AS move, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS gain FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL HAVING sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) > 0")
def impact_ranking(spark, d):
    """Accepted moves by gain, largest first."""
    m = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(c("l_returnflag").alias("move")).agg(F.count_if(c("l_discount") > 0.05).alias("gain"))
    return m.where("gain > 0").orderBy(c("gain").desc(), "move")


@query("SELECT id, candidate FROM (SELECT b.id, md5(coalesce(b.candidate_message, '')) AS candidate, row_number() OVER (ORDER BY b.id) AS k FROM (SELECT DISTINCT id, verdict, candidate_message, rewritten_message FROM v1_b) b WHERE trim(coalesce(candidate_message, '')) <> '' AND (verdict = 'adequate') = (rewritten_message IS NULL) AND trim(candidate_message) NOT IN (SELECT trim(candidate_message) FROM v1_test WHERE candidate_message IS NOT NULL)) WHERE k <= 200")
def first_valid_generations(spark, d):
    """The first 200 records that are valid and not in the evaluation set."""
    held = table(spark, d, "v1_test").where("candidate_message is not null").select(F.trim("candidate_message").alias("t")).distinct()
    b = table(spark, d, "v1_b").select("id", "verdict", "candidate_message", "rewritten_message").distinct()
    ok = b.where((F.trim(T.text_or_empty(c("candidate_message"))) != "") & ((c("verdict") == "adequate") == c("rewritten_message").isNull()))
    return ok.withColumn("t", F.trim("candidate_message")).join(held, "t", "left_anti").orderBy("id").limit(200).select("id", F.md5("candidate_message").alias("candidate"))
