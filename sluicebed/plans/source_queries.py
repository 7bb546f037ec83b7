"""Round trips through files and the generators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.verdicts import VERDICTS, is_valid
from ..operators import dedup
from ..session import table
from ..sources import dialogues, generators, jsonl, logs, reports
from .catalog import GOLD, VERDICT_LIST, WITH_PREDS, gold, query
from .lineage import shared_dir
from .metric_queries import _LEAK_COLS, _LEAK_SQL, binary_prf
from .text_queries import _REC, _records

c = F.col


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}-{name}"


@query("SELECT id, problem, verdict, rewritten_message, array_to_string(conversation_history, '|') AS history FROM v1_b")
def jsonl_round_trip(spark, d):
    df = table(spark, d, "v1_b").select("id", "problem", "verdict", "rewritten_message", "conversation_history")
    path = _scratch(spark, "rows")
    jsonl.write_jsonl(df, path)
    return jsonl.read_jsonl(spark, path, df.schema).select("id", "problem", "verdict", "rewritten_message", F.array_join("conversation_history", "|").alias("history"))


@query("SELECT 'core' AS shard, count(*) AS n FROM v1_b UNION ALL SELECT 'file', count(*) FROM v1_test")
def shard_provenance(spark, d):
    """Rows that name their shard keep the name; others get that of their file."""
    path = _scratch(spark, "shards")
    a = table(spark, d, "v1_b").select("id", F.lit("core").alias("_shard"))
    jsonl.write_jsonl(a, path)
    jsonl.write_jsonl(table(spark, d, "v1_test").select("id"), path, "append")
    rows = jsonl.read_shards(spark, path, table(spark, d, "v1_test").select("id").schema)
    return rows.groupBy(F.when(c("_shard") == "core", "core").otherwise("file").alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT id, min(s) AS shard FROM (SELECT id, 0 AS s FROM v1_b UNION ALL SELECT id, 1 FROM human_boundary UNION ALL SELECT id, 2 FROM v1_test) GROUP BY id")
def first_wins_shards(spark, d):
    parts = [table(spark, d, t).select("id", F.lit(i).alias("shard")) for i, t in enumerate(("v1_b", "human_boundary", "v1_test"))]
    return dedup.one_per_key(parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct(), [c("id")], [c("shard")])


@query(f"SELECT id, verdict FROM (SELECT DISTINCT id, verdict FROM v1_b) WHERE list_contains({VERDICT_LIST}, verdict)")
def tolerant_read(spark, d):
    """Good lines with broken and invalid ones among them: only the good ones come back."""
    df = table(spark, d, "v1_b").select("id", "verdict").distinct()
    path = _scratch(spark, "lines")
    good = df.select(F.to_json(F.struct("id", "verdict")).alias("value"))
    bad = df.select(F.concat(F.lit('{"id": "'), "id", F.lit('", "verdict": ')).alias("value")).unionByName(df.select(F.to_json(F.struct("id", F.lit("nonsense").alias("verdict"))).alias("value")))
    good.unionByName(bad).write.text(path)
    rows, _ = jsonl.read_tolerant(spark, path, df.schema, "id", is_valid(c("verdict")))
    return rows


@query("SELECT 2 * count(*) AS n_bad FROM (SELECT DISTINCT id FROM v1_b)")
def tolerant_read_bad_count(spark, d):
    df = table(spark, d, "v1_b").select("id", F.lit("adequate").alias("verdict")).distinct()
    path = _scratch(spark, "lines")
    broken = df.select(F.concat(F.lit('{"id": '), "id").alias("value"))
    df.select(F.to_json(F.struct("id", "verdict")).alias("value")).unionByName(broken).unionByName(broken).write.text(path)
    return jsonl.read_tolerant(spark, path, df.schema, "id", is_valid(c("verdict")))[1]


@query("SELECT DISTINCT 'c' || o_orderkey AS conversation_id, r AS pos, CASE r WHEN 0 THEN 'Expert' ELSE 'Novice' END AS model, o_orderstatus AS response, 'Sum of ' || o_orderkey || '?' AS problem FROM orders, (SELECT unnest([0, 1]) AS r)")
def nested_documents(spark, d):
    """Conversations written as files of JSON arrays and read back as one row per response."""
    path = _scratch(spark, "nested")
    o = table(spark, d, "orders")
    answer = lambda m: F.struct(c("o_orderstatus").alias("response"), F.create_map(F.lit("Guidance"), F.lit("Yes")).alias("annotation")).alias(m)
    doc = F.struct(F.concat(F.lit("c"), "o_orderkey").alias("conversation_id"), F.concat(F.lit("Tutor: The question is: Sum of "), "o_orderkey", F.lit("? Student: hm")).alias("conversation_history"), F.lit("1").alias("ground_truth"), F.struct(answer("Expert"), answer("Novice")).alias("responses"))
    files = o.groupBy(F.floor(c("o_orderkey") / 1000)).agg(F.to_json(F.collect_list(doc)).alias("value"))  # a thousand keys to a file
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = dialogues.read_nested(spark, path)
    return rows.select("conversation_id", "pos", "model", "response", "problem")


@query(r"SELECT event_id, 2 AS pos, 'focus' AS move, 'look at step ' || event_id || ' of the list again' AS text, 'Teacher: hello there|Student: ok' AS history FROM events")
def guided_teacher_turns(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Teacher: (probing) hello there|EOM|Student: ok|EOM|Teacher: (focus) look at step "), "event_id", F.lit(" of the list again|EOM|Teacher: (telling) no")).alias("conv"))
    g = dialogues.guided_turns(e, "event_id", "conv", ["probing", "focus"], 25)
    return g.select("event_id", "pos", "move", "text", F.array_join("history", "|").alias("history"))


@query("SELECT 'absent' AS source, 0 AS n UNION ALL SELECT 'present', count(*) FROM v1_test UNION ALL SELECT 'existing', count(*) FROM v1_test")
def optional_source(spark, d):
    """A source that is there, one that is not, and those of a list that are."""
    df, here, gone = table(spark, d, "v1_test").select("id"), _scratch(spark, "present"), _scratch(spark, "absent")
    jsonl.write_jsonl(df, here)
    reads = {"absent": jsonl.read_optional(spark, gone, df.schema), "present": jsonl.read_optional(spark, here, df.schema), "existing": jsonl.read_existing(spark, [gone, here], df.schema)}
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, x in reads.items()])


@query("SELECT doc_id, trim(list_last(string_split(coalesce(text, ''), '####'))) = trim(coalesce(text, '')) AS whole FROM documents")
def marked_answers(spark, d):
    t = T.text_or_empty(c("text"))
    return table(spark, d, "documents").select("doc_id", (F.trim(F.element_at(F.split(t, "####"), -1)) == F.trim(t)).alias("whole"))


def _blobs(g):
    """Results of a hundred items or so each: a bare list, or the list under one of two keys."""
    parts = max(1, g.count() // 100)
    packed = g.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "pred")).alias("x"))
    under = lambda name: F.to_json(F.struct(c("x").alias(name)))
    return packed.select(F.when(c("part") % 3 == 0, F.to_json("x")).when(c("part") % 3 == 1, under("items")).otherwise(under("per_item")).alias("value"))


@query(f"WITH {GOLD} SELECT id, gold AS pred FROM gold")
def result_blobs(spark, d):
    """Results in all three forms come back as items."""
    path = _scratch(spark, "blob")
    _blobs(gold(spark, d).select("id", c("gold").alias("pred"))).write.text(path)
    return jsonl.result_items(spark, path, one_per_line=True)


@query(f"WITH {GOLD} SELECT id, gold AS pred FROM gold WHERE gold <> 'adequate'")
def newest_results(spark, d):
    """Of several result files of a folder the one written last is read."""
    folder, g = _scratch(spark, "downloads"), gold(spark, d).select("id", c("gold").alias("pred"))
    _blobs(g).write.text(f"{folder}/results-1.json")
    _blobs(g.where("pred <> 'adequate'")).write.text(f"{folder}/results-2.json")
    return jsonl.result_items(spark, jsonl.newest(spark, folder, ".json"), one_per_line=True)


@query(f"WITH {_REC} SELECT id, coalesce(verdict, '') AS label FROM r")
def replaced_with_backup(spark, d):
    """A table overwritten by a query over itself."""
    path, keep = _scratch(spark, "table"), _scratch(spark, "backup")
    df = _records(spark, d).select("id", "verdict")
    jsonl.write_jsonl(df, path)
    old = jsonl.read_jsonl(spark, path, df.schema)
    new = old.select("id", T.text_or_empty(c("verdict")).alias("label"))
    jsonl.replace_with_backup(new, path, keep)
    return jsonl.read_jsonl(spark, path, new.schema)


@query("SELECT count(*) * 2 AS n, count(*) * 2 AS n_stamped FROM events")
def appended_log(spark, d):
    path = _scratch(spark, "log")
    e = table(spark, d, "events").select("event_id", "event_type")
    jsonl.append_log(e, path)
    jsonl.append_log(e, path)
    return spark.read.schema("event_id bigint, ts double").json(path).agg(F.count("*").alias("n"), F.count("ts").alias("n_stamped"))


@query("SELECT DISTINCT id, problem, correct_solution, array_to_string(conversation_history, '|') AS history, candidate_message FROM v1_test")
def label_stripped(spark, d):
    return table(spark, d, "v1_test").select("id", "problem", "correct_solution", F.array_join("conversation_history", "|").alias("history"), "candidate_message").distinct()


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, ceil(count(*) OVER () / 6)::BIGINT AS per FROM orders) SELECT pos // per AS batch, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM p GROUP BY ALL")
def chunk_files(spark, d):
    path = _scratch(spark, "chunks")
    jsonl.write_chunks(table(spark, d, "orders").select("o_orderkey"), path, 6, [c("o_orderkey")])
    return spark.read.schema("o_orderkey bigint, batch bigint").json(path).groupBy("batch").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT 1 AS attempt, true AS written, count(*) AS n FROM region UNION ALL SELECT 2, false, count(*) FROM region UNION ALL SELECT 3, true, count(*) FROM nation")
def write_once(spark, d):
    """A first write, a second that finds the table there, a third that is forced; and the rows after each."""
    path = _scratch(spark, "once")
    first, second = table(spark, d, "region").select(c("r_name").alias("name")), table(spark, d, "nation").select(c("n_name").alias("name"))
    rows = []
    for attempt, (df, force) in enumerate([(first, False), (second, False), (second, True)], 1):
        written = jsonl.write_once(df, path, force)
        rows.append((attempt, written, jsonl.read_jsonl(spark, path, first.schema).count()))
    return spark.createDataFrame(rows, "attempt int, written boolean, n bigint")


@query(f"WITH {GOLD} SELECT g.id, coalesce(r.raw, '') AS raw FROM gold g LEFT JOIN (SELECT id, min(gold_reasoning) AS raw FROM v1_test WHERE slice = 'core' GROUP BY id) r USING (id)")
def replayed_outputs(spark, d):
    raw = table(spark, d, "v1_test").where("slice = 'core'").groupBy("id").agg(F.min("gold_reasoning").alias("raw"))
    return gold(spark, d).select("id").join(raw, "id", "left").select("id", T.text_or_empty(c("raw")).alias("raw"))


@query(f"WITH t AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) SELECT i AS id, n_name, {VERDICT_LIST}[i % 5 + 1] AS label FROM (SELECT unnest(range(1000)) AS i) JOIN t ON i % 25 = k")
def generated_cycle(spark, d):
    return generators.cycle(spark, 1000, table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", VERDICTS).select("id", "n_name", "label")


@query("""WITH e AS (SELECT user_id % 8 AS log, event_id, event_id % 1000 AS iteration, CASE WHEN event_id % 5 = 0 THEN 'Val' ELSE 'Train' END AS kind, ((event_id % 1000) / 8.0)::DOUBLE AS loss FROM events),
r AS (SELECT *, CASE WHEN iteration < lag(iteration) OVER (PARTITION BY log ORDER BY event_id) THEN 1 ELSE 0 END AS reset FROM e), k AS (SELECT *, sum(reset) OVER (PARTITION BY log ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM r),
b AS (SELECT log, run FROM (SELECT log, run, row_number() OVER (PARTITION BY log ORDER BY count(*) DESC, run) AS rn FROM k GROUP BY log, run) WHERE rn = 1)
SELECT log::VARCHAR AS log, kind, iteration, loss FROM k JOIN b USING (log, run)""")
def training_log(spark, d):
    """The longest run of each of eight logs, written as text with lines in between that say nothing."""
    path = _scratch(spark, "train")
    e = table(spark, d, "events").select("event_id", (c("user_id") % 8).alias("log"), (c("event_id") % 1000).alias("iteration"))
    said = F.concat(F.lit("Iter "), "iteration", F.when(c("event_id") % 5 == 0, ": Val loss ").otherwise(": Train loss "), (c("iteration") / 8).cast("string"))
    lines = e.withColumn("value", F.when(c("event_id") % 7 == 0, F.concat(F.lit("saved\n"), said)).otherwise(said))
    lines.repartition(8, "log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(path)
    best = logs.longest_run(logs.read_losses(spark, path))
    return best.select(F.regexp_extract("file", r"log=(\d+)", 1).alias("log"), "kind", c("iteration").cast("bigint").alias("iteration"), "loss")


@query(f"""{WITH_PREDS}, {_LEAK_SQL}, m AS (SELECT model, {_LEAK_COLS} FROM l)
SELECT model, printf('%.1f%%', round_even(accuracy * 100, 1)) AS accuracy, printf('%+.3f', round_even(recall - precision, 3)) AS gap, printf('%.2f [%.2f,%.2f]', round_even(f1, 2), round_even(precision, 2), round_even(recall, 2)) AS cell FROM m""")
def formatted_report(spark, d):
    """Cells of a report."""
    m = binary_prf(spark, d)
    return m.select("model", reports.percent(c("accuracy")).alias("accuracy"), reports.signed(c("recall") - c("precision")).alias("gap"), reports.interval_cell(c("f1"), c("precision"), c("recall")).alias("cell"))


@query(f"WITH {_REC}, k AS (SELECT verdict, id, coalesce(candidate_message, '') AS t, row_number() OVER (PARTITION BY verdict ORDER BY id) AS rn FROM r) SELECT verdict, string_agg(t, chr(10) || '---' || chr(10) ORDER BY id) AS pack FROM k WHERE rn <= 3 GROUP BY verdict")
def exemplar_packs(spark, d):
    return reports.exemplar_pack(_records(spark, d).select("verdict", "id", "candidate_message"), "verdict", "id", T.text_or_empty(c("candidate_message")), 3)
