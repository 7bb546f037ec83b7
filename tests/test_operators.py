"""Semantics that the test tables do not show: nulls, ties, empty tables, reruns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebed.functions import jsonx, text as T, verdicts as V
from sluicebed.operators import changes, dedup, joins, loops, metrics, sampling, votes
from sluicebed.plans.lineage import settle
from sluicebed.sources import jsonl, logs, reports


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, verdict, errors",
    [
        ('{"verdict": "adequate", "reasoning": "ok", "rewritten_message": null}', "adequate", []),
        ('<think>{"verdict"</think> Sure {"verdict": "adequate", "reasoning": "a}b", "rewritten_message": null} bye', "adequate", []),
        ('{"verdict": "adequate", "reasoning": "ok"}', "adequate", ["no rewrite key"]),
        ('{"verdict": "adequate", "reasoning": 5, "rewritten_message": "x"}', "adequate", ["no reasoning", "rewrite of an adequate message"]),
        ('{"verdict": "vague_unhelpful", "reasoning": "r", "rewritten_message": " "}', "vague_unhelpful", ["no rewrite"]),
        ('{"verdict": "adequate", "reasoning": "r", "rewritten_message": null, "more": 1}', "adequate", ["unexpected keys"]),
        ('{"verdict": "adequate", "reasoning": "r"', None, ["not an object"]),
        ("[1, 2]", None, ["not an object"]),
        ("no json", None, ["not an object"]),
        (None, None, ["not an object"]),
    ],
)
def test_json_salvage(spark, raw, verdict, errors):
    assert one(spark, raw, lambda c: jsonx.field_text(jsonx.parsed_variant(c), "verdict")) == verdict
    assert one(spark, raw, jsonx.output_errors) == errors


@pytest.mark.parametrize("text, literal, found", [("it is 13.", "13", True), ("213", "13", False), ("x 2(x+1) y", "2(x+1)", True), ("13", "", False), (None, "13", False), ("13", None, False), ("a.b", "a?b", False)])
def test_bounded_literal(spark, text, literal, found):
    row = spark.createDataFrame([(text, literal)], "t string, l string").select(T.holds_literal(F.col("t"), F.col("l")).alias("y")).first()
    assert row.y is found


def test_history_helpers(spark):
    df = spark.createDataFrame([(["Student: a", "Tutor: b"],), ([],), (None,), ([None],)], "h array<string>")
    assert [r.y for r in df.select(T.last_role(F.col("h")).alias("y")).collect()] == ["tutor", "none", "none", "other"]
    assert one(spark, ["a", "b"], lambda c: T.last_turns(c, 4), "array<string>") == ["a", "b"]


def test_tiers_and_null_rules(spark):
    df = spark.createDataFrame([("adequate", "adequate"), ("gives_final_answer", "gives_away_key_step"), ("adequate", None), ("adequate", "odd"), ("vague_unhelpful", "gives_final_answer")], "gold string, pred string")
    assert [r.t for r in df.select(V.verdict_tier(F.col("gold"), F.col("pred")).alias("t")).collect()] == [2, 1, 0, 0, 0]
    m = metrics.leak_metrics(df, []).first()
    assert (m.n, m.tp, m.fp, m.fn) == (5, 1, 1, 0)
    r = metrics.rescored_metrics(df, []).first()
    assert r.two_way == 3 / 5  # the null prediction is wrong here


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id string, gold string, pred string")
    assert metrics.leak_metrics(none, ["id"]).count() == 0
    assert metrics.kappa(none, ["id"], "gold", "pred").count() == 0
    assert sampling.three_way_split(none.select("id"), "id", "0").count() == 0
    assert sampling.downsample(none, "gold", "id", "0").count() == 0
    assert metrics.bootstrap_interval(spark.createDataFrame([], "v int, n bigint"), "v", 50, "0").first().mean is None


def test_binomial_quantiles_equal_brute_force():
    for n, p in [(1, 0.5), (7, 0.2), (40, 0.93), (300, 0.001)]:
        mass = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        u = (np.arange(500) + 0.5) / 500
        assert list(metrics.binomial_quantiles(n, p, u)) == [int(np.argmax(mass >= x)) for x in u]
    assert list(metrics.binomial_quantiles(9, 0.0, u[:2])) == [0, 0] and list(metrics.binomial_quantiles(9, 1.0, u[:2])) == [9, 9]
    assert abs(metrics.binomial_quantiles(10**9, 0.3, np.array([0.5]))[0] - 3 * 10**8) < 3


def test_bootstrap_is_that_of_single_picks(spark):
    values = np.repeat([-2.0, 0.0, 1.0, 2.0], [30, 200, 120, 50])
    counts = spark.createDataFrame([(-2, 30), (0, 150), (0, 50), (1, 120), (2, 50), (None, 7), (5, 0)], "v int, n bigint")
    got = metrics.bootstrap_interval(counts, "v", 4000, "s").first()
    means = np.sort(np.random.default_rng(1).choice(values, (4000, 400)).mean(axis=1))
    assert (got.mean, got.n) == (values.mean(), 400)
    assert abs(got.low - means[100]) < 0.02 and abs(got.high - means[3900]) < 0.02 and got.low < got.mean < got.high
    one = metrics.bootstrap_interval(spark.createDataFrame([(3, 9)], "v int, n bigint"), "v", 20, "s").first()
    assert (one.mean, one.low, one.high, one.n) == (3.0, 3.0, 3.0, 9)
    huge = metrics.bootstrap_interval(spark.createDataFrame([(0, 3 * 10**9), (1, 10**9)], "v int, n bigint"), "v", 200, "s").first()
    assert huge.low < 0.25 < huge.high and huge.high - huge.low < 1e-4


@pytest.mark.parametrize("n, sizes", [(1, (0, 0, 1)), (2, (1, 0, 1)), (3, (1, 1, 1)), (10, (8, 1, 1)), (101, (80, 10, 11))])
def test_split_sizes(spark, n, sizes):
    out = sampling.three_way_split(spark.range(n), "id", "0")
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "valid", "test")) == sizes


def test_positions_are_total(spark):
    rows = random.Random(1).sample(range(10_000), 777)
    got = sampling.ordered_positions(spark.createDataFrame([(r,) for r in rows], "x int").repartition(5), [F.col("x")]).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.pos)] == sorted(rows) and [r.pos for r in sorted(got, key=lambda r: r.pos)] == list(range(777))


def test_containment_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = ["aa", "b", "ccc", "dd dd", "e.", "ff"]
    needles = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 4)))) for i in range(40)] + [(40, None), (41, " "), (42, "a")]
    hay = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(60)] + [(60, None), (61, "")]
    got = dedup.contained_texts(spark.createDataFrame(needles, "k int, n string"), spark.createDataFrame(hay, "h int, t string"), "k", "n", "h", "t")
    want = {(k, h) for k, n in needles for h, t in hay if n and n.strip() and t and n in t}
    assert {(r.k, r.h) for r in got.collect()} == want


def test_overlay_is_idempotent(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, label string")
    change = spark.createDataFrame([("a", "n", False), ("b", None, True), ("q", "n", False)], "id string, new_label string, drop boolean")
    once = joins.overlay(base, change, "id", "label")
    assert {(r.id, r.label, r.stale) for r in once.collect()} == {("a", "n", True), ("c", "z", False)}
    twice = joins.overlay(once.drop("stale"), change, "id", "label")
    assert {(r.id, r.label) for r in twice.collect()} == {("a", "n"), ("c", "z")}
    assert changes.change_log(base, change, "id", "label").count() == 2


def test_consensus_ties_and_divisor(spark):
    v = spark.createDataFrame([("1", "a", "adequate"), ("1", "b", "adequate"), ("1", "c", None), ("1", "d", "x"), ("2", "a", "vague_unhelpful"), ("2", "b", "adequate")], "id string, model string, vote string")
    cur = spark.createDataFrame([("1", "adequate"), ("2", "adequate"), ("3", "adequate")], "id string, current string")
    got = {r.id: (r.majority, r.n_agree, r.category) for r in votes.strict_consensus(v, cur, "id", "vote").collect()}
    assert got == {"1": ("adequate", 2, "NO_CONSENSUS"), "2": ("adequate", 1, "NO_CONSENSUS"), "3": (None, 0, "NO_CONSENSUS")}


def test_consensus_of_all_models_asked(spark):
    v = spark.createDataFrame([("1", "a", "adequate"), ("1", "b", "adequate"), ("2", "a", "adequate")], "id string, model string, vote string")
    cur = spark.createDataFrame([("1", "vague_unhelpful"), ("2", "adequate"), ("3", None)], "id string, current string")
    got = {r.id: (r.n_models, r.category) for r in votes.strict_consensus(v, cur, "id", "vote", n_models=3).collect()}
    assert got == {"1": (3, "CHANGE"), "2": (3, "NO_CONSENSUS"), "3": (3, "NO_CONSENSUS")}


def test_scorer_failures(spark):
    def broken(pdf):
        if (pdf["x"] == 2).any():
            raise ValueError
        return pdf["x"] > 1

    df = spark.createDataFrame([(1,), (2,), (3,)], "x int").coalesce(1)
    assert {r.x: r.ok for r in loops.score(df, broken, "boolean", "ok", True).collect()} == {1: False, 2: True, 3: True}
    assert {r.x: r.ok for r in loops.score(df, broken, "boolean", "ok").collect()}[2] is None


def test_scorer_tries_again(spark, tmp_path):
    tries = tmp_path / "tries"
    tries.mkdir()

    def shaky(pdf):
        n = len(list(tries.iterdir()))
        (tries / str(n)).touch()
        if n < 2:
            raise ValueError
        return pdf["x"] * 2

    df = spark.createDataFrame([(1,), (2,)], "x int").coalesce(1)
    assert {r.x: r.y for r in loops.score(df, shaky, "integer", "y", retries=2, wait=0.01).collect()} == {1: 2, 2: 4}
    assert len(list(tries.iterdir())) == 3


def test_registry_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(loops, "MOST_MODELS", 1)
    models = spark.createDataFrame([("a", "k"), ("b", "k")], "model string, kind string")
    with pytest.raises(ValueError):
        loops.dispatch(spark.range(2), models, "kind", {"k": lambda t: t})


def test_containment_plan_has_no_nested_loop(spark):
    needles = spark.createDataFrame([(1, "one two three four")], "k int, n string")
    hay = spark.createDataFrame([(1, "x one two three four y")], "h int, t string")
    plan = dedup.contained_texts(needles, hay, "k", "n", "h", "t")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_settled_tables_go(spark):
    from sluicebed.plans import lineage

    one = settle(spark.range(5), "one")
    lineage.release(one)
    with lineage.settled_scope():
        two = settle(spark.range(5), "two")
        assert two.count() == 5
    for df in (one, two):
        assert not jsonl.exists(spark, df.settled_path)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from sluicebed.plans import lineage

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        lineage.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_first_hits_over_batches(spark, tmp_path):
    from sluicebed.plans.stream_queries import _STORE
    from sluicebed.streaming import feedback

    schema = "k string, t int, hit boolean"
    batches = [[("a", 1, False), ("a", 2, None), ("b", 1, True), ("c", 1, False)], [("a", 3, True), ("b", 2, True), ("c", 3, False), ("c", 2, False)], [("a", 4, True), ("c", 4, True)]]
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = feedback.first_hits(feedback.feedback_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "k", "t", "hit", most=3)
            feedback.run_available_totals(stream, f"{tmp_path}/out", f"{tmp_path}/mark")
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    got = {r.k: (r.turns, r.first_hit) for r in feedback.latest_totals(spark, f"{tmp_path}/out", ["k"]).collect()}
    assert got == {"a": (3, 3), "b": (1, 1), "c": (3, None)}


def test_files(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, v string").schema
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": "1", "v": "old"}\n\n{"id": "1", "v": "new"}\n{"id": "2"\nnoise\n')
    rows, bad = jsonl.read_tolerant(spark, f"file://{folder}", schema, "id", F.col("v").isNotNull())
    assert [(r.id, r.v) for r in rows.collect()] == [("1", "new")] and bad.first().n_bad == 2
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, f"file://{folder}", schema).collect()
    assert jsonl.newest(spark, f"file://{folder}", ".jsonl").endswith("a.jsonl") and jsonl.newest(spark, f"file://{tmp_path}/no") is None
    assert jsonl.read_existing(spark, [f"file://{tmp_path}/no"], schema).count() == 0
    target, keep = f"file://{tmp_path}/t", f"file://{tmp_path}/k"
    for value in ("1", "2", "3"):
        jsonl.replace_with_backup(spark.createDataFrame([(value, None)], schema), target, keep)
    assert jsonl.read_jsonl(spark, target, schema).first().id == "3" and jsonl.read_jsonl(spark, keep, schema).first().id == "1"
    blob = tmp_path / "r.json"
    for text in ('[{"id": "1", "pred": "a"}]', '{"items": [{"id": "1", "pred": "a"}]}', '{"n": 1, "per_item": [{"id": "1", "pred": "a"}]}'):
        blob.write_text(text)
        assert [(r.id, r.pred) for r in jsonl.result_items(spark, f"file://{blob}").collect()] == [("1", "a")]


def test_log_and_report(spark, tmp_path):
    (tmp_path / "x.log").write_text("Iter 1: Train loss 3\nIter 2: Val loss 2.5\nIter 1: Train loss 2\n")
    got = logs.longest_run(logs.read_losses(spark, f"file://{tmp_path}/x.log"))
    assert {(r.kind, r.iteration, r.loss) for r in got.collect()} == {("Train", 1, 3.0), ("Val", 2, 2.5)}
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert reports.markdown_table(df, ["a"]) == "| a | b |\n|---|---|\n| 1 |  |\n"


def test_settle_keeps_rows(spark):
    assert sorted(r.id for r in settle(spark.range(5), "t").collect()) == list(range(5))


def test_climb_stops():
    got = loops.climb(lambda i: i, lambda x: x in (0, 2), lambda: False)
    assert [h["accepted"] for h in got] == [True, False, True, False, False]
    assert loops.climb(lambda i: i, lambda x: True, lambda: True) == []


def test_common_prefix_of_long_texts(spark):
    a = "ü" * 70_000 + "x"
    row = spark.createDataFrame([(a, "ü" * 70_000 + "y"), ("", "a"), ("same", "same")], "a string, b string").select(T.common_prefix_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in row] == [70_000, 0, 4]


def test_positions_within_skewed_classes(spark):
    rows = [("big" if i % 10 else None, i) for i in range(500)]
    got = sampling.positions_within(spark.createDataFrame(rows, "k string, x int").repartition(6), ["k"], [F.col("x")]).collect()
    for key in ("big", None):
        mine = sorted((r.x, r.pos) for r in got if r.k == key)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_series_over_blocks(spark, monkeypatch):
    from sluicebed.operators import series

    monkeypatch.setattr(series, "BLOCK", 7)
    rng = random.Random(3)
    rows = [("hot" if i % 9 else f"k{i}", i, rng.randrange(10)) for i in range(300)]
    got = series.reset_runs(spark.createDataFrame(rows, "k string, t int, v int").repartition(5), ["k"], [F.col("t")], "v").collect()
    want, state = {}, {}
    for k, t, v in rows:
        last, run = state.get(k, (None, 0))
        run += last is not None and v < last
        state[k] = (v, run)
        want[(k, t)] = run
    assert {(r.k, r.t): r.run for r in got} == want
    assert series.reset_runs(spark.createDataFrame([], "k string, t int, v int"), ["k"], [F.col("t")], "v").count() == 0


def test_running_prefix_is_whole(spark):
    from sluicebed.operators import series

    df = spark.createDataFrame([("a", i, None if i == 3 else f"v{i}") for i in range(9)] + [("b", 1, "x")], "k string, i int, v string")
    got = {(r.k, r.i): r.history for r in series.running_prefix(df, ["k"], [F.col("i")], "v").collect()}
    values = [None if i == 3 else f"v{i}" for i in range(9)]
    assert got == {("a", i): values[:i] for i in range(9)} | {("b", 1): []}


def test_prefix_classes_by_the_whole_conversation(spark, tmp_path):
    from sluicebed.plans.join_queries import prefix_classes

    known = ["mrb-1180-90f-Gemini", "mrb-0005446-Mistral", "junk-a-1"]
    ids = {"mrb-1180-90f-Phi": "prefix", "mrb-1180-9-Phi": "prefix", "mrb-1180-777-Phi": "other", "mrb-0005-Phi": "prefix", "mrb-0005447-Phi": "other", "mrb-0005446x-Phi": "other", "mrb-0005446-Novice": "novice", "junk-a-1": "other"}
    spark.createDataFrame([(x,) for x in known], "id string").write.parquet(f"{tmp_path}/human_boundary.parquet")
    spark.createDataFrame([(x,) for x in ids] * 2, "id string").write.parquet(f"{tmp_path}/v1_b.parquet")
    assert sorted(map(tuple, prefix_classes(spark, str(tmp_path)).collect())) == sorted(ids.items())
