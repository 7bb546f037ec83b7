"""Consensus, calibrated samples, related splits, and the registered queries against DuckDB."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebed.llm import queries as Q
from sluicebed.llm.calibrated_sample import draw, newton_tilt, pivotal, sampling_plan
from sluicebed.llm.consensus import consensus, contradicted_majorities
from sluicebed.llm.problem_key import problem_key
from sluicebed.llm.related_splits import assign_splits, id_origin, related_groups, split_report
from sluicebed.llm.verdicts import VERDICTS, named_label

from ..duck import DATA, assert_same, connection


@pytest.mark.parametrize("text, label", [("adequate", "adequate"), (" Gives-away KEY step\n", "gives_away_key_step"), ('{"verdict": "vague_unhelpful"}', "vague_unhelpful"), ("**adequate**.", "adequate"), ("inadequate", None), ("adequate or vague_unhelpful", None), ("gives", None), ("", None), (None, None)])
def test_named_label(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(named_label(F.col("t")).alias("l")).first().l == label


def simulated(seed, n=600):
    """Votes of annotators of known accuracy."""
    rng = random.Random(seed)
    skill = {"good": 0.95, "fine": 0.8, "weak": 0.5, "noise1": 0.2, "noise2": 0.2}
    truth, rows = {}, []
    for i in range(n):
        t = truth[f"i{i}"] = rng.choice(VERDICTS)
        votes = {a: t if rng.random() < p else rng.choice(VERDICTS) for a, p in skill.items() if rng.random() < 0.9}
        rows.append((f"i{i}", votes))
    return truth, rows


def test_consensus_beats_majority(spark):
    truth, rows = simulated(1)
    items, annotators = consensus(spark.createDataFrame(rows, "id string, votes map<string,string>"), "id", "votes")
    got = {r.id: r for r in items.collect()}
    weighted = sum(got[i].label == t for i, t in truth.items() if i in got)
    plain = sum(got[i].plurality == t for i, t in truth.items() if i in got)
    assert weighted > plain and weighted > 0.93 * len(got)
    r = {x.annotator: x for x in annotators.collect()}
    assert r["good"].reliability > r["fine"].reliability > r["weak"].reliability > max(r["noise1"].reliability, r["noise2"].reliability, 0)


def test_consensus_edges(spark):
    rows = [
        ("a", {"x": "adequate", "y": "Adequate", "z": "vague_unhelpful"}, "vague_unhelpful", 1),
        ("a", {"x": "adequate", "y": "Adequate", "z": "vague_unhelpful"}, "vague_unhelpful", 1),
        ("tie", {"x": "adequate", "y": "vague_unhelpful"}, None, 1),
        ("one", {"x": "adequate"}, None, 1),
        ("null", None, None, 1),
        ("bad", {"x": "??", "y": None}, None, 1),
        ("both", {"x": "adequate"}, "adequate", 1),
        ("both", {"x": "vague_unhelpful", "y": "adequate"}, "adequate", 1),
        (None, {"x": "adequate"}, None, 1),
    ]
    df = spark.createDataFrame(rows, "id string, votes map<string,string>, majority string, label int")
    items, annotators = consensus(df, "id", "votes")
    got = {r.id: r for r in items.collect()}
    assert set(got) == {"a", "tie", "one", "both"} and got["tie"].plurality is None and got["tie"].agreement == 0 and got["one"].agreement is None
    assert got["a"].plurality == "adequate" and got["a"].n_votes == 3 and got["both"].n_votes == 1
    assert [(r.id, r.label) for r in contradicted_majorities(df, "id", "majority", items).collect()] == [("a", "adequate")]
    assert {r.annotator for r in annotators.collect()} == {"x", "y", "z"}
    none, nobody = consensus(df.limit(0), "id", "votes")
    assert none.count() == 0 and nobody.count() == 0


def reliabilities(spark, rows):
    _, annotators = consensus(spark.createDataFrame(rows, "id string, votes map<string,string>"), "id", "votes")
    return {r.annotator: r.reliability for r in annotators.collect()}


def test_opposed_annotators(spark):
    rng = random.Random(3)
    pairs = [rng.sample(VERDICTS, 2) for _ in range(100)]
    two = reliabilities(spark, [(f"i{k}", {"a": x, "b": y}) for k, (x, y) in enumerate(pairs)])
    assert two["a"] <= 0 and two["b"] <= 0
    three = reliabilities(spark, [(f"i{k}", {"a": x, "b": x, "c": y}) for k, (x, y) in enumerate(pairs)])
    assert three["a"] > 0.5 and three["b"] > 0.5 and three["c"] < 0
    apart = reliabilities(spark, [("i", {"a": "adequate"}), ("j", {"b": "adequate"})])
    assert apart == {"a": None, "b": None}


def test_reliabilities_are_those_of_the_leading_eigenvector(spark, monkeypatch):
    from sluicebed.llm import consensus as C

    _, rows = simulated(4, n=200)
    votes = C.usable_votes(spark.createDataFrame(rows, "id string, votes map<string,string>"), "id", "votes")
    entries = C.agreement_matrix(votes).collect()
    names = sorted({r.i for r in entries})
    m = np.zeros((len(names), len(names)))
    for r in entries:
        m[names.index(r.i), names.index(r.j)] = r.c
    np.fill_diagonal(m, np.maximum(np.where(np.eye(len(names)) == 1, -np.inf, m).max(axis=1), 0))
    values, vectors = np.linalg.eigh(m)
    want = vectors[:, -1] * np.sqrt(values[-1]) * np.sign(vectors[:, -1].sum())
    got = {r.annotator: r.reliability for r in C.spectral_reliability(votes).collect()}
    assert np.allclose([got[n] for n in names], want, atol=1e-4)
    monkeypatch.setattr(C, "_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        C.spectral_reliability(votes)


def test_newton_and_pivotal():
    counts, wanted = np.array([100.0, 40.0, 7.0]), np.array([10.0, 20.0, 6.0])
    assert np.allclose(newton_tilt(counts, wanted, 0.2) * counts, wanted)
    far, few = np.array([1e9, 3.0, 1.0, 5e6]), np.array([1.0, 900.0, 1e6, 5e6])
    assert np.allclose(newton_tilt(far, few, 1e-4) * far, few)
    margins = np.array([[1, 0, 1.0], [1, 0, 0], [0, 1, 1.0]])
    p = newton_tilt(counts, np.array([30.0, 5.0, 20.0]), 0.2, margins)
    assert np.allclose(margins.T @ (p * counts), [30, 5, 20], atol=1e-5)
    rng = np.random.default_rng(0)
    hits = np.zeros(6)
    pi = np.array([0.2, 0.5, 0.5, 0.8, 0.6, 0.4])
    for _ in range(4000):
        out = pivotal(pi, rng.random(6))
        assert abs(out.sum() - 3) < 1e-9 and set(np.round(out, 9)) <= {0.0, 1.0}
        hits += out
    assert np.abs(hits / 4000 - pi).max() < 0.03


def test_calibrated_sample(spark):
    rng = random.Random(2)
    rows = [(f"r{i:05d}", rng.choices(["x", "y", "z", None], [70, 20, 1, 5])[0]) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:50] + [(None, "x")], "id string, c string").withColumns({"target_share": F.lit(1), "_u": F.lit(2)})
    targets = spark.createDataFrame([("x", 0.5, 1, "e"), ("y", 0.3, 1, "e"), ("z", 0.2, 10, "e"), ("none", None, 2, "e"), ("y", 0.3, 1, "f")], "c string, target_share double, min_rows int, id string")
    records, plan = sampling_plan(df, "id", {"c": F.col("c")}, targets, 0.1)
    size = {p["c"]: (p["wanted"], p["taken"], p["gap"]) for p in plan}
    n_z = sum(c == "z" for _, c in rows)
    assert size == {"x": (150, 150, 0), "y": (90, 90, 0), "z": (60, n_z, 60 - n_z), "none": (2, 0, 2)}
    for block in (7, 100_000):
        sample = draw(records, plan, ["c"], "s", block).collect()
        got = {}
        for r in sample:
            got[r.c] = got.get(r.c, 0) + 1
        assert got == {"x": 150, "y": 90, "z": n_z} and len({r.id for r in sample}) == len(sample)
    empty, plan = sampling_plan(df.limit(0), "id", {"c": F.col("c")}, targets, 0.1)
    assert all(p["available"] == 0 for p in plan) and draw(empty, plan, ["c"]).count() == 0
    assert sampling_plan(df, "id", {"c": F.col("c")}, targets.limit(0), 0.1)[1] == []


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Nela buys 25 boxes at 5 cm.", "Problem:  nela buys twenty-five boexs at five centimetres!", True),
        ("Find 8400 - 47.", "The question is: Find 8400 - forty-seven.", True),
        ("Take 19 percent of 5000.", "Q. take nineteen per cent of 5,000", True),
        ("A wall is 44 cm long.", "A wall is 44cm long", True),
        ("Find 8400 - 47.", "Find 8400 + 47.", False),
        ("Nela buys 25 boxes.", "Nela buys 26 boxes.", False),
        ("Nela buys 25 boxes.", "Vera buys 25 boxes.", False),
        ("It costs two hundred and five coins.", "It costs 205 coins.", True),
        ("Take 30 of the 25 cm and 17 more.", "Take thrity of the twetny-five cnetimeters and sevneteen more.", True),
        ("There are three.", "There are 3.", True),
        ("There are 3.", "Three are 3.", False),
        ("It costs 12 and 5 coins.", "It costs twelve and five coins.", True),
    ],
)
def test_problem_key(a, b, same):
    assert (problem_key(a) == problem_key(b)) is same


@pytest.mark.parametrize("key, origin", [("mrb-12-a-M1", "mrb-12-a"), ("mrb-12-a-M1-r2", "mrb-12-a"), ("mathdial-9-3", "mathdial-9"), ("exp-adv-7b", "exp-adv-7"), ("exp-adv-7a-r2", "exp-adv-7"), ("gsm8k-12-r2", "gsm8k-12"), ("v1-35-001", "v1-35-001")])
def test_id_origin(key, origin):
    assert id_origin(key) == origin


def test_related_groups(spark):
    rows = [
        ("mrb-1-A", "Nela has 3 boxes."), ("mrb-1-B", "Vera has 4 boxes."), ("gsm8k-1", "vera has four boxes"), ("gsm8k-1-r2", "Other text 9."),
        ("v1-1", "Lone 77."), ("v1-2", "lone 77"), ("v1-3", None), ("v1-4", " "), ("v1-3-r2", None), (None, "Lone 77."), ("v1-1", "Lone 77."), ("v1-9", "Solo 1."), ("v1-9", "Solo 1."),
    ]
    df = spark.createDataFrame(rows, "id string, problem string").withColumns({"pkey": F.lit(1), "origin": F.lit(2), "label": F.lit(3)})
    got = {r.id: (r.group_id, r.n_problems) for r in related_groups(df, "id", "problem").collect()}
    assert got == {"mrb-1-A": ("gsm8k-1", 2), "mrb-1-B": ("gsm8k-1", 2), "gsm8k-1": ("gsm8k-1", 2), "gsm8k-1-r2": ("gsm8k-1", 2), "v1-1": ("v1-1", 2), "v1-2": ("v1-1", 2), "v1-3": ("v1-3", 0), "v1-3-r2": ("v1-3", 0), "v1-4": ("v1-4", 1), "v1-9": ("v1-9", 1)}
    assert related_groups(df.limit(0), "id", "problem").count() == 0


def test_split_shares(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v1-x-"), "id").alias("id"), F.concat(F.lit("Count "), "id").alias("problem"))
    out = assign_splits(df, "id", "problem")
    report = {r.split: r.share for r in split_report(out).collect()}
    assert abs(report["train"] - 0.8) < 0.02 and abs(report["validation"] - 0.1) < 0.02 and abs(report["test"] - 0.1) < 0.02
    few = {r.id: r.split for r in assign_splits(df.limit(500), "id", "problem").collect()}
    assert few.items() <= {r.id: r.split for r in out.collect()}.items()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, DATA)
    sql = Q.oracle_sql().get(name)
    if sql:
        assert_same(df, con, sql)
    else:
        rows = df.collect()
        assert len(rows) == len(set(map(str, rows)))
