"""Consensus labels, agreement and annotator reliability from several annotators' votes.

Method: spectral reliability. For every two annotators the share of equal votes on the items both
judged is centred by the agreement expected by chance and damped by how few those items are. The
leading eigenvector of that matrix, found by power iteration with joins over its non-empty entries,
says how well each annotator agrees with the common opinion, and its entries weight the votes.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import release, settle
from .verdicts import VERDICTS, named_label

#: Overlaps of about this many items are damped to half.
OVERLAP_PRIOR = 10
_STEPS, _ROUNDS, _TOLERANCE = 6, 80, 1e-6


def usable_votes(df: DataFrame, id_column: str, votes_column: str, labels: list[str] = VERDICTS) -> DataFrame:
    """(id, annotator, label): one row per usable vote; ``votes_column`` is a map annotator -> vote.

    Null ids, null maps and votes that do not name exactly one label are left out. Repeated rows count
    once; votes of one annotator on one item that contradict each other are not usable.
    """
    votes = df.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.explode(F.col(f"`{votes_column}`")).alias("annotator", "vote")).where("id is not null")
    named = votes.select("id", "annotator", named_label(F.col("vote"), labels).alias("label")).where("label is not null")
    return named.groupBy("id", "annotator").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "annotator", "label")


def agreement_matrix(votes: DataFrame, prior: float = OVERLAP_PRIOR) -> DataFrame:
    """The chance-centred agreement of annotators: (i, j, c, n), both directions.

    An item with v votes gives v * (v - 1) / 2 pairs, which are added up before any shuffle.
    """
    totals = votes.groupBy("annotator").agg(F.count("*").alias("n"))
    rates = votes.groupBy("annotator", "label").agg(F.count("*").alias("k")).join(totals, "annotator").select("annotator", "label", (F.col("k") / F.col("n")).alias("p"))
    a = votes.select("id", F.col("annotator").alias("i"), F.col("label").alias("li"))
    b = votes.select("id", F.col("annotator").alias("j"), F.col("label").alias("lj"))
    met = a.join(b, "id").where("i < j").groupBy("i", "j").agg(F.count("*").alias("n"), F.sum((F.col("li") == F.col("lj")).cast("long")).alias("agree"))
    ri = rates.select(F.col("annotator").alias("i"), "label", F.col("p").alias("pi"))
    rj = rates.select(F.col("annotator").alias("j"), "label", F.col("p").alias("pj"))
    chance = met.select("i", "j").join(ri, "i").join(rj, ["j", "label"]).groupBy("i", "j").agg(F.sum(F.col("pi") * F.col("pj")).alias("pe"))
    centred = F.when(F.col("pe") < 1, (F.col("agree") / F.col("n") - F.col("pe")) / (1 - F.col("pe"))).otherwise(F.lit(0.0))
    one = met.join(chance, ["i", "j"], "left").withColumn("pe", F.coalesce("pe", F.lit(0.0))).select("i", "j", (centred * F.col("n") / (F.col("n") + F.lit(float(prior)))).alias("c"), "n")
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "c", "n"))


def spectral_reliability(votes: DataFrame, prior: float = OVERLAP_PRIOR, strict: bool = True) -> DataFrame:
    """(annotator, n_votes, reliability): the leading eigenvector, scaled so that the agreement of two
    annotators is about the product of their reliabilities; null for those who share no item.

    By its row sums no eigenvalue is below some -g. The matrix is shifted by g / 2, so that the iteration
    leads to the largest one, never to a large negative one, which is disagreement. The majority of
    the weight counts as right, the rest gets negative reliabilities. All are 0 if no common opinion
    exists or if the annotators split into two equal camps, of which either may be right. If the
    iteration has not settled after ``_STEPS`` * ``_ROUNDS`` steps, it is an error, or unless ``strict`` a warning.
    """
    pairs = settle(agreement_matrix(votes, prior), "agreement")
    # The diagonal is not observed; as in factor analysis the largest entry of the row stands for it.
    own = pairs.groupBy("i").agg(F.greatest(F.max("c"), F.lit(0.0)).alias("c"), F.sum(F.abs("c")).alias("row"))
    bounds = own.agg(F.max(F.col("row") + F.col("c")).alias("top"), F.max(F.col("row") - F.col("c")).alias("g")).first()
    top, shift = bounds.top or 0.0, max(bounds.g or 0.0, 0.0) / 2
    matrix = settle(pairs.select("i", "j", "c").unionByName(own.select("i", F.col("i").alias("j"), (F.col("c") + F.lit(shift)).alias("c"))), "matrix")
    # Not all entries alike at the start: a vector without a share of the leading one would never find it.
    x = settle(own.select("i", (F.lit(1.0) + F.pmod(F.xxhash64("i"), F.lit(1000)) / 10_000).alias("x")), "vector")
    value, settled = 0.0, top == 0
    for _ in range(_ROUNDS if top else 0):
        y = x
        for _ in range(_STEPS):
            y = matrix.join(y.withColumnRenamed("i", "j"), "j").groupBy("i").agg((F.sum(F.col("c") * F.col("x")) / F.lit(top + shift)).alias("x"))
        # after the steps the vector has grown by the shifted eigenvalue, over its bound, to the power of their number
        y = settle(y.select("i", F.col("x").alias("raw")).join(x, "i"), "vector")
        s = y.agg(F.sum(F.col("raw") * F.col("raw")).alias("yy"), F.sum(F.col("raw") * F.col("x")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx")).first()
        release(x)
        x = y.select("i", (F.col("raw") / F.lit(math.sqrt(s.yy))).alias("x"))
        x.settled_path = y.settled_path
        value = (s.xy / s.xx) ** (1 / _STEPS) * (top + shift) - shift
        settled = 1 - s.xy / math.sqrt(s.yy * s.xx) < _TOLERANCE**2
        if settled:
            break
    if not settled:
        told = f"the reliabilities have not settled after {_STEPS * _ROUNDS} steps"
        if strict:
            raise RuntimeError(told)
        warnings.warn(told)
    both = x.agg(F.sum("x").alias("total"), F.sum(F.abs("x")).alias("size")).first()
    one_sided = both.size is not None and abs(both.total) > 1e-3 * both.size
    factor = math.copysign(math.sqrt(max(value, 0.0)), both.total) if one_sided and value > 1e-9 * top else 0.0
    counts = votes.groupBy("annotator").agg(F.count("*").alias("n_votes"))
    found = x.select(F.col("i").alias("annotator"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x") * F.lit(factor))).alias("reliability"))
    return counts.join(found, "annotator", "left").select("annotator", "n_votes", "reliability")


def vote_weight(reliability, n_labels: int):
    """The log-odds of a vote being right, if a reliability r means right in 1/K + (1 - 1/K) r of cases."""
    p = F.greatest(F.lit(1 / n_labels), F.least(F.lit(0.99), F.lit(1 / n_labels) + F.lit(1 - 1 / n_labels) * reliability))
    return F.when(reliability.isNull(), F.lit(1.0)).otherwise(F.log(F.lit(float(n_labels - 1)) * p / (1 - p)))


def consensus(df: DataFrame, id_column: str, votes_column: str, labels: list[str] = VERDICTS, prior: float = OVERLAP_PRIOR, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items, annotators).

    items (id, label, share, n_votes, agreement, plurality, plurality_votes): ``label`` has the largest
    sum of weights (ties: more votes, then the order of ``labels``), ``share`` is its part of the
    weights, ``agreement`` the share of equal pairs among the votes (null for a single vote),
    ``plurality`` the label with more votes than any other (null on a tie). Items without a usable vote
    are left out. annotators (annotator, n_votes, reliability, weight, n_with_consensus). ``strict`` is
    that of ``spectral_reliability``.
    """
    votes = settle(usable_votes(df, id_column, votes_column, labels), "votes")
    rated = settle(spectral_reliability(votes, prior, strict).withColumn("weight", vote_weight(F.col("reliability"), len(labels))), "annotators")
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    per_label = votes.join(rated.select("annotator", "weight"), "annotator").groupBy("id", "label").agg(F.round(F.sum("weight"), 9).alias("w"), F.count("*").alias("n"))
    best = F.max(F.struct("w", "n", (-order).alias("o"), "label"))
    most = F.max("n")
    tops = F.max(F.struct("n", "label"))
    items = per_label.groupBy("id").agg(best.alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n_votes"), F.sum(F.col("n") * (F.col("n") - 1)).alias("equal"), most.alias("most"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"), tops.alias("t"))
    items = items.select(
        "id",
        F.col("b.label").alias("label"),
        F.coalesce(F.try_divide("b.w", "w"), F.lit(1.0)).alias("share"),
        "n_votes",
        F.when(F.col("n_votes") > 1, F.col("equal") / (F.col("n_votes") * (F.col("n_votes") - 1))).alias("agreement"),
        F.when((F.size("ns") == 1) | (F.col("ns")[0] > F.try_element_at("ns", F.lit(2))), F.col("t.label")).alias("plurality"),
        F.col("most").alias("plurality_votes"),
    )
    items = settle(items, "items")
    same = votes.join(items.select("id", F.col("label").alias("chosen")), "id").groupBy("annotator").agg(F.sum((F.col("label") == F.col("chosen")).cast("long")).alias("n_with_consensus"))
    return items, rated.join(same, "annotator", "left").select("annotator", "n_votes", "reliability", "weight", "n_with_consensus")


def contradicted_majorities(df: DataFrame, id_column: str, majority_column: str, items: DataFrame, labels: list[str] = VERDICTS, least_votes: int = 2) -> DataFrame:
    """(id, label) where a label leads with at least ``least_votes`` votes and the record says otherwise."""
    said = df.select(F.col(f"`{id_column}`").cast("string").alias("id"), named_label(F.col(f"`{majority_column}`"), labels).alias("said")).groupBy("id").agg(F.min("said").alias("said"))
    led = items.where((F.col("plurality_votes") >= least_votes) & F.col("plurality").isNotNull())
    return led.join(said, "id").where(~F.col("said").eqNullSafe(F.col("plurality"))).select("id", F.col("plurality").alias("label"))
