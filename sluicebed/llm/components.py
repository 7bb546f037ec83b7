"""Connected components by hash-to-min.

Every node keeps a cluster of nodes, at first itself and its neighbours. In each round a node sends
its whole cluster to the smallest node in it, and that smallest node to all others of the cluster,
until nothing changes; then every node knows the smallest node of its component. Clusters are rows
(node, member), never collected values, so a component may hold any share of the graph. The cluster
of its smallest node is then one key of a join with a single row, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import release, settle


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of edges (u, v) of one comparable type; label is the smallest node.

    Loops, repeated edges and either direction are fine; rows with a null end are ignored; no edges
    give no rows. Raises if the components have not settled after ``max_rounds`` rounds.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null")
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    loops = edges.select("u", F.col("u").alias("v")).unionByName(edges.select(F.col("v").alias("u"), "v"))
    clusters = settle(edges.unionByName(flipped).unionByName(loops).distinct(), "clusters")
    before = None
    for _ in range(max_rounds):
        least = clusters.groupBy("u").agg(F.min("v").alias("m"))
        sent = clusters.join(least, "u").select("v", "m")
        nodes = sent.select(F.col("m").alias("u"), "v").unionByName(sent.select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, clusters = clusters, settle(nodes.distinct(), "clusters")
        release(last)
        now = clusters.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            return clusters.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
        before = now
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
