"""Connected components of an edge table by alternating star contraction, one shuffle of narrow rows a step.

Each round links every node's larger neighbours to its smallest one, then every node to the smallest of the nodes that
it links to (large star, small star), until nothing changes; the number of rounds grows with the logarithm of the number
of nodes. Rounds are written to the shared folder, so that lineage stays short. Minima are combined ahead of the
shuffle, and the edges of a node with very many are dealt to several tasks, each with a copy of the node's minimum.

Defined cases: edges with a null end and those of a node to itself are no edges; repeated edges count once; ids may be any
64-bit numbers; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import materialise, spread_join


def _least(links: DataFrame) -> DataFrame:
    """Each node's smallest parent."""
    return links.groupBy("n").agg(F.min("p").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of an edge; nodes without edges have no row."""
    own = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b")
    # Kept as (node, parent) with parent < node.
    links = materialise(own.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("p")).distinct(), "links")
    state = _state(links)
    while state["n"]:
        # Large star: for every node, its larger neighbours go to the smallest of it and its neighbours.
        least = _least(links)
        hubs = links.groupBy("p").agg(F.count(F.lit(1)).alias("_edges")).withColumnRenamed("p", "_n")
        # A node that is nobody's parent meets no edge; one without a parent stands for itself.
        met = hubs.join(least, hubs["_n"] == least["n"], "left").select(F.col("_n").alias("n"), "m", "_edges")
        large = spread_join(links.select(F.col("p").alias("n"), F.col("n").alias("big")), met, "n", "_edges", state["n"])
        large = large.select(F.col("big").alias("n"), F.coalesce("m", "n").alias("p")).unionByName(least.select("n", F.col("m").alias("p"))).where("n > p").distinct()
        # Small star: for every node, its smaller neighbours go to the smallest of them.
        large = materialise(large, "links")
        least = large.groupBy("n").agg(F.min("p").alias("m"), F.count(F.lit(1)).alias("_edges"))
        small = spread_join(large, least, "n", "_edges", large.count()).select(F.col("p").alias("n"), F.col("m").alias("p")).where("n > p")
        links = materialise(small.unionByName(_least(large).select("n", F.col("m").alias("p"))).distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    nodes = links.select(F.col("n").alias("node"), F.col("p").alias("component"))
    return nodes.unionByName(links.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())


def _state(links: DataFrame):
    """How many links there are, and a sum that changes with them."""
    return links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("n", "p").cast("decimal(38,0)")).alias("h")).first()
