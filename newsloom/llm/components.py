"""Connected components of a graph in a table, by alternating star operations.

Every round links each node's neighbours to the smallest one that it sees, first over its
larger neighbours, then over its smaller ones, until nothing changes; the number of rounds
grows with the logarithm of the longest path. Edges are added up before they shuffle, and
each round is written to the shared folder, so that no lineage grows and none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import join_apart
from newsloom.session import materialize


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours."""
    return pairs.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("node", "other").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    return (
        join_apart(both, _smallest(both), "node")
        .filter("other > node")
        .select(F.col("other").alias("node"), F.col("least").alias("other"))
        .filter("node <> other")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    least = _smallest(down)
    moved = (
        join_apart(down, least, "node")
        .select(F.col("other").alias("node"), F.col("least").alias("other"))
        .unionByName(least.select("node", F.col("least").alias("other")))
    )
    return moved.filter("node <> other").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, least) for every node of `edges` (node, other) but the smallest of each
    component; `least` is the smallest node it can reach. Loops, doubled and turned edges
    count once; edges with a null end are left out. No edges give an empty result.
    """
    edges = edges.filter("node <> other")
    now = materialize(_small_star(edges), "stars")
    mark = _mark(now)
    while True:
        now = materialize(_small_star(_large_star(now)), "stars")
        new = _mark(now)
        if new == mark:
            return now.select("node", F.col("other").alias("least"))
        mark = new


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal tables of edges: their number and two sums of hashes."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.bit_xor(F.xxhash64("node", "other")),
            F.sum(F.hash("other", "node").cast("long")),
        ).first()
    )
