"""Connected components by alternating large-star and small-star.

Edges are ``u, v`` with ``u > v``. Large-star links each node's larger neighbours to
the smallest node it knows of; small-star does so with the smaller ones and the
node itself. Both keep the components; the edges end as stars around the smallest
nodes. Minima are combined per task before they move, and edges of a node with
many neighbours are joined to its minimum, not gathered. The minima are written
first: a join of two plain shuffles is one that adaptive execution can split, so
not even the edges of one node must meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for each node that has an edge to another.

    ``edges`` has columns ``u, v`` in any direction, with repetitions and loops; null
    ends are no nodes. Without edges there are no rows.
    """
    edges = stored(_oriented(edges), "edges")
    known = _state(edges)
    while known[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == known:
            break
        known = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges; equal once they no longer change."""
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), "minima")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    edges = stored(edges, "edges")
    least = stored(edges.groupBy("u").agg(F.min("v").alias("least")), "minima")
    linked = edges.join(least, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return linked.unionByName(least.select("u", F.col("least").alias("v"))).distinct()
