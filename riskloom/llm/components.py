"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each half-round is an aggregation (minimum, combined on the map side) and a join, in which the few
vertices with a large share of all edges are dealt into parts; no neighbour list is ever collected, so
a vertex may have any degree. Every round is written to the shared folder and read back, which cuts
the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with ``a > b``."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    met = join_hot(both, least, ["a"], "n", F.xxhash64("b"))
    return _oriented(met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_hot(edges, least, ["a"], "n", F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (any one orderable type) -> ``node, root`` with the least node of each component.

    Only nodes that have an edge to another node appear. Self loops, repeated and reversed edges are
    harmless; an empty table gives an empty result. Nulls on either side are no edge.
    """
    edges = _oriented(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    now = materialize(edges, "edges")
    seen = _state(now)
    while True:
        large = materialize(_large_star(now), "edges")
        after = materialize(_small_star(large), "edges")
        discard(large)
        state = _state(after)
        discard(now)
        now = after
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """A digest of the edge set: equal before and after a round means a fixed point."""
    r = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        F.bit_xor(F.xxhash64("b", "a")).alias("x"),
    ).first()
    return r["n"], r["h"], r["x"]
