"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import materialize

SMALL_EDGES = 250_000


def _met(edges: DataFrame, least: DataFrame, small: bool) -> DataFrame:
    """``edges`` with each a's ``least``: broadcast if ``small``; else written
    first, so that the join has plain shuffles on both sides and Spark can
    split a hub's task."""
    if small:
        return edges.join(F.broadcast(least), "a")
    return edges.join(materialize(least, "components-least").hint("merge"), "a")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _met(both, least, small).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if not small:
        down = materialize(down, "components-down")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _met(down, least, small).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(a, b) links of any orderable type -> (node, component), component the
    least node reachable.

    Self links and nulls are ignored; nodes without another end are absent; an
    empty table gives an empty table. Rounds grow with the logarithm of the
    longest path. Every node's minimum is a partial aggregate, so a hub never
    gathers its neighbours in one task; minima are broadcast while a round has
    at most ``small_edges`` links, which are twice as many nodes at most. Each
    round is cut in the shared folder.
    """
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark, n = None, edges.count()
    for _ in range(max_rounds):
        small = n <= small_edges
        edges = materialize(_small_star(_large_star(edges, small), small), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
