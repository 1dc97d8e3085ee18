"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: A node with more than this share of the edges is looked up in a broadcast table, of at most twice its inverse in rows.
HOT = 1 / 500


def _with_low(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` with ``m``, the smallest ``b`` of their ``a``. ``n``: a number of edges, of which there are twice as many at most.

    The least neighbour of a node is a partial aggregate. Nodes with many edges (fewer than 2 / HOT of them, as their edges are at most all)
    are broadcast, so that no task gets all edges of one.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
    hot = F.broadcast(low.filter(F.col("c") > n * HOT).select("a", "m"))
    cold = edges.join(hot.select("a"), "a", "left_anti").join(low.filter(F.col("c") <= n * HOT).select("a", "m"), "a")
    return edges.join(hot, "a").unionByName(cold)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_low(both, n).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges point from the larger to the smaller end."""
    moved = _with_low(edges, n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to ``id``, ``root``: for every node with an edge to another node, the smallest
    id of its component. Loops and repeated edges do not matter; no edges give no rows.

    The edges stay distributed; the driver sees one count and one checksum a round, and the rounds are about
    the logarithm of the longest path.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if seen == mark or not seen.n:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        mark = seen
        large = materialize(_large_star(now, seen.n), "edges")
        last, now = now, materialize(_small_star(large, seen.n), "edges")
        release(last, large)
