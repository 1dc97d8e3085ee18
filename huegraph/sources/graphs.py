"""Graphs from tables, generated grids, and the catalogue of named matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix_market import read_matrix_market

#: Names of the matrices of the standard reports; a name stands for ``<folder>/<name>.mtx`` (fixed values).
MATRICES = ("CurlCurl_0", "CurlCurl_4", "atmosmodd", "atmosmodj", "atmosmodl", "atmosmodm", "af_shell3", "af_shell4", "af_shell7", "af_shell8", "Cube_Coup_dt0", "ML_Geer")


class Catalog:
    """Matrices by name or path, each loaded once and cached until ``clear``."""

    def __init__(self, spark: SparkSession, folder: str, more: dict[str, str] | None = None):
        self.spark, self.paths = spark, {m: f"{folder}/{m}.mtx" for m in MATRICES} | (more or {})
        self._loaded: dict[str, tuple[DataFrame, DataFrame]] = {}

    def load(self, name: str) -> tuple[DataFrame, DataFrame]:
        path = self.paths.get(name, name)
        if path not in self._loaded:
            edges, nodes = read_matrix_market(self.spark, path)
            self._loaded[path] = edges.cache(), nodes
        return self._loaded[path]

    def clear(self) -> None:
        for edges, _ in self._loaded.values():
            edges.unpersist()
        self._loaded.clear()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order: symmetric, no loops, no repeated edges."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = items.withColumnRenamed("l_partkey", "dst")
    return items.join(other, "l_orderkey").filter("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst").distinct()


def order_part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite graph of parts (ids from 0) and orders (ids behind the parts), both directions."""
    shift = _table(spark, sf_dir, "part").count()
    items = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + shift).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return items.unionByName(items.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def order_part_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by order (src) and part (dst)."""
    items = _table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("val"))


def grid(spark: SparkSession, x: int, y: int, z: int) -> tuple[DataFrame, DataFrame]:
    """The stencil of seven points on a cuboid: ``edges(src, dst, val)`` with 6 on the diagonal and -1 beside it, and
    ``nodes(id)``. The id runs along x, then y, then z."""
    nodes = spark.range(x * y * z)
    place = nodes.select("id", (F.col("id") % x).alias("i"), F.expr(f"id div {x} % {y}").alias("j"), F.expr(f"id div {x * y}").alias("k"))
    steps = [(f"i > 0", -1), (f"i < {x - 1}", 1), ("j > 0", -x), (f"j < {y - 1}", x), ("k > 0", -x * y), (f"k < {z - 1}", x * y)]
    around = F.array(F.struct(F.lit(True).alias("ok"), F.col("id").alias("dst"), F.lit(6.0).alias("val")), *(F.struct(F.expr(c).alias("ok"), (F.col("id") + d).alias("dst"), F.lit(-1.0).alias("val")) for c, d in steps))
    edges = place.select(F.col("id").alias("src"), F.explode(around).alias("e")).filter("e.ok").select("src", "e.dst", "e.val")
    return edges, nodes


def parse_cuboid(name: str) -> tuple[int, int, int]:
    """``XxYxZ`` as three sizes."""
    parts = name.lower().split("x")
    if len(parts) != 3 or not all(p.isdigit() and int(p) > 0 for p in parts):
        raise ValueError(f"not a cuboid: {name}")
    return tuple(int(p) for p in parts)
