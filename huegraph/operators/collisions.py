"""Colour collisions at distance one and two, for every hash parameter and width.

Distance one: a vertex collides once with every stored neighbour (not itself) of its own colour. Distance two: the
largest colour class of its closed neighbourhood, less one. Repeated entries count as often as they are stored;
loops do not count; a vertex without neighbours has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KS, WS, equal_colors, hash_value, mask
from ..runtime import materialize

#: Vertices with more stored neighbours than this are counted by partial sums from all over the cluster.
HUB = 1_000_000


def _numbers(values: Iterable[int]):
    return F.array(*(F.lit(v) for v in values))


def _cells(df: DataFrame, ks: Iterable[int], ws: Iterable[int]) -> DataFrame:
    """Every (k, w) once: a few rows of literals."""
    return df.sparkSession.range(1).select(F.explode(_numbers(ks)).alias("k")).select("k", F.explode(_numbers(ws)).alias("w"))


def _every_node(wide: DataFrame, nodes: DataFrame, ks: Iterable[int], ws: Iterable[int], name: str) -> DataFrame:
    """``wide`` has an array for each (id, k), a value for each width; every vertex and cell gets a row, after the join."""
    every = nodes.select("id", F.explode(_numbers(ks)).alias("k")).join(wide, ["id", "k"], "left")
    cells = F.array(*(F.struct(F.lit(w).alias("w"), F.coalesce(F.get(name, F.lit(i)), F.lit(0)).cast("long").alias(name)) for i, w in enumerate(ws)))
    return every.select("id", "k", F.explode(cells).alias("c")).select("id", "k", "c.w", f"c.{name}")


def _report(counts: DataFrame, name: str, ks: Iterable[int], ws: Iterable[int]) -> DataFrame:
    """Total and maximum for every cell; vertices that are missing have no collisions."""
    return _filled(counts.groupBy("k", "w").agg(F.sum(name).alias("total"), F.max(name).alias("max")), ks, ws)


def _filled(found: DataFrame, ks: Iterable[int], ws: Iterable[int]) -> DataFrame:
    # a row for each cell at most, so the right side may be broadcast
    return _cells(found, ks, ws).join(F.broadcast(found), ["k", "w"], "left").select("k", "w", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("max", F.lit(0)).cast("long").alias("max"))


def _d1_wide(edges: DataFrame, ks: Iterable[int], ws: list[int]) -> DataFrame:
    """(id, k, d1), d1 an array with a count for each width.

    Hashes are computed at both ends of an edge, no colour table is joined. Widths are nested: an edge that differs
    in the lowest bits differs at every width, so seven of eight rows go before the shuffle.
    """
    pairs = edges.filter("src <> dst").select("src", "dst", F.explode(_numbers(ks)).alias("k"))
    a, b = hash_value("src", F.col("k")), hash_value("dst", F.col("k"))
    near = pairs.select("src", "k", a.alias("a"), b.alias("b")).filter(equal_colors(F.col("a"), F.col("b"), min(ws)))
    sums = [F.count_if(equal_colors(F.col("a"), F.col("b"), w)).alias(f"w{w}") for w in ws]
    return near.groupBy(F.col("src").alias("id"), "k").agg(*sums).select("id", "k", F.array(*(f"w{w}" for w in ws)).alias("d1"))


def d1_nonzero(edges: DataFrame, ks: Iterable[int] = KS, ws: Iterable[int] = WS) -> DataFrame:
    """(id, k, w, d1) where there is a collision at all."""
    ws = list(ws)
    cells = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.get("d1", F.lit(i)).alias("d1")) for i, w in enumerate(ws))))
    return _d1_wide(edges, ks, ws).select("id", "k", cells.alias("c")).select("id", "k", "c.w", "c.d1").filter("d1 > 0")


def d1_per_node(edges: DataFrame, nodes: DataFrame, ks: Iterable[int] = KS, ws: Iterable[int] = WS) -> DataFrame:
    ws = list(ws)
    return _every_node(_d1_wide(edges, ks, ws), nodes, ks, ws, "d1")


def d1_collisions(edges: DataFrame, ks: Iterable[int] = KS, ws: Iterable[int] = WS) -> DataFrame:
    """One row for each (k, w): total and max over all vertices."""
    return _report(d1_nonzero(edges, ks, ws), "d1", ks, ws)


def _largest_class(near: DataFrame, ks: Iterable[int], ws: Iterable[int]) -> DataFrame:
    hashed = near.select("id", "v", F.explode(_numbers(ks)).alias("k")).select("id", "k", hash_value("v", F.col("k")).alias("h"))
    colored = hashed.select("id", "k", F.explode(_numbers(ws)).alias("w"), "h").select("id", "k", "w", F.col("h").bitwiseAND(mask(F.col("w"))).cast("int").alias("color"))
    sizes = colored.groupBy("id", "k", "w", "color").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("id", "k", "w").agg((F.max("n") - 1).alias("d2")).filter("d2 > 0")


def _class_sizes(ids: np.ndarray, v: np.ndarray, ks: list[int], ws: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by id: the distinct ids, and the largest class of each, by k and w.

    The low bits of a hash are read in reverse order, so that one sort by the widest colour has the classes of all
    narrower ones as runs too.
    """
    top = max(ws)
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    slot = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
    out = np.empty((len(first), len(ks), len(ws)), np.int64)
    for a, k in enumerate(ks):
        d = (1 << k) - 1
        h = ((v // d) << k | v % d) & ((1 << top) - 1)
        back = np.zeros_like(h)
        for bit in range(top):
            back |= (h >> bit & 1) << (top - 1 - bit)
        key = np.sort(slot << top | back)
        for b, w in enumerate(ws):
            run = key >> (top - w)
            at = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            size = np.diff(np.r_[at, len(run)])
            owner = run[at] >> w
            out[:, a, b] = np.maximum.reduceat(size, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
    return ids[first], out


def _whole_vertices(batches, least: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows that hold all rows of their vertices, from batches sorted by id."""
    ids, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        ids, v = np.r_[ids, batch.column("id").to_numpy()], np.r_[v, batch.column("v").to_numpy()]
        if len(ids) >= least:
            cut = int(np.searchsorted(ids, ids[-1]))  # the last vertex may go on
            if cut:
                yield ids[:cut], v[:cut]
                ids, v = ids[cut:], v[cut:]
    if len(ids):
        yield ids, v


def _sorted_classes(near: DataFrame, ks: list[int], ws: list[int], totals: bool) -> DataFrame:
    """(id, k, d2), d2 an array with the largest class less one for each width, by a sort of each vertex's neighbours; with ``totals`` one row
    for each (k, w) of every run of rows: the sum and the maximum of d2."""
    cell_k, cell_w = np.repeat(ks, len(ws)).astype(np.int32), np.tile(ws, len(ks)).astype(np.int32)

    def count(batches) -> Iterator[pa.RecordBatch]:
        for ids, v in _whole_vertices(batches):
            names, sizes = _class_sizes(ids, v, ks, ws)
            d2 = sizes.reshape(len(names), -1) - 1
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array(cell_k), pa.array(cell_w), pa.array(d2.sum(0)), pa.array(d2.max(0))], names=["k", "w", "total", "max"])
            else:  # a row for each vertex and parameter, its widths as an array
                wide = pa.ListArray.from_arrays(np.arange(0, d2.size + 1, len(ws), dtype=np.int32), pa.array(d2.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, len(ks))), pa.array(np.tile(np.array(ks, np.int32), len(names))), wide], names=["id", "k", "d2"])

    placed = near.select(F.col("id").cast("long"), F.col("v").cast("long")).repartition("id").sortWithinPartitions("id")
    return placed.mapInArrow(count, "k int, w int, total long, max long" if totals else "id long, k int, d2 array<long>")


def _closed(edges: DataFrame, hub: int) -> tuple[DataFrame, DataFrame | None]:
    """``(id, v)`` of all closed neighbourhoods, and apart those of hubs, if there are any."""
    # written once: the search for hubs and the count read it
    own = materialize(edges.filter("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("v")), "edges")
    degree = own.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hubs = degree.filter(F.col("n") > hub).select("id")
    near = own.unionByName(degree.select("id", F.col("id").alias("v")))
    if hubs.isEmpty():
        return near, None
    return near.join(hubs, "id", "left_anti"), near.join(hubs, "id", "left_semi")


def _d2_wide(edges: DataFrame, ks: list[int], ws: list[int], hub: int) -> DataFrame:
    """(id, k, d2), d2 an array with a count for each width; only vertices with a neighbour can have one.

    The stored edges are shuffled once, by vertex, and each vertex's neighbours sorted for every parameter. Hubs take a
    second branch, where partial counts of classes are shuffled instead of neighbours.
    """
    few, many = _closed(edges, hub)
    out = _sorted_classes(few, ks, ws, False)
    if many is None:
        return out
    cells = _largest_class(many, ks, ws).groupBy("id", "k").agg(*(F.max(F.when(F.col("w") == w, F.col("d2"))).alias(f"w{w}") for w in ws))
    return out.unionByName(cells.select("id", "k", F.array(*(F.coalesce(f"w{w}", F.lit(0)).cast("long") for w in ws)).alias("d2")))


def d2_nonzero(edges: DataFrame, ks: Iterable[int] = KS, ws: Iterable[int] = WS, hub: int = HUB) -> DataFrame:
    """(id, k, w, d2) where there is a collision at all."""
    ws = list(ws)
    cells = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.get("d2", F.lit(i)).alias("d2")) for i, w in enumerate(ws))))
    return _d2_wide(edges, list(ks), ws, hub).select("id", "k", cells.alias("c")).select("id", "k", "c.w", "c.d2").filter("d2 > 0")


def d2_per_node(edges: DataFrame, nodes: DataFrame, ks: Iterable[int] = KS, ws: Iterable[int] = WS, hub: int = HUB) -> DataFrame:
    return _every_node(_d2_wide(edges, list(ks), list(ws), hub), nodes, ks, list(ws), "d2")


def d2_collisions(edges: DataFrame, ks: Iterable[int] = KS, ws: Iterable[int] = WS, hub: int = HUB) -> DataFrame:
    """One row for each (k, w): total and max over all vertices."""
    few, many = _closed(edges, hub)
    parts = _sorted_classes(few, list(ks), list(ws), True)
    if many is not None:
        parts = parts.unionByName(_largest_class(many, ks, ws).groupBy("k", "w").agg(F.sum("d2").alias("total"), F.max("d2").alias("max")))
    return _filled(parts.groupBy("k", "w").agg(F.sum("total").alias("total"), F.max("max").alias("max")), ks, ws)


def best_parameters(report: DataFrame) -> DataFrame:
    """For every width the parameter with the least total; ties to the least maximum, then the smaller k."""
    best = F.min(F.struct("total", "max", "k")).alias("b")
    return report.groupBy("w").agg(best).select("w", "b.k", "b.total", "b.max")
