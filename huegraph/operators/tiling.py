"""Tiles of consecutive rows under a byte budget, equal shares, tile and layer statistics, orders inside tiles.

An assignment is ``(id, layer, tile, pos)``: the vertex's layer (slice), its tile (bar), and its place in the slice.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import TILE_COSTS, Cost
from ..runtime import materialize
from .linalg import degrees, prefix_sum

BUDGET = 65_536


def equal_parts(spark: SparkSession, rows: int, parts: int) -> DataFrame:
    """``(part, lo, hi)``: ``rows`` over ``parts``; the first ``rows mod parts`` have one more."""
    if rows <= 0 or parts <= 0:
        raise ValueError("rows and parts must be positive")
    low, more = divmod(rows, parts)
    lo = lambda p: p * low + F.least(p, F.lit(more))
    part = F.col("id")
    return spark.range(parts).select(part.alias("part"), lo(part).alias("lo"), lo(part + 1).alias("hi"))


class _Slope:
    """A cost of a tile as integers: bytes for each entry and row, a fixed part, and a part for each pair of rows."""

    def __init__(self, spark: SparkSession, cost: Cost, degree: int):
        at = spark.range(1).select(*(cost(F.lit(r), F.lit(c), F.lit(degree)).cast("long").alias(f"c{r}_{c}") for r, c in ((0, 0), (0, 1), (1, 0), (2, 0), (3, 0)))).first()
        self.fixed, self.entry = at[0], at[1] - at[0]
        self.odd, self.even = at[2] - at[0], at[3] - at[0]
        if at[4] - at[0] != self.even + self.odd:
            raise ValueError("the cost is not linear in pairs of rows")

    def __call__(self, rows, cols):
        """Of numbers or arrays of them."""
        return self.fixed + cols * self.entry + rows // 2 * self.even + rows % 2 * self.odd


def _jumps(degree: np.ndarray, own: int, size: _Slope, budget: int) -> np.ndarray:
    """For each of the first ``own`` rows as the first of a tile the row behind its last: the greatest that fits, by bisection."""
    upto = np.r_[0, np.cumsum(degree)]
    first = np.arange(own)
    fits, past = first + 1, np.full(own, len(degree) + 1)  # a row alone always fits
    while (past - fits > 1).any():
        mid = (fits + past) // 2
        ok = size(mid - first, upto[mid] - upto[first]) <= budget
        fits, past = np.where(ok, mid, fits), np.where(ok, past, mid)
    return fits


def greedy_tiles(edges: DataFrame, nodes: DataFrame, variant: str = "d1", budget: int = BUDGET, cost: Cost | None = None, by_row: DataFrame | None = None, block: int = 65_536) -> DataFrame:
    """``(tile, lo, hi)``: as many consecutive rows as fit the budget, tile after tile; the last tile ends at the last row.

    ``variant`` names a cost of ``TILE_COSTS``; ``cost`` is one of your own, linear in entries and pairs of rows. A row that alone exceeds the
    budget raises. ``by_row``: the degrees, where they are known. Ids are dense, from 0.

    Where a tile ends depends on all tiles before it, but in a block of rows little depends on where its first tile begins: every block
    finds, for each row that may be the first of one, the row behind the last tile that begins in the block, and the number of its tiles. Both are
    step functions of few steps; the driver walks from block to block (some steps for each ``block`` rows), and all blocks cut their tiles at once.
    A block also reads as many rows behind it as a tile may have.
    """
    if cost is None and variant not in TILE_COSTS:
        raise ValueError(f"unknown variant: {variant}")
    spark = edges.sparkSession
    by_row = materialize(degrees(edges, nodes), "degrees") if by_row is None else by_row
    top, n = by_row.agg(F.max("degree"), F.count(F.lit(1))).first()
    size = _Slope(spark, cost or TILE_COSTS[variant], top or 0)
    if top is not None and size(1, top) > budget:
        raise ValueError("a row does not fit the budget; a larger one is needed for this matrix")
    halo = int(_jumps(np.zeros(min(n, budget), np.int64), 1, size, budget)[0]) if n else 0
    block = max(block, halo)
    home = F.expr(f"id div {block}")
    shown = F.when((F.col("id") % block < halo) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    placed = by_row.select("id", "degree", F.explode(shown).alias("block"))

    def jumps(pdf: pd.DataFrame) -> tuple[int, np.ndarray]:
        pdf = pdf.sort_values("id")
        start = int(pdf["block"].iloc[0]) * block
        return start, _jumps(pdf["degree"].to_numpy(), min(block, n - start), size, budget)

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        start, jump = jumps(pdf)
        out, count = jump.copy(), np.ones(len(jump), np.int64)
        while (inside := out < len(jump)).any():
            count[inside], out[inside] = count[inside] + count[out[inside]], out[out[inside]]
        out, count = out[: max(1, halo)], count[: max(1, halo)]
        at = np.flatnonzero(np.r_[True, (out[1:] != out[:-1]) | (count[1:] != count[:-1])])
        return pd.DataFrame({"block": start // block, "entry": start + at, "exit": start + out[at], "count": count[at]})

    known: dict[int, list] = {}
    for r in placed.groupBy("block").applyInPandas(steps, "block long, entry long, exit long, count long").collect():
        known.setdefault(r.block, []).append((r["entry"], r["exit"], r["count"]))
    row, tile, entries = 0, 0, []
    for b in sorted(known):
        if row >= min(n, (b + 1) * block):
            continue
        entries.append((b, row, tile))
        own = sorted(known[b])
        _, row, more = own[bisect_right(own, (row, n + 1, 0)) - 1]
        tile += more

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        start, jump = jumps(pdf)
        row, tile, out = int(pdf["row"].iloc[0]) - start, int(pdf["tile"].iloc[0]), []
        while row < len(jump):
            out.append((tile, start + row, start + int(jump[row])))
            row, tile = int(jump[row]), tile + 1
        return pd.DataFrame(out, columns=["tile", "lo", "hi"]).astype("int64")

    begin = spark.createDataFrame(entries, "block long, row long, tile long")  # a row for each block
    return placed.join(F.broadcast(begin), "block").groupBy("block").applyInPandas(cut, "tile long, lo long, hi long")


def tile_sizes(tiles: DataFrame, edges: DataFrame, nodes: DataFrame, by_row: DataFrame | None = None) -> DataFrame:
    """``(tile, nodes, edges)`` of tiles of consecutive rows. ``by_row``: the degrees, where they are known."""
    by_row = materialize(degrees(edges, nodes), "degrees") if by_row is None else by_row
    sums = prefix_sum(by_row, "degree", "upto").select((F.col("id") + 1).alias("row"), "upto")
    ends = tiles.select("tile", F.explode(F.array("lo", "hi")).alias("row")).join(sums, "row", "left").select("tile", "row", F.coalesce("upto", F.lit(0)).alias("upto"))
    return ends.groupBy("tile").agg((F.max("row") - F.min("row")).alias("nodes"), (F.max("upto") - F.min("upto")).alias("edges"))


def tile_stats(tiles: DataFrame, edges: DataFrame, nodes: DataFrame, by_row: DataFrame | None = None) -> DataFrame:
    """One row: tiles, the most nodes and edges of any, and nodes and edges of the biggest (the last of equals)."""
    biggest = F.max_by(F.struct("nodes", "edges"), F.struct((F.col("nodes") + F.col("edges")).alias("s"), "tile"))
    got = tile_sizes(tiles, edges, nodes, by_row).agg(F.count(F.lit(1)).alias("tiles"), F.max("nodes").alias("max_nodes"), F.max("edges").alias("max_edges"), biggest.alias("b"))
    return got.select("tiles", "max_nodes", "max_edges", F.col("b.nodes").alias("biggest_nodes"), F.col("b.edges").alias("biggest_edges"))


def share_stats(sizes: DataFrame, size: str = "nodes") -> DataFrame:
    """One row on the tiles of a comparison: their number, and the least, average and greatest size."""
    return sizes.agg(F.count(F.lit(1)).alias("tiles"), F.min(size).alias("min_tile"), F.avg(size).alias("avg_tile"), F.max(size).alias("max_tile"))


def strongest(votes: DataFrame, group: list[str], order: list, room: str) -> DataFrame:
    """Of each group its first rows by ``order``, as many as the column ``room`` says: the cut at a capacity."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return votes.withColumn("__i", at).filter(F.col("__i") <= F.col(room)).drop("__i")


def tile_view(edges: DataFrame, lo: int, hi: int) -> DataFrame:
    """The rows of one tile; the range reaches the scan."""
    return edges.filter(F.col("src").between(lo, hi - 1))


def layer_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"))


def slice_stats(assigned: DataFrame) -> DataFrame:
    """For each layer its nodes and the average, least and greatest size of its tiles."""
    sizes = assigned.groupBy("layer", "tile").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("layer").agg(F.sum("n").alias("nodes"), F.avg("n").alias("avg_tile"), F.min("n").alias("min_tile"), F.max("n").alias("max_tile"))


def _ranked(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """The place of each row behind all rows of earlier groups: a window in each group, a prefix sum over the groups."""
    inside = Window.partitionBy(*group).orderBy(*order)
    sums = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return df.withColumn("__r", F.row_number().over(inside)).join(starts, group).withColumn(out, F.col("__start") + F.col("__r") - 1).drop("__r", "__start")


def layer_major(assigned: DataFrame) -> DataFrame:
    """Append ``new_pos``: by layer, in it by tile, in it as before."""
    return _ranked(assigned, ["layer", "tile"], ["pos"], "new_pos")


def tile_major(assigned: DataFrame) -> DataFrame:
    """Append ``new_pos``: by tile, in it by layer, in it as before."""
    return _ranked(assigned, ["tile", "layer"], ["pos"], "new_pos")


def tile_starts(assigned: DataFrame) -> DataFrame:
    """``(tile, layer, start, nodes)`` in tile-major order."""
    sums = assigned.groupBy("tile", "layer").agg(F.count(F.lit(1)).alias("nodes"))
    before = Window.orderBy("tile", "layer").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("tile", "layer", F.coalesce(F.sum("nodes").over(before), F.lit(0)).cast("long").alias("start"), "nodes")


def bar_sizes(assigned: DataFrame) -> DataFrame:
    """For each tile its nodes over all layers, and the sum up to it."""
    sums = assigned.groupBy("tile").agg(F.count(F.lit(1)).alias("nodes"))
    return sums.select("tile", "nodes", F.sum("nodes").over(Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("upto"))


def _sides(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(id, tile, n, outside)``: entries of a vertex, and those that lead to other tiles."""
    own = assigned.select(F.col("id").alias("src"), F.col("tile").alias("t1"))
    far = assigned.select(F.col("id").alias("dst"), F.col("tile").alias("t2"))
    both = edges.select("src", "dst").join(own, "src").join(far, "dst")
    return both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t1") != F.col("t2")).alias("outside"))


def border_first(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Append ``border`` and ``new_pos``: in every tile of every layer the vertices with a neighbour in another tile come
    first, as before, then the others in reverse."""
    sides = _sides(edges, assigned).select("id", (F.col("outside") > 0).alias("border"))
    marked = assigned.join(sides, "id", "left").withColumn("border", F.coalesce("border", F.lit(False)))
    order = [F.when(F.col("border"), 0).otherwise(1), F.when(F.col("border"), F.col("pos")).otherwise(-F.col("pos"))]
    return _ranked(marked, ["tile", "layer"], order, "new_pos")


def border_offsets(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(tile, layer, offset)``: the place of the first vertex without neighbours in other tiles."""
    marked = border_first(edges, assigned).groupBy("tile", "layer").agg(F.min("new_pos").alias("start"), F.count_if("border").alias("borders"))
    return marked.select("tile", "layer", (F.col("start") + F.col("borders")).cast("long").alias("offset"))


def single_offsets(assigned: DataFrame) -> DataFrame:
    """Offsets where there is one tile: its starts."""
    return tile_starts(assigned).select("tile", "layer", F.col("start").alias("offset"))


def redundancy(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row of percentages: entries that lead out of their tile, average, least and greatest over the tiles (a tile
    without entries has 0), and vertices that have such an entry. The diagonal leads nowhere."""
    sides = assigned.select("id", "tile").join(_sides(edges, assigned), "id", "left")
    bars = sides.groupBy("tile").agg(F.coalesce(F.sum("outside"), F.lit(0)).alias("o"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("outside") > 0).alias("b"), F.count(F.lit(1)).alias("v"))
    share = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("o") / F.col("n"))
    out = bars.select(share.alias("s"), "b", "v").agg(F.avg("s").alias("a"), F.least(F.min("s"), F.lit(1.0)).alias("lo"), F.max("s").alias("hi"), (F.sum("b") / F.sum("v")).alias("nodes"))
    return out.select((F.col("a") * 100).alias("avg_edges"), (F.col("lo") * 100).alias("min_edges"), (F.col("hi") * 100).alias("max_edges"), (F.col("nodes") * 100).alias("nodes"))


def redundancy_single(spark: SparkSession) -> DataFrame:
    """The report where there is one tile: nothing leads out."""
    return spark.range(1).select(*(F.lit(0.0).alias(c) for c in ("avg_edges", "min_edges", "max_edges", "nodes")))


def coarsen(assigned: DataFrame, most: int, end_at_first: bool = True) -> DataFrame:
    """``(layer, new_layer)``: a layer joins the one before it while no tile of the union exceeds ``most`` vertices.

    The first layer that doesn't fit ends the merging, and all later ones stay as they are; with ``end_at_first`` false
    (the rule where there is one tile) merging starts again behind it.

    Whether a layer joins depends on all layers before it: one task reads the sizes of tiles, in order, as a
    stream and keeps those of the layer that is growing. Its rows are layers times tiles, not vertices.
    """
    sizes = assigned.groupBy("layer", "tile").agg(F.count(F.lit(1)).alias("n")).repartition(1).sortWithinPartitions("layer", "tile")

    def fold(batches) -> Iterator[pa.RecordBatch]:
        open_: dict[int, int] = {}
        now: dict[int, int] = {}
        layer, new, merging = None, -1, True

        def close() -> pa.RecordBatch:
            nonlocal open_, new, merging
            if new >= 0 and merging and all(open_.get(t, 0) + n <= most for t, n in now.items()):
                open_ |= {t: open_.get(t, 0) + n for t, n in now.items()}
            else:
                merging = merging and (new < 0 or not end_at_first)
                open_, new = dict(now), new + 1
            return pa.RecordBatch.from_arrays([pa.array([layer], pa.int64()), pa.array([new], pa.int64())], names=["layer", "new_layer"])

        for batch in batches:
            for l, t, n in zip(*(batch.column(c).to_pylist() for c in ("layer", "tile", "n")), strict=True):
                if layer is not None and l != layer:
                    yield close()
                    now = {}
                layer = l
                now[t] = n
        if layer is not None:
            yield close()

    return sizes.select(F.col("layer").cast("long"), F.col("tile").cast("long"), "n").mapInArrow(fold, "layer long, new_layer long")
