"""Partitions of layered graphs: votes of neighbours under a capacity, balanced cuts, whole tilings in one call, and independent layers
of a triangular matrix.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import is_stage, materialize, release
from .linalg import prefix_sum
from .tiling import border_first, border_offsets, coarsen, layer_major, redundancy, strongest, tile_starts

#: Weights of edges for the cut of a layer: an end has no tile yet, both are in one tile, both are in different tiles (fixed values).
WEIGHT_OPEN, WEIGHT_SAME, WEIGHT_DIFFERENT = 2, 2, 1
#: How far a tile of such a cut may be above its share, in thousandths (fixed value).
SLACK = 111
#: Entries of a triangular matrix that are held at once.
CHUNK = 1 << 19


def _in_parts(nodes: DataFrame, count: int, tiles: int) -> DataFrame:
    """``(id, tile)``: consecutive ids in equal shares, from the rank of each id."""
    low, more = divmod(count, tiles)
    ranked = prefix_sum(nodes.select("id", F.lit(1).alias("one")), "one", "rank")
    tile = F.when(F.col("rank") <= more * (low + 1), F.expr(f"(rank - 1) div {low + 1}")).otherwise(F.expr(f"{more} + (rank - 1 - {more * (low + 1)}) div {max(1, low)}"))
    return ranked.select("id", tile.cast("long").alias("tile"))


def _filled(nodes: DataFrame, fixed: DataFrame, count: int, tiles: int, most: int) -> DataFrame:
    """``(id, tile)`` of all vertices: ``fixed`` ones (as far as ``most`` allows, by id) where they are, the others in order of their ids where
    there is room below equal shares, then below ``most``."""
    sizes = fixed.withColumn("room", F.lit(most))
    kept = materialize(strongest(sizes, ["tile"], [F.col("id")], "room").select("id", "tile"), "fixed")
    low, more = divmod(count, tiles)
    every = nodes.sparkSession.range(tiles).select(F.col("id").alias("tile"), (F.lit(low) + (F.col("id") < more).cast("int")).alias("share"))
    held = every.join(kept.groupBy("tile").agg(F.count(F.lit(1)).alias("n")), "tile", "left").select("tile", "share", F.coalesce("n", F.lit(0)).alias("n"))
    # rooms of each tile: below its share, and behind all of those up to ``most``
    early, late = F.greatest(F.col("share") - F.col("n"), F.lit(0)), F.lit(most) - F.greatest("share", "n")
    runs = held.select("tile", F.explode(F.array(F.struct(F.lit(0).alias("late"), early.alias("c")), F.struct(F.lit(1).alias("late"), late.alias("c")))).alias("r")).select("tile", "r.late", "r.c").filter("c > 0")
    before = Window.orderBy("late", "tile").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("late", "tile", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("from"), "c")  # two rows a tile
    ranked = starts.select("tile", F.explode(F.expr("sequence(`from` + 1, `from` + c)")).alias("rank"))
    free = prefix_sum(nodes.join(kept, "id", "left_anti").select("id", F.lit(1).alias("one")), "one", "rank").select("id", "rank")
    return kept.unionByName(free.join(ranked, "rank").select("id", "tile"))


def balanced_partition(edges: DataFrame, nodes: DataFrame, tiles: int, rounds: int = 3, slack: float = 0.03, fixed: DataFrame | None = None) -> DataFrame:
    """``(id, tile)``: ``tiles`` parts of equal size (up to ``slack``) with few edges between them; edges may have a ``weight``.

    Starts from equal shares of consecutive ids, or from the tiles of ``fixed(id, tile)``; in every round vertices that have more
    neighbours in another part move there, best gains first, as far as both sizes allow. Half of the vertices (by a hash) may move in a
    round, so that neighbours don't change places.
    """
    count = nodes.count()
    if count < tiles:
        raise ValueError("fewer vertices than tiles")
    most, least = max(math.ceil(count / tiles), math.floor(count / tiles * (1 + slack))), min(count // tiles, math.ceil(count / tiles * (1 - slack)))
    now = materialize(_in_parts(nodes, count, tiles) if fixed is None else _filled(nodes, fixed, count, tiles, most), "parts")
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    links = edges.filter("src <> dst").select(F.col("src").alias("id"), "dst", weight.alias("weight"))
    for r in range(rounds):
        far = now.select(F.col("id").alias("dst"), F.col("tile").alias("to"))
        votes = links.join(far, "dst").groupBy("id", "to").agg(F.sum("weight").alias("n"))
        own = votes.join(now, "id").groupBy("id", "tile")
        best = own.agg(F.max(F.when(F.col("to") != F.col("tile"), F.struct("n", (-F.col("to")).alias("t")))).alias("b"), F.sum(F.when(F.col("to") == F.col("tile"), F.col("n"))).alias("here"))
        gain = F.col("b.n") - F.coalesce("here", F.lit(0))
        moves = best.filter(F.col("b").isNotNull()).select("id", "tile", (-F.col("b.t")).alias("to"), gain.alias("gain")).filter(F.col("gain") > 0).filter(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0)
        sizes = now.groupBy("tile").agg(F.count(F.lit(1)).alias("size"))
        room = sizes.select(F.col("tile").alias("to"), (most - F.col("size")).alias("room"))
        spare = sizes.select("tile", (F.col("size") - least).alias("spare"))
        order = [F.desc("gain"), F.col("id")]
        taken = strongest(strongest(moves.join(room, "to").join(spare, "tile"), ["to"], order, "room"), ["tile"], order, "spare").select("id", "to")
        last, now = now, materialize(now.join(taken, "id", "left").select("id", F.coalesce("to", "tile").alias("tile")), "parts")
        release(last)
    return now


def cut_size(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: stored entries between different parts (``cut``), and the sizes of the parts (``least``, ``most``)."""
    a = parts.select(F.col("id").alias("src"), F.col("tile").alias("a"))
    b = parts.select(F.col("id").alias("dst"), F.col("tile").alias("b"))
    cut = edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("a") != F.col("b")).alias("cut"))
    sizes = parts.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return cut.join(F.broadcast(sizes))  # one row and one row


def preassigned(links: DataFrame, done: DataFrame, layer: int, neighbour: int) -> DataFrame:
    """``(id, tile)`` of the vertices of ``layer`` whose neighbours in the layer ``neighbour`` are all in one tile. ``links``: see ``layer_links``."""
    seen = links.filter((F.col("la") == layer) & (F.col("lb") == neighbour)).join(done.select(F.col("id").alias("dst"), "tile"), "dst")
    seen = seen.groupBy(F.col("src").alias("id")).agg(F.min("tile").alias("tile"), F.max("tile").alias("other"))
    return seen.filter("tile = other").select("id", "tile")


def edge_weights(links: DataFrame, fixed: DataFrame, layer: int) -> DataFrame:
    """``(src, dst, weight)`` of the edges inside ``layer``, the diagonal left out: 2 where an end has no tile in ``fixed`` yet or both ends
    have the same, 1 where they have different ones."""
    inside = links.filter((F.col("la") == layer) & (F.col("lb") == layer) & (F.col("src") != F.col("dst")))
    a = fixed.select(F.col("id").alias("src"), F.col("tile").alias("ta"))
    b = fixed.select(F.col("id").alias("dst"), F.col("tile").alias("tb"))
    weight = F.when(F.col("ta").isNull() | F.col("tb").isNull(), WEIGHT_OPEN).when(F.col("ta") == F.col("tb"), WEIGHT_SAME).otherwise(WEIGHT_DIFFERENT)
    return inside.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", weight.alias("weight"))


def layer_links(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """``(src, dst, la, lb)``: edges inside layers and between adjacent ones, written once in a folder for each layer of ``src``, so that
    the work on a layer reads its own edges only."""
    a = layers.select(F.col("id").alias("src"), F.col("layer").alias("la"))
    b = layers.select(F.col("id").alias("dst"), F.col("layer").alias("lb"))
    near = edges.select("src", "dst").join(a, "src").join(b, "dst").filter(F.abs(F.col("la") - F.col("lb")) <= 1).select("src", "dst", "lb", "la")
    return materialize(near.repartition("la", F.pmod(F.xxhash64("src"), F.lit(16))), "links", by="la")


def _vote_round(links: DataFrame, done: DataFrame, members: DataFrame, layer: int, most: int, sides: list[int]) -> DataFrame:
    """``(id, tile)`` of a round: unassigned ``members`` vote for tiles with room in this layer by their links to the layers at ``sides``, then by
    links inside the layer; only a unique winner counts; a tile takes its strongest votes first."""
    sizes = done.join(members.select("id"), "id", "left_semi").groupBy("tile").agg(F.count(F.lit(1)).alias("size"))
    open_ = done.join(sizes, "tile", "left").select(F.col("id").alias("dst"), "tile", (most - F.coalesce("size", F.lit(0))).alias("room")).filter("room > 0")
    free = members.join(done, "id", "left_anti").select(F.col("id").alias("src"), "pos")
    own = links.filter((F.col("la") == layer) & F.col("lb").isin([layer, *(layer + s for s in sides)]) & (F.col("src") != F.col("dst")))
    votes = own.join(free, "src").join(open_, "dst").groupBy("src", "pos", "tile", "room").agg(F.count_if(F.col("lb") != layer).alias("direct"), F.count_if(F.col("lb") == layer).alias("inside"))
    rank = Window.partitionBy("src").orderBy(F.desc("direct"), F.desc("inside"))
    tops = votes.withColumn("r", F.rank().over(rank)).filter("r = 1").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("src")))
    return strongest(tops.filter("same = 1"), ["tile"], [F.desc("direct"), F.desc("pos")], "room").select(F.col("src").alias("id"), "tile")


def _voted(links: DataFrame, done: DataFrame, members: DataFrame, layer: int, most: int, sides: list[int]) -> DataFrame:
    """``done`` with what rounds of votes add, until no vote decides."""
    while True:
        new = materialize(_vote_round(links, done, members, layer, most, sides), "votes")
        if new.isEmpty():
            return done
        done = materialize(done.unionByName(new), "done")


def _leftover(links: DataFrame, layer: int, members: DataFrame, done: DataFrame, tiles: int, most: int) -> DataFrame:
    """``(id, tile)`` of the members that no vote decided: one after the other to the tile with most links inside the
    layer, else the smallest tile, unassigned neighbours of the layer along with it as far as there is room.

    Sequential by definition, so one task; it gets what is left of one layer, not the graph.
    """
    rest = members.join(done, "id", "left_anti")
    own = members.join(done, "id", "left")
    inside = links.filter((F.col("la") == layer) & (F.col("lb") == layer) & (F.col("src") != F.col("dst")))
    near = inside.join(rest.select(F.col("id").alias("src")), "src").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("near"))
    rows = own.join(near, "id", "left").select("id", "pos", "tile", "near")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tile = {i: int(t) for i, t in zip(pdf["id"], pdf["tile"], strict=True) if not pd.isna(t)}
        before, sizes = set(tile), np.bincount(list(tile.values()), minlength=tiles)
        for i, near in zip(pdf["id"], pdf["near"], strict=True):
            if i in tile:
                continue
            near = [] if near is None else list(near)
            links = np.zeros(tiles, np.int64)
            for j in near:
                if j in tile and sizes[tile[j]] < most:
                    links[tile[j]] += 1
            best = int(np.argmin(sizes)) if links.min() == links.max() else int(np.argmax(links))
            for j in [i, *(j for j in near if j not in tile)][: max(0, most - int(sizes[best]))]:
                tile[j] = best
                sizes[best] += 1
        made = [(i, t) for i, t in tile.items() if i not in before]
        return pd.DataFrame(made, columns=["id", "tile"]).astype("int64")

    return rows.groupBy().applyInPandas(assign, "id long, tile long")


class _Start(NamedTuple):
    placed: DataFrame  # (id, layer, pos)
    links: DataFrame
    order: list[int]
    first: int
    most: int
    done: DataFrame  # (id, tile) of the first layer


def _largest_layer(edges: DataFrame, layers: DataFrame, tiles: int) -> _Start:
    """The largest layer (the first of equals) cut into balanced parts, the size of the largest of which is the capacity everywhere."""
    placed = materialize(layers.withColumn("pos", F.row_number().over(Window.partitionBy("layer").orderBy("id")) - 1), "layers")
    count = {r.layer: r.n for r in placed.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a layer
    order = sorted(count)
    if order != list(range(order[0], order[0] + len(order))):
        raise ValueError("layers must be numbered without gaps")
    first = max(order, key=lambda x: (count[x], -x))
    links = layer_links(edges, placed)
    members = placed.filter(F.col("layer") == first).select("id")
    inner = links.filter((F.col("la") == first) & (F.col("lb") == first))
    done = balanced_partition(inner, members, min(tiles, count[first]), slack=0.001)
    most = done.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return _Start(placed, links, order, first, most, done)


def section_layers(edges: DataFrame, layers: DataFrame, tiles: int) -> DataFrame:
    """``(id, layer, tile, pos)`` for ``layers(id, layer)``: the largest layer is cut into balanced parts, the layers on both
    sides of it follow outwards. A layer first votes by its links to the layer before it; when the layer behind it has done so too, what is left
    votes by its links to both, and what is still left joins one by one.

    No tile of any layer exceeds the largest tile of the largest layer. The driver walks over the layers; all votes are distributed, and
    read the edges of their layer only.
    """
    placed, links, order, first, most, done = _largest_layer(edges, layers, tiles)
    for side, path in ((1, [x for x in reversed(order) if x < first]), (-1, [x for x in order if x > first])):
        for i, layer in enumerate(path):
            members = placed.filter(F.col("layer") == layer)
            if i == 0:
                done = _voted(links, done, members, layer, most, [side])
            if i + 1 < len(path):
                later = path[i + 1]
                done = _voted(links, done, placed.filter(F.col("layer") == later), later, most, [side])
            done = _voted(links, done, members, layer, most, [-1, 1])
            done = materialize(done.unionByName(_leftover(links, layer, members, done, tiles, most)), "done")
    return placed.join(done, "id").select("id", "layer", "tile", "pos")


def cut_layers(edges: DataFrame, layers: DataFrame, tiles: int) -> DataFrame:
    """``(id, layer, tile, pos)`` as ``section_layers``, by balanced cuts: in every layer the vertices whose neighbours in the layer before are all
    in one tile start there, edges inside the layer are weighed by it, and the layer is cut by these weights, up to ``SLACK`` thousandths above
    equal shares."""
    placed, links, order, first, _, done = _largest_layer(edges, layers, tiles)
    for side, path in ((1, [x for x in reversed(order) if x < first]), (-1, [x for x in order if x > first])):
        for layer in path:
            members = placed.filter(F.col("layer") == layer).select("id")
            fixed = materialize(preassigned(links, done, layer, layer + side), "fixed")
            parts = balanced_partition(edge_weights(links, fixed, layer), members, min(tiles, members.count()), slack=SLACK / 1000, fixed=fixed)
            done = materialize(done.unionByName(parts), "done")
    return placed.join(done, "id").select("id", "layer", "tile", "pos")


class Tiling(NamedTuple):
    """A whole tiling: ``assigned(id, layer, tile, pos)`` after merging layers, ``order(id, new_pos)`` tile by tile with border vertices first,
    ``starts(tile, layer, start, nodes)``, ``offsets(tile, layer, offset)`` of the first vertex without neighbours in other tiles, the
    ``report`` of redundant entries, and the capacity ``most``."""

    assigned: DataFrame
    order: DataFrame
    starts: DataFrame
    offsets: DataFrame
    report: DataFrame
    most: int


def tile_graph(edges: DataFrame, layers: DataFrame, tiles: int, method: str = "votes", merge: bool = True) -> Tiling:
    """Tiles of a layered graph in one call: assignment by ``votes`` (``section_layers``) or by the ``cut`` (``cut_layers``), layers merged as far as
    no tile exceeds the largest one (``merge``), and the order, starts, offsets and report of the result."""
    if method not in ("votes", "cut"):
        raise ValueError(f"votes or cut: {method}")
    found = materialize((section_layers if method == "votes" else cut_layers)(edges, layers, tiles), "assigned")
    most = found.groupBy("layer", "tile").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    # places over all layers, so that merged layers stay in order
    assigned = layer_major(found).select("id", "layer", "tile", F.col("new_pos").alias("pos"))
    if merge:
        assigned = assigned.join(coarsen(found, most), "layer").select("id", F.col("new_layer").alias("layer"), "tile", "pos")
    assigned = materialize(assigned, "assigned")
    order = border_first(edges, assigned).select("id", "new_pos")
    return Tiling(assigned, order, tile_starts(assigned), border_offsets(edges, assigned), redundancy(edges, assigned), most)


def simple_tiling(edges: DataFrame, nodes: DataFrame, tiles: int) -> Tiling:
    """All vertices as one layer, by a balanced cut."""
    return tile_graph(edges, nodes.select("id", F.lit(0).alias("layer")), tiles, "cut")


class _Triangle:
    """The entries of a lower-triangular matrix on disk, by row and by column; in memory are a few numbers for each vertex. ``ids`` is sorted, rows
    and columns are places in it; ``row`` marks the vertices that are rows, others are columns only."""

    def __init__(self, batches: Iterator[pa.RecordBatch], folder: str):
        self.folder, nodes = folder, [np.zeros(0, np.int64)]
        paths = {np.int32: f"{folder}/narrow", np.int64: f"{folder}/wide"}
        with open(paths[np.int32], "wb") as narrow, open(paths[np.int64], "wb") as wide:
            for batch in batches:
                src, dst = batch.columns
                nodes.append(src.filter(dst.is_null()).to_numpy(zero_copy_only=False))
                pairs = np.stack([x.filter(dst.is_valid()).to_numpy(zero_copy_only=False) for x in (src, dst)], axis=1)
                small = np.array_equal(pairs, pairs.astype(np.int32))
                pairs.astype(np.int32 if small else np.int64).tofile(narrow if small else wide)
        held, maps = np.unique(np.concatenate(nodes)), [_mapped(path, kind).reshape(-1, 2) for kind, path in paths.items()]
        del nodes
        alone = [np.setdiff1d(pairs[:, 1], held) for pairs in _chunks(maps)]
        self.ids = np.union1d(held, np.unique(np.concatenate(alone))) if any(map(len, alone)) else held
        self.row = np.isin(self.ids, held)
        placed = f"{folder}/placed"
        with open(placed, "wb") as out:
            for pairs in _chunks(maps):
                at = np.searchsorted(self.ids, pairs)
                rows = np.minimum(at[:, 0], len(self.ids) - 1)
                at[self.row[rows] & (self.ids[rows] == pairs[:, 0]) & (at[:, 0] != at[:, 1])].astype(np.int32).tofile(out)
            own = np.flatnonzero(self.row).astype(np.int32)  # a row always has its own column, once
            np.stack([own, own], axis=1).tofile(out)
        del maps
        for path in paths.values():
            os.remove(path)
        self.by_row, self.by_column = self._grouped(placed, 0), self._grouped(placed, 1)
        os.remove(placed)

    def _grouped(self, path: str, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of each place begin (one more for the end), and their other sides."""
        placed = _mapped(path, np.int32).reshape(-1, 2)
        start = np.zeros(len(self.ids) + 1, np.int64)
        for part in _chunks([placed]):
            start[1:] += np.bincount(part[:, key], minlength=len(self.ids))
        np.cumsum(start, out=start)
        name = f"{self.folder}/{key}"
        with open(name, "wb") as out:
            out.truncate(4 * len(placed))
        other, free = _mapped(name, np.int32, "r+"), start[:-1].copy()
        for part in _chunks([placed]):
            part = part[np.argsort(part[:, key], kind="stable")]
            at, first, n = np.unique(part[:, key], return_index=True, return_counts=True)
            other[np.repeat(free[at] - first, n) + np.arange(len(part))] = part[:, 1 - key]
            free[at] += n
        return start, other

    def layers(self, tiles: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``layer`` and ``tile`` of every place (-1 where it is no row).

        A row that joins a tile marks the rows that share its columns, so a row is asked once for its columns in all, when it joins, and not
        once for each layer that it waits.
        """
        (row_start, columns), (column_start, rows), n = self.by_row, self.by_column, len(self.ids)
        layer_of, tile_of = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        free, several = -1, -2  # a row that touches no tile, or more than one
        touch, mark = np.full(n, -1, np.int32), np.full(n, free, np.int32)  # of columns, of rows
        left, limit, layer = np.flatnonzero(self.row)[::-1], tiles or n, 0

        def put(i: int, t: int) -> None:
            layer_of[i], tile_of[i] = layer, t
            own = columns[row_start[i] : row_start[i + 1]]
            own = own[touch[own] < 0]
            touch[own] = t
            for some in _packs(own, column_start):
                near = np.concatenate([rows[a:b] for a, b in some])
                now = mark[near]
                mark[near] = np.where((now == free) | (now == t), t, several)

        while len(left):
            touch[: left[0] + 1], mark[: left[0] + 1] = -1, free
            sizes = 0
            for i in _asked(left, lambda at: mark[at] == free):
                put(i, sizes)
                sizes += 1
                if sizes == limit:
                    break
            limit = sizes if not layer else limit
            left = left[layer_of[left] < 0]
            count = np.ones(sizes, np.int64)
            for i in _asked(left, lambda at: mark[at] != several):
                t = int(mark[i])
                t = int(np.argmin(count)) if t == free else t
                put(i, t)
                count[t] += 1
            left, layer = left[layer_of[left] < 0], layer + 1
        return layer_of, tile_of


def _mapped(path: str, kind: type, mode: str = "r") -> np.ndarray:
    """The numbers in a file, which stay there."""
    return np.asarray(np.memmap(path, kind, mode)) if os.path.getsize(path) else np.zeros(0, kind)


def _chunks(maps: list[np.ndarray]) -> Iterator[np.ndarray]:
    for pairs in maps:
        for i in range(0, len(pairs), CHUNK):
            yield pairs[i : i + CHUNK].astype(np.int64)


def _packs(places: np.ndarray, start: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Ranges of entries of ``places``, ``CHUNK`` entries at once at most."""
    some, held = [], 0
    for a, b in zip(start[places].tolist(), start[places + 1].tolist(), strict=True):
        for x in range(a, b, CHUNK):
            y = min(b, x + CHUNK)
            if held + y - x > CHUNK:
                yield some
                some, held = [], 0
            some.append((x, y))
            held += y - x
    if some:
        yield some


def _asked(left: np.ndarray, fits: Callable[[np.ndarray], np.ndarray]) -> Iterator[int]:
    """The rows of ``left`` that fit when their turn comes; a row that doesn't fit never will."""
    i, step = 0, 64
    while i < len(left):
        part, taken = left[i : i + step], 0
        part = part[fits(part)]
        while len(part):
            yield int(part[0])
            taken += 1
            part = part[1:][fits(part[1:])]
        i += step
        step = min(CHUNK, 2 * step) if taken < 8 else max(64, step // 2)


def triangular_layers(edges: DataFrame, nodes: DataFrame, tiles: int | None = None) -> DataFrame:
    """``(id, layer, tile)`` for a lower-triangular matrix: within a layer no row of a tile uses a column that another tile
    of the layer holds or uses, so that the tiles of a layer are independent.

    Greedy from the last row to the first: the first layer gets a tile for every row that touches no earlier tile, up
    to ``tiles``; a later row joins the only tile it touches, or the smallest where it touches none; rows that
    touch several tiles wait for the next layer. Every decision depends on those before it, so one task decides; the entries pass
    through it into files of its own folder, and it holds a few numbers for each vertex.
    """
    low = (edges if is_stage(edges) else materialize(edges.filter("src >= dst"), "triangle")).filter("src >= dst")  # one task reads what is written
    alone = materialize(nodes.filter("id IS NOT NULL").select("id"), "nodes")
    rows = low.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).unionByName(alone.select(F.col("id").cast("long").alias("src"), F.lit(None).cast("long").alias("dst")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            matrix = _Triangle(batches, folder)
            layer, tile = matrix.layers(tiles)
        at = np.flatnonzero(matrix.row)
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(x[part].astype(np.int64)) for x in (matrix.ids, layer, tile)], ["id", "layer", "tile"])

    return rows.coalesce(1).mapInArrow(assign, "id long, layer long, tile long")


def proper_coloring(edges: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """``(id, color)`` without equal colours at the ends of any edge: in every round each uncoloured vertex draws a colour out of twice as many as
    it has neighbours, and two more, and keeps it where no neighbour has it, nor an uncoloured one that goes first has drawn it.

    A draw fails with probability 1/2 at most, so the rounds are about the logarithm of the number of vertices, and only edges of
    vertices without a colour are read again.
    """
    off = edges.filter("src <> dst").select("src", "dst")
    both = materialize(off.unionByName(off.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    free = materialize(nodes.select("id").join(degree, "id", "left").select("id", (2 * F.coalesce("degree", F.lit(0)) + 2).alias("palette")), "free")
    # edges whose first end has no colour yet, with the colour of the second, where it has one
    open_, done, turn = both.select("src", "dst", F.lit(None).cast("long").alias("color")), None, 0
    while not free.isEmpty():
        first = lambda c, turn=turn: F.xxhash64(c, F.lit(seed + 1), F.lit(turn))
        drawn = free.select("id", "palette", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(turn)), "palette").alias("drawn"))
        own, far = drawn.select(F.col("id").alias("src"), F.col("drawn").alias("mine")), drawn.select(F.col("id").alias("dst"), F.col("drawn").alias("theirs"))
        seen = open_.join(own, "src").join(far, "dst", "left")
        taken = (F.col("color") == F.col("mine")) | ((F.col("theirs") == F.col("mine")) & (F.struct(first("dst"), "dst") > F.struct(first("src"), "src")))
        beaten = seen.filter(taken).select(F.col("src").alias("id")).distinct().withColumn("lost", F.lit(True))
        state = materialize(drawn.join(beaten, "id", "left"), "colors")
        new = state.filter("lost IS NULL").select("id", F.col("drawn").alias("color"))
        done = new if done is None else done.unionByName(new)
        free = state.filter("lost").select("id", "palette")
        known = new.select(F.col("id").alias("dst"), F.col("color").alias("new"))
        open_ = materialize(open_.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(known, "dst", "left").select("src", "dst", F.coalesce("color", "new").alias("color")), "links")
        turn += 1
    return done if done is not None else nodes.select("id", F.lit(0).cast("long").alias("color")).limit(0)
