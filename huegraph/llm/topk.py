"""Exact top-k search by inner product with KD-trees over shards.

Every vector becomes integers, floor(scale * x). A shard (about ``shard_rows`` vectors) holds a KD-tree: median splits on the
widest dimension, and a tight box around the points below every node. The bound of a box for a query is the greatest inner
product any point of the box can have.

Traversal is best-first: each query has a frontier of boxes, takes the one of the greatest bound, opens it (its two halves
join the frontier) or scores its points, and ends when no bound reaches its k-th score so far. The queries of a batch
walk side by side, so that those at the same node share one product.

A tree is built once, where its shard's points meet. The queries among them search it there and then; their k-th scores
go with them to all other shards, whose trees are read as they were built.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

_LOWEST = -(2**62)


class KdTree:
    """Points in the order of the leaves, and nodes: the rows below each, its box, and its first child (the second is the next node);
    leaves have none. Node 0 is the root."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int):
        order, rows, child = np.arange(len(points)), [(0, len(points))], []
        for lo, hi in rows:  # grows while it is walked
            if hi - lo <= leaf:
                child.append(-1)
                continue
            own = order[lo:hi]
            here = points[own]
            dim, half = int(np.argmax(here.max(0) - here.min(0))), (hi - lo) // 2
            order[lo:hi] = own[np.argpartition(here[:, dim], half)]
            child.append(len(rows))
            rows += [(lo, lo + half), (lo + half, hi)]
        self.rows, self.child = np.array(rows), np.array(child)
        points = points[order]
        self.ids = ids[order]
        self.low = np.array([points[lo:hi].min(0) for lo, hi in rows]).astype(np.float64)
        self.high = np.array([points[lo:hi].max(0) for lo, hi in rows]).astype(np.float64)
        # the least integers that hold them: a tree travels as bytes
        self.points = points.astype(np.result_type(*(np.min_scalar_type(-1 - abs(int(v))) for v in (points.min(initial=0) + 1, points.max(initial=0)))))

    def bounds(self, node: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The bound of a node's box for queries, given as their positive and negative parts."""
        b = up @ self.high[node] + down @ self.low[node]
        return b + 1e-9 * np.abs(b)  # rounding must never hide a box

    def search(self, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The best ``k`` (scores, ids) for each query, of those that reach ``kth``, and the number of boxes looked at; missing ones have the
        lowest score. A query does not find its own id."""
        n = len(queries)
        best, who = np.full((n, k), _LOWEST, np.int64), np.full((n, k), -1, np.int64)
        q = queries.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        frontier = np.full((n, len(self.rows)), -np.inf)
        frontier[:, 0] = self.bounds(0, up, down)
        floor, open_, looked = kth.astype(np.int64), np.arange(n), n
        while True:
            pick = frontier[open_].argmax(1)
            alive = frontier[open_, pick] >= floor[open_]
            open_, pick = open_[alive], pick[alive]
            if not len(open_):
                return best, who, looked
            frontier[open_, pick] = -np.inf
            for node in np.unique(pick):
                own, child = open_[pick == node], int(self.child[node])
                if child >= 0:
                    for c in (child, child + 1):
                        frontier[own, c] = self.bounds(c, up[own], down[own])
                    looked += 2 * len(own)
                    continue
                lo, hi = self.rows[node]
                scores = _product(queries[own], self.points[lo:hi].astype(np.int64))
                scores[query_ids[own][:, None] == self.ids[None, lo:hi]] = _LOWEST
                use = scores.max(1) >= floor[own]
                own, scores = own[use], scores[use]
                s = np.concatenate([best[own], scores], 1)
                i = np.concatenate([who[own], np.broadcast_to(self.ids[lo:hi], scores.shape)], 1)
                top = np.lexsort((i, -s), axis=1)[:, :k]
                best[own], who[own] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                floor[own] = np.maximum(floor[own], best[own, -1])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where they are exact, else through Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _found(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, kth: np.ndarray, k: int, batch: int = 2_048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query_id, vec_id, score) of a tree's answers, for bounded numbers of queries at once."""
    for i in range(0, len(ids), batch):
        best, who, _ = tree.search(vectors[i : i + batch], ids[i : i + batch], kth[i : i + batch], k)
        row, col = np.nonzero(best > _LOWEST)
        yield ids[i : i + batch][row], who[row, col], best[row, col]


def _build(pdf: pd.DataFrame, k: int, leaf: int) -> pd.DataFrame:
    """A shard's tree as one row, and below it the answers to the queries among its points."""
    points, ids = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy()
    tree = KdTree(points, ids, leaf)
    own = pdf["chosen"].to_numpy()
    parts = [(np.empty(0, np.int64),) * 3, *_found(tree, ids[own], points[own], np.full(own.sum(), _LOWEST), k)]
    query, vec, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    out = pd.DataFrame({"query_id": query, "vec_id": vec, "score": score}).astype("Int64")
    row = pd.DataFrame({"query_id": [None], "vec_id": [None], "score": [None]}, dtype="Int64")
    out = pd.concat([row, out], ignore_index=True)
    out["tree"] = [pickle.dumps(tree)] + [None] * (len(out) - 1)
    out["dim"], out["shard"] = pdf["dim"].iloc[0], pdf["shard"].iloc[0]
    return out


def _visit(batches, k: int) -> Iterator[pa.RecordBatch]:
    """Answers of the trees (turn 0) to the queries behind each in the stream (turn 1); one tree is held at a time."""
    tree, place = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        dim, shard, known = (batch.column(c).to_numpy() for c in ("dim", "shard", "turn"))
        cuts = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (known[1:] != known[:-1])])
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            if not known[lo]:
                tree, place = pickle.loads(batch.column("tree")[lo].as_py()), (dim[lo], shard[lo])
            elif place == (dim[lo], shard[lo]):  # a shard may have no points of the queries' length
                part = batch.slice(lo, hi - lo)
                vectors = part.column("v").flatten().to_numpy().reshape(hi - lo, -1)
                for found in _found(tree, part.column("id").to_numpy(), vectors, part.column("kth").to_numpy(), k):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])


def quantize(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` and ``v`` (array of integers); rows with a null id, a null vector, null or non-finite components go."""
    e = F.transform(F.col(embedding), lambda x: x.cast("double"))
    whole = F.forall(F.col("e"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), e.alias("e")).filter(F.col("id").isNotNull() & F.col("e").isNotNull() & whole)
    return rows.select("id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"), F.size("e").alias("dim")).filter("dim > 0")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, shard_rows: int = 16_384, leaf: int = 256) -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` other rows with the greatest integer inner
    product: query_id, rank, vec_id, score; ties to the smaller id.

    Exact over all rows. Rows without a usable vector take no part; a query meets only vectors of its own
    length, which may be any. Fewer than ``k`` candidates: all of them. Of repeated rows with a query's id the least vector is the query,
    none is its candidate; a repeated candidate id fills as many ranks as it has rows. Empty table: no rows. Other columns are not read.

    Points are shuffled once, to their shard; trees once, to the queries, of which each shard gets all.
    """
    # a number for each row, written down: rows are dealt evenly by it, however often one is repeated
    rows = materialize(quantize(vectors, vec_id, embedding, scale).withColumn("u", F.rand(7)), "vectors")
    n = max([1, *(r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect())])  # a row for each length of vectors
    shards, is_query = -(-n // shard_rows), F.col("id") % every == 0
    one = rows.filter(is_query).groupBy("id").agg(F.min(F.struct("v", "u")).alias("q")).select("id", F.col("q.u").alias("u"), F.lit(True).alias("chosen"))
    rows = rows.join(one, ["id", "u"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))).withColumn("shard", F.floor(F.col("u") * shards).cast("int"))
    schema = "query_id long, vec_id long, score long, tree binary, dim int, shard int"
    built = materialize(rows.groupBy("dim", "shard").applyInPandas(lambda pdf: _build(pdf, k, leaf), schema), "trees")
    home = built.filter("tree IS NULL").select("query_id", "vec_id", "score", F.col("shard").alias("from"), "dim")
    found = home.select("query_id", "vec_id", "score")
    if shards > 1:
        best = home.groupBy(F.col("query_id").alias("id"), "dim", F.col("from").alias("own")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        queries = rows.filter("chosen").withColumnRenamed("shard", "own")
        queries = queries.join(best, ["id", "dim", "own"], "left").withColumn("kth", F.coalesce("kth", F.lit(_LOWEST)))
        sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> own")
        trees = built.filter("tree IS NOT NULL").select("dim", "shard", F.lit(0).alias("turn"), "tree")
        none = F.lit(None).cast("binary").alias("tree")
        stream = trees.unionByName(sent.select("dim", "shard", F.lit(1).alias("turn"), none, "id", "v", "kth"), allowMissingColumns=True)
        # a partition for each shard, so that a stream holds few trees
        stream = stream.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "turn")
        found = found.unionByName(stream.select("dim", "shard", "turn", "tree", "id", "v", "kth").mapInArrow(lambda it: _visit(it, k), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
