"""Variable-capacity best-fit packing of documents into training sequences.

Best-fit decreasing looks at lengths alone, so it runs on the histogram of piece lengths, which has at most as many
entries as the greatest capacity whatever the number of documents. The plan says for every length which run of
bins its pieces go to; a distributed rank within the length gives each piece its bin.

Several capacities are permitted. A piece goes to the open bin that it leaves least room in. Where none fits, a new bin is
opened: of the capacities that hold the piece the one of least cost for each token expected in it, where the
expectation comes from the lengths still to be packed. At the end every bin shrinks to the least permitted capacity
that holds its contents.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, with_columns

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence beside its slots, in slots: start-up and padding to whole kernels.
OVERHEAD = 16


class Plan:
    """Runs of bins for every length: arrays sorted by (length, first rank), and the bins' final capacities."""

    def __init__(self, runs: list[tuple[int, int, int, int]], bins: list[tuple[int, int]], capacities: tuple[int, ...]):
        runs.sort()
        self.length, self.rank, self.bin, self.offset = np.array(runs, np.int64).reshape(-1, 4).T
        bins.sort()
        self.first, self.used = np.array(bins, np.int64).reshape(-1, 2).T
        self.capacities = np.array(sorted(capacities), np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, offset in it and its capacity for the piece of each length with each rank (from 0)."""
        big = max(1, int(self.rank.max(initial=0)) + 1, int(rank.max(initial=0)) + 1)
        at = np.searchsorted(self.length * big + self.rank, length * big + rank, "right") - 1
        bins = self.bin[at] + rank - self.rank[at]
        used = self.used[np.searchsorted(self.first, bins, "right") - 1]
        return bins, self.offset[at], self.capacities[np.searchsorted(self.capacities, used)]


def _opened(length: int, fits: list[int], mean_rest: float) -> int:
    """The capacity of least cost for each token expected in it: the piece, and as much of the rest as pieces of
    the mean remaining length fill."""

    def cost(c: int) -> float:
        room = c - length
        filled = length + (room // mean_rest) * mean_rest if mean_rest > 0 else length
        return (c + OVERHEAD) / filled

    return min(fits, key=lambda c: (cost(c), c))


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> Plan:
    """Pack ``histogram`` (length to number of pieces; lengths from 1 to the greatest capacity)."""
    sizes = sorted(capacities)
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> runs of equal bins (first, count, used)
    rooms: list[int] = []  # in order
    runs: list[tuple[int, int, int, int]] = []
    closed: list[tuple[int, int]] = []
    bins, rest_tokens, rest_pieces = 0, sum(k * n for k, n in histogram.items()), sum(histogram.values())

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room == 0:
            closed.append((run[0], run[2]))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            # the least room that the piece fits into
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # one kind of bin for all that is left of this length; each bin takes what fits of it in later turns
                mean = rest_tokens / rest_pieces
                cap = _opened(length, [c for c in sizes if c >= length], mean)
                each = cap // length
                first, n = bins, -(-left // each)
                bins += n
                put(cap, (first, n, 0))
                continue
            room = rooms[at]
            first, n, used = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            take = min(n, left)
            if take < n:
                put(room, (first + take, n - take, used))
            runs.append((length, rank, first, used))
            put(room - length, (first, take, used + length))
            rank, left = rank + take, left - take
            rest_tokens -= take * length
            rest_pieces -= take
    closed += [(first, used) for own in open_.values() for first, _, used in own]
    return Plan(runs, closed, capacities)


def best_fit_pack(docs: DataFrame, doc_id: str = "doc_id", length: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, salt_rows: int = 50_000) -> DataFrame:
    """One row for each piece: ``doc_id``, ``piece`` (from 0), ``start`` and ``n_tokens`` of the piece in its document,
    ``bin_id``, ``bin_offset`` and ``capacity``, the bin's final size.

    A document longer than the greatest capacity is cut into pieces of that size and a rest. Null, zero and negative
    lengths: one row with 0 tokens and null bin, offset and capacity. Repeated rows are packed as
    often as they occur; a null id is packed like any other. Pieces of equal length are interchangeable: they are
    ranked by hashed id, then id. Other columns are not read. Empty table: no rows.

    The driver gets the histogram alone, at most as many rows as the greatest capacity.
    """
    top = max(capacities)
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), n.alias("n"))
    pieces = F.expr(f"sequence(0L, greatest((n + {top - 1}) div {top}, 1L) - 1L)")
    cut = rows.select("doc_id", "n", F.explode(pieces).alias("piece")).withColumn("start", F.col("piece") * top)
    cut = cut.withColumn("n_tokens", F.least(F.col("n") - F.col("start"), F.lit(top))).drop("n")
    cut = materialize(cut, "pieces")
    # a hot length is spread over salts; within one the rank is a window, between them a prefix sum
    salts = cut.count() // salt_rows + 16
    used = cut.filter("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = used.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
    histogram = {r.n_tokens: r.c for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(plan(histogram, capacities)))

    def placed(batches) -> Iterator[pa.RecordBatch]:
        own: Plan = pickle.loads(packed.value)
        for batch in batches:
            if batch.num_rows:
                b, o, c = own.place(batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy())
                yield with_columns(batch, ["rank"], bin_id=pa.array(b), bin_offset=pa.array(o), capacity=pa.array(c))

    within = Window.partitionBy("n_tokens", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "piece")
    ranked = used.withColumn("r", F.row_number().over(within) - 1).join(starts.drop("c"), ["n_tokens", "salt"])
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    cols = ["doc_id", "piece", "start", "n_tokens"]
    out = ranked.select(*cols, (F.col("r") + F.col("base")).alias("rank")).mapInArrow(placed, f"doc_id {kind}, piece long, start long, n_tokens long, bin_id long, bin_offset long, capacity long")
    none = F.lit(None).cast("long")
    empty = cut.filter("n_tokens = 0").select(*cols, none.alias("bin_id"), none.alias("bin_offset"), none.alias("capacity"))
    return out.unionByName(empty)
