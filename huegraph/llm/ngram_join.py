"""Similarity join on the Jaccard index of word n-grams, by a MinHash LSH forest.

1. Every text becomes its set of n-gram hashes (64 bits) and a signature of ``trees * depth`` minima. Texts
   with the same set are one representative with a number of copies, named by the set's hash.
2. A tree sorts the representatives by its share of the signature, as a prefix trie. The first one below a trie node is the node's pivot.
   A representative starts at the node of the longest prefix it shares with others and is compared with the pivot there, by whole
   signatures; then its prefix is shortened, as long as it is not covered, down to the length at which a pair at the threshold shares a
   node of some tree with the target probability (``forest_depth``), and no further. It is covered by a pivot that is all but equal, or by one
   that hangs together with the pivot of the shortest prefix. What stays uncovered (strays) is compared with all below that node, in blocks.
   Equal minima of at least ``least_agreement`` link two candidates: the share of pairs at the threshold that have fewer is a hundredth of
   what the target recall leaves. Linked candidates form families (connected components).
3. Within a family all pairs are verified exactly on the n-gram sets, in blocks of bounded size. Links are
   counted there; pairs are never emitted, only the count of each member and a spanning forest.

No trie node, family or partner list is capped: larger ones have more chunks and blocks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, settings, text_batches, with_columns
from .components import components

_BLOOM = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__optimizer__runtime__bloomFilter__enabled": "true", "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0", "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1g"}
_WORD = re.compile(r"[^ \t-\r]+")
_FACTORS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """Word to a 64-bit hash, the same on every machine."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) >= 200_000:
            self.clear()
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word windows; of all words together where there are fewer."""
    found = _WORD.findall(text or "")
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : len(h) - width + 1 + k] * _FACTORS[k]
    return np.unique(_mix(total))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _hashers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of ``size`` hash functions of 32 bits."""
    rng = np.random.default_rng(17)
    return rng.integers(0, 2**32, size, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, size, dtype=np.uint32)


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The low 16 bits of the minimum by each hash function."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * a + b).min(0), out=low)
    return low.astype(np.uint16).tobytes()


def forest_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at ``threshold`` shares a node of some tree with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_agreement(threshold: float, size: int, recall: float) -> int:
    """The number of equal minima that a pair at ``threshold`` misses with a hundredth of the probability 1 - ``recall`` at most."""
    below = 0.0
    for k in range(size):
        below += math.comb(size, k) * threshold**k * (1 - threshold) ** (size - k)
        if below > (1 - recall) / 100:
            return k
    return size


def _whole_groups(batches, key: list[str]) -> Iterator[pa.Table]:
    """Tables that hold all rows of their groups, from batches that come sorted by ``key``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cuts = _starts(t, key)
        if cuts[-1]:
            yield t.slice(0, cuts[-1])
        held = t.slice(cuts[-1])
    if held is not None:
        yield held


def _starts(t: pa.Table, key: list[str]) -> np.ndarray:
    cols = [t.column(k).to_numpy() for k in key]
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])


def _groups(batches, key: list[str]) -> Iterator[pa.Table]:
    """A table for each value of ``key`` from batches that come sorted by it."""
    for t in _whole_groups(batches, key):
        starts = _starts(t, key)
        for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
            yield t.slice(lo, hi - lo)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of each of ``n`` nodes: the smallest node of its component under the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _signatures(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint16) for x in column])


def _agree(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y with at least ``least`` equal minima."""
    rows, cols = [], []
    for i in range(0, len(x), 64):
        r, c = np.nonzero((x[i : i + 64, None, :] == y[None, :, :]).sum(2) >= least)
        rows.append(r + i)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def descend(path: np.ndarray, sig: np.ndarray, first: np.ndarray, used: int, least: int, close: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tries in sorted order: rows of minima ``path``, whole signatures, and whether a row is the first below a node of ``used`` minima. Gives
    (row, pivot) of all linked pairs, and which rows stay uncovered."""
    n, depth = path.shape
    at = np.arange(n)
    change = [first]
    for j in range(depth):
        change.append(change[-1] | np.r_[True, path[1:, j] != path[:-1, j]])
    covered, before = first.copy(), at
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(depth, used - 1, -1):  # from the longest prefix to the shortest
        pivot = np.maximum.accumulate(np.where(change[d] if d > used else first, at, 0))
        open_ = np.flatnonzero((pivot != before) & ~covered)
        before = pivot
        agree = np.empty(len(open_), np.int64)
        for i in range(0, len(open_), 8192):
            rows = open_[i : i + 8192]
            agree[i : i + 8192] = (sig[rows] == sig[pivot[rows]]).sum(1)
        hit = open_[agree >= least]
        found.append((hit, pivot[hit]))
        covered[open_[agree >= close]] = True
    linked = first.copy()
    for rows, pivots in reversed(found):  # pivots of shorter prefixes first
        linked[rows] |= linked[pivots]
    rows, pivots = (np.concatenate(c) for c in zip(*found, strict=True))
    return rows, pivots, ~(covered | linked)


def _trie_pass(batches, used: int, least: int, close: int, chunk: int):
    """For every member of a node: the pivots it is linked with, and whether it is a stray. Signatures go on where a node has strays, or may
    have some in another chunk."""
    for t in _whole_groups(batches, ["node", "chunk"]):
        first = np.zeros(t.num_rows, bool)
        first[_starts(t, ["node", "chunk"])] = True
        key, c = t.column("key").to_numpy(), t.column("c").to_numpy()
        sig = _signatures(t.column("sig").to_pylist())
        rows, pivots, stray = descend(_signatures(t.column("path").to_pylist()), sig, first, used, least, close)
        stray &= c > 2  # of two the other one is the pivot
        order = np.argsort(rows, kind="stable")
        near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(key)))].astype(np.int32)), pa.array(key[pivots[order]]))
        group = np.cumsum(first) - 1
        open_ = (np.bincount(group, stray) > 0)[group] | (c > chunk)
        keep = np.flatnonzero((open_ | ~first) & ~(first & (t.column("chunk").to_numpy() > 0)))  # a pivot stands in every chunk of its node
        kept = pa.array([x if o else None for x, o in zip(t.column("sig").to_pylist(), open_, strict=True)], pa.binary())
        out = pa.RecordBatch.from_arrays([t.column("node").combine_chunks(), pa.array(key), pa.array(c), kept, pa.array(stray), near], names=["node", "key", "c", "sig", "stray", "near"])
        yield out.take(pa.array(keep))


def _stray_edges(batches, least: int):
    """Within a group: edges between strays (is_stray) and members, as (id, smallest id it hangs on)."""
    for t in _groups(batches, ["node", "stray_block", "member_block"]):
        ids, stray = t.column("key").to_numpy(), t.column("is_stray").to_numpy()
        sig = _signatures(t.column("sig").to_pylist())
        if not stray.any() or stray.all():
            continue
        a, b = _agree(sig[stray], sig[~stray], least)
        a, b = ids[stray][a], ids[~stray][b]
        names = np.unique(np.concatenate([a, b]))
        if len(names) > 1:
            root = names[_forest(len(names), np.searchsorted(names, a), np.searchsorted(names, b))]
            use = names != root
            yield pa.RecordBatch.from_arrays([pa.array(names[use]), pa.array(root[use])], names=["a", "b"])


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    a, b = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(a, b)
    for i in range(0, len(shared), 2048):
        part = shared[i : i + 2048]

        def dense(sets, part=part):
            m = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                at = np.searchsorted(part, s)
                at[at == len(part)] = 0
                m[k, at[part[at] == s]] = 1
            return m

        out += (dense(x) @ dense(y).T).astype(np.int64)
    return out


def _cut(batches, n: int):
    """The n-gram sets of the members' texts, each text cut once. An id may stand on several rows: only the text whose set is meant counts."""
    words = _Words()
    for batch, texts in text_batches(batches):
        sets = [shingles(t, n, words) for t in texts]
        meant = [set_key(s) == k for s, k in zip(sets, zip(batch.column("key").to_pylist(), batch.column("k2").to_pylist(), strict=True), strict=True)]
        yield with_columns(batch, ["text", "k2"], grams=pa.array([s.tobytes() for s in sets], pa.large_binary())).filter(pa.array(meant))


def _verify(batches, num: int, den: int):
    """Exact links within a family's block: for each member its weighted links and the least member it hangs on."""
    for t in _groups(batches, ["family", "i", "j"]):
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ids, use = np.unique(t.column("key").to_numpy(), return_index=True)  # repeated rows of a text count once here, all in ``copies``
        block, copies = t.column("block").to_numpy()[use], t.column("copies").to_numpy()[use]
        grams = t.column("grams").to_pylist()
        sets = [np.frombuffer(grams[r], np.uint64) for r in use]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            continue
        both = _overlaps([sets[r] for r in left], [sets[r] for r in right])
        size = np.array([len(s) for s in sets], np.int64)
        linked = den * both >= num * (size[left][:, None] + size[right][None, :] - both)
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), np.int64)
        links[left] += linked @ copies[right]
        if i != j:
            links[right] += linked.T @ copies[left]
        a, b = np.nonzero(linked)
        root = ids[_forest(len(ids), left[a], right[b])]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], names=["key", "links", "root"])


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 16, depth: int = 8, recall: float = 0.9995, close: float = 0.98, chunk: int = 1_024, block: int = 1_024, block_size: int = 1_000_000) -> DataFrame:
    """One row for each input row: ``doc_id``, ``class_id`` (the smallest id connected to it by links), ``rep_id`` (the
    smallest id with the same n-gram set) and ``n_links``, the number of other rows with a Jaccard index of at least
    ``threshold`` (numerator, denominator).

    Words are runs without ASCII white space, compared as they are; a text of fewer than ``n`` words is one
    n-gram. A text without words (null, empty) is its own class and has no links. A row with a null id has null
    class and no links. Repeated rows are links of each other; of rows with one id and different texts each has its own links. Texts of any
    length count whole. Other columns are not read. Empty table: no rows.

    A pair at the threshold is found with probability ``recall`` at least (less a hundredth of the rest), more similar ones more often; links
    are exact, on 64-bit n-gram hashes.
    """
    size, (num, den) = trees * depth, threshold
    used, least = forest_depth(num / den, trees, depth, recall), least_agreement(num / den, trees * depth, recall)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def signed(batches):
        (a, b), words = _hashers(size), _Words()
        for batch, texts in text_batches(batches):
            sets = [shingles(t, n, words) for t in texts]
            keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
            yield with_columns(batch, ["text"], k1=pa.array(keys[:, 0]), k2=pa.array(keys[:, 1]), n=pa.array([len(s) for s in sets], pa.int64()), sig=pa.array([_signature(s, a, b) if len(s) else None for s in sets], pa.binary()))

    rows = materialize(source.mapInArrow(signed, "id long, k1 long, k2 long, n long, sig binary"), "sets")
    sets = rows.filter("n > 0 AND id IS NOT NULL")
    reps = materialize(sets.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps").withColumnRenamed("k1", "key")

    # 2: nodes of the shortest prefix with two members or more; a set that no other set can be near to takes no part
    apart = reps.filter(F.col("n") * (den - num) >= num)
    prefix = lambda t, minima: F.substring("sig", 2 * t * depth + 1, 2 * minima)
    below = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), prefix(t, used)).alias("node")) for t in range(trees))))
    nodes = apart.select("key", below.alias("x")).select("key", "x.tree", "x.node")
    full = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("pivot")).filter("c > 1")
    is_pivot, chunks = F.col("key") == F.col("pivot"), F.ceil(F.col("c") / chunk)
    spread = lambda blocks, salt: F.pmod(F.xxhash64("key", F.lit(salt)), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    # a large node is dealt to chunks; its pivot goes to all of them, and first in each
    mine = F.when(is_pivot, F.sequence(F.lit(0), (chunks - 1).cast("int"))).otherwise(F.array(spread(chunks, 4)))
    members = nodes.join(full, "node").select("node", "tree", "key", "c", (~is_pivot).alias("turn"), F.explode(mine).alias("chunk"))
    path = F.expr(f"substring(sig, {2 * depth} * tree + 1, {2 * depth})")
    tries = members.join(apart.select("key", "sig"), "key").withColumn("path", path).drop("tree").repartition("node", "chunk").sortWithinPartitions("node", "chunk", "turn", "path", "key")
    matched = materialize(tries.mapInArrow(lambda it: _trie_pass(it, used, least, math.ceil(close * size), chunk), "node long, key long, c long, sig binary, stray boolean, near array<long>"), "members")
    near = matched.select(F.col("key").alias("a"), F.explode("near").alias("b"))
    counts = matched.filter("stray").groupBy("node").agg(F.count(F.lit(1)).alias("strays"))
    stray_blocks, member_blocks = F.ceil(F.col("strays") / block), F.ceil(F.col("c") / block)
    open_ = matched.join(counts, "node").select("node", "key", "sig", "stray", "c", "strays")
    cols = ["node", "key", "sig", "stray_block", "member_block", "is_stray"]
    as_stray = open_.filter("stray").withColumn("stray_block", spread(stray_blocks, 1)).withColumn("member_block", every(member_blocks)).withColumn("is_stray", F.lit(True))
    as_member = open_.withColumn("member_block", spread(member_blocks, 2)).withColumn("stray_block", every(stray_blocks)).withColumn("is_stray", F.lit(False))
    group = ["node", "stray_block", "member_block"]
    strays = as_stray.select(*cols).unionByName(as_member.select(*cols)).repartition(*group).sortWithinPartitions(*group)
    families = components(near.unionByName(strays.mapInArrow(lambda it: _stray_edges(it, least), "a long, b long")))
    release(matched)

    # 3: exact links within the families
    known = materialize(families.withColumnRenamed("id", "key").join(reps.drop("sig"), "key").select("key", F.col("root").alias("family"), "rep", "copies", "n", "k2"), "families")
    count = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_size)).cast("int")
    sizes = materialize(known.groupBy("family").agg(count.alias("blocks")), "sizes")
    # blocks are dealt before the texts come: a large family is split as a skewed join, or its size is broadcast where all are few
    dealt = materialize(known.join(sizes, "family").withColumn("block", spread(F.col("blocks"), 3)), "dealt")
    # the same plan at every size: texts are shuffled by id, and a Bloom filter of the members' ids (its size is fixed by
    # Spark's settings) keeps those of all other documents out of the shuffle
    texts = dealt.filter("copies >= 1").join(source.withColumnRenamed("id", "rep"), "rep").select("family", "block", "blocks", "key", "k2", "copies", "text")
    grams = texts.mapInArrow(lambda it: _cut(it, n), "family long, block int, blocks int, key long, copies long, grams binary")
    grams = grams.withColumn("other", every(F.col("blocks"))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    cut = ["family", "i", "j"]
    grams = grams.select(*cut, "block", "key", "copies", "grams").repartition(*cut).sortWithinPartitions(*cut)
    with settings(docs.sparkSession, **_BLOOM):
        links = materialize(grams.mapInArrow(lambda it: _verify(it, num, den), "key long, links long, root long"), "links")
    release(sizes, dealt)
    classes = components(links.filter("links > 0 AND key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "key")
    low = classes.join(known.select("key", "rep"), "key").groupBy("root").agg(F.min("rep").alias("class_id"))
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))

    own = reps.select("key", "k2", "rep", "copies").join(counted, "key", "left").join(classes.join(low, "root").select("key", "class_id"), "key", "left")
    own = own.select(F.col("key").alias("k1"), "k2", F.col("rep").alias("rep_id"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sets.select("id", "k1", "k2").join(own, ["k1", "k2"]).select("id", "class_id", "rep_id", "n_links")
    alone = rows.filter("n = 0 OR id IS NULL").select("id", F.col("id").alias("class_id"), F.col("id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).withColumnRenamed("id", "doc_id")
