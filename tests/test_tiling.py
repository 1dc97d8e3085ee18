import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from huegraph.functions.columns import TILE_COSTS
from huegraph.operators import sectioning, tiling
from huegraph.sources.graphs import grid


def up(n, m):
    return -(-n // m) * m


COSTS = {
    "d1": lambda r, c, d: 4 * (c + r + 1),
    "d2": lambda r, c, d: 4 * (c + r + 1 + c + r),
    "d2_sortnet": lambda r, c, d: 4 * (c + r + 1 + (up(d, 32) + 1) * r),
    "d1_warp": lambda r, c, d: 4 * (c + r + 1) + up(r, 2) * 128,
    "d2_warp": lambda r, c, d: 4 * (c + r + 1 + (up(d, 32) + 1) * 16 * r) + up(r, 2) * 128,
    "d2_warp_small": lambda r, c, d: 4 * (c + r + 1 + (c + r) * 16) + up(r, 2) * 128,
}


def greedy(degree, cost, budget):
    out, lo, cols, top = [], 0, 0, max(degree)
    for i, d in enumerate(degree):
        cols += d
        if cost(i + 1 - lo, cols, top) > budget:
            out.append((lo, i))
            lo, cols = i, d
    return [*out, (lo, len(degree))]


@pytest.mark.parametrize("variant", TILE_COSTS)
def test_greedy_tiles_equal_a_loop(spark, variant):
    rng = random.Random(3)
    degree = [rng.choice([0, 1, 2, 5, 30]) for _ in range(400)] + [0] * 5
    edges = spark.createDataFrame([(i, j) for i, d in enumerate(degree) for j in range(d)], "src long, dst long")
    budget = 4 * COSTS[variant](1, 30, 30)
    got = sorted(tuple(r) for r in tiling.greedy_tiles(edges, spark.range(len(degree)), variant, budget).collect())
    want = greedy(degree, COSTS[variant], budget)
    assert got == [(t, lo, hi) for t, (lo, hi) in enumerate(want)]
    stats = tiling.tile_stats(spark.createDataFrame(got, "tile long, lo long, hi long"), edges, spark.range(len(degree))).first()
    sizes = [(hi - lo, sum(degree[lo:hi])) for lo, hi in want]
    biggest = max(reversed(sizes), key=sum)
    assert tuple(stats) == (len(sizes), max(n for n, _ in sizes), max(e for _, e in sizes), *biggest)


def test_greedy_tiles_refuse(spark):
    edges = spark.createDataFrame([(0, i) for i in range(100)], "src long, dst long")
    with pytest.raises(ValueError, match="budget"):
        tiling.greedy_tiles(edges, spark.range(100), "d1", 100)
    with pytest.raises(ValueError, match="variant"):
        tiling.greedy_tiles(edges, spark.range(100), "d3")
    own = tiling.greedy_tiles(edges, spark.range(100), budget=150, cost=lambda rows, cols, degree: rows + cols)
    assert sorted(tuple(r) for r in own.collect()) == [(0, 0, 50), (1, 50, 100)]
    assert tiling.greedy_tiles(edges.limit(0), spark.range(0)).collect() == []


def test_equal_parts(spark):
    assert [tuple(r)[1:] for r in tiling.equal_parts(spark, 10, 4).orderBy("part").collect()] == [(0, 3), (3, 6), (6, 8), (8, 10)]
    assert [tuple(r)[1:] for r in tiling.equal_parts(spark, 2, 3).orderBy("part").collect()] == [(0, 1), (1, 2), (2, 2)]
    with pytest.raises(ValueError):
        tiling.equal_parts(spark, 0, 3)


def assignment(spark, n=60, layers=3, tiles=4, seed=5):
    rng = random.Random(seed)
    rows, at = [], [0] * layers
    for i in range(n):
        layer = rng.randrange(layers)
        rows.append((i, layer, rng.randrange(tiles), at[layer]))
        at[layer] += 1
    return rows, spark.createDataFrame(rows, "id long, layer int, tile int, pos long")


def test_border_order_and_redundancy_equal_loops(spark):
    rows, assigned = assignment(spark)
    rng = random.Random(6)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(70)] + [(55, 55)]
    tile = {i: t for i, _, t, _ in rows}
    out = {i: [b for a, b in edges if a == i and tile[b] != tile[i]] for i in tile}
    want, offsets, place = {}, {}, 0
    for t in range(4):
        for layer in range(3):
            own = [i for i, lay, tt, _ in sorted(rows, key=lambda r: r[3]) if (lay, tt) == (layer, t)]
            front, back = [i for i in own if out[i]], [i for i in own if not out[i]][::-1]
            if own:
                offsets[t, layer] = place + len(front)
            for i in front + back:
                want[i] = place
                place += 1
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.id: r.new_pos for r in tiling.border_first(df, assigned).collect()} == want
    assert {(r.tile, r.layer): r.offset for r in tiling.border_offsets(df, assigned).collect()} == offsets
    shares = []
    for t in range(4):
        own = [(a, b) for a, b in edges if tile[a] == t]
        shares.append(sum(tile[b] != t for _, b in own) / len(own) if own else 0.0)
    got = tiling.redundancy(df, assigned).first()
    assert tuple(got) == pytest.approx((sum(shares) * 25, min(shares) * 100, max(shares) * 100, sum(bool(x) for x in out.values()) * 100 / 60))
    assert tuple(tiling.redundancy_single(spark).first()) == (0.0, 0.0, 0.0, 0.0)


def test_orders(spark):
    rows, assigned = assignment(spark)
    for f, key in ((tiling.layer_major, lambda r: (r[1], r[2], r[3])), (tiling.tile_major, lambda r: (r[2], r[1], r[3]))):
        assert {r.id: r.new_pos for r in f(assigned).collect()} == {r[0]: i for i, r in enumerate(sorted(rows, key=key))}
    starts = {(r.tile, r.layer): r.start for r in tiling.tile_starts(assigned).collect()}
    assert {(r.tile, r.layer): r.offset for r in tiling.single_offsets(assigned).collect()} == starts


def test_coarsening(spark):
    sizes = {0: (2, 2), 1: (1, 2), 2: (3, 0), 3: (1, 1), 4: (1, 1)}
    rows = [(layer, t) for layer, s in sizes.items() for t, n in enumerate(s) for _ in range(n)]
    df = spark.createDataFrame(rows, "layer int, tile int")
    run = lambda *a, **b: [r.new_layer for r in tiling.coarsen(df, *a, **b).orderBy("layer").collect()]
    assert run(4) == [0, 0, 1, 2, 3]  # layer 2 does not fit and ends the merging
    assert run(4, end_at_first=False) == [0, 0, 1, 1, 2]
    assert run(100) == [0] * 5 and run(1) == [0, 1, 2, 3, 4]
    assert tiling.coarsen(df.limit(0), 4).collect() == []


def test_balanced_partition(spark):
    edges, nodes = grid(spark, 6, 6, 6)
    parts = sectioning.balanced_partition(edges, nodes, 5, rounds=2)
    row = sectioning.cut_size(edges, parts).first()
    assert parts.select("id").distinct().count() == 216 == parts.count()
    assert row.most <= 45 and row.least >= 41
    start = sectioning.cut_size(edges, sectioning.balanced_partition(edges, nodes, 5, rounds=0)).first()
    assert row.cut <= start.cut
    with pytest.raises(ValueError):
        sectioning.balanced_partition(edges, nodes, 1000)


def test_sectioning_respects_capacity_and_layers(spark):
    edges, nodes = grid(spark, 4, 4, 3)
    layers = nodes.selectExpr("id", "cast(id div 16 as int) as layer")
    got = sectioning.section_layers(edges, layers, 4).collect()
    assert sorted(r.id for r in got) == list(range(48))
    count = {}
    for r in got:
        assert r.layer == r.id // 16 and 0 <= r.tile < 4
        count[r.layer, r.tile] = count.get((r.layer, r.tile), 0) + 1
    assert max(count.values()) == 4
    # a layer on top of another is cut alike: each vertex has one neighbour in the layer before
    tile = {r.id: r.tile for r in got}
    assert all(tile[i] == tile[i % 16] for i in tile)


def test_preassignment_and_weights(spark):
    layers = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 1), (6, 1)], "id long, layer int")
    done = spark.createDataFrame([(0, 5), (1, 6)], "id long, tile long")
    edges = spark.createDataFrame([(2, 0), (2, 0), (3, 0), (3, 1), (2, 3), (2, 4), (5, 1), (6, 0), (2, 5), (2, 6), (2, 2)], "src long, dst long")
    links = sectioning.layer_links(edges, layers)
    fixed = sectioning.preassigned(links, done, 1, 0)
    assert sorted(tuple(r) for r in fixed.collect()) == [(2, 5), (5, 6), (6, 5)]
    got = sorted(tuple(r) for r in sectioning.edge_weights(links, fixed, 1).collect())
    assert got == [(2, 3, 2), (2, 5, 1), (2, 6, 2)]  # inside the layer and off the diagonal only


def test_fixed_tiles_start_the_cut(spark):
    edges, nodes = grid(spark, 4, 4, 2)
    fixed = spark.createDataFrame([(i, 0) for i in range(20)] + [(31, 2)], "id long, tile long")
    got = {r.id: r.tile for r in sectioning.balanced_partition(edges, nodes, 4, rounds=0, slack=0.111, fixed=fixed).collect()}
    sizes = [list(got.values()).count(t) for t in range(4)]
    assert sorted(got) == list(range(32)) and max(sizes) <= 8 and all(got[i] == 0 for i in range(8)) and got[31] == 2


@pytest.mark.parametrize("method", ["votes", "cut"])
def test_whole_tiling(spark, method):
    edges, nodes = grid(spark, 5, 4, 6)
    layers = nodes.selectExpr("id", "cast(id div 20 as int) as layer")
    made = sectioning.tile_graph(edges, layers, 3, method)
    rows = {r.id: (r.tile, r.layer, r.pos) for r in made.assigned.collect()}
    order = {r.id: r.new_pos for r in made.order.collect()}
    assert sorted(rows) == list(range(120)) and sorted(order.values()) == list(range(120))
    out = {r.src for r in edges.collect() if rows[r.src][0] != rows[r.dst][0]}
    at = 0
    for r in sorted(made.starts.collect(), key=lambda r: (r.tile, r.layer)):
        own = sorted((i for i in rows if rows[i][:2] == (r.tile, r.layer)), key=lambda i: rows[i][2])
        want = [i for i in own if i in out] + [i for i in own if i not in out][::-1]
        assert (r.start, r.nodes) == (at, len(own)) and [order[i] for i in want] == list(range(at, at + len(own)))
        at += len(own)
    offsets = {(r.tile, r.layer): r.offset for r in made.offsets.collect()}
    assert len(offsets) == made.starts.count() and made.report.count() == 1
    with pytest.raises(ValueError):
        sectioning.tile_graph(edges, layers, 3, "other")


def test_one_layer(spark):
    edges, nodes = grid(spark, 4, 4, 2)
    made = sectioning.simple_tiling(edges, nodes, 4)
    assert {r.layer for r in made.assigned.collect()} == {0} and made.most == 8
    assert sorted(r.new_pos for r in made.order.collect()) == list(range(32))


def test_greedy_blocks_equal_a_loop(spark):
    rng = random.Random(8)
    degree = [rng.choice([0, 1, 3, 9]) for _ in range(700)]
    edges = spark.createDataFrame([(i, j) for i, d in enumerate(degree) for j in range(d)], "src long, dst long")
    for budget in (60, 200, 4000):
        got = sorted(tuple(r)[1:] for r in tiling.greedy_tiles(edges, spark.range(700), "d1", budget, block=16).collect())
        assert got == greedy(degree, COSTS["d1"], budget)


@pytest.mark.parametrize("tiles", [None, 3])
def test_triangular_layers_are_independent(spark, tiles):
    edges, nodes = grid(spark, 5, 4, 3)
    got = {r.id: (r.layer, r.tile) for r in sectioning.triangular_layers(edges, nodes, tiles).collect()}
    assert sorted(got) == list(range(60))
    uses = {}
    for r in edges.filter("src >= dst").collect():
        uses.setdefault((got[r.src][0], r.dst), set()).add(got[r.src][1])
    assert all(len(t) == 1 for t in uses.values())
    if tiles:
        assert max(t for _, t in got.values()) < tiles


def test_coloring_is_proper(spark):
    edges, nodes = grid(spark, 5, 5, 3)
    more = edges.select("src", "dst").union(spark.createDataFrame([(0, 74), (3, 3)], "src long, dst long"))
    got = {r.id: r.color for r in sectioning.proper_coloring(more, nodes).collect()}
    assert sorted(got) == list(range(75))
    assert all(got[r.src] != got[r.dst] for r in more.collect() if r.src != r.dst)
    assert sectioning.proper_coloring(more.limit(0), spark.range(0)).collect() == []


def test_triangular_layers_hold_no_entries(tmp_path):
    rng, n, many = np.random.default_rng(5), 1000, 600
    def batches():
        yield pa.record_batch([pa.array(np.arange(n)), pa.nulls(n, pa.int64())], ["src", "dst"])
        for _ in range(many):
            a, b = rng.integers(0, n, (2, 10_000))
            yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["src", "dst"])
    tracemalloc.start()
    matrix = sectioning._Triangle(batches(), str(tmp_path))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(matrix.by_row[1]) > 5_900_000 and peak < 6_000_000 * 16
