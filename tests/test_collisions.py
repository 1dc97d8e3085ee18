import random
from collections import Counter

import numpy as np
import pytest

from huegraph.functions.columns import KS, WS, bit_reverse, color, hash_value, round_up
from huegraph.operators import collisions

from pyspark.sql import functions as F


def h(v, k):
    d = 2**k - 1
    return (v // d) << k | v % d


def brute(edges, n, ks=KS, ws=WS):
    """Both reports by plain loops over the rows of the matrix."""
    near = [[] for _ in range(n)]
    for a, b in edges:
        if a != b:
            near[a].append(b)
    one, two = {}, {}
    for k in ks:
        for w in ws:
            c = lambda v: h(v, k) & (2**w - 1)  # noqa: B023, E731
            d1 = [sum(c(u) == c(v) for u in near[v]) for v in range(n)]
            d2 = [max(Counter(map(c, [v, *near[v]])).values()) - 1 for v in range(n)]
            one[k, w], two[k, w] = (sum(d1), max(d1)), (sum(d2), max(d2))
    return one, two


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def cells(df):
    return {(r.k, r.w): (r.total, r["max"]) for r in df.collect()}


def both(pairs):
    return [*pairs, *((b, a) for a, b in pairs)]


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return both({(min(p), max(p)) for p in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if p[0] != p[1]})


CASES = {
    "pair": (both([(0, 7)]), 8),
    "path": (both([(0, 1), (1, 2), (2, 3)]), 4),
    "star": (both([(0, i) for i in range(1, 201)]), 201),
    "isolated": ([], 3),
    "diagonal": ([*both([(0, 7)]), *((i, i) for i in range(8))], 8),
    "duplicate": (both([(0, 7)]) * 2, 8),
    "random": (random_graph(60, 500, 1), 60),
}


@pytest.mark.parametrize("name", CASES)
def test_reports_equal_loops(spark, name):
    edges, n = CASES[name]
    one, two = brute(edges, n)
    df = frame(spark, edges)
    assert cells(collisions.d1_collisions(df)) == one and len(one) == 128
    assert cells(collisions.d2_collisions(df)) == two
    assert cells(collisions.d2_collisions(df, hub=5)) == two  # vertices above five neighbours by the other branch


def test_known_cells(spark):
    star = frame(spark, both([(0, i) for i in range(1, 2001)]))
    one, two = cells(collisions.d1_collisions(star, [3])), cells(collisions.d2_collisions(star, [3]))
    assert one == two and one[3, 3] == (570, 285) and one[3, 4] == (284, 142) and one[3, 10] == (4, 2)
    twice = frame(spark, both([(0, 7)]) * 2)
    assert cells(collisions.d1_collisions(twice, [3]))[3, 3] == (4, 2)
    assert {v for key, v in cells(collisions.d2_collisions(twice, [3])).items()} == {(4, 2), (2, 1)}


def test_part_graph_of_the_small_tables(spark):
    from huegraph.plans import queries

    one = cells(queries.d1_collisions(spark, "/root/testdata/sf0.01"))
    two = cells(queries.d2_collisions(spark, "/root/testdata/sf0.01"))
    assert (one[3, 3], one[3, 10], one[18, 10]) == ((33006, 41), (180, 2), (134, 1))
    assert (two[3, 3], two[3, 10], two[18, 10]) == ((42361, 41), (2039, 2), (1885, 1))


def test_invariants_per_vertex(spark):
    edges, n = CASES["random"]
    df, nodes = frame(spark, edges), spark.range(n + 2)
    one = {(r.id, r.k, r.w): r.d1 for r in collisions.d1_per_node(df, nodes).collect()}
    two = {(r.id, r.k, r.w): r.d2 for r in collisions.d2_per_node(df, nodes).collect()}
    assert len(one) == len(two) == (n + 2) * 128
    for (i, k, w), d in one.items():
        assert two[i, k, w] >= d
        if w > 3:
            assert d <= one[i, k, w - 1] and two[i, k, w] <= two[i, k, w - 1]
    assert all(v[0] % 2 == 0 for v in cells(collisions.d1_collisions(df)).values())


def test_a_vertex_over_many_batches():
    import pyarrow as pa

    ids, v = np.r_[np.zeros(900), np.ones(50), np.full(5, 2)].astype(np.int64), np.arange(955)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100]), pa.array(v[i : i + 100])], names=["id", "v"]) for i in range(0, 955, 100)]
    runs = list(collisions._whole_vertices(batches, least=150))
    assert np.concatenate([a for a, _ in runs]).tolist() == ids.tolist() and np.concatenate([b for _, b in runs]).tolist() == v.tolist()
    assert [set(a.tolist()) for a, _ in runs] == [{0, 1}, {2}]


def test_scalar_functions(spark):
    big = [0, 1, 6, 7, 15, 16, 2**20, 2**31 - 1]
    df = spark.createDataFrame([(v, k, w) for v in big for k in (3, 7, 18) for w in (3, 10)], "v long, k int, w int")
    for r in df.select("v", "k", "w", hash_value("v", F.col("k")).alias("h"), color("v", F.col("k"), F.col("w")).alias("c"), hash_value("v", 3).alias("h3"), bit_reverse("v").alias("b"), round_up("v", 32).alias("u"), round_up("v", 0).alias("z")).collect():
        assert r.h == h(r.v, r.k) and r.c == h(r.v, r.k) & (2**r.w - 1) and r.h3 == h(r.v, 3)
        assert r.b == int(f"{r.v:032b}"[::-1], 2) and r.u == -(-r.v // 32) * 32 and r.z == r.v
    assert [h(v, 3) for v in range(17)] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 16, 17, 18]


def test_best_parameters_break_ties(spark):
    report = spark.createDataFrame([(3, 5, 10, 4), (4, 5, 10, 3), (5, 5, 10, 3), (6, 5, 12, 1)], "k int, w int, total long, max long")
    assert [tuple(r) for r in collisions.best_parameters(report).collect()] == [(5, 4, 10, 3)]


def test_plans_stay_narrow(spark):
    plan = collisions.d1_collisions(frame(spark, CASES["random"][0]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
