import math
import random

import pytest

from huegraph.operators import linalg

SF = "/root/testdata/sf0.001"


def vector(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, x double")


def test_spmv_and_isolated_rows(spark):
    edges = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (2, 1, -1.0), (2, 1, -1.0)], "src long, dst long, val double")
    got = {r.id: r.y for r in linalg.spmv(edges, vector(spark, [1.0, 10.0]), spark.range(4)).collect()}
    assert got == {0: 32.0, 1: 0.0, 2: -20.0, 3: 0.0}
    with pytest.raises(ValueError):
        linalg.with_precision(edges, "half")


def test_permutations_are_undone(spark):
    rng = random.Random(1)
    new = list(range(50))
    rng.shuffle(new)
    perm = spark.createDataFrame(list(enumerate(new)), "old long, new long")
    edges = spark.createDataFrame([(rng.randrange(50), rng.randrange(50), float(i)) for i in range(300)], "src long, dst long, val double")
    moved = linalg.permute_matrix(edges, perm)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(moved) == sorted((new[r.src], new[r.dst], r.val) for r in edges.collect())
    assert rows(linalg.unpermute_matrix(moved, perm)) == rows(edges)
    x = vector(spark, [float(i) for i in range(50)])
    assert rows(linalg.unpermute_vector(linalg.permute_vector(x, perm), perm)) == rows(x)
    y = linalg.spmv(moved, linalg.permute_vector(x, perm), spark.range(50)).withColumnRenamed("y", "x")
    assert rows(linalg.unpermute_vector(y, perm)) == rows(linalg.spmv(edges, x, spark.range(50)))


def test_comparison(spark):
    inf, nan = float("inf"), float("nan")
    got = linalg.compare(vector(spark, [1.0, 2.5, 0.0, inf, 5.0, nan, inf]), vector(spark, [1.0, 2.0, 4.0, 1.0, 0.0, 1.0, inf])).first()
    assert (got.max_abs, got.max_rel, got.zeros, got.infinite) == (4.0, 1.0, 1, 1)
    assert got.rms == pytest.approx(math.sqrt((0.25 + 16) / 7))
    empty = linalg.compare(spark.createDataFrame([], "id long, x double"), spark.createDataFrame([], "id long, x double")).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0, 0)


def test_prefix_sum_over_blocks(spark):
    df = spark.createDataFrame([(i * 3, i % 7) for i in range(200)], "id long, v long")
    got = [r.s for r in linalg.prefix_sum(df, "v", "s", block=16).orderBy("id").collect()]
    want, total = [], 0
    for i in range(200):
        total += i % 7
        want.append(total)
    assert got == want


def test_symmetry(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 2), (1, 2)], "src long, dst long")
    assert tuple(linalg.pattern_symmetry(edges).first()) == (3, 1)
    assert tuple(linalg.pattern_symmetry(edges.limit(0)).first()) == (0, 0)
    assert sorted(map(tuple, linalg.symmetrize(edges).collect())) == sorted([(0, 1), (1, 0), (1, 0), (0, 1), (1, 2), (2, 1), (1, 2), (2, 1), (2, 2)])
    assert {r.id: r.degree for r in linalg.degrees(edges, spark.range(4)).collect()} == {0: 1, 1: 3, 2: 1, 3: 0}
