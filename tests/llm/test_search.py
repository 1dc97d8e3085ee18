import numpy as np

from huegraph.llm.topk import KdTree, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, id string, block string"


def brute(rows, every=50, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for q, qv in ok:
        if q % every == 0:
            c = sorted((-int(qv @ v), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(c)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(df, **kw).collect())


def test_equals_brute_force_over_shards_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(60)]  # one common vector: ties
    rows += [(800, None), (850, [1.0, None] + [0.0] * 6), (900, [float("nan")] * 8), (901, [float("inf")] * 8), (950, []), (1000, [1.0, 2.0]), (1001, [0.5, 0.5]), (None, [1.0] * 8), (1050, [1e6] * 8)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, shard_rows=100, leaf=16) == want


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.1, 0.2])]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 2
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []


def test_tree_covers_all_rows_with_tight_boxes():
    rng = np.random.default_rng(2)
    points = rng.integers(-100, 100, (1000, 3))
    tree = KdTree(points, np.arange(1000), 32)
    assert sorted(tree.ids.tolist()) == list(range(1000)) and tree.points.dtype == np.int8
    for (lo, hi), child, low, high in zip(tree.rows, tree.child, tree.low, tree.high, strict=True):
        own = points[tree.ids[lo:hi]]
        assert (low == own.min(0)).all() and (high == own.max(0)).all()
        assert hi - lo <= 32 if child < 0 else (tree.rows[child][0], tree.rows[child + 1][1]) == (lo, hi)
    best, who, _ = tree.search(points[:4], np.arange(4), np.full(4, -(2**62)), 5)
    for q in range(4):
        want = sorted((-int(points[q] @ points[i]), i) for i in range(1000) if i != q)[:5]
        assert list(zip((-best[q]).tolist(), who[q].tolist(), strict=True)) == want


def test_inner_boxes_and_the_propagated_score_save_work():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (64, 8))
    points = np.concatenate([c + rng.normal(0, 3, (64, 8)) for c in centres]).astype(np.int64)
    ids, queries, low = np.arange(len(points)), points[::64], np.full(64, -(2**62))
    tree = KdTree(points, ids, 32)
    best, who, looked = tree.search(queries, ids[::64], low, 5)
    assert looked < 0.5 * 64 * len(tree.rows)
    # a shard of worse points: what is known from another shard ends the walk at its root
    other = KdTree(points // 4, ids + 5000, 32)
    alone, told = other.search(queries, ids[::64], low, 5), other.search(queries, ids[::64], best[:, -1], 5)
    assert told[2] < alone[2] / 4 and (told[0] < best[:, -1:]).all()
    for q in range(64):
        want = sorted((-int(queries[q] @ points[i]), i) for i in range(len(points)) if i != 64 * q)[:5]
        assert list(zip((-best[q]).tolist(), who[q].tolist(), strict=True)) == want


def test_repeated_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(120)]
    again = [*rows, *[rows[7]] * 3, (50, rows[50][1]), (100, [9.0] * 4)]
    got = run(spark, again, shard_rows=30, leaf=8)
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q in (0, 50, 100) for r in range(1, 6)]
    plain = [r for i, r in enumerate(again) if i not in (len(again) - 2, len(again) - 1)]
    assert [g for g in got if g[0] == 50] == [w for w in brute([*plain, again[-1]]) if w[0] == 50][:5]


def test_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 3000).tolist()) for i in range(60)]
    assert run(spark, rows) == brute(rows) == run(spark, rows, shard_rows=20, leaf=4)
