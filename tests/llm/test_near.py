import random
import re

import pytest

from huegraph.llm.components import components
from huegraph.llm.ngram_join import _forest, descend, forest_depth, least_agreement, ngram_join

from .texts import ODD

SCHEMA = "doc_id long, text string, class_id string, rep string, node string"


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if i != j and s[i] and s[j] and rows[i][0] is not None and rows[j][0] is not None and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])] for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((doc, None if doc is None else min(rows[j][0] for j in seen), len(near[i])))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    passage = [word() for _ in range(60)]
    rows += [(len(rows) + i, " ".join([word() for _ in range(20 + i)] + passage)) for i in range(15)]
    hot = [word() for _ in range(80)]
    for i in range(60):  # one large group of near copies
        own = list(hot)
        own[i] = word()
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, rows[0][1]), rows[3], (5000, rows[3][1])]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 8, "block_size": 2000, "chunk": 4}])
def test_equals_brute_force(spark, sizes):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join(df, **sizes).collect()), key=str)
    assert got == brute(rows)


def test_pairs_that_do_not_match_their_pivot(spark):
    """One tree and one minimum: documents that share a passage share a node, where the pivot is like none of them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(25):
        own = [word() for _ in range(30)] + passage
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, word()]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"block": 4}):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(df, trees=1, depth=64, recall=0.79, **sizes).collect()}
        assert sum(got[2 * i + 1] == (2 * i, 1) for i in range(25)) >= 23


def test_empty_table(spark):
    assert ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_depth_shortens_to_the_target():
    assert forest_depth(0.8, 16, 8, 0.9995) == 4
    assert forest_depth(0.99, 16, 8, 0.9995) == 8
    assert forest_depth(0.1, 2, 8, 0.9999) == 1


def test_signatures_lose_a_hundredth_of_what_the_target_leaves():
    rng = random.Random(1)
    for recall in (0.9, 0.9995):
        least = least_agreement(0.8, 128, recall)
        below = sum(sum(rng.random() < 0.8 for _ in range(128)) < least for _ in range(4000)) / 4000
        assert below <= (1 - recall) / 100 + 0.002
    assert least_agreement(0.8, 128, 0.9995) < 0.67 * 128


def test_prefixes_are_shortened_until_a_member_is_covered():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 9, 32).astype(np.uint16)
    rows = [base]
    for _ in range(40):
        own = rows[rng.integers(len(rows))].copy()
        at = rng.integers(2, 32, rng.choice([1, 3, 12]))
        own[at] = rng.integers(100, 200, len(at))
        rows.append(own)
    sig = np.array(sorted(map(tuple, rows)), np.uint16)
    sig = np.concatenate([sig, sig[::3] + np.uint16(1)])  # a second node
    path, first = sig[:, :8], np.zeros(len(sig), bool)
    first[[0, 41]] = True
    order = np.lexsort(np.c_[np.cumsum(first), path].T[::-1])
    assert (order == np.arange(len(sig))).all()
    got_rows, got_pivots, stray = descend(path, sig, first, 2, 24, 31)
    edges, covered, linked = set(), {}, {}
    for i in range(len(sig)):  # one by one, with the first row below each prefix as its pivot
        node = 0 if i < 41 else 41
        if i == node:
            covered[i] = linked[i] = True
            continue
        seen, covered[i], mine = {i}, False, []
        for d in range(8, 1, -1):
            pivot = next(j for j in range(node, i + 1) if d == 2 or (path[j, :d] == path[i, :d]).all())
            if pivot in seen or covered[i]:
                continue
            seen.add(pivot)
            same = int((sig[i] == sig[pivot]).sum())
            if same >= 24:
                edges.add((i, pivot))
                mine.append(pivot)
            covered[i] = same >= 31
        linked[i] = any(linked[j] for j in mine)
    assert set(zip(got_rows.tolist(), got_pivots.tolist(), strict=True)) == edges
    assert [bool(x) for x in stray] == [not (covered[i] or linked[i]) for i in range(len(sig))] and stray.any()


def test_components_with_hot_and_cold_nodes(spark):
    pairs = [(2 * i + 5000, 2 * i + 5001) for i in range(1500)]
    star = [(100, i) for i in range(101, 300)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs + star, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 300)} | {i: i - i % 2 for i in range(5000, 8000)}


def test_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (3, b), (4, a + " x"), (5, b + " y"), (3, a)]
    got = sorted(tuple(r) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect())
    assert got == [(3, 3, 1), (3, 3, 2), (3, 3, 2), (4, 3, 2), (5, 3, 1)]


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 300_000)], "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(3, 3), (2, 1), (1, 2)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 40)} | {1: 1, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_forest_roots():
    import numpy as np

    assert _forest(6, np.array([5, 4, 1]), np.array([4, 3, 2])).tolist() == [0, 1, 1, 3, 3, 3]
