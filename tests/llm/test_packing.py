import random
from collections import defaultdict

import pytest

from huegraph.llm.packing import _opened, best_fit_pack

CAPS = (16, 32, 64)


def check(rows, got, caps):
    """Every token of every row is in exactly one place; bins are filled without gaps and no larger than needed."""
    bins, seen = defaultdict(list), defaultdict(list)
    for r in got:
        if r.n_tokens == 0:
            assert r.bin_id is None and r.capacity is None and r.bin_offset is None
            seen[r.doc_id].append((r.start, 0))
        else:
            bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.capacity))
            seen[r.doc_id].append((r.start, r.n_tokens))
    for items in bins.values():
        end = 0
        for offset, n, _ in sorted(items):
            assert offset == end
            end += n
        assert {c for _, _, c in items} == {min(c for c in caps if c >= end)}
    want = defaultdict(int)
    for i, n in rows:
        want[i] += max(0, n or 0)
    assert {i: sum(n for _, n in x) for i, x in seen.items()} == want
    return bins


def brute_bins(lengths, caps):
    """Best-fit decreasing piece by piece."""
    pieces = sorted((p for n in lengths for p in [max(caps)] * (n // max(caps)) + ([n % max(caps)] if n % max(caps) else [])), reverse=True)
    rooms, used, left, count = [], [], sum(pieces), len(pieces)
    for p in pieces:
        fit = min((i for i, r in enumerate(rooms) if r >= p), key=lambda i: rooms[i], default=None)
        if fit is None:
            rooms.append(_opened(p, [c for c in sorted(caps) if c >= p], left / count))
            used.append(0)
            fit = len(rooms) - 1
        rooms[fit] -= p
        used[fit] += p
        left, count = left - p, count - 1
    return used


@pytest.mark.parametrize("seed", range(3))
def test_is_a_tight_packing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, None, -3, 1, 5, 16, 17, 40, 63, 64, 65, 200, rng.randint(1, 90)])) for i in range(300)] + [(7, 9), (7, 9), (None, 3)]
    df = spark.createDataFrame([(i, n, "x", "x") for i, n in rows], "doc_id long, n_tokens long, bin_id string, salt string")
    bins = check(rows, best_fit_pack(df, capacities=CAPS).collect(), CAPS)
    own = brute_bins([n for _, n in rows if n and n > 0], CAPS)
    slots = lambda ends: sum(min(c for c in CAPS if c >= e) for e in ends)
    mine = [sum(n for _, n, _ in x) for x in bins.values()]
    assert sum(mine) == sum(own) and slots(mine) <= slots(own) * 1.03 + max(CAPS)


def test_one_length_and_empty_table(spark):
    df = spark.createDataFrame([(i, 20) for i in range(1000)], "doc_id long, n_tokens long")
    bins = check([(i, 20) for i in range(1000)], best_fit_pack(df, capacities=CAPS, salt_rows=10).collect(), CAPS)
    assert len(bins) == 334
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []
    again = [[tuple(r) for r in sorted(best_fit_pack(df.repartition(k), capacities=CAPS).collect())] for k in (1, 7)]
    assert again[0] == again[1]
