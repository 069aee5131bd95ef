import random

import numpy as np
import pytest

from dialoom.operators import best_overlap

ROWS = "k string, seg_id bigint, start_ms bigint, end_ms bigint"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 100])
def test_searches_equal_brute_force(n):
    rng = np.random.default_rng(n)
    x, y, v = (rng.integers(0, 12, n) for _ in range(3))
    qx, qy = rng.integers(-1, 13, 60), rng.integers(-1, 13, 60)
    got = best_overlap.best_below(x, y, v, qx, qy)
    assert got.tolist() == [max((int(c) for a, b, c in zip(x, y, v) if a <= p and b <= q), default=-1) for p, q in zip(qx, qy)]
    got = best_overlap.extreme(x, v, qx)
    assert got.tolist() == [max((int(c) for a, c in zip(x, v) if a <= p), default=-1) for p in qx]


@pytest.mark.parametrize("width", [None, 9, 60])
@pytest.mark.parametrize("least", [1, 8])
def test_best_overlaps_equal_all_pairs(spark, width, least):
    """Ties by id, long spans over many slabs, spans of no length, keys without references."""
    r = random.Random(width or 1)
    make = lambda n, keys, long, first: [(r.choice(keys), first + i, t := r.randrange(200), t + r.randrange(long)) for i in range(n)]
    rows = make(120, "xyz", 40, 0) + make(5, "xy", 190, 500)
    refs = make(80, "xy", 30, 0) + make(6, "xy", 190, 300) + [("x", 900 + i, 50, 70) for i in range(5)]
    want = []
    for k, i, s, e in rows:
        some = [(min(e, b) - max(s, a), -j) for q, j, a, b in refs if q == k]
        best = max((x for x in some if x[0] >= least), default=None)
        want += [(k, i, -best[1], best[0])] if best else []
    got = best_overlap.best_overlaps(spark.createDataFrame(rows, ROWS), spark.createDataFrame(refs, ROWS).repartition(3), ["k"], width=width, min_ms=least)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_deep_overlaps_leave_few_candidates():
    """A thousand spans on each side that all overlap: four candidates a row, not a thousand."""
    s = np.arange(1000)
    one = np.ones(1000, bool)
    got = best_overlap.candidates(s, s + 5000, one, one, s, s + 5000, s, one)
    assert sum(len(rows) for rows, _ in got) <= 4 * 1000
