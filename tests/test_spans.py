"""Interval algebra against brute force, with slabs and bins far smaller than the data."""
import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import slabs, spans

W = 7  # slab width in ms: nearly every span crosses slabs


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, seg_id bigint, speaker string, start_ms bigint, end_ms bigint")


def sample(seed, n=60, top=150, long=25):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(top)
        out.append((r.choice("xy"), i, r.choice("ABC"), s, s + r.randrange(long)))
    return out


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def brute_union(rows, gap):
    out = []
    for k in "xy":
        cur = None
        for s, e in sorted((r[3], r[4]) for r in rows if r[0] == k):
            if cur and s <= cur[1] + gap:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                out.append((k, cur))
    return sorted((k, a, b) for k, (a, b) in out)


@pytest.mark.parametrize("seed,gap", [(1, 0), (2, 3), (3, 10)])
def test_union(spark, seed, gap):
    rows = sample(seed, 40, 400, 12)
    assert got(spans.merge_spans(frame(spark, rows), ["k"], gap, W), "k", "start_ms", "end_ms") == brute_union(rows, gap)


def busy_ms(rows, k, need=2):
    return {t for t in range(0, 600) if sum(r[0] == k and r[3] <= t < r[4] for r in rows) >= need}


@pytest.mark.parametrize("seed", [4, 5])
def test_busy_regions_and_coverage(spark, seed):
    rows = sample(seed, 25)
    df = frame(spark, rows)
    reg = got(spans.busy_regions(df, ["k"], 2, W), "k", "start_ms", "end_ms")
    for k in "xy":
        mine = [(a, b) for kk, a, b in reg if kk == k]
        assert {t for a, b in mine for t in range(a, b)} == busy_ms(rows, k)
        assert all(b < c for (_, b), (c, _) in zip(mine, mine[1:]))  # maximal and disjoint
    ov = spans.overlap_sum(df, df, ["k"], ["seg_id"], "ov", windows=[(F.col("start_ms") - 5, F.col("start_ms")), (F.col("end_ms"), F.col("end_ms") + 5)],
                           weight=F.col("seg_id") % 4, width=W)
    for k, i, _, s, e, o in got(ov, "k", "seg_id", "speaker", "start_ms", "end_ms", "ov"):
        want = sum((r[1] % 4) * (max(0, min(r[4], s) - max(r[3], s - 5)) + max(0, min(r[4], e + 5) - max(r[3], e))) for r in rows if r[0] == k)
        assert o == want


def test_golden_regions(spark):
    f = lambda *xs: frame(spark, [("x", i, "A", s, e) for i, (s, e) in enumerate(xs)])
    reg = lambda *xs: got(spans.busy_regions(f(*xs), ["k"], 2, W), "start_ms", "end_ms")
    assert reg((0, 2000), (2000, 4000)) == []
    assert reg((0, 10_000), (1000, 2000), (2000, 3000)) == [(1000, 3000)]
    assert reg((0, 2000), (1000, 3000)) == [(1000, 2000)]
    assert got(spans.merge_spans(f((0, 1000), (1150, 2000)), ["k"], 150, W), "start_ms", "end_ms") == [(0, 2000)]
    c = spans.clamp_to_regions(f((0, 1000)), f((5000, 6000)), ["k"], ["seg_id"], 100)
    assert got(c, "clamped_start_ms", "clamped_end_ms") == [(0, 1000)]


@pytest.mark.parametrize("seed", [6, 7])
def test_atoms_pairs_and_joins(spark, seed):
    rows = sample(seed, 25)
    df = frame(spark, rows)
    at = spans.active_speakers(spans.atomic_spans(df, ["k"], W), df, ["k"], 10, width=W)
    sets = {}
    for k, s, e, d, a in got(at, "k", "start_ms", "end_ms", "depth", "active"):
        sets.setdefault((k, s, e, d), set()).add(a)
    for (k, s, e, d), names in sets.items():
        act = [r for r in rows if r[0] == k and r[3] <= s and e <= r[4] and r[4] > r[3]]
        assert len(act) == d and {r[2] for r in act} == names
    assert sum(e - s for (k, s, e, d) in sets) == sum(len(busy_ms(rows, k, 1)) for k in "xy")
    pairs = got(spans.pair_regions(df, ["k"], 10, W), "k", "speaker_a", "speaker_b", "start_ms", "end_ms")
    for k in "xy":
        cell = {(a, b, t) for kk, a, b, s, e in pairs if kk == k for t in range(s, e)}
        want = {(*sorted(n), t) for t in range(600) for n in [{r[2] for r in rows if r[0] == k and r[3] <= t < r[4]}] if len(n) == 2}
        assert cell == want
    j = spans.overlap_join(df, df, ["k"], 10)
    want = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and min(a[4], b[4]) - max(a[3], b[3]) > 0]
    assert got(j, "seg_id", "r_seg_id") == sorted(want)


@pytest.mark.parametrize("seed", [8, 9])
def test_subtract_clamp_gap(spark, seed):
    rows, cuts = sample(seed, 25), sample(seed + 50, 12)
    df, rm = frame(spark, rows), frame(spark, cuts)
    out = got(spans.subtract(df, rm, ["k", "speaker"], ["seg_id"], W), "seg_id", "start_ms", "end_ms")
    for r in rows:
        gone = {t for c in cuts if (c[0], c[2]) == (r[0], r[2]) for t in range(c[3], c[4])}
        assert {t for i, s, e in out if i == r[1] for t in range(s, e)} == set(range(r[3], r[4])) - gone
    gaps = [(k, 1000 + i, sp, s, s + 9) for i, (k, _, sp, s, _) in enumerate(rows)]
    hit = got(spans.other_speaker_in_gap(frame(spark, gaps), df, ["k"], ["speaker", "seg_id"], 10, width=W), "seg_id")
    want = [(i,) for k, i, sp, s, e in gaps if any(r[0] == k and r[2] != sp and r[4] > r[3] and r[3] < e and r[4] > s for r in rows)]
    assert hit == sorted(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_subtract_numbers_the_gaps(spark, seed):
    """Many removals per span, touching ones, spans at exact edges of removals, keys without removals."""
    r = random.Random(seed)
    cuts = [("x", i, "a", t := r.randrange(400), t + r.randrange(0, 9)) for i in range(120)] + [("y", 500, "a", 5, 9), ("y", 501, "a", 9, 12)]
    rows = [(k, i, "a", t := r.randrange(300), t + r.randrange(0, 200)) for i, k in enumerate(["x", "y", "z"] * 12)]
    rows += [("y", 100, "a", 5, 12), ("y", 101, "a", 0, 5), ("y", 102, "a", 12, 20), ("y", 103, "a", 4, 13)]
    out = got(spans.subtract(frame(spark, rows), frame(spark, cuts), ["k", "speaker"], ["seg_id"], 37), "seg_id", "start_ms", "end_ms")
    want = []
    for k, i, _, s, e in rows:
        left = [t for t in range(s, e) if not any(c[0] == k and c[3] <= t < c[4] for c in cuts)]
        begins = [t for t in left if t - 1 not in left]
        want += [(i, t, next(u for u in range(t, e + 1) if u not in left)) for t in begins]
    assert out == sorted(want)


@pytest.mark.parametrize("seed", [5, 6])
def test_coactive_equals_frame_counts(spark, seed):
    a, b = sample(seed, 30), sample(seed + 9, 25)
    df = spans.coactive(frame(spark, a), frame(spark, b), ["k"], 10, right_weight=F.col("seg_id") % 3 + 1, width=W)
    want = {}
    for x in a:
        for y in b:
            ms = min(x[4], y[4]) - max(x[3], y[3])
            if x[0] == y[0] and ms > 0:
                want[x[0], x[2], y[2]] = want.get((x[0], x[2], y[2]), 0) + ms * (y[1] % 3 + 1)
    assert {(r.k, r.speaker, r.r_speaker): r.ms for r in df.collect() if r.ms} == want


def test_split_long(spark):
    df = spark.createDataFrame([("x", 0, 70_000, "a b c d e f g")], "k string, start_ms bigint, end_ms bigint, text string")
    p = got(spans.split_long(df, 30_000, "text"), "part", "part_start_ms", "part_end_ms", "text")
    assert [x[3] for x in p] == ["a b", "c d", "e f g"] and p[0][2] == 23_333 and p[2][2] == 70_000


def test_slab_width_splits_dense_keys(spark):
    df = spark.range(4000).select(F.lit("x").alias("k"), F.col("id").alias("start_ms"))
    assert slabs.slab_width(df, ["k"], "start_ms", rows_per_slab=100, coarse=1000) == 100
