import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.operators import assignment, metrics

SEG = "k string, seg_id bigint, speaker string, start_ms bigint, end_ms bigint"


@pytest.mark.parametrize("n,m", [(3, 3), (2, 4), (4, 2), (1, 3), (5, 5)])
def test_assignment_is_optimal(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for _ in range(30):
        s = rng.integers(0, 20, (n, m)).astype(float)
        pairs = assignment.solve(s)
        small, flip = (s, False) if n <= m else (s.T, True)
        best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert sum(s[r, c] for r, c in pairs) == best and len(pairs) == min(n, m)


def test_word_edits():
    def brute(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]
    r = random.Random(1)
    for _ in range(200):
        a, b = [r.choice("abc") for _ in range(r.randrange(8))], [r.choice("abc") for _ in range(r.randrange(8))]
        e, s, d, i, n = metrics.word_edits(a, b)
        assert e == brute(a, b) == s + d + i and n == len(a) and len(a) - d + i == len(b) and min(s, d, i) >= 0


def test_wer(spark):
    df = spark.createDataFrame([("", "x"), ("", ""), ("Xin chào, bạn", "xin chào"), ("a b", "a b")], "r string, h string")
    assert sorted(round(x["wer"], 4) for x in metrics.with_wer(df, "r", "h").collect()) == [0.0, 0.0, 0.3333, 1.0]


def talk(seed, n=30):
    r = random.Random(seed)
    return [("x", i, r.choice("AB"), s, s + r.randrange(50, 900)) for i in range(n) for s in [r.randrange(4000)]]


def test_identical_sides(spark):
    df = spark.createDataFrame(talk(1), SEG)
    d = metrics.diarization_error(df, df, ["k"], 500).first()
    assert d["der"] == 0 and d["missed_ms"] == d["false_alarm_ms"] == d["confusion_ms"] == 0
    o = metrics.precision_recall(metrics.overlap_identity(df, df, ["k"], 200, 500)).first()
    assert o["f1"] == 1 and o["exact2_ms"] == o["both_correct_exact_ms"] > 0
    solo = spark.createDataFrame([("x", 0, "A", 0, 100)], SEG)
    assert metrics.precision_recall(metrics.overlap_identity(solo, solo, ["k"], 200, 500)).first()["f1"] == 0


def test_diarization_error_counts(spark):
    ref, hyp = talk(2, 14), [(k, i, {"A": "q", "B": "p"}[sp] if i % 5 else "z", s + 40, e) for k, i, sp, s, e in talk(2, 14)]
    total = miss = fa = 0
    cells = {}
    for t in range(0, 5000):
        r, h = [x[2] for x in ref if x[3] <= t < x[4]], [x[2] for x in hyp if x[3] <= t < x[4]]
        total, miss, fa = total + len(r), miss + max(0, len(r) - len(h)), fa + max(0, len(h) - len(r))
        for a in h:
            for b in r:
                cells[a, b] = cells.get((a, b), 0) + 1
    hs, rs = sorted({a for a, _ in cells}), sorted({b for _, b in cells})
    pairs = assignment.solve(np.array([[cells.get((a, b), 0) for b in rs] for a in hs], float))
    m = {hs[i]: rs[j] for i, j in pairs}
    conf = 0
    for t in range(0, 5000):
        r, h = [x[2] for x in ref if x[3] <= t < x[4]], [m.get(x[2]) for x in hyp if x[3] <= t < x[4]]
        conf += min(len(r), len(h)) - sum(min(r.count(s), h.count(s)) for s in set(r))
    d = metrics.diarization_error(spark.createDataFrame(ref, SEG), spark.createDataFrame(hyp, SEG), ["k"], 300).first()
    assert (d["total_ms"], d["missed_ms"], d["false_alarm_ms"], d["confusion_ms"]) == (total, miss, fa, conf)


def test_label_map_without_overlap_takes_lowest(spark):
    ref = spark.createDataFrame([("x", 0, "B", 0, 100), ("x", 1, "A", 100, 200)], SEG)
    hyp = spark.createDataFrame([("x", 0, "h", 500, 600), ("x", 1, "g", 0, 150)], SEG)
    m = metrics.label_map(metrics.snapped(hyp, ["k"]), metrics.snapped(ref, ["k"]), ["k"], 100)
    assert {(r["speaker"], r["ref_speaker"]) for r in m.collect()} == {("h", "A"), ("g", "B")}


def test_mapping_health(spark):
    df = spark.createDataFrame([("x", "v1", "A", .5), ("x", "v2", None, None)], "k string, other string, local string, score double")
    h = metrics.mapping_health(df, ["k"]).first()
    assert h["coverage"] == .5 and not h["noisy"] and not h["healthy"]
