import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.operators import frames, speakers
from dialoom.operators import vectors as ov


def test_centroids_and_scores(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 1.0), ("a", [0.0, 1.0], 3.0), ("b", [2.0, 0.0], 1.0), ("c", [1.0, 1.0], 0.0)], "s string, embedding array<double>, w double")
    c = {r["s"]: r["centroid"] for r in ov.centroids(df, ["s"], weight=F.col("w")).collect()}
    assert c["a"] == pytest.approx([1 / 10 ** .5, 3 / 10 ** .5]) and c["b"] == pytest.approx([1, 0]) and "c" not in c


def test_nearest_blocks_equal_single_pass(spark):
    rng = np.random.default_rng(0)
    mk = lambda n: [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(n, 4)))]
    q, b = spark.createDataFrame(mk(30), "q bigint, v array<double>"), spark.createDataFrame(mk(90), "b bigint, v array<double>")
    one = sorted(map(tuple, ov.nearest(q, b, 5, "q", "b", "v", "v").collect()))
    many = sorted(map(tuple, ov.nearest(q, b, 5, "q", "b", "v", "v", block_rows=7).collect()))
    assert one == many and len(one) == 150


def collide(spark, rows):
    df = spark.createDataFrame([("r", 0, i, t, tier, s, e, sims) for i, (t, tier, s, e, sims) in enumerate(rows)],
                               "recording_id string, chunk bigint, vec_id bigint, track bigint, tier string, start_ms bigint, end_ms bigint, sims array<double>")
    df = df.withColumn("_t", F.array_max("sims")).withColumn("top1_score", F.col("_t")).withColumn("top1_label", F.array_position("sims", F.col("_t")) - 1).drop("_t")
    out = speakers.with_margin(speakers.resolve_collisions(speakers.initial_assignment(df), "vec_id"))
    return [(r["label"], r["valid"]) for r in out.orderBy("vec_id").collect()]


def test_collisions(spark):
    # overlapping in time: the weaker track moves to its next label
    assert collide(spark, [(0, "primary", 0, 100, [.9, .1]), (1, "primary", 50, 150, [.8, .5])]) == [(0, True), (1, True)]
    # apart in time: both stay
    assert collide(spark, [(0, "primary", 0, 100, [.9, .1]), (1, "primary", 100, 150, [.8, .5])]) == [(0, True), (0, True)]
    # second choice only meets the softer bar
    assert collide(spark, [(0, "primary", 0, 100, [.9, .1]), (1, "primary", 50, 150, [.8, .17])]) == [(0, True), (1, True)]
    # no acceptable second choice
    assert collide(spark, [(0, "primary", 0, 100, [.9, .1]), (1, "primary", 50, 150, [.8, .1])])[1][1] is False


def test_average_linkage():
    x = np.array([0, .1, .2, 5, 5.1, 9])
    d = np.abs(x[:, None] - x[None, :])
    assert speakers.average_linkage(d, k=3).tolist() == [0, 0, 0, 1, 1, 2]
    assert speakers.average_linkage(d, threshold=4.5).tolist() == [0, 0, 0, 1, 1, 1]


def test_cannot_link(spark):
    df = spark.createDataFrame([("r", 0, 0, 0, [1.0, 0.0]), ("r", 1, 0, 1, [1.0, 0.01]), ("r", 2, 1, 0, [0.0, 1.0])], "recording_id string, vec_id bigint, chunk bigint, track bigint, embedding array<double>")
    c = {r["vec_id"]: r["cluster"] for r in speakers.cluster_anchors(df, ["recording_id"], "vec_id", k=2).collect()}
    assert c[0] != c[1]


@pytest.mark.parametrize("slab", [2, 65_536])
def test_propagation(spark, monkeypatch, slab):
    monkeypatch.setattr(speakers, "CHUNKS_PER_SLAB", slab)
    key = "recording_id string, chunk bigint, track bigint"
    slots = spark.createDataFrame([("r", c, t) for c in (1, 3, 5, 20) for t in (0, 1)], key)
    own = spark.createDataFrame([("r", 1, 0, 0, .9), ("r", 5, 0, 1, .5)], key + ", label bigint, best_sim double")
    forced = spark.createDataFrame([("r", 3, 1, 2, "primary", .9, .5)], key + ", label bigint, dominant_tier string, top1_score double, top1_minus_top2 double")
    out = {(r["chunk"], r["track"]): (r["final_label"], r["rule"]) for r in speakers.propagate(slots, own, forced).collect()}
    assert out[(3, 0)] == (0, "neighbour") and out[(1, 0)] == (0, "own")  # a tie goes to the earlier chunk
    assert out[(3, 1)] == (2, "forced") and out[(20, 1)] == (2, "global") and out[(20, 0)][1] in ("global", "nearest")


def test_orphans(spark):
    df = spark.createDataFrame([("primary", .5, .1), ("primary", .3, .1), ("fallback", .5, .01), (None, .5, .5)], "t string, s double, m double")
    assert [r[0] for r in df.select(speakers.orphan_reason(F.col("t"), F.col("s"), F.col("m"))).collect()] == ["accepted", "low_score", "low_margin", "missing_meta"]


def test_seed_table(spark):
    enr = spark.createDataFrame([("r", "An", [1.0, 0.0])], "recording_id string, name string, centroid array<double>")
    cl = spark.createDataFrame([("r", 0, [.9, .1]), ("r", 1, [0.0, 1.0]), ("r", 2, [.5, .5])], "recording_id string, cluster bigint, centroid array<double>")
    out = sorted((r["idx"], r["seed_name"], r["matched"]) for r in speakers.seed_table(enr, cl, ["recording_id"], 3).collect())
    assert out == [(0, "An", 0), (1, "unknown_1", 1), (2, "unknown_2", 2)]


def track(spark, probs):
    return spark.createDataFrame([("r", 0, t, f, float(p)) for t, ps in enumerate(probs) for f, p in enumerate(ps)], "recording_id string, chunk bigint, track bigint, frame bigint, prob double")


def test_frames(spark):
    on = F.col("prob") > .5
    df = track(spark, [[1] * 30 + [0] * 5 + [1] * 25, [0] * 25 + [1] * 5 + [0] * 30])
    assert sorted((r["track"], r["start_frame"], r["end_frame"]) for r in frames.runs(df, on).collect()) == [(0, 0, 30), (0, 35, 60), (1, 25, 30)]
    c = {(r["track"], r["start_frame"]): (r["clean_ms"], r["tier"], r["used_start"], r["used_end"]) for r in frames.clean_spans(df, on, min_ms=100).collect()}
    assert c[(0, 0)] == (500, "primary", 0, 25) and c[(0, 35)] == (500, "primary", 35, 60) and c[(1, 25)] == (0, "fallback", 25, 30)
    w = {r["track"]: r["start_frame"] for r in frames.densest_windows(df, on, 10).collect()}
    assert w == {0: 0, 1: 20}
    frag = {r["track"]: r for r in frames.fragment_spans(track(spark, [[0] * 50 + [1] + [0] * 49, [0] * 100, [0] * 40 + [1, 0] * 10 + [0] * 40]), on).collect()}
    assert frag[0]["reason"] == "too_sparse" and frag[1]["reason"] == "no_active" and frag[2]["reason"] == "ok"
    assert (frag[2]["end_frame"] - frag[2]["start_frame"]) * 20 <= 800


def test_median_mirrors_edges(spark):
    ps = [.9, .1, .8, .2, .7, .3]
    ext = ps[::-1] + ps + ps[::-1]
    want = [sorted(ext[6 + i - 2:6 + i + 3])[2] for i in range(6)]
    got = frames.median_smooth(track(spark, [ps]), window=5).orderBy("frame").collect()
    assert [r["smooth"] for r in got] == want


def test_speech_mask_over_slabs(spark):
    import random
    r = random.Random(1)
    on = [r.random() < .5 for _ in range(50)]
    df = spark.createDataFrame([("r", i, 1.0 if x else 0.0) for i, x in enumerate(on)], "recording_id string, frame bigint, rms double")
    ext = on[::-1] + on + on[::-1]
    want = [int(sum(ext[50 + i - 7:50 + i + 8]) >= 8) for i in range(50)]
    got = frames.speech_mask(df, ["recording_id"], .5, slab_frames=9).orderBy("frame").collect()
    assert [x["speech"] for x in got] == want


def test_purify_skips_unhealthy(spark):
    cents = spark.createDataFrame([("r", "A", [1.0, 0.0]), ("r", "B", [0.0, 1.0])], "k string, speaker string, centroid array<double>")
    rows = spark.createDataFrame([("r", "A", i, [1.0, .1], True, "primary", 2.0, .9, .5) for i in range(30)],
                                 "k string, speaker string, vec_id bigint, embedding array<double>, valid boolean, tier string, used_dur double, score double, margin double")
    out = {r["speaker"]: r for r in ov.purify(rows, cents, ["k"], "speaker", "vec_id").collect()}
    assert out["A"]["skip_reason"] == "insufficient_per_cluster_candidates" and out["A"]["purified"] == [1.0, 0.0]
    more = rows.unionByName(rows.withColumn("speaker", F.lit("B")).withColumn("vec_id", F.col("vec_id") + 100))
    out = {r["speaker"]: r for r in ov.purify(more, cents, ["k"], "speaker", "vec_id").collect()}
    assert out["A"]["skip_reason"] is None and .99 < out["A"]["shift_cosine"] < 1 and out["B"]["shift_cosine"] < .5
