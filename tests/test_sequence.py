"""Order-dependent operators against plain loops, on slabs of a few rows."""
import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import dedup, sequence, settle, summary

LINE = "k string, idx bigint, speaker string, start_ms bigint, end_ms bigint, text string"


def talk(seed, n=80, gap=900, dur=4000):
    r = random.Random(seed)
    out = []
    for k in "xy":
        t = 0
        for i in range(n):
            t += r.randrange(-300, gap)
            t = max(t, 0)
            d = r.randrange(200, dur)
            out.append((k, i, r.choice("AAB"), t, t + d, f"w{i} v{i % 3}"))
            t += d
    return out


def by_key(rows):
    for k in "xy":
        yield k, sorted((r for r in rows if r[0] == k), key=lambda r: (r[3], r[4], r[1]))


@pytest.mark.parametrize("seed,width", [(1, 5000), (2, 2000), (3, 10_000_000)])
def test_merge_adjacent(spark, seed, width):
    rows = talk(seed)
    want = []
    for k, ls in by_key(rows):
        cur = None
        for _, i, sp, s, e, _ in ls:
            if cur and cur[2] == sp and s - cur[4] <= 600:
                cur[4], cur[5] = max(cur[4], e), cur[5] + 1
            else:
                cur = [k, i, sp, s, e, 1]
                want.append(cur)
    df = spark.createDataFrame(rows, LINE)
    got = sequence.merge_adjacent(df, ["k"], "idx", 600, width).select("k", "idx", "speaker", "start_ms", "end_ms", "n_lines").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("seed,slab", [(4, 8), (5, 16), (6, 65_536)])
def test_pack_blocks(spark, monkeypatch, seed, slab):
    monkeypatch.setattr(sequence, "SLAB_ROWS", slab)
    rows = talk(seed, 70)
    rows = [(*r[:5], "game" if random.Random(r[1]).random() < .1 else r[5] * random.Random(r[1]).randrange(1, 30)) for r in rows]
    want = {}
    for k, ls in by_key(rows):
        block, start, used, n = -1, None, 0, 0
        for _, i, sp, s, e, t in ls:
            c = len(f"[{s / 1000:.1f}s - {e / 1000:.1f}s] {sp}: {t}\n")
            if n == 0 or ("game" in t and e - start >= 25_000) or used + c > 900 or e - start > 40_000 or n >= 8:
                block, start, used, n = block + 1, s, 0, 0
            used, n = used + c, n + 1
            want[(k, i)] = block
    df = spark.createDataFrame(rows, LINE)
    b = sequence.pack_blocks(df, ["k"], ["start_ms", "end_ms", "idx"], F.floor(F.col("start_ms") / 9000), 900, 40_000, 8)
    assert {(r["k"], r["idx"]): r["block_id"] for r in b.collect()} == want


def test_nine_short_lines_make_eight_and_one(spark):
    df = spark.createDataFrame([("x", i, "A", i * 100, i * 100 + 50, "hi") for i in range(9)], LINE)
    b = sequence.pack_blocks(df, ["k"], ["start_ms", "end_ms", "idx"], F.lit(0))
    assert sorted(r["count"] for r in b.groupBy("block_id").count().collect()) == [1, 8]


def test_lines_are_cleaned_and_packed_once(spark):
    df = spark.createDataFrame([("x", i, "AB"[i % 2], i * 900, i * 900 + 800, f"ờm line {i}") for i in range(30)], LINE)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    kept = summary.filter_lines(df)
    assert plan(kept).count("ừm|") == 1 and kept.count() == 30
    b = sequence.pack_blocks(df, ["k"], ["start_ms", "end_ms", "idx"], F.lit(0))
    assert "giải lao" not in plan(b) and b.count() == 30
    assert "ừm|" not in plan(summary.summarize(df, ["k"], "idx", F.lit(0), width=10_000)[1])


def seq_short(ls):
    """Merging of short lines, written as a scan over a list that is rewritten in place."""
    ls, out, i = [dict(zip(("sp", "s", "e", "t"), l)) for l in ls], [], 0
    near = lambda a, b: b["s"] - a["e"] <= 500 and (a["sp"] == b["sp"] or b["s"] - a["e"] <= 250)
    join = lambda a, b: {"sp": a["sp"], "s": a["s"], "e": b["e"], "t": a["t"] + " " + b["t"]}
    while i < len(ls):
        c = ls[i]
        if c["e"] - c["s"] < 2500:
            if i + 1 < len(ls) and near(c, ls[i + 1]):
                ls[i + 1] = join(c, ls[i + 1])
            elif out and near(out[-1], c):
                out[-1] = join(out[-1], c)
            else:
                out.append(c)
        else:
            out.append(c)
        i += 1
    return out


@pytest.mark.parametrize("slab_ms", [3000, 20_000, 10 ** 9])
def test_merge_short_relayed_over_slabs(spark, slab_ms):
    rows = talk(7, 60)
    want = []
    for k, ls in by_key(rows):
        want += [(k, x["s"], x["e"], x["sp"], x["t"]) for x in seq_short([(r[2], r[3], r[4], r[5]) for r in ls])]
    df = spark.createDataFrame(rows, LINE)
    got = sequence.merge_short(df, ["k"], "idx", F.floor(F.col("start_ms") / slab_ms)).select("k", "start_ms", "end_ms", "speaker", "text")
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("slab_ms", [5000, 10 ** 9])
def test_build_chunks(spark, slab_ms):
    rows = talk(8, 50, gap=2500)
    segs = [(r[0], r[2], r[3], r[4]) for r in rows] + [("x", "C", 30_000, 31_000)]
    want = []
    for k, ls in by_key(rows):
        items, cur = seq_short([(r[2], r[3], r[4], r[5]) for r in ls]), None
        for n in items:
            if cur:
                gap, same = n["s"] - cur["e"], n["sp"] == cur["sp"]
                fits = n["e"] - cur["s"] <= 18_000
                other = any(g[0] == k and g[1] != cur["sp"] and g[2] < n["s"] and g[3] > cur["e"] for g in segs)
                if fits and ((gap <= 500 and (same or gap <= 200)) or (same and 500 < gap <= 1500 and not other)):
                    cur = {**cur, "e": n["e"], "t": cur["t"] + " " + n["t"]}
                    continue
                want.append((k, cur["s"], cur["e"], cur["sp"], cur["t"]))
            cur = n
        want.append((k, cur["s"], cur["e"], cur["sp"], cur["t"]))
    df = spark.createDataFrame(rows, LINE)
    sg = spark.createDataFrame(segs, "k string, speaker string, start_ms bigint, end_ms bigint")
    # one region over everything, so that clamping changes nothing here
    wide = sg.unionByName(spark.createDataFrame([(k, "A", 0, 0) for k in "xy"], sg.schema))
    got = sequence.build_chunks(df, wide, ["k"], "idx", slab_ms, 5000, width=5000)
    assert sorted(map(tuple, got.select("k", "start_ms", "end_ms", "speaker", "text").collect())) == sorted(want)


def test_runs_are_cut_at_gaps_across_slabs(spark):
    ends = [(0, 100), (50, 9000), (300, 400), (9400, 9500), (9901, 9950), (10_460, 10_470), (30_000, 30_010)]
    df = spark.createDataFrame([("x", i, "A", s, e, "t") for i, (s, e) in enumerate(ends)], LINE)
    for slab_ms in (100, 1000, 10 ** 9):
        got = sequence.gap_runs(df, ["k"], ["start_ms", "end_ms", "idx"], F.floor(F.col("start_ms") / slab_ms), 500)
        assert [r[0] for r in got.orderBy("idx").select("_run").collect()] == [1, 1, 1, 1, 1, 2, 3]


def test_merge_short_of_a_long_key_relays_runs_only(spark):
    """Lines beyond the merge bound of each other: a run is a line or two, however many slabs the key has."""
    rows = [("x", i, "AB"[i % 2], 2000 * i, 2000 * i + 900 + 700 * (i % 3 == 0), f"w{i}") for i in range(400)]
    want = [("x", x["s"], x["e"], x["sp"], x["t"]) for x in seq_short([(r[2], r[3], r[4], r[5]) for r in rows])]
    got = sequence.merge_short(spark.createDataFrame(rows, LINE), ["k"], "idx", F.floor(F.col("start_ms") / 3000))
    assert sorted(map(tuple, got.select("k", "start_ms", "end_ms", "speaker", "text").collect())) == sorted(want)


def test_runs_across_slabs_are_folded_in_one_stream(spark, monkeypatch):
    """A run over many slabs takes no rounds unless it is larger than a slab may be; the results are the same."""
    rows = [("xy"[i >= 170], i, "AB"[i % 5 == 0], 700 * i - 9 * (i % 7), 700 * i + 690 + 2500 * (i % 11 == 0) + 9000 * (i % 40 == 39), f"w{i}") for i in range(300)]
    want = [(k, x["s"], x["e"], x["sp"], x["t"]) for k, ls in by_key(rows) for x in seq_short([(r[2], r[3], r[4], r[5]) for r in ls])]
    relay, relayed = sequence.relay_fold, []
    monkeypatch.setattr(sequence, "relay_fold", lambda *a, **k: relayed.append(1) or relay(*a, **k))
    for most in (10 ** 6, 20):
        monkeypatch.setattr(sequence, "RUN_ROWS", most)
        got = sequence.merge_short(spark.createDataFrame(rows, LINE), ["k"], "idx", F.floor(F.col("start_ms") / 9000))
        assert sorted(map(tuple, got.select("k", "start_ms", "end_ms", "speaker", "text").collect())) == sorted(want)
        assert len(relayed) == (most == 20)


def test_sliding_windows(spark):
    df = spark.createDataFrame([("x", i, "A", i * 10, i * 10 + 5, f"t{i}") for i in range(6)], LINE)
    w = sequence.sliding_windows(df, ["k"], "idx", F.col("text")).orderBy("window_id").collect()
    assert [(r["window_id"], r["n_lines"], r["start_ms"]) for r in w] == [(0, 5, 0), (1, 4, 20), (2, 2, 40)]


def test_consecutive_groups(spark):
    df = spark.createDataFrame([("x", i, t) for i, t in [(0, "a"), (1, "a"), (2, "b"), (4, "b"), (5, "a")]], "k string, i bigint, t string")
    g = sequence.consecutive_groups(df, ["k"], "i", "t", [F.count(F.lit(1)).alias("n")], slab_rows=2)
    assert sorted((r["group_id"], r["t"], r["n"]) for r in g.collect()) == [(0, "a", 2), (1, "b", 1), (2, "b", 1), (3, "a", 1)]


# ---- duplicates ----

def greedy(rows, match):
    kept = []
    for r in rows:
        if not any(match(p, r) for p in kept):
            kept.append(r)
    return kept


def settled(df, match, reach=400, width=None):
    return sorted(x["id"] for x in settle.kept_rows(df, ["k"], "id", F.col("start_ms") + reach, match, width=width).collect())


SPANS = "k string, id bigint, start_ms bigint, end_ms bigint"


@pytest.mark.parametrize("width", [None, 700, 1500, 10_000])
@pytest.mark.parametrize("density", [40, 130, 300])
def test_settled_rows_equal_the_sequential_rule(spark, width, density):
    """Random links inside the reach, over pieces of any length; the densest rows leave few moments to cut at."""
    r = random.Random(density)
    rows = [(r.choice("xy"), i, t := r.randrange(density * 200), t + r.randrange(500)) for i in range(200)]
    match = lambda a, b: b[0] - a[0] <= 400 and (a[0] * 7 + b[0] * 13 + a[1] * 3 + b[1]) % 3 == 0
    want = []
    for k in "xy":
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[3], x[1]))
        want += [x[1] for x in greedy(mine, lambda a, b: match(a[2:], b[2:]))]
    assert settled(spark.createDataFrame(rows, SPANS), match, width=width) == sorted(want)


@pytest.mark.parametrize("width", [50_000, None])
def test_a_chain_of_ten_thousand_links_takes_the_jobs_of_a_short_one(spark, width):
    """Each row matches the next: every other one stays, whatever the number of pieces."""
    sc, jobs = spark.sparkContext, []
    for n in (20, 10_001):
        rows = spark.range(n).select(F.lit("x").alias("k"), "id", (F.col("id") * 250).alias("start_ms"), (F.col("id") * 250 + 100).alias("end_ms"))
        sc.setJobGroup(f"chain-{n}-{width}", "chain")
        assert settled(rows, lambda a, b: b[0] - a[0] <= 250, 250, width) == list(range(0, n, 2))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"chain-{n}-{width}")))
    sc.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 6                     # adaptive execution may run a few more stages as jobs


def test_rows_that_reach_over_many_cuts(spark):
    """Three long rows stay open across all pieces and each decides rows far away."""
    rows = [("x", i, i, 10**9) for i in range(3)] + [("x", 10 + i, 1000 + 500 * i, 1000 + 500 * i + 10) for i in range(300)]
    match = lambda a, b: a[1] == 10**9 and b[1] != 10**9 and b[0] // 500 % 5 == a[0]
    got = settle.kept_rows(spark.createDataFrame(rows, SPANS), ["k"], "id", F.when(F.col("end_ms") == 10**9, 200_000).otherwise(F.col("start_ms")),
                           match, width=7000)
    assert sorted(x["id"] for x in got.collect()) == [r[1] for r in rows if r[3] == 10**9 or r[2] // 500 % 5 > 2]


def dup_rows(seed, n=160):
    r = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta".split()
    out = []
    for i in range(n):
        s = r.randrange(6000)
        t = " ".join(r.sample(words, r.randrange(0, 6)) if r.random() < .8 else words)
        out.append((r.choice("xy"), i, s, s + r.choice([300, 1000, 4000]) + r.randrange(60), t))
    return out


@pytest.mark.parametrize("width", [None, 1700])
def test_near_duplicates(spark, width):
    rows = dup_rows(1)
    sim = lambda a, b: (len(a & b) / max(len(a), len(b))) if a and b else 0
    want = []
    for k in "xy":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3], r[1]))
        want += [r[1] for r in greedy(mine, lambda p, c: abs(p[2] - c[2]) + abs(p[3] - c[3]) < 1000 and sim(set(p[4].split()), set(c[4].split())) > .8)]
    df = spark.createDataFrame(rows, "k string, id bigint, start_ms bigint, end_ms bigint, text string")
    got = dedup.near_duplicates(df, ["k"], "id", "text", width=width)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_token_sets_travel_as_one_text(spark, monkeypatch):
    seen, settled_rows = [], settle.kept_rows
    monkeypatch.setattr(settle, "kept_rows", lambda df, *a, **k: seen.append(df.schema["_set"].dataType.simpleString()) or settled_rows(df, *a, **k))
    df = spark.createDataFrame([("x", 1, 0, 500, "b  A c d e f"), ("x", 2, 100, 600, "f e d c a B"), ("x", 3, 100, 600, "a"), ("x", 4, 0, 500, " ")],
                               "k string, id bigint, start_ms bigint, end_ms bigint, text string")
    assert sorted(r["id"] for r in dedup.near_duplicates(df, ["k"], "id", "text").collect()) == [1, 3, 4] and seen == ["string"]


@pytest.mark.parametrize("width", [None, 1700])
def test_same_text_duplicates(spark, width):
    rows = dup_rows(2)
    iou = lambda p, c: max(0, min(p[3], c[3]) - max(p[2], c[2])) / (max(p[3], c[3]) - min(p[2], c[2]))
    want = []
    for k in "xy":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3], r[1]))
        want += [r[1] for r in greedy(mine, lambda p, c: p[4] == c[4] and ((abs(p[2] - c[2]) <= 300 and abs(p[3] - c[3]) <= 300) or iou(p, c) >= .85))]
    df = spark.createDataFrame(rows, "k string, id bigint, start_ms bigint, end_ms bigint, text string")
    got = dedup.same_text_duplicates(df, ["k"], "id", "text", width=width)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("rows,want", [([(1, ["u1"]), (2, ["u1"]), (3, ["u1"])], [1, 2]),
                                       ([(1, ["u1"]), (2, ["u1", "u2"]), (3, ["u1", "u2"]), (4, ["u2"])], [1, 2, 4]),
                                       ([(1, []), (2, None)], [1, 2])])
def test_reuse_quota_golden(spark, rows, want):
    got = dedup.reuse_quota(spark.createDataFrame(rows, "s bigint, ids array<string>"), "ids", "s")
    assert sorted(r["s"] for r in got.collect()) == want


def test_reuse_quota_random(spark):
    r = random.Random(5)
    rows = [(i, [f"u{x}" for x in r.sample(range(12), r.randrange(1, 4))]) for i in range(60)]
    used, want = {}, []
    for s, ids in rows:
        if all(used.get(u, 0) < 2 for u in ids):
            want.append(s)
            for u in ids:
                used[u] = used.get(u, 0) + 1
    got = dedup.reuse_quota(spark.createDataFrame(rows, "s bigint, ids array<string>"), "ids", "s")
    assert sorted(x["s"] for x in got.collect()) == want


def test_blocks_are_chosen_without_working_out_features_again(spark):
    """A filter on the score would be pushed below the features, with each rule's text squeezed again for every word."""
    rows = [("a", i, "P" if i % 3 else "Q", 40_000 * i, 40_000 * i + 35_000, f"line {i} deploy api docker cần kiểm tra" if i % 2 else "ok") for i in range(9)]
    d = spark.createDataFrame(rows, "k string, idx long, speaker string, start_ms long, end_ms long, text string")
    f = summary.features(summary.blocks(d, ["k"], "idx", F.lit(0)))
    got = summary.choose_blocks(f, ["k"])
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x and "regexp_replace" in x]
    scores = {r.block_id: r.score for r in f.select("block_id", "score").collect()}
    want = sorted((b for b, s in scores.items() if s >= 3), key=lambda b: (-scores[b], b))[:12]
    assert want and len(want) < len(scores) and {(r.block_id, r.score) for r in got.collect()} == {(b, scores[b]) for b in want}


def disk_of(spark, run):
    """MB of shuffle files and folders of tables that `run` leaves, and its result."""
    import time
    from pathlib import Path

    from dialoom.session import scratch_folder
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {f.toString(): f.length() for f in (lambda a: [a.apply(i) for i in range(a.size())])(disk.getAllFiles()) if "shuffle_" in f.getName()}
    top = Path(scratch_folder(spark).removeprefix("file:")).parent
    tables = lambda: {p for p in top.glob("*") if p.is_dir()}
    spark.range(1).count()
    had, tabled = shuffles(), tables()
    out = run()
    for _ in range(50):        # files go in the background
        left = sum(n for f, n in shuffles().items() if f not in had)
        if left < 50_000:
            break
        time.sleep(0.2)
    return left / 1e6, len(tables() - tabled), out


def long_talk(n=8000):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(4000)]
    return [(f"k{i % 40}", i, f"S{i // 40 % 3}", 4000 * (i // 40), 4000 * (i // 40) + 3500, " ".join(r.choice(words) for _ in range(15))) for i in range(n)]


def test_summaries_leave_one_table_and_no_shuffles(spark):
    """A step's table and shuffles go once the next table is there: all steps together had several copies of all texts."""
    df = spark.createDataFrame(long_talk(), LINE)
    mb, tables, (norm, sums) = disk_of(spark, lambda: summary.summarize(df, ["k"], "idx", F.floor(F.col("start_ms") / 3_600_000), width=3_600_000))
    assert mb < 0.05 and tables == 1 and norm.count() == sums.count() > 40
    mb, tables, docs = disk_of(spark, lambda: summary.meeting_documents(norm, sums, ["k"]))
    assert mb < 0.05 and tables == 2
    got = {r.k: r for r in docs.collect()}
    assert len(got) == 40 and sum(r.num_blocks for r in got.values()) == sums.count()
    assert sum(len(r.cleaned_transcript) for r in got.values()) == norm.selectExpr("sum(size(lines))").first()[0]


def test_chunks_leave_one_table_and_no_shuffles(spark):
    df = spark.createDataFrame(long_talk(), LINE)
    mb, tables, chunks = disk_of(spark, lambda: sequence.build_chunks(df, df, ["k"], "idx", 3_600_000, width=3_600_000))
    assert mb < 0.05 and tables <= 2 and chunks.count() > 100
