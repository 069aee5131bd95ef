"""From scored embeddings to speaker labels: collisions, votes, profiles, propagation, clustering, seeds, label maps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import tiers, vectors as fv
from dialoom.operators import assignment, slabs
from dialoom.operators import vectors as ov
from dialoom.session import cut_lineage

CHUNK = ["recording_id", "chunk"]
TRACK = ["recording_id", "chunk", "track"]
SOFT = 0.8  # share of the threshold that still lets a displaced track take its second choice
MAX_CHUNK_GAP = 4
VOTE_CONFIDENCE = 0.50
CHUNKS_PER_SLAB = 65_536
SEED_ENROLLED, SEED_CLUSTER = "enrollment", "phase1_bootstrap"  # fixed values


def initial_assignment(rows: DataFrame) -> DataFrame:
    """Best centroid per row, valid from the tier's threshold on (`sims`, `top1_*` come from `vectors.scored`)."""
    thr = tiers.assign_threshold(F.col("tier"))
    return rows.withColumns({"label": F.col("top1_label").cast("long"), "score": F.col("top1_score"),
                             "valid": F.col("top1_score") >= thr})


def resolve_collisions(rows: DataFrame, row_id: str) -> DataFrame:
    """Two tracks of a chunk speaking at once cannot be one speaker: the weaker one moves to its next choice.

    A chunk's tracks are numbered by their first valid row. One join finds the track pairs whose valid rows overlap in
    time; then each pair number is one round for all chunks together: an aggregation gives both tracks' strongest valid
    rows, and where their labels agree the weaker track takes its best other label if that meets its threshold, or 0.8 of
    it, and loses its rows otherwise. A chunk is a fixed stretch of audio, so it has few tracks and few rounds.
    """
    limit = tiers.ASSIGN_SIM
    thr = F.lit(limit["fallback"])
    for tier, bar in limit.items():
        thr = F.when(F.col("tier") == tier, F.lit(bar)).otherwise(thr)
    lean = rows.select(*CHUNK, row_id, "track", "start_ms", "end_ms", "sims", "label", "score", "valid", thr.alias("bar"))
    firsts = lean.filter("valid").groupBy(*CHUNK, "track").agg(F.min(row_id).alias("first"))
    firsts = firsts.withColumn("nth", F.row_number().over(Window.partitionBy(*CHUNK).orderBy("first"))).drop("first")
    now = cut_lineage(lean.join(firsts, [*CHUNK, "track"], "left").withColumn("member", F.col("valid")))

    one = now.filter("member").select(*CHUNK, F.col("nth").alias("x"), F.col("start_ms").alias("xs"), F.col("end_ms").alias("xe"))
    two = now.filter("member").select(*CHUNK, F.col("nth").alias("y"), F.col("start_ms").alias("ys"), F.col("end_ms").alias("ye"))
    at_once = one.join(two, CHUNK).filter("x < y AND xs < ye AND ys < xe").groupBy(*CHUNK, "x", "y").agg(F.lit(1).alias("met"))
    at_once = cut_lineage(at_once)

    rank = F.struct("score", (-F.col(row_id)).alias("early"))
    lead = F.struct("label", "score", "sims", "bar")
    for x, y in sorted(tuple(r) for r in at_once.select("x", "y").distinct().collect()):
        live = lambda k: F.when(F.col("member") & F.col("valid") & (F.col("nth") == k), rank)  # noqa: E731, B023
        top = now.groupBy(*CHUNK).agg(F.max_by(lead, live(x)).alias("a"), F.max_by(lead, live(y)).alias("b"),
                                      F.max(live(x)).isNotNull().alias("has_a"), F.max(live(y)).isNotNull().alias("has_b"))
        clash = top.join(at_once.filter((F.col("x") == x) & (F.col("y") == y)), CHUNK).filter("has_a AND has_b AND a.label = b.label")
        weaker = F.when(F.col("a.score") >= F.col("b.score"), F.col("b")).otherwise(F.col("a"))
        clash = clash.select(*CHUNK, F.when(F.col("a.score") >= F.col("b.score"), y).otherwise(x).alias("nth"), weaker.alias("w"))
        others = F.array_sort(F.filter(F.transform("w.sims", lambda s, i: F.struct((-s).alias("n"), i.cast("long").alias("to"))), lambda o: o["to"] != F.col("w.label")))
        best = F.get(others, F.lit(0))
        moves = clash.select(*CHUNK, "nth", F.lit(True).alias("hit"), best["to"].alias("to"), F.col("w.bar").alias("w_bar"), (-best["n"]).alias("reach"))
        bar = (F.when(F.col("reach") >= F.col("w_bar"), F.col("bar")).when(F.col("reach") >= F.col("w_bar") * SOFT, F.col("w_bar") * SOFT))
        now = now.join(moves, [*CHUNK, "nth"], "left")
        moved, new = F.col("hit") & F.col("member"), F.get("sims", F.col("to").cast("int"))
        stays = bar.isNotNull()
        now = cut_lineage(now.withColumns({
            "valid": F.when(moved, F.coalesce(new >= bar, F.lit(False))).otherwise(F.col("valid")),
            "label": F.when(moved & stays, F.col("to")).otherwise(F.col("label")),
            "score": F.when(moved & stays, new).otherwise(F.col("score"))}).drop("hit", "to", "w_bar", "reach"))
    return rows.drop("label", "score", "valid").join(now.select(*CHUNK, row_id, "label", "score", "valid"), [*CHUNK, row_id])


def with_margin(rows: DataFrame) -> DataFrame:
    """Second-best label apart from the assigned one, and the margin to it."""
    rest = F.array_sort(F.filter(F.transform("sims", lambda s, i: F.struct((-s).alias("n"), i.alias("i"))),
                                 lambda x: x["i"] != F.col("label")))
    second = F.get(rest, F.lit(0))
    return rows.withColumns({"second_score": F.coalesce(-second["n"], F.lit(-1.0)),
                             "margin": F.col("score") - F.coalesce(-second["n"], F.lit(0.0))})


def track_votes(rows: DataFrame, row_id: str) -> DataFrame:
    """Label per (chunk, track) by tier weight times score; the label seen first wins ties."""
    v = rows.filter("valid").withColumn("_w", tiers.vote_weight(F.col("tier")) * F.greatest("score", F.lit(1e-4)))
    per = v.groupBy(*TRACK, "label").agg(F.sum("_w").alias("votes"), F.min(row_id).alias("_first"))
    return per.groupBy(*TRACK).agg(F.max_by(F.struct("label", "votes"), F.struct(F.round("votes", 9), -F.col("_first"))).alias("b"),
                                   F.sum("votes").alias("total_votes")).select(*TRACK, "b.label", "b.votes", "total_votes")


def track_profile(rows: DataFrame) -> DataFrame:
    """Mean score vector, best two labels of it, tier shares of the votes, mean margin per (chunk, track)."""
    v = rows.filter("valid").withColumn("_w", tiers.vote_weight(F.col("tier")) * F.greatest("score", F.lit(1e-4)))
    mean = (v.select(*TRACK, F.posexplode("sims").alias("_i", "_s")).groupBy(*TRACK, "_i").agg(F.avg("_s").alias("m"))
            .groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("_i", "m"))).alias("_p"))
            .select(*TRACK, F.transform("_p", lambda p: p["m"]).alias("avg_sims")))
    share = lambda t: (F.sum(F.when(F.col("tier") == t, F.col("_w")).otherwise(0.0)) / F.greatest(F.sum("_w"), F.lit(1e-8)))
    agg = v.groupBy(*TRACK).agg(F.avg("score").alias("best_sim"), F.avg("used_dur").alias("avg_used_dur"), F.avg("margin").alias("avg_margin"),
                                *[share(t).alias(f"{t}_vote_ratio") for t in ("primary", "aux", "fallback")])
    # dominant tier: largest share, primary before aux before fallback on ties
    out = agg.join(mean, TRACK).withColumn("_t", fv.top_two(F.col("avg_sims"))).select("*", "_t.*").drop("_t")
    return out.withColumns({
        "top1_minus_top2": F.col("top1_score") - F.col("top2_score"),
        "dominant_tier": F.when((F.col("primary_vote_ratio") >= F.col("aux_vote_ratio")) & (F.col("primary_vote_ratio") >= F.col("fallback_vote_ratio")), "primary")
        .when(F.col("aux_vote_ratio") >= F.col("fallback_vote_ratio"), "aux").otherwise("fallback")})


def force_profile(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """Profile of a track from the duration-weighted mean of all its embeddings, valid or not."""
    c = ov.centroids(rows, TRACK, weight=F.greatest("used_dur", F.lit(1e-4))).withColumnRenamed("centroid", "embedding")
    s = ov.scored(c.select(*TRACK, "embedding"), packed, ["recording_id"])
    dom = rows.groupBy(*TRACK, "tier").agg(F.sum(F.greatest("used_dur", F.lit(1e-4))).alias("_w"))
    dom = dom.groupBy(*TRACK).agg(F.max_by("tier", F.struct("_w", "tier")).alias("dominant_tier"))
    return s.join(dom, TRACK).select(*TRACK, F.col("top1_label").cast("long").alias("label"), "top1_score", "top2_score",
                                     (F.col("top1_score") - F.col("top2_score")).alias("top1_minus_top2"), "dominant_tier")


# fixed values of the acceptance of tracks without history: (score, margin) per tier group
ORPHAN_STRONG, ORPHAN_WEAK = (0.34, 0.06), (0.40, 0.08)


def orphan_reason(tier: Column, score: Column, margin: Column, strong=ORPHAN_STRONG, weak=ORPHAN_WEAK) -> Column:
    good = tier.isin("primary", "aux")
    s = F.when(good, strong[0]).otherwise(weak[0])
    m = F.when(good, strong[1]).otherwise(weak[1])
    return (F.when(tier.isNull(), "missing_meta").when(score < s, "low_score").when(margin < m, "low_margin")
            .otherwise("accepted"))


def propagate(slots: DataFrame, mapped: DataFrame, forced: DataFrame) -> DataFrame:
    """Labels for all (recording, chunk, track) slots, with the rule that gave them.

    Order of rules: own label; nearest labelled chunk of the track within four chunks (the earlier one on ties); forced
    profile; majority label of the track with enough confidence; nearest at any distance; accepted orphan.
    """
    key = ["recording_id", "track"]
    d = slots.join(mapped.select(*TRACK, "label", "best_sim"), TRACK, "left")
    # nearest labelled chunk on both sides; chunk slabs keep a track of any length out of a single task
    own = F.when(F.col("label").isNotNull(), F.struct("chunk", "label", "best_sim"))
    d = d.withColumn("_own", own).withColumn(slabs.SLAB, F.floor(F.col("chunk") / CHUNKS_PER_SLAB).cast("long"))
    after = lambda w, a: w.rowsBetween(a, Window.unboundedFollowing)
    d = slabs.scan(
        d, key, ["chunk"],
        local=lambda w: [{"_lp": F.max("_own").over(slabs.upto(w)), "_ln": F.min("_own").over(after(w, 0))}],
        summary=[F.max("_own").alias("_hi"), F.min("_own").alias("_lo")],
        carry=lambda w: [{"_cp": F.max("_hi").over(slabs.before(w)), "_cn": F.min("_lo").over(after(w, 1))}],
        carried=["_cp", "_cn"])
    d = d.withColumns({"_p": F.coalesce("_lp", "_cp"), "_n": F.coalesce("_ln", "_cn")}).drop("_own", "_lp", "_ln", "_cp", "_cn", slabs.SLAB)
    near_p, near_n = F.col("chunk") - F.col("_p.chunk"), F.col("_n.chunk") - F.col("chunk")
    take_p = F.col("_n").isNull() | (F.col("_p").isNotNull() & (near_p <= near_n))
    d = d.withColumn("_near", F.when(take_p, F.col("_p")).otherwise(F.col("_n")))
    d = d.join(forced.select(*TRACK, F.col("label").alias("f_label"), F.col("dominant_tier").alias("f_tier"),
                             F.col("top1_score").alias("f_score"), F.col("top1_minus_top2").alias("f_margin")), TRACK, "left")
    close = F.abs(F.col("chunk") - F.col("_near.chunk")) <= MAX_CHUNK_GAP
    d = d.withColumns({
        "label1": F.coalesce("label", F.when(close, F.col("_near.label")), "f_label"),
        "rule1": F.when(F.col("label").isNotNull(), "own").when(close, "neighbour").when(F.col("f_label").isNotNull(), "forced"),
        "sim1": F.coalesce("best_sim", F.when(close, F.col("_near.best_sim")), F.when(F.col("f_label").isNotNull(), F.col("f_score")), F.lit(0.1))})
    votes = d.filter("label1 IS NOT NULL").groupBy(*key, "label1").agg(F.sum(F.greatest("sim1", F.lit(0.01))).alias("v"))
    glob = votes.groupBy(*key).agg(F.max_by(F.struct(F.col("label1").alias("g"), "v"), F.struct(F.round("v", 9), -F.col("label1"))).alias("b"),
                                   F.sum("v").alias("_t")).select(*key, F.col("b.g").alias("g_label"), (F.col("b.v") / F.col("_t")).alias("g_conf"))
    d = d.join(glob, key, "left")
    sure = F.col("g_conf") >= VOTE_CONFIDENCE
    orphan = orphan_reason(F.col("f_tier"), F.col("f_score"), F.col("f_margin")) == "accepted"
    rules = [("label1", F.col("label1").isNotNull(), F.col("rule1")), ("g_label", F.coalesce(sure, F.lit(False)), F.lit("global")),
             ("_near.label", F.col("_near").isNotNull(), F.lit("nearest")), ("g_label", F.col("g_label").isNotNull(), F.lit("global_weak")),
             ("f_label", orphan, F.lit("orphan"))]
    lab, why = F.lit(None).cast("long"), F.lit("unmapped")
    for col, cond, name in reversed(rules):
        lab, why = F.when(cond, F.col(col)).otherwise(lab), F.when(cond, name).otherwise(why)
    return d.select(*TRACK, lab.alias("final_label"), why.alias("rule"))


# ---- clustering -------------------------------------------------------------------------------------------------------

def average_linkage(dist: np.ndarray, k: int | None = None, threshold: float | None = None) -> np.ndarray:
    """Labels of average-linkage clustering down to `k` clusters or up to a distance threshold."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, member, alive = np.ones(n), [[i] for i in range(n)], n
    while alive > 1 and (k is None or alive > k):
        i, j = divmod(int(np.argmin(d)), n)
        if threshold is not None and d[i, j] >= threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        member[i] += member[j]
        member[j] = []
        alive -= 1
    out = np.zeros(n, dtype=int)
    for lab, m in enumerate(sorted((m for m in member if m), key=min)):
        out[m] = lab
    return out


CANNOT_LINK = 3.0  # beyond the largest cosine distance


def cluster_anchors(df: DataFrame, keys: Sequence[str], row_id: str, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Average-linkage clusters per recording; tracks of one chunk cannot link. Recordings with fewer than `k` rows give none.

    One distance matrix per recording, as the method demands: a recording's anchors are bounded by its chunks.
    """
    keys = list(keys)
    schema = T.StructType([*[df.schema[c] for c in [*keys, row_id]], T.StructField("cluster", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(row_id)
        if k is not None and len(p) < k:
            return pd.DataFrame(columns=[*keys, row_id, "cluster"])
        m = np.stack(p["embedding"].to_numpy())
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        d = np.clip(1.0 - m @ m.T, 0.0, 2.0)
        if "chunk" in p and "track" in p:
            c, t = p["chunk"].to_numpy(), p["track"].to_numpy()
            d[(c[:, None] == c[None, :]) & (t[:, None] != t[None, :])] = CANNOT_LINK
        return p[[*keys, row_id]].assign(cluster=average_linkage(d, k, threshold).astype("int64"))

    cols = [*keys, row_id, "embedding", *[c for c in ("chunk", "track") if c in df.columns]]
    return df.select(*cols).groupBy(*keys).applyInPandas(run, schema)


def seed_table(enrolled: DataFrame, clusters: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Speaker seeds per recording: enrolled speakers first, then unmatched clusters as unknown_1, unknown_2, …

    `enrolled`: keys, name, centroid. `clusters`: keys, cluster, centroid. Each enrolled speaker takes at most one
    cluster out of the running, by the best one-to-one cosine assignment. With n or more enrolled speakers the first n are
    the seeds and no cluster is matched; a recording with fewer than n seeds in all has none.
    """
    keys = list(keys)
    have = enrolled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    short = clusters.join(have.filter(F.col("_k") >= n), keys, "left_anti")
    pair = enrolled.withColumnRenamed("centroid", "_a").join(short.withColumnRenamed("centroid", "_b"), keys)
    sims = pair.select(*keys, "name", "cluster", fv.cosine(F.col("_a"), F.col("_b")).alias("sim"))
    taken = assignment.best_pairs(sims, keys, "name", "cluster", "sim")
    w = Window.partitionBy(*keys)
    a = enrolled.withColumn("idx", F.row_number().over(w.orderBy("name")) - 1).filter(F.col("idx") < n)
    a = a.join(taken.select(*keys, "name", "cluster"), [*keys, "name"], "left")
    a = a.select(*keys, "idx", F.lit(SEED_ENROLLED).alias("seed_type"), F.col("name").alias("seed_name"), F.col("cluster").alias("matched"), "centroid")
    rest = short.join(taken.select(*keys, "cluster"), [*keys, "cluster"], "left_anti").join(have, keys, "left").fillna({"_k": 0})
    rest = rest.withColumn("_r", F.row_number().over(w.orderBy("cluster"))).filter(F.col("_r") <= n - F.col("_k"))
    b = rest.select(*keys, (F.col("_k") + F.col("_r") - 1).alias("idx"), F.lit(SEED_CLUSTER).alias("seed_type"),
                    F.concat(F.lit("unknown_"), F.col("_r").cast("string")).alias("seed_name"), F.col("cluster").alias("matched"), "centroid")
    seeds = a.unionByName(b).withColumn("_n", F.count(F.lit(1)).over(w))
    return seeds.filter(F.col("_n") >= n).drop("_n")


def known_like(rows: DataFrame, packed: DataFrame, keys: Sequence[str], sim: float = 0.42, margin: float = 0.05) -> DataFrame:
    """Marks anchors that clearly belong to an enrolled speaker."""
    s = ov.scored(rows, packed, keys)
    return s.withColumn("known", (F.col("top1_score") >= sim) & (F.col("top1_score") - F.col("top2_score") >= margin))


def speaker_index(label: Column) -> Column:
    return F.split_part(label, F.lit("_"), F.lit(2)).try_cast("int")


def relabel(df: DataFrame, mapping: DataFrame, keys: Sequence[str], column: str = "speaker") -> DataFrame:
    """Apply (keys, old, new); labels without an entry stay."""
    m = mapping.select(*keys, F.col("old").alias(column), F.col("new").alias("_new"))
    return df.join(m, [*keys, column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def hub_penalty(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Penalty of speakers holding a large share of time, rows and fallback evidence."""
    free, hard = 0.34, 0.44  # fixed values
    keys = list(keys)
    dur = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    heavy = tiers.fallback_heavy(F.col("tier"), 0.55)
    by = df.groupBy(*keys, "speaker").agg(F.sum(dur).alias("d"), F.count(F.lit(1)).alias("n"), F.sum(F.when(heavy, dur).otherwise(0)).alias("f"))
    tot = by.groupBy(*keys).agg(F.sum("d").alias("_d"), F.sum("n").alias("_n"))
    over = lambda s: F.greatest(F.lit(0.0), (s - free) / (hard - free))
    j = by.join(tot, keys)
    raw = 0.55 * over(F.col("d") / F.col("_d")) + 0.25 * over(F.col("n") / F.col("_n")) + 0.20 * 0.30 * F.col("f") / F.greatest("d", F.lit(1e-8))
    return j.withColumn("_raw", raw).select(*keys, "speaker", F.when((F.col("_d") > 0) & (F.col("_raw") > 0), F.pow("_raw", F.lit(1.55))).otherwise(0.0).alias("penalty"))


def dominant_tier(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = df.groupBy(*keys, "tier").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("d"))
    return per.groupBy(*keys).agg(F.max_by("tier", F.struct("d", "tier")).alias("dominant_tier"))


# ---- second-opinion label map ------------------------------------------------------------------------------------------

def label_scores(overlap: DataFrame, acoustic: DataFrame, neighbour: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlap 1.0, acoustic 0.8 and neighbour 0.55, each over its largest cell of the recording.

    Inputs are (keys, other, local, v); a pair that an input lacks has nothing there.
    """
    keys = list(keys)
    pair = [*keys, "other", "local"]
    parts = {"overlap": overlap, "acoustic": acoustic, "neighbour": neighbour}
    long = [d.select(*pair, *[(F.col("v") if c == n else F.lit(0.0)).alias(c) for c in parts]) for n, d in parts.items()]
    d = long[0].unionByName(long[1]).unionByName(long[2]).groupBy(*pair).agg(*[F.sum(c).alias(c) for c in parts])
    top = d.groupBy(*keys).agg(*[F.max(c).alias(f"_{c}") for c in ("overlap", "acoustic", "neighbour")])
    d = d.join(top, keys)
    part = lambda c: F.when(F.col(f"_{c}") > 1e-8, F.col(c) / F.col(f"_{c}")).otherwise(0.0)
    return d.withColumn("score", part("overlap") + 0.8 * part("acoustic") + 0.55 * part("neighbour")).select(*pair, "overlap", "acoustic", "neighbour", "score")


def second_opinion_map(scores: DataFrame, keys: Sequence[str], min_score: float = 0.38, min_overlap_ms: int = 250) -> DataFrame:
    """One-to-one map other → local (null where the chosen pair is too weak)."""
    keys = list(keys)
    best = assignment.best_pairs(scores, keys, "other", "local", "score")
    best = best.join(scores.select(*keys, "other", "local", "overlap"), [*keys, "other", "local"])
    best = best.filter((F.col("score") >= min_score) & (F.col("overlap") >= min_overlap_ms)).drop("overlap")
    return scores.select(*keys, "other").distinct().join(best, [*keys, "other"], "left")
