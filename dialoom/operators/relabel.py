"""Score vectors over time and the rules that move single-speaker stretches to another speaker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import tiers, vectors as fv
from dialoom.operators import sequence, slabs, spans, speakers
from dialoom.operators.spans import E, S
from dialoom.session import cut_lineage

W_SCALE, V_SCALE = 10_000, 1_000_000  # weights and weighted scores are summed as integers

# fixed values
MERGE_GAP_MS = 300
STABLE = {"min_ms": 900, "margin": 0.14, "top_gap": 0.06, "heavy": 0.55}
TRUSTED = {"margin": 0.06, "min_ms": 250}
SCORE_BLOCK = 0.45
TEMPORAL = {"bridge_ms": 1200, "neighbour_ms": 800, "margin": 0.18, "gain": 0.08, "window_ms": 1200, "support_ms": 350, "score_ms": 1600}
SECOND = {"min_ms": 250, "margin": 0.16, "stable_ms": 300, "fallback": 0.45, "gain": 0.06, "neighbour_s": 0.08, "window_ms": 900,
          "hub_gain": 0.11, "hub_support": 0.18}


def score_weight(tier: Column) -> Column:
    """Row weight for score averages, a twentieth of it for fallback-heavy rows, as an integer."""
    w = tiers.row_weight(tier)
    return F.round(F.when(tiers.fallback_heavy(tier, SCORE_BLOCK), w * 0.05).otherwise(w) * W_SCALE).cast("long")


def _weighted(i: int) -> Column:
    return F.round(F.coalesce(F.get(F.col("sims"), F.lit(i)), F.lit(0.0)) * score_weight(F.col("tier")) * V_SCALE / W_SCALE).cast("long")


def _fitting(rows: DataFrame, n: int) -> DataFrame:
    """Rows as they are; a row with more than `n` score positions is an error, as none may be dropped unseen."""
    return rows.withColumn("sims", F.when(F.size("sims") > n, F.raise_error(F.lit(f"a row has more than {n} score positions"))).otherwise(F.col("sims")))


def span_score_vectors(df: DataFrame, rows: DataFrame, keys: Sequence[str], row_id: Sequence[str], n: int, width: int) -> DataFrame:
    """Overlap-weighted mean score vector of each span over all rows of its key (zeros without any overlap).

    One running total per vector position and one for the weight: the position is part of the key of the scan.
    """
    keys = list(keys)
    dims = F.array(*[F.struct(F.lit(i).alias("d"), (F.lit(1).cast("long") * (score_weight(F.col("tier")) if i < 0 else _weighted(i))).alias("w")) for i in range(-1, n)])
    per = _fitting(rows, n).filter(F.col(E) > F.col(S)).select(*keys, S, E, F.explode(dims).alias("_x")).select(*keys, S, E, F.col("_x.d").alias("_d"), F.col("_x.w").alias("_w2"))
    ask = df.select(*dict.fromkeys([*keys, *row_id]), S, E).withColumn("_d", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    got = spans.overlap_sum(ask, per, [*keys, "_d"], row_id, "_sum", weight=F.col("_w2"), width=width)
    ids = list(dict.fromkeys([*keys, *row_id]))
    parts = got.groupBy(*ids).agg(F.max(F.when(F.col("_d") == -1, F.col("_sum"))).alias("_t"),
                                  *[F.max(F.when(F.col("_d") == i, F.col("_sum"))).alias(f"_v{i}") for i in range(n)])
    mean = [F.when(F.col("_t") > 0, F.col(f"_v{i}") * W_SCALE / V_SCALE / F.col("_t")).otherwise(0.0) for i in range(n)]
    return df.join(parts.select(*ids, F.array(*mean).alias("score_vector")), ids)


def profiled_atoms(rows: DataFrame, keys: Sequence[str], n: int, width: int) -> DataFrame:
    """Atomic intervals with the number of speakers, the speaker index where it is one, the mean score vector of the
    active rows, its best two labels, and how many active rows are fallback-heavy.

    One sweep over rows and per-speaker unions together; where one union is active, the running sum of speaker indexes
    *is* that speaker.
    """
    keys = list(keys)
    live = _fitting(rows, n).filter(F.col(E) > F.col(S))
    zero = F.lit(0).cast("long")
    names = {"depth": F.lit(1).cast("long"), "w": score_weight(F.col("tier")), "u": zero, "uidx": zero,
             "fb": F.when(tiers.fallback_ratio(F.col("tier")) > 0, score_weight(F.col("tier"))).otherwise(zero),
             "heavy": F.when(tiers.fallback_heavy(F.col("tier"), STABLE["heavy"]), F.lit(1)).otherwise(F.lit(0)).cast("long"),
             **{f"v{i}": _weighted(i) for i in range(n)}}
    a = live.select(*keys, S, E, *[c.alias(f"x_{k}") for k, c in names.items()])
    un = spans.speaker_unions(live, keys, width=width)
    b = un.select(*keys, S, E, *[{"u": F.lit(1).cast("long"), "uidx": speakers.speaker_index(F.col("speaker")).cast("long")}.get(k, zero).alias(f"x_{k}") for k in names])
    both = cut_lineage(a.unionByName(b))  # the sweep reads it twice
    st = spans.depth_steps(both, keys, {k: F.col(f"x_{k}") for k in names}, width)
    st = st.filter((F.col("depth") > 0) & F.col("next_ms").isNotNull())
    mean = F.array(*[F.when(F.col("w") > 0, F.round(F.col(f"v{i}") * W_SCALE / V_SCALE / F.col("w"), 9)).otherwise(0.0) for i in range(n)])
    st = st.withColumn("vec", mean).withColumn("_t", fv.top_two(F.col("vec")))
    return st.select(*keys, F.col("t").alias(S), F.col("next_ms").alias(E), "depth", F.col("u").alias("n_speakers"),
                     F.when(F.col("u") == 1, F.col("uidx").cast("int")).alias("idx"), "vec", "_t.*",
                     F.round(F.col("_t.top1_score") - F.col("_t.top2_score"), 9).alias("margin"), "heavy",
                     F.when(F.col("w") > 0, F.col("fb") / F.col("w")).otherwise(0.0).alias("fallback_share"))


def _speaker(idx: Column) -> Column:
    return F.concat(F.lit("SPK_"), idx.cast("string"))


def stable_zones(atoms: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Stretches of one speaker with a clear, matching best score and no fallback-heavy row, from 0.9 s on."""
    p = STABLE
    cur = F.get("vec", F.col("idx"))
    ok = (F.col("n_speakers") == 1) & (F.col("margin") >= p["margin"]) & (F.round(F.col("top1_score") - cur, 9) <= p["top_gap"]) & (F.col("top1_label") == F.col("idx")) & (F.col("heavy") == 0)
    z = atoms.filter(ok).select(*keys, _speaker(F.col("idx")).alias("speaker"), S, E)
    z = spans.merge_spans(z, [*keys, "speaker"], 0, width).drop("n_spans")
    return z.filter(F.col(E) - F.col(S) >= p["min_ms"])


def trusted_rows(atoms: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Single-speaker atoms of 0.25 s or more whose best score is the speaker's by a margin; touching ones merged."""
    p = TRUSTED
    ok = (F.col("n_speakers") == 1) & (F.col("margin") >= p["margin"]) & (F.col("top1_label") == F.col("idx")) & (F.col("heavy") == 0) & (F.col(E) - F.col(S) >= p["min_ms"])
    z = atoms.filter(ok).select(*keys, _speaker(F.col("idx")).alias("speaker"), S, E, F.get("vec", F.col("idx")).alias("_s"))
    return spans.merge_spans(z, [*keys, "speaker"], 0, width, aggs=[F.max("_s").alias("score")]).drop("n_spans")


MERGED = T.StructType([T.StructField(S, T.LongType()), T.StructField(E, T.LongType()), T.StructField("tier", T.StringType()),
                       T.StructField("sims", T.ArrayType(T.DoubleType()))])


def merge_scored_rows(rows: DataFrame, keys: Sequence[str], row_id: str, slab_ms: int, gap_ms: int = MERGE_GAP_MS) -> DataFrame:
    """Merge rows of one speaker within the gap: vectors averaged by duration pair by pair, tier of the longer side.

    The pairwise rule depends on order (merged spans weigh by their hull), so it is a fold over runs without such a gap;
    a run that crosses slabs is relayed slab by slab.
    """
    def step(state, r):
        cur = state.get("cur")
        new = {S: int(r[S]), E: int(r[E]), "tier": r["tier"], "sims": [float(x) for x in r["sims"]]}
        if cur is None or new[S] > cur[E] + gap_ms:
            state["cur"] = new
            return [] if cur is None else [cur]
        da, db = max(0, cur[E] - cur[S]), max(0, new[E] - new[S])
        t = max(da + db, 1e-8)
        state["cur"] = {S: min(cur[S], new[S]), E: max(cur[E], new[E]), "tier": cur["tier"] if da >= db else new["tier"],
                        "sims": [(da * a + db * b) / t for a, b in zip(cur["sims"], new["sims"])]}
        return []

    lean = rows.select(*keys, "speaker", row_id, S, E, "tier", "sims")
    return sequence.run_fold(lean, [*keys, "speaker"], [S, E, row_id], F.floor(F.col(S) / slab_ms), gap_ms, step,
                             lambda st: [st["cur"]] if st.get("cur") else [], MERGED)


def _support(atoms: DataFrame, sup: DataFrame, keys: Sequence[str], who: dict[str, str], windows: Sequence[tuple[Column, Column]],
             weight: Column | None, width: int) -> DataFrame:
    """Weighted speech inside `windows` of each atom by the speakers named in columns; `who` maps column -> output.

    All asked speakers share one scan.
    """
    ids = [*keys, S, E]
    ask = atoms.select(*ids, F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(c).alias("s")) for c, o in who.items()])).alias("_a"))
    ask = ask.select(*ids, F.col("_a.s").alias("speaker"), F.col("_a.o").alias("_o")).filter("speaker IS NOT NULL")
    cols = ["speaker", S, E, *(["tier"] if weight is not None else [])]
    got = spans.overlap_sum(ask, sup.select(*keys, *cols), [*keys, "speaker"], [S, E, "_o"], "_x", windows=windows, weight=weight, width=width)
    wide = got.groupBy(*ids).agg(*[F.max(F.when(F.col("_o") == o, F.col("_x"))).alias(o) for o in who.values()])
    return atoms.join(wide, ids, "left").fillna(0, list(who.values()))


def _beside(ms: int) -> list[tuple[Column, Column]]:
    return [(F.col(S) - ms, F.col(S)), (F.col(E), F.col(E) + ms)]


def _around_edges(ms: int) -> list[tuple[Column, Column]]:
    return [(F.col(c) + a, F.col(c) + b) for c in (S, E) for a, b in ((-ms, 0), (0, ms))]


def temporal_relabel(rows: DataFrame, keys: Sequence[str], n: int, width: int) -> DataFrame:
    """Single-speaker atoms that move to another speaker: bridged by equal neighbours, or by a better score with support.

    Returns keys, span, old, new, reason.
    """
    p, keys = TEMPORAL, list(keys)
    atoms = cut_lineage(profiled_atoms(rows, keys, n, width))
    zones = cut_lineage(stable_zones(atoms, keys, width))
    d = slabs.with_slab(atoms, S, width)
    one = F.struct(F.when(F.col("n_speakers") == 1, F.col("idx")).alias("i"), F.col(S).alias("s"), F.col(E).alias("e"))
    d = slabs.neighbour(d, keys, [S], -1, {"_p": one})
    d = slabs.neighbour(d, keys, [S], 1, {"_n": one}).drop(slabs.SLAB)
    d = d.filter("n_speakers = 1").withColumns({
        "old": _speaker(F.col("idx")), "dur": F.col(E) - F.col(S), "cur": F.get("vec", F.col("idx"))}).filter("cur IS NOT NULL")
    sure = (F.col("margin") >= p["margin"] + 0.06) & (F.col("top1_label") == F.col("idx")) & (F.col("dur") >= p["bridge_ms"])
    d = d.filter(~sure)
    wide = lambda c: F.col(f"{c}.e") - F.col(f"{c}.s") >= p["neighbour_ms"]
    bridge = ((F.col("_p.i") == F.col("_n.i")) & (F.col("_p.i") != F.col("idx")) & wide("_p") & wide("_n")
              & (F.col("dur") <= p["bridge_ms"]) & (F.col("margin") <= p["margin"]))
    d = d.withColumn("_bspk", F.when(bridge, _speaker(F.col("_p.i")))).withColumn("_aspk", _speaker(F.col("top1_label")))
    d = cut_lineage(d)
    d = _support(d, zones, keys, {"_bspk": "_bsup"}, [(F.col(S) - p["window_ms"], F.col(E) + p["window_ms"])], None, width)
    d = _support(d, rows, keys, {"_aspk": "_asup"}, _beside(p["window_ms"]), tiers.support_weight(F.col("tier")), width)
    score = ((F.col("_aspk") != F.col("old")) & (F.col("top1_score") - F.col("cur") >= p["gain"]) & (F.col("margin") <= p["margin"])
             & (F.col("dur") <= p["score_ms"]) & (F.col("_asup") >= p["support_ms"] * 100))
    reason = F.when(F.col("_bspk").isNotNull() & (F.col("_bsup") >= p["support_ms"]), "bridge").when(score, "score")
    d = d.withColumn("reason", reason).filter("reason IS NOT NULL")
    return d.select(*keys, S, E, "old", F.when(F.col("reason") == "bridge", F.col("_bspk")).otherwise(F.col("_aspk")).alias("new"), "reason", "vec")


def apply_relabels(rows: DataFrame, relabels: DataFrame, keys: Sequence[str], row_id: str, bin_ms: int, width: int) -> DataFrame:
    """Cut the moved stretches out of their old speaker and add them to the new one (rows: row_id, tier, sims)."""
    gone = relabels.select(*keys, F.col("old").alias("speaker"), S, E)
    kept = spans.subtract(rows.select(*keys, row_id, "speaker", S, E, "tier", "sims"), gone, [*keys, "speaker"], [row_id], width)
    moved = relabels.select(*keys, F.lit(-1).cast("long").alias(row_id), F.col("new").alias("speaker"), S, E, F.lit("reseg").alias("tier"), F.col("vec").alias("sims"))
    return kept.select(*moved.columns).unionByName(moved)


def second_opinion_scores(rows: DataFrame, other: DataFrame, anchors: DataFrame, keys: Sequence[str], n: int, width: int, bin_ms: int) -> DataFrame:
    """Speaker-by-speaker matrix between a second diarization and the own labels (rows: seg_id, speaker, span, tier, sims)."""
    keys = list(keys)
    local = rows.select(*keys, F.col("speaker").alias("local")).distinct()
    ask = cut_lineage(other.filter(F.col(E) > F.col(S)).select(*keys, "seg_id", F.col("speaker").alias("other"), S, E))
    named = lambda d: d.withColumnsRenamed({"r_speaker": "local"}).withColumn("v", F.col("ms").cast("double")).drop("ms")
    overlap = named(spans.coactive(ask, anchors, keys, bin_ms, "other", width=width))
    # the score vector of a second-opinion speaker, weighted by the length of the spans, holds the scores of all own labels
    vec = span_score_vectors(ask, rows, keys, ["seg_id"], n, width).select(*keys, "other", (F.col(E) - F.col(S)).alias("d"), F.posexplode("score_vector").alias("i", "x"))
    summed = vec.groupBy(*keys, "other", "i").agg(F.sum(F.col("x") * F.col("d")).alias("x"))
    length = ask.groupBy(*keys, "other").agg(F.sum(F.col(E) - F.col(S)).alias("_d"))
    every = length.join(local.withColumn("i", speakers.speaker_index(F.col("local"))), keys)     # speakers by speakers
    acoustic = (every.join(summed, [*keys, "other", "i"], "left")
                .select(*keys, "other", "local", F.coalesce(F.col("x") / F.col("_d"), F.lit(0.0)).alias("v")))
    around = ask.select(*keys, "other", F.explode(F.array(*[F.struct(a.cast("long").alias(S), b.cast("long").alias(E)) for a, b in _around_edges(SECOND["window_ms"])])).alias("w"))
    neighbour = named(spans.coactive(around.select(*keys, "other", "w.*"), rows, keys, bin_ms, "other", right_weight=tiers.support_weight(F.col("tier")), width=width))
    return speakers.label_scores(overlap, acoustic, neighbour, keys)


def second_opinion_relabel(rows: DataFrame, other: DataFrame, mapping: DataFrame, keys: Sequence[str], n: int, width: int, bin_ms: int) -> DataFrame:
    """Single-speaker atoms where exactly one second-opinion speaker is active, with the decision and its reason.

    `mapping`: keys, other, local. Reasons follow the order of the gates: unmapped, same, short, overlap_context,
    confident, fallback, low_gain, neighbour, accepted.
    """
    p, keys = SECOND, list(keys)
    atoms = cut_lineage(profiled_atoms(rows, keys, n, width))
    zones = cut_lineage(stable_zones(atoms, keys, width))
    overlapped = spans.pair_regions(rows, keys, bin_ms, width).select(*keys, S, E)
    single = atoms.filter("n_speakers = 1").withColumn("cur", _speaker(F.col("idx")))
    # second-opinion speaker at the middle of the atom
    mid = single.select(*keys, S, E, F.floor((F.col(S) + F.col(E)) / 2).cast("long").alias("m"))
    un = spans.speaker_unions(other, keys, width=width)
    at = spans._inside(mid.select(*keys, F.col("m").alias(S), F.col(S).alias("_s"), F.col(E).alias("_e")), un, keys, bin_ms)
    at = at.groupBy(*keys, F.col("_s").alias(S), F.col("_e").alias(E)).agg(F.min("active").alias("other"), F.count(F.lit(1)).alias("_k")).filter("_k = 1").drop("_k")
    d = single.join(at, [*keys, S, E]).join(mapping.select(*keys, "other", F.col("local").alias("target")), [*keys, "other"], "left")
    hub = speakers.hub_penalty(rows, keys).select(*keys, F.col("speaker").alias("target"), "penalty")
    d = cut_lineage(d.join(hub, [*keys, "target"], "left").fillna({"penalty": 0.0}))
    both = {"cur": "_nc", "target": "_nt"}
    d = _support(d, rows, keys, both, _around_edges(p["window_ms"]), tiers.support_weight(F.col("tier")), width)
    d = cut_lineage(_support(d, zones, keys, {"cur": "_zc", "target": "_zt"}, _beside(p["window_ms"]), None, width))
    near = spans.overlap_sum(d.select(*keys, S, E), overlapped, keys, [S, E], "_ov", width=width)
    d = d.join(near.select(*keys, S, E, "_ov"), [*keys, S, E])
    gain = F.coalesce(F.get("vec", speakers.speaker_index(F.col("target"))), F.lit(0.0)) - F.coalesce(F.get("vec", F.col("idx")), F.lit(0.0))
    ngain = (F.col("_nt") - F.col("_nc")) / 100_000.0
    reason = (F.when(F.col("target").isNull(), "unmapped").when(F.col("target") == F.col("cur"), "same")
              .when(F.col(E) - F.col(S) < p["min_ms"], "short").when(F.col("_ov") > 0, "overlap_context")
              .when((F.col("margin") >= p["margin"]) & (F.col("_zc") >= p["stable_ms"]), "confident")
              .when(F.col("fallback_share") >= p["fallback"], "fallback")
              .when(gain < p["gain"] + p["hub_gain"] * F.col("penalty"), "low_gain")
              .when((ngain < p["neighbour_s"] + 0.5 * p["hub_support"] * F.col("penalty")) & (F.col("_zt") < F.col("_zc")), "neighbour")
              .otherwise("accepted"))
    return d.select(*keys, S, E, F.col("cur").alias("old"), F.col("target").alias("new"), reason.alias("reason"), "vec")
