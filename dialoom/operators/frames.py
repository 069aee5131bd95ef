"""Frame-level activity: smoothing, runs, clean spans, dense windows, energy gate.

A chunk is a fixed stretch of audio (16 s), so windows over (recording, chunk, track) are bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators import spans

TRACK = ["recording_id", "chunk", "track"]
PRIMARY_MIN_MS, AUX_MIN_MS, OUT_MIN_MS = 400, 300, 100


def median_smooth(df: DataFrame, keys: Sequence[str] = TRACK, window: int = 11) -> DataFrame:
    """Running median of `prob`, edges mirrored."""
    half = window // 2
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    f = F.col("frame")
    spots = F.array_compact(F.array(f, F.when(f < half, -1 - f), F.when(f >= F.col("_n") - half, 2 * F.col("_n") - 1 - f)))
    wide = df.withColumn("_n", n).withColumn("_at", F.explode(spots))
    w = Window.partitionBy(*keys).orderBy("_at").rowsBetween(-half, half)
    out = wide.withColumn("smooth", F.get(F.array_sort(F.collect_list("prob").over(w)), F.lit(half)))
    return out.filter(F.col("_at") == f).drop("_n", "_at")


def runs(df: DataFrame, active: Column, keys: Sequence[str] = TRACK, dt_ms: int = 20, min_ms: int = OUT_MIN_MS) -> DataFrame:
    """Maximal runs of active frames, an open run closing at the end: (start_frame, end_frame) half open."""
    w = Window.partitionBy(*keys).orderBy("frame")
    on = df.filter(active).withColumn("_g", F.col("frame") - F.row_number().over(w))
    out = on.groupBy(*keys, "_g").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame")).drop("_g")
    return out.filter((F.col("end_frame") - F.col("start_frame")) * dt_ms >= min_ms)


def clean_spans(df: DataFrame, active: Column, dt_ms: int = 20, min_ms: int = AUX_MIN_MS) -> DataFrame:
    """Per run its longest stretch with no other active track, and the tier that length earns.

    primary from 0.4 s, aux from 0.3 s, else fallback over the whole run. The first of equally long stretches wins.
    """
    keys = TRACK
    live = df.withColumn("_a", active.cast("int"))
    live = live.withColumn("_n", F.sum("_a").over(Window.partitionBy("recording_id", "chunk", "frame")))
    w = Window.partitionBy(*keys).orderBy("frame")
    on = live.filter("_a = 1").withColumn("_g", F.col("frame") - F.row_number().over(w))
    on = on.withColumn("_c", F.when(F.col("_n") == 1, F.col("frame") - F.row_number().over(
        Window.partitionBy(*keys, "_g", F.col("_n") == 1).orderBy("frame"))))
    run = on.groupBy(*keys, "_g").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"))
    cl = on.filter("_n = 1").groupBy(*keys, "_g", "_c").agg(F.min("frame").alias("cs"), (F.max("frame") + 1).alias("ce"))
    best = cl.groupBy(*keys, "_g").agg(F.max_by(F.struct("cs", "ce"), F.struct(F.col("ce") - F.col("cs"), -F.col("cs"))).alias("b"))
    out = run.filter((F.col("end_frame") - F.col("start_frame")) * dt_ms >= min_ms).join(best, [*keys, "_g"], "left")
    clean = F.coalesce((F.col("b.ce") - F.col("b.cs")) * dt_ms, F.lit(0))
    tier = F.when(clean >= PRIMARY_MIN_MS, "primary").when(clean >= AUX_MIN_MS, "aux").otherwise("fallback")
    out = out.withColumns({"clean_ms": clean.cast("long"), "tier": tier})
    whole = F.col("tier") == "fallback"
    return out.select(*keys, "start_frame", "end_frame", "clean_ms", "tier",
                      F.when(whole, F.col("start_frame")).otherwise(F.col("b.cs")).alias("used_start"),
                      F.when(whole, F.col("end_frame")).otherwise(F.col("b.ce")).alias("used_end"))


def anchor_spans(df: DataFrame, active: Column, dt_ms: int = 20) -> DataFrame:
    """Spans fit for anchors: runs without overlap, or whose clean stretch is long enough and 80 % of the run."""
    c = clean_spans(df, active, dt_ms, PRIMARY_MIN_MS)
    dur = (F.col("end_frame") - F.col("start_frame")) * dt_ms
    return c.filter((F.col("clean_ms") >= PRIMARY_MIN_MS) & (F.col("clean_ms") * 100 >= dur * 80))


def densest_windows(df: DataFrame, active: Column, frames: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """Per track the first window of `frames` frames holding most active frames."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(0, frames - 1)
    d = df.withColumns({"_hit": F.sum(active.cast("long")).over(w), "_n": n})
    d = d.filter((F.col("frame") + frames <= F.col("_n")) | (F.col("frame") == 0))
    return d.groupBy(*keys).agg(F.max_by(F.struct("frame", "_hit", "_n"), F.struct(F.col("_hit"), -F.col("frame"))).alias("b")).select(
        *keys, F.col("b.frame").alias("start_frame"), F.least(F.col("b.frame") + frames, F.col("b._n")).alias("end_frame"),
        F.col("b._hit").alias("active_frames"), F.col("b._n").alias("n_frames"))


def fragment_spans(df: DataFrame, active: Column, dt_ms: int = 20, min_total_ms: int = 60, window_ms: int = 400,
                   pad_ms: int = 80, min_ms: int = 240, max_ms: int = 800) -> DataFrame:
    """Fallback span of a fragmented track: densest window, padded, widened to the minimum and cut to the maximum.

    `reason` is ok, no_active or too_sparse; spans are null unless ok.
    """
    frames = lambda ms: max(1, round(ms / dt_ms))
    d = densest_windows(df, active, frames(window_ms))
    d = d.join(df.groupBy(*TRACK).agg(F.count_if(active).alias("total_active")), TRACK)
    n, least = F.col("n_frames"), frames(min_ms)
    most = max(least, frames(max_ms))

    def placed(start: Column, width: Column) -> tuple[Column, Column]:
        """An interval of a width moved to lie inside the track, or the whole track if that is shorter."""
        s = F.greatest(F.least(start, n - width), F.lit(0))
        return s, F.least(s + width, n)

    s, e = F.greatest(F.lit(0), F.col("start_frame") - frames(pad_ms)), F.least(n, F.col("end_frame") + frames(pad_ms))
    grown = placed(s - F.floor((least - (e - s)) / 2), F.lit(least))
    s, e = F.when(e - s < least, grown[0]).otherwise(s), F.when(e - s < least, grown[1]).otherwise(e)
    cut = placed(F.bround((s + e) / 2).cast("long") - most // 2, F.lit(most))
    long_ = e - s > most
    reason = F.when(F.col("total_active") == 0, "no_active").when(F.col("total_active") * dt_ms < min_total_ms, "too_sparse").otherwise("ok")
    good = reason == "ok"
    return d.select(*TRACK, "total_active", "active_frames", reason.alias("reason"),
                    F.when(good, F.when(long_, cut[0]).otherwise(s)).cast("long").alias("start_frame"),
                    F.when(good, F.when(long_, cut[1]).otherwise(e)).cast("long").alias("end_frame"))


def raw_hypothesis(run_spans: DataFrame, labels: DataFrame, profile: DataFrame, offset_ms: Column, dt_ms: int = 20) -> DataFrame:
    """Active runs with their speaker and score profile; tracks without a profile count as propagated with score 0."""
    d = run_spans.join(labels, TRACK).join(profile, TRACK, "left")
    return d.select(*TRACK, F.concat(F.lit("SPK_"), F.col("label").cast("string")).alias("speaker"),
                    (offset_ms + F.col("start_frame") * dt_ms).cast("long").alias("start_ms"),
                    (offset_ms + F.col("end_frame") * dt_ms).cast("long").alias("end_ms"),
                    F.coalesce("dominant_tier", F.lit("propagated")).alias("tier"),
                    *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("best_sim", "top1_score", "top2_score", "fallback_vote_ratio")])


# ---- energy gate ------------------------------------------------------------------------------------------------------

def frame_energy(blocks: DataFrame, keys: Sequence[str], frame: int, hop: int, samples: str = "samples") -> DataFrame:
    """RMS per frame of blocks of PCM samples (a block holds whole hops plus the tail its last frame needs)."""
    n = F.size(samples)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - frame), F.lit(hop))
    rms = F.transform(starts, lambda s: F.sqrt(F.aggregate(F.slice(samples, s + 1, F.lit(frame)), F.lit(0.0), lambda a, x: a + x * x) / F.least(F.lit(frame), n - s)))
    return blocks.select(*keys, "block", F.posexplode(rms).alias("i", "rms"))


def speech_mask(energy: DataFrame, keys: Sequence[str], threshold: float = 0.0025, smooth: int = 15, slab_frames: int = 65_536) -> DataFrame:
    """0/1 speech per frame: RMS over the recording's RMS against a threshold, then a running majority.

    `energy` has (keys, frame, rms) with frames from 0. The majority of `smooth` frames equals their median; frames
    beyond the ends mirror the edge. Neighbouring slabs share the few frames the window reaches over.
    """
    keys = list(keys)
    tot = energy.groupBy(*keys).agg((F.sqrt(F.avg(F.col("rms") * F.col("rms"))) + 1e-8).alias("_g"), F.max("frame").alias("_last"))
    d = energy.join(tot, keys).withColumn("_on", (F.col("rms") / F.col("_g") >= threshold).cast("long"))
    half, f, last = smooth // 2, F.col("frame"), F.col("_last")
    spots = F.array_compact(F.array(f, F.when(f < half, -1 - f), F.when(f > last - half, 2 * last + 1 - f)))
    d = d.withColumn("_at", F.explode(spots)).withColumn("_home", F.explode(F.array_distinct(F.array(
        F.floor((F.col("_at") - half) / slab_frames), F.floor(F.col("_at") / slab_frames), F.floor((F.col("_at") + half) / slab_frames)))))
    w = Window.partitionBy(*keys, "_home").orderBy("_at").rowsBetween(-half, half)
    d = d.withColumn("speech", (F.sum("_on").over(w) >= half + 1).cast("long"))
    return d.filter((F.col("_at") == f) & (F.floor(f / slab_frames) == F.col("_home"))).select(*keys, "frame", "speech")


# fixed values: needed speech share, the same for fallback rows, and the score that protects a row
MIN_SPEECH, MIN_SPEECH_FALLBACK, PROTECTED_SCORE = 0.15, 0.08, 0.45


def silence_gate(rows: DataFrame, mask: DataFrame, keys: Sequence[str], row_id: Sequence[str], hop_ms: int = 10, width: int | None = None) -> DataFrame:
    """Rows with their `speech_ratio` and `keep`: enough speech frames under them, or a protected score.

    The share is a difference of running totals over the speech frames, so long rows cost as much as short ones.
    """
    keys = list(keys)
    n = mask.groupBy(*keys).agg((F.max("frame") + 1).alias("_n"))
    d = rows.join(n, keys)
    first = F.least(F.floor(F.col("start_ms") / hop_ms), F.col("_n") - 1)
    d = d.withColumn("_s", F.greatest(F.lit(0), first).cast("long"))
    d = d.withColumn("_e", F.greatest(F.col("_s") + 1, F.least(F.floor(F.col("end_ms") / hop_ms), F.col("_n"))).cast("long"))
    on = mask.filter("speech = 1").select(*keys, (F.col("frame") * hop_ms).cast("long").alias("start_ms"), ((F.col("frame") + 1) * hop_ms).cast("long").alias("end_ms"))
    d = spans.overlap_sum(d, on, keys, row_id, "_on", windows=[(F.col("_s") * hop_ms, F.col("_e") * hop_ms)], width=width)
    need = F.when(F.col("tier") == "fallback", MIN_SPEECH_FALLBACK).otherwise(MIN_SPEECH)
    d = d.withColumn("speech_ratio", F.col("_on") / ((F.col("_e") - F.col("_s")) * hop_ms))
    return d.withColumn("keep", (F.col("top1_score") >= PROTECTED_SCORE) | (F.col("speech_ratio") >= need)).drop("_n", "_s", "_e", "_on")
