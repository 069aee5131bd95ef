"""Evaluation: segment matching, label mapping, diarization error, overlap identity, word error."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import text
from dialoom.operators import assignment, spans
from dialoom.operators.best_overlap import best_overlaps
from dialoom.operators.spans import E, S
from dialoom.session import cut_lineage

FRAME_MS = 10


def best_match(hyp: DataFrame, ref: DataFrame, keys: Sequence[str], width: int | None = None, min_ms: int = 500) -> DataFrame:
    """Each hypothesis row with its most-overlapping reference row (smallest id on ties), null up to the minimum."""
    best = best_overlaps(hyp, ref, keys, "seg_id", width, min_ms + 1)
    return hyp.join(best, [*keys, "seg_id"], "left").select(hyp["*"], "ref_id", "overlap_ms")


def majority_labels(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Most frequent `right` label per `left` label, the smallest name on ties."""
    n = pairs.groupBy(*keys, left, right).count()
    return n.groupBy(*keys, left).agg(F.min_by(F.struct(right, F.col("count").alias("votes")),
                                               F.struct(-F.col("count"), F.col(right))).alias("b")).select(*keys, left, "b.*")


def snapped(df: DataFrame, keys: Sequence[str], frame_ms: int = FRAME_MS, width: int | None = None) -> DataFrame:
    """Per-speaker masks on the frame grid, as unions of spans (starts floored, ends ceiled)."""
    g = df.withColumns({S: (F.floor(F.col(S) / frame_ms) * frame_ms).cast("long"),
                        E: (F.ceil(F.col(E) / frame_ms) * frame_ms).cast("long")})
    return spans.speaker_unions(g, keys, width=width)


def overlap_matrix(hyp_masks: DataFrame, ref_masks: DataFrame, keys: Sequence[str], bin_ms: int) -> DataFrame:
    """Shared time per (hypothesis speaker, reference speaker); masks are disjoint per speaker."""
    j = spans.overlap_join(hyp_masks, ref_masks, keys, bin_ms)
    return j.groupBy(*keys, "speaker", F.col("r_speaker").alias("ref_speaker")).agg(F.sum("overlap_ms").alias("overlap_ms"))


def label_map(hyp_masks: DataFrame, ref_masks: DataFrame, keys: Sequence[str], bin_ms: int) -> DataFrame:
    """Reference label with the largest overlap per hypothesis label; lowest label on ties and without any overlap."""
    m = overlap_matrix(hyp_masks, ref_masks, keys, bin_ms)
    best = m.groupBy(*keys, "speaker").agg(F.min_by(F.struct("ref_speaker", "overlap_ms"),
                                                    F.struct(-F.col("overlap_ms"), F.col("ref_speaker"))).alias("b"))
    lowest = ref_masks.groupBy(*keys).agg(F.min("speaker").alias("_low"))
    names = hyp_masks.select(*keys, "speaker").distinct()
    return (names.join(best, [*keys, "speaker"], "left").join(lowest, list(keys), "left")
            .select(*keys, "speaker", F.coalesce("b.ref_speaker", "_low", "speaker").alias("ref_speaker"),
                    F.coalesce("b.overlap_ms", F.lit(0).cast("long")).alias("overlap_ms")))


def _counted(parts: dict[str, DataFrame], keys: Sequence[str], width: int) -> DataFrame:
    """Step function of how many spans of each named table are active, over all their boundaries."""
    u = None
    for n, d in parts.items():
        d = d.filter(F.col(E) > F.col(S)).select(*keys, S, E, F.lit(n).alias("_src"))
        u = d if u is None else u.unionByName(d)
    one = lambda n: F.when(F.col("_src") == n, F.lit(1)).otherwise(F.lit(0)).cast("long")
    st = spans.depth_steps(u, keys, {n: one(n) for n in parts}, width)
    return st.filter(F.col("next_ms").isNotNull()).withColumn("dur", F.col("next_ms") - F.col("t"))


def overlap_identity(ref: DataFrame, hyp: DataFrame, keys: Sequence[str], bin_ms: int, width: int,
                     frame_ms: int = FRAME_MS) -> DataFrame:
    """Overlap detection and identity on the frame grid, one row per key, in milliseconds.

    No speaker sets are built: with r reference, h hypothesis and i common speakers active at an instant, the sets are
    equal iff r = h = i, and i is the depth of the spans where both sides have the same speaker.
    """
    r = cut_lineage(snapped(ref, keys, frame_ms, width))
    h0 = cut_lineage(snapped(hyp, keys, frame_ms, width))
    m = label_map(h0, r, keys, bin_ms).select(*keys, "speaker", "ref_speaker")
    h = h0.join(m, [*keys, "speaker"]).drop("speaker").withColumnRenamed("ref_speaker", "speaker")
    h = cut_lineage(spans.speaker_unions(h, keys, width=width))
    both = _counted({"r": r, "h": h}, [*keys, "speaker"], width).filter("r > 0 AND h > 0")
    both = both.select(*keys, F.col("t").alias(S), F.col("next_ms").alias(E))
    st = _counted({"r": r, "h": h, "i": both}, keys, width)
    tot = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("dur"))), F.lit(0).cast("long")).alias(name)
    R, H, I = F.col("r"), F.col("h"), F.col("i")
    return st.groupBy(*keys).agg(
        tot(R >= 2, "ref_overlap_ms"), tot(H >= 2, "hyp_overlap_ms"), tot((R >= 2) & (H >= 2), "tp_ms"),
        tot((R < 2) & (H >= 2), "fp_ms"), tot((R >= 2) & (H < 2), "fn_ms"),
        tot(R == 2, "exact2_ms"), tot((R == 2) & (I >= 2), "both_correct_any_ms"),
        tot((R == 2) & (H == 2) & (I == 2), "both_correct_exact_ms"), tot((R == 2) & (I == 1), "one_correct_ms"),
        tot((R == 2) & (I == 0), "zero_correct_ms"), tot((R == 2) & (H >= 2), "detected_ms"),
        tot((R == 2) & (H < 2), "collapsed_ms"), tot((R == 1) & (H >= 2), "fp_on_single_ms"),
        tot((R == 1) & (H >= 2) & (I >= 1), "kept_true_plus_extra_ms"), tot((R == 1) & (H >= 2) & (I == 0), "both_wrong_ms"))


def precision_recall(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp_ms"), F.col("fp_ms"), F.col("fn_ms")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return df.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def diarization_error(ref: DataFrame, hyp: DataFrame, keys: Sequence[str], width: int, bin_ms: int = 300_000) -> DataFrame:
    """Missed, false-alarm and confused time per key (no collar, overlap scored, optimal one-to-one label mapping).

    Shared time per label pair meets only labels that are active together; the per-instant counts are running totals.
    """
    keys = list(keys)
    ref, hyp = ref.filter(F.col(E) > F.col(S)), hyp.filter(F.col(E) > F.col(S))
    cells = (spans.coactive(hyp, ref, keys, bin_ms, width=width)
             .select(*keys, "speaker", F.col("r_speaker").alias("ref_speaker"), F.col("ms").cast("double").alias("ms")))
    pairs = assignment.best_pairs(cells, keys, "speaker", "ref_speaker", "ms").filter("ms > 0").drop("ms")
    mapped = cut_lineage(hyp.join(pairs, [*keys, "speaker"]).select(*keys, F.col("ref_speaker").alias("speaker"), S, E))
    same = _counted({"r": ref, "h": mapped}, [*keys, "speaker"], width)
    right = same.groupBy(*keys).agg(F.sum(F.least("r", "h") * F.col("dur")).alias("correct_ms"))
    st = _counted({"r": ref, "h": hyp}, keys, width)
    R, H, D = F.col("r"), F.col("h"), F.col("dur")
    tot = st.groupBy(*keys).agg(F.sum(R * D).alias("total_ms"), F.sum(F.greatest(F.lit(0), R - H) * D).alias("missed_ms"),
                                F.sum(F.greatest(F.lit(0), H - R) * D).alias("false_alarm_ms"), F.sum(F.least(R, H) * D).alias("_both"))
    out = tot.join(right, keys, "left").withColumn("confusion_ms", F.col("_both") - F.coalesce("correct_ms", F.lit(0)))
    return out.select(*keys, "total_ms", "missed_ms", "false_alarm_ms", "confusion_ms",
                      ((F.col("missed_ms") + F.col("false_alarm_ms") + F.col("confusion_ms"))
                       / F.greatest(F.col("total_ms"), F.lit(1))).alias("der"))


# ---- word error -------------------------------------------------------------------------------------------------------

EDITS = T.StructType([T.StructField(n, T.LongType()) for n in ("edits", "substitutions", "deletions", "insertions", "ref_words")])


def word_edits(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int, int]:
    """Edit counts of a best word alignment (fewest insertions among the best), row by row in numpy.

    A cell holds its edits and, apart, the insertions used; cells are compared by edits, then insertions. Along a row both
    grow by one per word to the right, so a running minimum of (cell - position) carries insertions.
    """
    n, m = len(ref), len(hyp)
    ids = {w: i for i, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    h = np.array([ids[w] for w in hyp], dtype=np.int64)
    at = np.arange(m + 1, dtype=np.int64)
    edits, ins = at.copy(), at.copy()
    for w in ref:
        e, s = edits + 1, ins.copy()                       # leave out the reference word
        e2, s2 = edits[:-1] + (h != ids[w]), ins[:-1]      # or put the hypothesis word in its place
        better = (e2 < e[1:]) | ((e2 == e[1:]) & (s2 < s[1:]))
        e[1:][better], s[1:][better] = e2[better], s2[better]
        low = np.minimum.accumulate(e - at)
        # Of equal edits the fewest insertions win; a new minimum of the edits starts anew.
        run = np.cumsum(np.concatenate(([0], low[1:] < low[:-1])))
        offset = np.where(e - at == low, s - at, m + n + 1)
        span = 2 * (m + n + 2)
        ins = np.minimum.accumulate(offset - run * span) + run * span + at
        edits = low + at
    best, used = int(edits[m]), int(ins[m])
    dele = used + n - m
    return best, best - used - dele, dele, used, n


@F.pandas_udf(EDITS)
def word_edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([word_edits((a or "").split(), (b or "").split()) for a, b in zip(ref, hyp)],
                        columns=[f.name for f in EDITS])


def with_wer(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Edit counts and word error rate; an empty reference gives 0 or 1 by whether the hypothesis is empty."""
    d = df.withColumn("_e", word_edit_counts(text.wer_normalize(F.col(ref)), text.wer_normalize(F.col(hyp)))).select("*", "_e.*").drop("_e")
    wer = F.when(F.col("ref_words") > 0, F.col("edits") / F.greatest(F.col("ref_words"), F.lit(1))).otherwise(
        F.when(F.col("insertions") > 0, 1.0).otherwise(0.0))
    return d.withColumn("wer", wer)


def wer_report(df: DataFrame, by: Sequence[str], matched: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(matched).alias("matched"), F.avg("wer").alias("mean_wer"),
        (F.sum("edits") / F.greatest(F.sum("ref_words"), F.lit(1))).alias("corpus_wer"),
        F.sum("substitutions").alias("substitutions"), F.sum("deletions").alias("deletions"), F.sum("insertions").alias("insertions"))


def mapping_health(mapped: DataFrame, keys: Sequence[str], min_speakers: int = 2, min_score: float = 0.38,
                   noise_coverage: float = 0.50) -> DataFrame:
    """Coverage, unique targets and mean score of a label mapping (columns other, local, score; null local = unmapped)."""
    hit = F.col("local").isNotNull()
    g = mapped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("mapped"), F.countDistinct("local").alias("unique_local"),
        F.coalesce(F.avg(F.when(hit, F.col("score"))), F.lit(0.0)).alias("avg_score"))
    cov = F.col("mapped") / F.greatest(F.col("total"), F.lit(1))
    floor = F.least(F.lit(min_speakers), F.greatest(F.col("total"), F.lit(1)))
    return g.withColumns({"coverage": cov, "noisy": cov < noise_coverage,
                          "healthy": (F.col("mapped") >= floor) & (F.col("unique_local") >= floor) & (F.col("avg_score") >= min_score)})
