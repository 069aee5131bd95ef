"""Training manifests: samples from chunks, buckets, overlap limits, target hours, stage assembly, scan summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import fixed, spans as fs, text
from dialoom.operators import dedup, slabs, spans

S, E = "start_ms", "end_ms"


@dataclass(frozen=True)
class Stage:
    name: str
    max_overlap: float
    ratios: dict[str, float] = field(default_factory=dict)


STAGE1 = Stage("stage1", 0.18, {"vivos": 0.10})
STAGE2 = Stage("stage2", 0.30, {"vivos": 0.05})
VALIDATION_FLOOR = 0.35


def bucket(class_name: Column, source_type: Column, forced: Column | None = None) -> Column:
    """A forced bucket, else the source's own, else the class table with silver_real as default."""
    own = F.when(source_type == "dubbed", "silver_dubbed").when(source_type == "robustness", "robustness").otherwise(
        text.lookup(class_name, fixed.CLASS_BUCKETS, "silver_real"))
    return own if forced is None else F.coalesce(forced, own)


def recordings(found: DataFrame, metadata: DataFrame, source_type: str, split: str, forced_bucket: str | None = None,
               overlap_mode: bool = False) -> DataFrame:
    """Recordings (data_name, audio_path, duration_ms) with class, bucket and id; the class defaults to the data name.

    In overlap mode the metadata's class only names the group: class and (unless forced) bucket are those of re-used
    read speech."""
    d = found.join(metadata, "data_name", "left")
    group = text.slug(F.coalesce("class_name", "data_name"))
    d = d.withColumns({"group_name": group, "class_name": F.lit(fixed.OVERLAP_CLASS) if overlap_mode else group,
                       "episode_index": F.coalesce("episode_index", F.lit("")), "source_type": F.lit(source_type), "split_name": F.lit(split)})
    forced = forced_bucket or (fixed.OVERLAP_CLASS if overlap_mode else None)
    return d.withColumns({
        "bucket": bucket(F.col("class_name"), F.col("source_type"), None if forced is None else F.lit(forced)),
        "parent_audio_id": text.stable_id(F.col("source_type"), F.col("split_name"), F.col("data_name"), F.col("audio_path"))})


def base_ids(rows: DataFrame, key: str, base_id: str) -> DataFrame:
    """Sorted distinct base utterance ids per recording."""
    return rows.filter(F.col(base_id).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(base_id)).alias("base_utt_ids"))


def samples(chunks: DataFrame, recs: DataFrame, segs: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Padded and clamped chunks with their overlap ratio and id; `recs` brings duration_ms and the recording columns."""
    keys = list(keys)
    d = chunks.join(recs, keys)
    a, b = fs.pad(F.col(S), F.col(E), F.col("duration_ms"), fixed.PAD_LEFT_MS, fixed.PAD_RIGHT_MS)
    d = d.withColumns({S: a, E: b}).filter(F.col(E) > F.col(S))
    d = d.withColumn("sample_id", text.stable_id(F.col("parent_audio_id"), text.centiseconds(F.col(S)), text.centiseconds(F.col(E)), text.squeeze(F.col("text"))))
    busy = spans.busy_regions(segs, keys, width=width)
    d = spans.overlap_sum(d, busy, keys, ["sample_id"], "_ov", width=width)
    return d.withColumn("overlap_ratio", F.col("_ov") / F.greatest(F.col(E) - F.col(S), F.lit(1))).drop("_ov")


def choose_to_hours(recs: DataFrame, id_col: str, hours: Column, target: float, seed: int, group: Sequence[str] = ()) -> DataFrame:
    """Recordings in seeded hash order until the target is reached, the crossing one included.

    The running total goes over slabs of the hash space, so no single task orders all recordings.
    """
    d = recs.withColumns({"_h": F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), "_hours": hours, "_all": F.lit(0)})
    d = d.withColumn(slabs.SLAB, F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"))
    keys = list(group) or ["_all"]
    d = slabs.running_sums(d, keys, ["_h", id_col], {"_acc": F.col("_hours")}, inclusive=False)
    return d.filter(F.col("_acc") < target).drop("_h", "_hours", "_all", slabs.SLAB, "_acc")


def overlap_filter(df: DataFrame, stage: Stage, validation: bool = False) -> DataFrame:
    top = max(VALIDATION_FLOOR, stage.max_overlap) if validation else stage.max_overlap
    return df.filter(F.col("overlap_ratio") <= top)


def stage_manifest(all_samples: DataFrame, all_recs: DataFrame, stage: Stage, seed: int, row_id: str = "sample_id") -> DataFrame:
    """Train and validation rows of a stage (`split` column): chosen recordings, overlap limits, duplicates, reuse quota.

    Both tables carry source_type and split_name; hours come from duration_ms.
    """
    train = all_recs.filter("split_name = 'train'")
    base_kinds = ["self_labeled", "dubbed"] + (["robustness"] if stage.name == "stage2" else [])
    base = train.filter(F.col("source_type").isin(base_kinds))
    chosen = base.select("parent_audio_id")
    hours = F.col("duration_ms") / 3_600_000.0
    for kind, ratio in stage.ratios.items():
        total = base.agg(F.sum(hours)).first()[0] or 0.0
        extra = choose_to_hours(train.filter(F.col("source_type") == kind), "parent_audio_id", hours, total * ratio, seed + 13)
        chosen = chosen.unionByName(extra.select("parent_audio_id"))
    rows = overlap_filter(all_samples.filter("split_name = 'train'").join(chosen.distinct(), "parent_audio_id", "left_semi"), stage)
    val = overlap_filter(all_samples.filter("split_name = 'val'"), stage, validation=True)
    both = rows.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    kept = dedup.same_text_duplicates(both, ["split", "parent_audio_id"], row_id, "text")
    kept = dedup.keep_first(kept, ["split", "audio_path", S, E, text.squeeze(F.col("text"))], [row_id])
    pooled = kept.filter((F.col("source_type") == "vivos") & (F.col("split") == "train"))
    if "base_utt_ids" in kept.columns:
        rank = F.struct("parent_audio_id", S, E, row_id)
        pooled = dedup.reuse_quota(pooled.withColumn("_seq", rank), "base_utt_ids", "_seq").drop("_seq")
    rest = kept.filter((F.col("source_type") != "vivos") | (F.col("split") != "train"))
    return rest.unionByName(pooled).withColumn("stage", F.lit(stage.name))


def scan_summary(recs: DataFrame, smp: DataFrame, by: Sequence[str]) -> DataFrame:
    r = recs.groupBy(*by).agg(F.count(F.lit(1)).alias("parents"), F.round(F.sum("duration_ms") / 3_600_000.0, 3).alias("hours"))
    s = smp.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"))
    return r.join(s, list(by), "left").fillna({"samples": 0})


def rttm_samples(segs: DataFrame, recs: DataFrame, keys: Sequence[str], width: int, skip_unknown: bool = False) -> DataFrame:
    """Inference rows straight from segments: long ones split, short and (optionally) unknown ones dropped, padded."""
    keys = list(keys)
    parts = spans.split_long(segs, fixed.HARD_MAX_MS).select(*keys, "seg_id", "part", "speaker", F.col("part_start_ms").alias(S), F.col("part_end_ms").alias(E))
    busy = spans.busy_regions(parts, keys, width=width)
    d = parts.filter(F.col(E) - F.col(S) >= fixed.MIN_SEGMENT_MS)
    if skip_unknown:
        d = d.filter(~F.startswith("speaker", F.lit("unknown")))
    d = d.join(recs, keys).withColumns({"rttm_start": F.col(S) / 1000, "rttm_end": F.col(E) / 1000})
    a, b = fs.pad(F.col(S), F.col(E), F.col("duration_ms"), fixed.PAD_LEFT_MS, fixed.PAD_RIGHT_MS)
    d = d.withColumns({S: a, E: b}).filter(F.col(E) > F.col(S))
    d = spans.overlap_sum(d, busy, keys, ["seg_id", "part"], "_ov", width=width)
    return d.withColumn("overlap_ratio", F.round(F.col("_ov") / (F.col(E) - F.col(S)), 4)).drop("_ov")
