"""A labelled data folder tree as tables: recordings, segments and text of every `data*` item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import fixed
from dialoom.operators import curation, sequence, slabs
from dialoom.sources import segments, transcripts


def scan_folder(spark: SparkSession, root: str, durations: DataFrame, source_type: str, split: str, forced_bucket: str | None = None,
                overlap_mode: bool = False) -> tuple[DataFrame, DataFrame]:
    """(recordings, samples) of `<root>/data*/{mixture.wav, labeled/*}` with `<root>/metadata.txt`.

    `durations` gives (data_name, duration_ms) of the recordings; audio itself is not opened. Recordings without a text are
    left out. Rows are numbered by their line in the file, so ids don't depend on how files are split.
    """
    wav = spark.read.format("binaryFile").load(f"{root}/data*/mixture.wav").select(F.col("path").alias("audio_path"))
    found = wav.withColumn("data_name", F.regexp_extract("audio_path", r"/([^/]+)/[^/]+$", 1)).join(durations, "data_name")
    meta = segments.read_metadata(spark, f"{root}/metadata.txt")
    recs = curation.recordings(found, meta, source_type, split, forced_bucket, overlap_mode).withColumnRenamed("data_name", "recording_id")
    txt = segments.load_text_segments(spark, root)
    recs = recs.join(txt.select("recording_id").distinct(), "recording_id", "left_semi")
    segs = segments.read_rttm(spark, f"{root}/data*/labeled/mixture.rttm").withColumnRenamed("line_no", "seg_id")
    width = slabs.slab_width(segs, ["recording_id"], "start_ms")
    lines = sequence.cut_lineage(txt.withColumnRenamed("line_no", "row_id"))
    chunks = sequence.build_chunks(lines.select("recording_id", "row_id", "start_ms", "end_ms", "speaker", "text"), segs,
                                   ["recording_id"], "row_id", width, width=width)
    smp = curation.samples(sequence.cut_lineage(chunks), recs, segs, ["recording_id"], width)
    ids = curation.base_ids(txt, "recording_id", "base_id") if "base_id" in txt.columns else None
    if ids is not None:
        recs = recs.join(ids, "recording_id", "left")
        smp = smp.join(ids, "recording_id", "left")
    return recs, smp


def scan_segments(spark: SparkSession, root: str, durations: DataFrame, skip_unknown: bool = False) -> DataFrame:
    """Inference samples of a tree that has RTTM files only; hyp*.rttm is preferred per folder."""
    rttm = segments.read_rttm(spark, f"{root}/data*/labeled/*.rttm")
    rttm = rttm.join(segments.preferred_rttm(rttm.select("recording_id", "path").distinct()), ["recording_id", "path"])
    rttm = sequence.cut_lineage(rttm.withColumnRenamed("line_no", "seg_id"))
    recs = durations.withColumnRenamed("data_name", "recording_id")
    return curation.rttm_samples(rttm, recs, ["recording_id"], slabs.slab_width(rttm, ["recording_id"], "start_ms"), skip_unknown)


def scan_all(spark: SparkSession, self_labeled: str, durations: DataFrame, **others: str) -> tuple[DataFrame, DataFrame]:
    """(recordings, samples) of all sources with a `part` column: the splits of the self-labelled root, and any of the roots
    `dubbed`, `vivos` and `robustness`, whose buckets are forced (`vivos` in overlap mode).

    `durations` gives (part, data_name, duration_ms)."""
    jobs = [(f"self_{split}", f"{self_labeled}/{folder}", "self_labeled", split, None) for folder, split in fixed.SELF_LABELED_FOLDERS.items()]
    jobs += [(f"{kind}_train", root, kind, "train", fixed.FORCED_BUCKETS[kind]) for kind, root in others.items() if root]
    recs = smp = None
    for part, root, kind, split, forced in jobs:
        mine = durations.filter(F.col("part") == part).select("data_name", "duration_ms")
        r, s = scan_folder(spark, root, mine, kind, split, forced, kind == fixed.OVERLAP_CLASS)
        r, s = r.withColumn("part", F.lit(part)), s.withColumn("part", F.lit(part))
        recs = r if recs is None else recs.unionByName(r, allowMissingColumns=True)
        smp = s if smp is None else smp.unionByName(s, allowMissingColumns=True)
    return recs, smp
