"""Media folders: upload checks, speaker-sample discovery, table profiles and stage timings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import slabs

# fixed values
AUDIO_EXTENSIONS = ["wav", "mp3", "flac", "m4a", "mp4", "aac", "ogg", "opus", "webm", "mov", "mkv", "wma", "aiff", "aif", "amr", "3gp",
                    "mpeg", "mpg"]
MAX_BYTES = 75 * 1024 * 1024


def media_catalogue(files: DataFrame) -> DataFrame:
    """(path, length) with extension and reject reason: extension, too_large, empty or null for accepted files."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("extension", ext).withColumn(
        "reject_reason", F.when(~F.col("extension").isin(AUDIO_EXTENSIONS), "extension").when(F.col("length") > MAX_BYTES, "too_large")
        .when(F.col("length") <= 0, "empty"))


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes only; contents are never read."""
    return media_catalogue(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length"))


def speaker_groups(files: DataFrame, root: str) -> DataFrame:
    """Sample files by speaker: sub-folders are speakers where any exist, else every root file is one."""
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    d = media_catalogue(files).filter(F.col("extension").isin(AUDIO_EXTENSIONS)).withColumn("_rel", rel)
    d = d.withColumn("_folder", F.regexp_extract("_rel", r"^([^/]+)/[^/]+$", 1)).filter(~F.col("_rel").rlike("/.*/"))
    nested = d.agg(F.max(F.col("_folder") != "").alias("_nested"))
    d = d.join(F.broadcast(nested), F.lit(True))  # one row
    stem = F.regexp_extract("_rel", r"^(.+)\.[^.]+$", 1)
    return (d.filter((F.col("_folder") != "") == F.col("_nested"))
            .select(F.when(F.col("_nested"), F.col("_folder")).otherwise(stem).alias("speaker"), "path"))


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def stage_times(log: DataFrame, run: str, ts: str, stage: str) -> DataFrame:
    """Seconds between a run's consecutive artifacts (looked up across day slabs, so a long log is no single task)."""
    d = log.withColumn(slabs.SLAB, F.floor(F.unix_micros(F.col(ts)) / 86_400_000_000).cast("long"))
    d = slabs.neighbour(d, [run], [ts, stage], -1, {"_prev": F.unix_micros(F.col(ts))}).drop(slabs.SLAB)
    return d.withColumn("seconds", F.round((F.unix_micros(F.col(ts)) - F.col("_prev")) / 1e6, 3)).filter(F.col("seconds").isNotNull()).drop("_prev")


def timing_summary(df: DataFrame, by: Sequence[str], seconds: Column, retried: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"),
                               F.min(seconds).alias("fastest"), F.max(seconds).alias("slowest"), F.count_if(retried).alias("retried"),
                               (F.count_if(retried) / F.count(F.lit(1))).alias("retry_rate"))
