"""Job, transcript and summary tables: owner lists, upserts, cascades, retention, renames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators import slabs

RETENTION_DAYS, MEDIA_DAYS = 3, 30  # fixed values


def owner_jobs(jobs: DataFrame, user: Column, deleted: bool = False) -> DataFrame:
    """Jobs of a user, newest first; the trash holds the soft-deleted ones by deletion time."""
    d = jobs.filter(F.col("user_id") == user).filter(F.coalesce("is_deleted", F.lit(False)) == F.lit(deleted))
    return d.orderBy(F.desc("deleted_at" if deleted else "created_at"), F.desc("job_id"))


def user_list(jobs: DataFrame, user: str, at: str, job: str) -> DataFrame:
    """All users' lists at once: `rank` (from 1) of each job in its user's list, newest first, by slabs of time."""
    d = jobs.withColumn("_at", -F.unix_micros(at))
    d = d.withColumn("_back", -F.col(job))
    width = slabs.slab_width(d, [user], "_at", coarse=30 * 86_400_000_000)
    d = slabs.with_slab(d, "_at", width)
    return slabs.running_sums(d, [user], ["_at", "_back"], {"rank": F.lit(1).cast("long")}).drop("_at", "_back", slabs.SLAB)


def job_transcripts(lines: DataFrame, jobs: DataFrame, user: Column, job: Column) -> DataFrame:
    """Lines of a job its owner may see, in time order, times rounded to two places."""
    own = jobs.filter((F.col("user_id") == user) & (F.col("job_id") == job)).select("job_id")
    return (lines.join(own, "job_id", "left_semi").orderBy("start_ms", "end_ms", "line_id")
            .select("job_id", "line_id", "speaker", "text", F.round(F.col("start_ms") / 1000, 2).alias("start"), F.round(F.col("end_ms") / 1000, 2).alias("end")))


def job_summaries(jobs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every job with its one summary, `pending` where none is there yet."""
    return jobs.join(summaries, "job_id", "left").withColumn("summary_status", F.when(F.col("meeting_overview").isNull(), "pending").otherwise("ready"))


def rename_speaker(lines: DataFrame, job: Column, old: Column, new: Column) -> DataFrame:
    return lines.withColumn("speaker", F.when((F.col("job_id") == job) & (F.col("speaker") == old), new).otherwise(F.col("speaker")))


def upsert_latest(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the one with the highest version, changes before current rows on ties."""
    u = current.withColumn("_c", F.lit(0)).unionByName(changes.withColumn("_c", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[c for c in u.columns if c not in {*keys, "_c"}])
    return u.groupBy(*keys).agg(F.max_by(row, F.struct(version, "_c")).alias("_r")).select(*keys, "_r.*")


def cascade_delete(gone: DataFrame, key: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the rows of deleted parents."""
    return {n: t.join(gone.select(key).distinct(), key, "left_anti") for n, t in tables.items()}


def expired_jobs(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return jobs.filter(F.col("is_deleted") & (F.col("deleted_at") < now - F.expr(f"INTERVAL {days} DAYS")))


def expired_media(jobs: DataFrame, now: Column, days: int = MEDIA_DAYS) -> DataFrame:
    """Jobs whose media (not rows) are due for removal."""
    return jobs.filter(F.col("file_path").isNotNull() & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")))


def retention(jobs: DataFrame, now: Column, children: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    gone = expired_jobs(jobs, now)
    return cascade_delete(gone, "job_id", {"jobs": jobs, **children})


def apply_flags(events: DataFrame, key: str) -> DataFrame:
    """Soft delete and restore as state flips: the last event of a key decides."""
    last = F.max_by(F.struct("action", "ts"), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(last.alias("l")).select(key, (F.col("l.action") == "delete").alias("is_deleted"),
                                                           F.when(F.col("l.action") == "delete", F.col("l.ts")).alias("deleted_at"))


def asr_to_transcripts(asr: DataFrame, job_id: Column) -> DataFrame:
    """ASR rows as transcript rows of a job. The line id is a digest of the row and its occurrence number among equal rows,
    so a repeated read gives the same ids and equal rows stay apart. Equal rows are counted before the shuffle."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    what = ["start", "end", "speaker", "predicted_text"]
    n = asr.select(job_id.alias("job_id"), *what).groupBy("job_id", *what).agg(F.count(F.lit(1)).alias("_n"))
    d = n.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    first = F.xxhash64("job_id", *what)
    return d.select("job_id", F.when(F.col("_k") == 1, first).otherwise(F.xxhash64("job_id", *what, "_k")).alias("line_id"), ms("start").alias("start_ms"),
                    ms("end").alias("end_ms"), "speaker", F.coalesce("predicted_text", F.lit("")).alias("text"))
