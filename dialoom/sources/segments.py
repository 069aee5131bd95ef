"""Segment files: RTTM, STM and speech labels, in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.sources.transcripts import read_lines, recording_of, read_transcript_jsonl

S, E = "start_ms", "end_ms"


def _fields(value: Column) -> Column:
    return F.split(F.trim(value), r"\s+")


def _ms(c: Column) -> Column:
    return F.round(c.try_cast("double") * 1000).cast("long")


def parse_rttm(lines: DataFrame, value: str = "value") -> DataFrame:
    """SPEAKER lines of at least eight fields; end is start plus duration. Adds recording (`uri`), speaker and span."""
    d = lines.withColumn("_f", _fields(F.col(value))).filter((F.size("_f") >= 8) & (F.get("_f", F.lit(0)) == "SPEAKER"))
    f = lambda i: F.get("_f", F.lit(i))
    d = d.withColumns({"uri": f(1), "speaker": f(7), S: _ms(f(3)), "_d": _ms(f(4))})
    return d.withColumn(E, F.col(S) + F.col("_d")).drop("_f", "_d", value)


def rttm_line(recording: Column, start: Column, end: Column, speaker: Column) -> Column:
    sec = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000), F.pmod(ms, F.lit(1000)))
    return F.concat_ws(" ", F.lit("SPEAKER"), recording, F.lit("1"), sec(start), sec(end - start), F.lit("<NA>"), F.lit("<NA>"),
                       speaker, F.lit("<NA>"), F.lit("<NA>"))


def read_rttm(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    d = parse_rttm(read_lines(spark, path))
    return d.select("path", recording_of(F.col("path")).alias("recording_id"), "uri", "speaker", S, E, "line_no")


def write_rttm(df: DataFrame, path: str, recording: str = "recording_id", buckets: int = 256) -> None:
    """Recordings in a fixed number of folders (each line names its recording); a recording's lines are ordered in each file."""
    out = df.select(F.pmod(F.crc32(F.col(recording).cast("binary")), F.lit(buckets)).alias("bucket"), F.col(recording).alias("recording"), F.col(S), F.col(E), rttm_line(F.col(recording), F.col(S), F.col(E), F.col("speaker")).alias("value"))
    # start time takes part in the partitioning, so one long recording spreads over several files
    out = out.repartitionByRange("bucket", "recording", S).sortWithinPartitions("bucket", "recording", S, E)
    out.select("bucket", "value").write.mode("overwrite").partitionBy("bucket").text(path)


def parse_stm(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fields from the seventh on are the text; blank text and empty spans are dropped."""
    d = lines.withColumn("_f", _fields(F.col(value))).filter(F.size("_f") >= 7)
    f = lambda i: F.get("_f", F.lit(i))
    d = d.withColumns({"speaker": f(2), S: _ms(f(3)), E: _ms(f(4)), "text": text.squeeze(F.array_join(F.slice("_f", F.lit(7), F.size("_f")), " "))})
    return d.filter((F.col("text") != "") & (F.col(E) > F.col(S))).drop("_f", value)


def read_stm(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_stm(read_lines(spark, path)).select("path", recording_of(F.col("path")).alias("recording_id"), "speaker", S, E, "text", "line_no")


def lab_line(start: Column, end: Column) -> Column:
    sec = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000), F.pmod(ms, F.lit(1000)))
    return F.concat_ws(" ", sec(start), sec(end))


def write_lab(df: DataFrame, path: str, recording: str = "recording_id") -> None:
    """One folder per recording, as the format's lines don't name theirs: for exports of selected recordings."""
    out = df.withColumn("value", lab_line(F.col(S), F.col(E))).repartitionByRange(recording, S).sortWithinPartitions(recording, S)
    out.select(F.col(recording).alias("recording"), "value").write.mode("overwrite").partitionBy("recording").text(path)


def parse_metadata(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """data_name | class_name | speakers | episode (or two blanks / tabs between); the last line of a name wins."""
    v = F.trim(value)
    d = lines.filter((v != "") & ~F.startswith(v, F.lit("#")))
    parts = F.when(F.contains(v, F.lit("|")), F.split(v, r"\|")).otherwise(F.split(v, r"\s{2,}|\t+"))
    d = d.withColumn("_f", F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")).filter(F.size("_f") >= 2)
    f = lambda i: F.coalesce(F.get("_f", F.lit(i)), F.lit(""))
    d = d.select(f(0).alias("data_name"), F.struct(f(1).alias("class_name"), f(2).alias("speakers"), f(3).alias("episode_index")).alias("m"), order)
    return d.groupBy("data_name").agg(F.max_by("m", order).alias("m")).select("data_name", "m.*")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return parse_metadata(read_lines(spark, path))


def first_source(parts: Sequence[DataFrame], key: str = "recording_id") -> DataFrame:
    """Per key the rows of the first table (in order) that has any."""
    u = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_rank", F.lit(i))
        u = p if u is None else u.unionByName(p, allowMissingColumns=True)
    best = u.groupBy(key).agg(F.min("source_rank").alias("source_rank"))
    return u.join(best, [key, "source_rank"])


def load_text_segments(spark: SparkSession, root: str) -> DataFrame:
    """Labelled text of every data folder below `root`: dataset JSONL, else transcript JSONL, else STM."""
    def some(pattern, reader):
        return reader(spark, f"{root}/data*/labeled/{pattern}")
    parts = []
    for pattern, reader in (("transcript_dataset.jsonl", read_transcript_jsonl), ("transcript.jsonl", read_transcript_jsonl), ("mixture.stm", read_stm)):
        try:
            parts.append(some(pattern, reader))
        except Exception as ex:  # no folder has this file
            if "PATH_NOT_FOUND" not in str(ex):
                raise
    if not parts:
        raise FileNotFoundError(root)
    return first_source(parts)


def preferred_rttm(files: DataFrame) -> DataFrame:
    """One RTTM per data folder: hyp* before others, then by name (`files` has path and recording_id)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.groupBy("recording_id").agg(F.min_by("path", F.struct((~F.startswith(name, F.lit("hyp"))).alias("a"), name)).alias("path"))
