"""Transcript scans: key-tolerant JSONL, bracketed text, ASR result CSV, and the quality gate over ASR rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import fixed, text
from dialoom.operators import slabs

ASR_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("sample_id", "parent_audio_id", "audio_path", "rttm_path", "data_name",
     "class_name", "group_name", "bucket", "source_type", "episode_index", "split_name", "speaker")]
    + [T.StructField(n, T.DoubleType()) for n in ("rttm_start", "rttm_end", "start", "end", "duration", "overlap_ratio")]
    + [T.StructField("predicted_text", T.StringType()), T.StructField("was_retried", T.BooleanType())])


def recording_of(path: Column) -> Column:
    """The data folder of a labelled file (…/<name>/labeled/<file>), else the file name without its extension."""
    folder = F.regexp_extract(path, r"/([^/]+)/labeled/[^/]+$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with their file and their number in it, from 0, however the file is split among tasks.

    Rows are counted inside each split, and the counts of a file's splits are summed up in their order.
    """
    df = spark.read.text(path if isinstance(path, str) else list(path))
    df = df.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias(slabs.SLAB),
                   F.monotonically_increasing_id().alias("_seen"))
    d = slabs.running_sums(df, ["path"], ["_seen"], {"line_no": F.lit(1).cast("long")})
    return d.select("path", "value", (F.col("line_no") - 1).alias("line_no"))


def _ms(c: Column) -> Column:
    return F.round(c.try_cast("double") * 1000).cast("long")


def first_present(m: Column, candidates: Sequence[str]) -> Column:
    """Value of the first key that exists in the map, be the value null or not."""
    out = None
    for k in candidates:
        hit = F.map_contains_key(m, k)
        out = F.when(hit, m[k]) if out is None else out.when(hit, m[k])
    return out


def read_transcript_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows with start, end and text under any candidate key; blank text and empty spans are dropped."""
    raw = read_lines(spark, path).withColumn("m", F.from_json("value", "map<string,string>"))
    k = fixed.KEY_CANDIDATES
    return (raw.select("path", "line_no", recording_of(F.col("path")).alias("recording_id"),
                       _ms(first_present(F.col("m"), k["start"])).alias("start_ms"),
                       _ms(first_present(F.col("m"), k["end"])).alias("end_ms"),
                       text.squeeze(first_present(F.col("m"), k["text"])).alias("text"),
                       first_present(F.col("m"), k["speaker"]).alias("speaker"),
                       first_present(F.col("m"), fixed.BASE_ID_KEYS).alias("base_id"))
            .filter("text <> '' AND end_ms > start_ms"))


def read_lenient_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Summarizer input: bad lines skipped, speaker→label→Unknown, text→content, end defaults to start; cleaned text."""
    raw = read_lines(spark, path).withColumn("m", F.from_json("value", "map<string,string>")).filter("m IS NOT NULL")
    start = F.coalesce(_ms(F.col("m")["start"]), F.lit(0).cast("long"))
    return (raw.select("path", F.col("line_no").alias("source_idx"), recording_of(F.col("path")).alias("recording_id"),
                       start.alias("start_ms"), F.coalesce(_ms(F.col("m")["end"]), start).alias("end_ms"),
                       F.coalesce(first_present(F.col("m"), ["speaker", "label"]), F.lit("Unknown")).alias("speaker"),
                       text.clean_line(first_present(F.col("m"), ["text", "content"])).alias("text")).filter("text <> ''"))


BRACKETED = r"^\[([\d.]+)s\s*-\s*([\d.]+)s\]\s*([^:]+):\s*(.*)$"


def read_bracketed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """`[1.0s - 2.0s] speaker: text` lines; anything else is dropped."""
    raw = read_lines(spark, path).withColumn("v", text.strip(F.col("value"))).filter(F.col("v").rlike(BRACKETED))
    part = lambda i: F.regexp_extract("v", BRACKETED, i)
    return (raw.select("path", F.col("line_no").alias("source_idx"), recording_of(F.col("path")).alias("recording_id"),
                       _ms(part(1)).alias("start_ms"), _ms(part(2)).alias("end_ms"),
                       text.clean_line(part(3)).alias("speaker"), text.clean_line(part(4)).alias("text")).filter("text <> ''"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return read_lenient_jsonl(spark, path) if path.lower().endswith(".jsonl") else read_bracketed(spark, path)


def read_asr_csv(spark: SparkSession, path: str | Sequence[str], strings: bool = False, raw_newlines: bool = False) -> DataFrame:
    """ASR results; `strings` keeps every column as text for the quality gate.

    Files are split among tasks, a row being a line; `raw_newlines` reads foreign files whose texts hold line breaks (one
    task per file).
    """
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in ASR_SCHEMA]) if strings else ASR_SCHEMA
    return spark.read.csv(path if isinstance(path, str) else list(path), schema=schema, header=True, multiLine=raw_newlines,
                          escape='"')


def write_asr_csv(df: DataFrame, path: str) -> None:
    """One row per line: line breaks inside texts are written as blanks."""
    line = lambda f: F.regexp_replace(F.col(f.name), r"[\r\n]+", " ") if isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType)
    df.select(*[line(f).alias(f.name) for f in ASR_SCHEMA]).write.mode("overwrite").csv(path, header=True, escape='"')


def quality_gate(raw: DataFrame) -> DataFrame:
    """ASR rows with `ok`: text present and no artifact, times castable. Speaker falls back to the data-name suffix."""
    txt = text.strip(F.coalesce("predicted_text", F.lit("")))
    start = F.coalesce(F.col("start"), F.lit("0.0"))
    s, e = start.try_cast("double"), F.coalesce(F.col("end"), start).try_cast("double")
    ok = (txt != "") & ~text.is_asr_artifact(txt) & s.isNotNull() & e.isNotNull()
    return raw.withColumns({
        "text": txt, "start_ms": F.round(s * 1000).cast("long"), "end_ms": F.round(e * 1000).cast("long"),
        "speaker": F.coalesce(F.nullif(text.strip(F.col("speaker")), F.lit("")), text.speaker_of_name(F.col("data_name"))), "ok": ok})


def gate_counters(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if("ok").alias("kept_rows"),
                     F.count_if(~F.col("ok")).alias("skipped_rows"))


def legacy_summary_rows(asr: DataFrame) -> DataFrame:
    """ASR rows as (start, end, speaker, text), the speaker read from the data name, blank text dropped."""
    spk = F.regexp_extract("data_name", r"_([^_]+)$", 1)
    return (asr.withColumn("text", text.strip(F.col("predicted_text"))).filter("text <> ''")
            .select("start", "end", F.when(spk != "", spk).otherwise("Unknown").alias("speaker"), "text"))


def chatbot_documents(asr: DataFrame, keys: Sequence[str], model: str, source_dir: str, engine: str) -> DataFrame:
    """One nested document per key: counters and the non-empty segments in time order."""
    seg = F.struct("start", "end", "speaker", "duration", F.col("predicted_text").alias("text"), "overlap_ratio", "was_retried")
    has = F.coalesce(F.col("predicted_text"), F.lit("")) != ""
    out = asr.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(has).alias("_v"), F.count_if("was_retried").alias("_r"),
                                 F.array_sort(F.collect_list(F.when(has, seg))).alias("segments"))
    meta = F.struct(F.col("_n").alias("total_segments"), F.col("_v").alias("valid_segments"), F.col("_r").alias("retry_count"),
                    F.lit(model).alias("model"), F.lit(source_dir).alias("source_dir"), F.lit(engine).alias("engine"))
    return out.select(*keys, F.struct(meta.alias("meta"), "segments").alias("doc"))
