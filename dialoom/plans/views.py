"""The transcript-shaped views the registered queries run on, in Spark and (for the SQL twins) as CTE text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.operators import slabs
from dialoom.session import configure

KEY = ["recording_id"]
BIN_MS = 300_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seg_events(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker segments: one recording per day, event type as speaker, value as seconds of speech."""
    ts = F.col("ts").cast("timestamp")
    start = F.unix_millis(ts)
    return table(spark, sf, "events").select(
        F.date_format(ts, "yyyy-MM-dd").alias("recording_id"), F.col("event_id").alias("seg_id"),
        F.col("event_type").alias("speaker"), start.alias("start_ms"),
        (start + F.round(F.col("value") * 1000).cast("long")).alias("end_ms"))


def sliced(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The segments and the slab width their density asks for (one counting pass over the base table)."""
    seg = seg_events(spark, sf)
    return seg, slabs.slab_width(seg, KEY, "start_ms")


SEG = """seg AS (
  SELECT strftime(ts, '%Y-%m-%d') AS recording_id, event_id AS seg_id, event_type AS speaker,
         epoch_us(ts)//1000 AS start_ms, epoch_us(ts)//1000 + CAST(round(value*1000) AS BIGINT) AS end_ms
  FROM events)"""

SPEAKERS = ["click", "error", "purchase", "signup", "view"]


def hyp_events(spark: SparkSession, sf: str) -> DataFrame:
    """A hypothesis copy: starts and ends shifted by up to 1.5 s, every 11th segment given to the next speaker."""
    seg = seg_events(spark, sf)
    shift = (F.col("seg_id") % 7 - 3) * 500
    names = F.array(*[F.lit(s) for s in SPEAKERS])
    nxt = F.element_at(names, (F.array_position(names, F.col("speaker")) % len(SPEAKERS) + 1).cast("int"))
    return seg.select("recording_id", "seg_id",
                      F.when(F.col("seg_id") % 11 == 0, nxt).otherwise(F.col("speaker")).alias("speaker"),
                      (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))


HYP = """hyp AS (
  SELECT recording_id, seg_id,
         CASE WHEN seg_id % 11 = 0 THEN CASE speaker WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase'
              WHEN 'purchase' THEN 'signup' WHEN 'signup' THEN 'view' ELSE 'click' END ELSE speaker END AS speaker,
         start_ms + (seg_id % 7 - 3)*500 AS start_ms, end_ms + (seg_id % 7 - 3)*500 AS end_ms
  FROM seg)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Timed conversation turns. A conversation is a handful of turns, so the clock is a plain window."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.col("role").alias("speaker"), "text", (60 * F.length("text")).cast("long").alias("dur"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    st = F.coalesce(F.sum(F.col("dur") + 200 + 150 * (F.col("turn") % 9)).over(w), F.lit(0)).cast("long")
    return c.select("conv_id", F.col("turn").cast("long").alias("turn"), "speaker", "text", st.alias("start_ms"),
                    (st + F.col("dur")).alias("end_ms"))


LINES = """lines AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role AS speaker, text, CAST(st AS BIGINT) AS start_ms,
         CAST(st+dur AS BIGINT) AS end_ms
  FROM (SELECT *, coalesce(sum(dur+200+150*(turn % 9)) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS st
        FROM (SELECT conv_id, turn, role, text, 60*length(text) AS dur FROM conversations) c) l)"""


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines as a transcript; the clock of a document is computed over the lines of that one cell."""
    d = table(spark, sf, "documents").select("doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "txt"))
    d = d.filter(F.trim("txt") != "").withColumn("dur", (40 * F.length("txt")).cast("long"))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    st = F.coalesce(F.sum(F.col("dur") + 100 * (F.col("idx") % 7)).over(w), F.lit(0)).cast("long")
    spk = F.concat(F.lit("SPK_"), F.floor(F.col("idx") / 2) % 3)
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), spk.alias("speaker"), "txt",
                    st.alias("start_ms"), (st + F.col("dur")).alias("end_ms"))


DOC_LINES = """doc_lines AS (
  SELECT doc_id, idx, 'SPK_' || CAST((idx // 2) % 3 AS VARCHAR) AS speaker, txt, start_ms, start_ms + dur AS end_ms
  FROM (SELECT doc_id, idx, txt, dur,
               CAST(coalesce(sum(dur+100*(idx % 7)) OVER (PARTITION BY doc_id ORDER BY idx
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS start_ms
        FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS idx,
                     unnest(string_split(text, chr(10))) AS txt,
                     40*length(unnest(string_split(text, chr(10)))) AS dur FROM documents)
        WHERE trim(txt) <> ''))"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.concat(F.lit("SPK_"), F.col("label")).alias("speaker"),
        F.col("embedding").cast("array<double>").alias("embedding"))


VECTORS = """vectors AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, 'SPK_' || CAST(label AS VARCHAR) AS speaker,
         CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
