"""Registered queries that write the formats' files to the shared folder and read them back, and rows made from such files."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import fixed, text, validate
from dialoom.operators import speakers, store
from dialoom.plans import sqltext as q
from dialoom.plans.registry import query
from dialoom.plans.vector_queries import ANCHORS, SIMS, cent_sql, packed_series, speaker_centroids
from dialoom.plans.views import LINES, VECTORS, cte, lines, table
from dialoom.session import scratch_folder
from dialoom.sources import media, segments, transcripts

SEC = lambda c: F.col(c) / 1000
NAMED = "conv_id || '_' || turn"


def named(spark, sf):
    return lines(spark, sf).withColumn("name", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


@query("transcript_jsonl", cte(LINES) + f"""SELECT {NAMED} AS base_id, start_ms, end_ms, {q.sq('text')} AS text, CASE WHEN turn % 3 < 2 THEN speaker END AS speaker
  FROM lines WHERE {q.sq('text')} <> '' AND end_ms > start_ms AND turn % 7 <> 6""")
def transcript_jsonl(spark, sf):
    """Turns as JSON lines under three sets of keys, every seventh without an end, written and read back by candidate keys."""
    d, (a, b), who = named(spark, sf), (fixed.KEY_CANDIDATES["start"], fixed.KEY_CANDIDATES["end"]), fixed.KEY_CANDIDATES["speaker"]
    body, ids = fixed.KEY_CANDIDATES["text"], fixed.BASE_ID_KEYS

    def as_json(k: int, speaker: bool, end: bool):
        some = [SEC("start_ms").alias(a[k % len(a)]), F.col("text").alias(body[k % len(body)]), F.col("name").alias(ids[k % len(ids)])]
        some += [SEC("end_ms").alias(b[k % len(b)])] if end else []
        return F.to_json(F.struct(*some, *([F.col("speaker").alias(who[k % len(who)])] if speaker else [])))

    kind = F.col("turn") % 3
    value = F.when(F.col("turn") % 7 == 6, as_json(0, True, False)).when(kind == 0, as_json(0, True, True)).when(kind == 1, as_json(1, True, True))
    path = scratch_folder(spark)
    d.select(value.otherwise(as_json(2, False, True)).alias("value")).write.text(path)
    return transcripts.read_transcript_jsonl(spark, path).select("base_id", "start_ms", "end_ms", "text", "speaker")


CLEANED = [f"p AS (SELECT conv_id, turn, {q.pre_clean('text')} AS t FROM lines)", *q.cleanup_steps("p", "conv_id, turn", "t", "k"),
           f"c AS (SELECT conv_id, turn, {q.sq('cleaned')} AS text FROM k)"]


@query("lenient_jsonl", cte(LINES, *CLEANED) + """SELECT CASE WHEN turn % 4 = 3 THEN 'Unknown' ELSE l.conv_id || '_' || turn END AS speaker, CASE WHEN turn % 5 = 4 THEN 0 ELSE start_ms END AS start_ms,
   CASE WHEN turn % 3 = 2 THEN CASE WHEN turn % 5 = 4 THEN 0 ELSE start_ms END ELSE end_ms END AS end_ms, c.text FROM lines l JOIN c USING (conv_id, turn) WHERE c.text <> ''""")
def lenient_jsonl(spark, sf):
    """Turns as JSON lines with keys left out by turn, between lines that are no JSON, read back leniently."""
    d, t = named(spark, sf), F.col("turn")
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("start", "end", "speaker", "label", "text", "content"))), F.array(
        F.when(t % 5 != 4, SEC("start_ms").cast("string")), F.when(t % 3 != 2, SEC("end_ms").cast("string")), F.when(t % 4 < 2, F.col("name")),
        F.when(t % 4 == 2, F.col("name")), F.when(t % 2 == 0, F.col("text")), F.when(t % 2 == 1, F.col("text")))), lambda k, v: v.isNotNull())
    path = scratch_folder(spark)
    d.select(F.explode(F.array(F.to_json(fields), F.lit("{ no json"))).alias("value")).write.text(path)
    return transcripts.read_lenient_jsonl(spark, path).select("speaker", "start_ms", "end_ms", "text")


@query("bracketed_lines", cte(LINES, *CLEANED) + f"""SELECT 'S_' || l.conv_id || '_' || turn AS speaker, start_ms//100*100 AS start_ms, end_ms//100*100 AS end_ms, c.text
  FROM lines l JOIN c USING (conv_id, turn) WHERE c.text <> '' AND NOT contains(l.text, chr(10))""")
def bracketed_lines(spark, sf):
    """Turns as `[1.0s - 2.0s] speaker: text` lines with noise between them, read back."""
    d = named(spark, sf).filter(~F.contains("text", F.lit("\n")))
    tenth = lambda c: F.format_string("%d.%d", F.floor(F.col(c) / 1000), F.floor(F.col(c) / 100) % 10)
    line = F.concat(F.lit("["), tenth("start_ms"), F.lit("s - "), tenth("end_ms"), F.lit("s] S_"), "name", F.lit(": "), "text")
    path = scratch_folder(spark)
    d.select(F.explode(F.array(line, F.lit("[no line] of a transcript"))).alias("value")).write.text(path)
    return transcripts.read_bracketed(spark, path).select("speaker", "start_ms", "end_ms", "text")


@query("file_line_numbers", "SELECT CAST(unnest(range(0, (SELECT count(*) FROM conversations))) AS BIGINT) AS line_no")
def file_line_numbers(spark, sf):
    """All turns in one file: its lines are numbered through, whatever tasks read it."""
    path = scratch_folder(spark)
    table(spark, sf, "conversations").select(F.concat_ws(" ", "conv_id", "turn", "role").alias("value")).coalesce(1).write.text(path)
    return transcripts.read_lines(spark, path).select("line_no")


def asr_rows(spark, sf):
    """Turns as ASR result rows; the data name ends in the role, every fifth row stands twice, every eleventh has no text."""
    d, t = named(spark, sf), F.col("turn")
    cols = {"sample_id": F.col("name"), "data_name": F.concat(F.lit("rec_"), F.col("conv_id").cast("string"), F.lit("_"), "speaker"), "speaker": F.when(t % 4 != 0, F.col("speaker")),
            "start": SEC("start_ms"), "end": SEC("end_ms"), "duration": (F.col("end_ms") - F.col("start_ms")) / 1000, "overlap_ratio": F.lit(0.25),
            "predicted_text": F.when(t % 11 != 10, text.squeeze(F.col("text"))), "was_retried": t % 6 == 5}
    rows = d.select("conv_id", "turn", *[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in transcripts.ASR_SCHEMA])
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.when(t % 5 == 4, 2).otherwise(1)))).drop("_k")


ASR = f"""asr AS (SELECT conv_id, turn, {NAMED} AS sample_id, 'rec_' || conv_id || '_' || speaker AS data_name, CASE WHEN turn % 4 <> 0 THEN speaker END AS speaker, start_ms/1000.0 AS s, end_ms/1000.0 AS e,
   start_ms, end_ms, CASE WHEN turn % 11 <> 10 THEN {q.sq('text')} END AS txt, turn % 6 = 5 AS retried, unnest(range(CASE WHEN turn % 5 = 4 THEN 2 ELSE 1 END)) AS k FROM lines)"""


@query("asr_csv", cte(LINES, ASR) + "SELECT sample_id, data_name, speaker, s AS start, e AS \"end\", coalesce(txt, '') AS predicted_text, retried AS was_retried, count(*) AS n FROM asr GROUP BY ALL")
def asr_csv(spark, sf):
    """ASR rows written as CSV and read back with their types."""
    path = scratch_folder(spark)
    transcripts.write_asr_csv(asr_rows(spark, sf), path)
    back = transcripts.read_asr_csv(spark, path).withColumn("predicted_text", F.coalesce("predicted_text", F.lit("")))
    return back.groupBy("sample_id", "data_name", "speaker", "start", "end", "predicted_text", "was_retried").agg(F.count(F.lit(1)).alias("n"))


@query("transcript_rows", cte(LINES, ASR) + """SELECT conv_id AS job_id, start_ms, end_ms, speaker, coalesce(txt, '') AS text, count(*) AS copies, count(*) AS line_ids FROM asr GROUP BY ALL""")
def transcript_rows(spark, sf):
    """ASR rows as transcript rows: equal rows keep apart by their line ids."""
    t = store.asr_to_transcripts(asr_rows(spark, sf), F.col("conv_id"))
    return t.groupBy("job_id", "start_ms", "end_ms", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("line_id").alias("line_ids"))


@query("legacy_rows", cte(LINES, ASR) + "SELECT s AS start, e AS \"end\", string_split(data_name, '_')[-1] AS speaker, txt AS text, count(*) AS n FROM asr WHERE txt <> '' GROUP BY ALL")
def legacy_rows(spark, sf):
    """ASR rows converted to summary input, the speaker read from the data name."""
    return transcripts.legacy_summary_rows(asr_rows(spark, sf)).groupBy("start", "end", "speaker", "text").agg(F.count(F.lit(1)).alias("n"))


@query("chatbot_documents", cte(LINES, ASR) + """SELECT conv_id, count(*) AS total_segments, count(*) FILTER (coalesce(txt, '') <> '') AS valid_segments, count(*) FILTER (retried) AS retry_count,
   coalesce(string_agg(txt, '|' ORDER BY s, e, speaker NULLS FIRST) FILTER (coalesce(txt, '') <> ''), '') AS texts FROM asr GROUP BY conv_id""")
def chatbot_documents(spark, sf):
    """One nested document per conversation: its counters, and the texts of its segments in order."""
    d = transcripts.chatbot_documents(asr_rows(spark, sf), ["conv_id"], "model", "folder", "engine")
    return d.select("conv_id", *[f"doc.meta.{c}" for c in ("total_segments", "valid_segments", "retry_count")], F.array_join("doc.segments.text", "|").alias("texts"))


FILES = "CASE WHEN page_id % 13 = 0 THEN '/data/' || page_id || '.wav' ELSE '/data/spk' || page_id % 7 || '/' || page_id || CASE page_id % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp3' ELSE '.txt' END END"


@query("speaker_groups", "SELECT page_id, 'spk' || page_id % 7 AS speaker FROM pages WHERE page_id % 13 <> 0 AND page_id % 3 <> 2 AND length(html) > 0")
def speaker_groups(spark, sf):
    """Sample files by speaker folder; files beside the folders and files that are no audio don't count."""
    p = table(spark, sf, "pages").select("page_id", F.expr(FILES).alias("path"), F.length("html").cast("long").alias("length"))
    got = media.speaker_groups(p, "/data")
    return got.select(F.regexp_extract("path", r"(\d+)\.[^.]+$", 1).cast("long").alias("page_id"), "speaker")


@query("lab_files", cte(LINES) + "SELECT conv_id, turn, start_ms, end_ms FROM lines WHERE end_ms > start_ms")
def lab_files(spark, sf):
    """Turns as RTTM files in buckets, read back; the label carries the turn."""
    d = lines(spark, sf).filter("end_ms > start_ms")
    path = scratch_folder(spark)
    segments.write_rttm(d.select(F.col("conv_id").cast("string").alias("recording_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("speaker"), "start_ms", "end_ms"), path, buckets=16)
    back = segments.read_rttm(spark, path + "/bucket=*")
    return back.select(F.col("uri").cast("long").alias("conv_id"), F.substring("speaker", 2, 20).cast("long").alias("turn"), "start_ms", "end_ms")


@query("line_tolerance", cte(LINES) + """SELECT conv_id, turn // 8 AS block, bool_and(turn % 8 <> 5 OR conv_id % 3 <> 1) AND bool_and(turn % 8 <> 2 OR conv_id % 5 <> 0) AND max(turn) % 8 <> 6 AS matches
  FROM lines GROUP BY conv_id, turn // 8""")
def line_tolerance(spark, sf):
    """Blocks of eight turns against a copy: edges moved by 100 ms, in some blocks one line by 150 ms, another speaker, or the
    last line left out."""
    d, t = lines(spark, sf), F.col("turn")
    line = lambda s, e, who: F.struct(t.alias("turn"), s.alias("start_ms"), e.alias("end_ms"), who.alias("speaker"))
    far = F.when((t % 8 == 5) & (F.col("conv_id") % 3 == 1), 150).otherwise(100)
    other = F.when((t % 8 == 2) & (F.col("conv_id") % 5 == 0), F.lit("nobody")).otherwise(F.col("speaker"))
    b = d.groupBy("conv_id", F.floor(t / 8).alias("block")).agg(
        F.array_sort(F.collect_list(line(F.col("start_ms"), F.col("end_ms"), F.col("speaker")))).alias("inp"),
        F.array_sort(F.collect_list(line(F.col("start_ms") + far, F.col("end_ms") - far, other))).alias("out"), F.max("turn").alias("last"))
    out = F.when(F.col("last") % 8 == 6, F.slice("out", F.lit(1), F.size("out") - 1)).otherwise(F.col("out"))
    return b.select("conv_id", "block", validate.lines_match(out, F.col("inp")).alias("matches"))


@query("job_transcript_lines", """SELECT CAST(l_orderkey AS BIGINT) AS job_id, CAST(l_linenumber AS BIGINT) AS line_id, l_returnflag AS speaker, round(l_partkey / 1000.0, 2) AS start, round(l_suppkey / 1000.0, 2) AS "end"
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders))""")
def job_transcript_lines(spark, sf):
    """The lines of one job as its owner sees them (the first job of the first owner)."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("job_id"), F.col("o_custkey").cast("long").alias("user_id"))
    first = o.agg(F.min(F.struct("user_id", "job_id")).alias("f")).select("f.*").first()
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("job_id"), F.col("l_linenumber").cast("long").alias("line_id"), F.col("l_returnflag").alias("speaker"),
                                             F.col("l_returnflag").alias("text"), F.col("l_partkey").alias("start_ms"), F.col("l_suppkey").alias("end_ms"))
    return store.job_transcripts(li, o, F.lit(first["user_id"]), F.lit(first["job_id"])).drop("text")


@query("known_anchors", cte(VECTORS, ANCHORS, cent_sql("anchors", "series, speaker", "used_dur", "ce"), SIMS) + "SELECT vec_id, top1_score >= 0.42 AND top1_score - top2_score >= 0.05 AS known FROM tp")
def known_anchors(spark, sf):
    """Anchors that clearly belong to an enrolled speaker."""
    a, c = speaker_centroids(spark, sf)
    return speakers.known_like(a, packed_series(c), ["series"]).select("vec_id", "known")


@query("speaker_indexes", "SELECT vec_id, TRY_CAST(CASE WHEN vec_id % 9 = 0 THEN '' WHEN vec_id % 4 = 3 THEN 'x' ELSE CAST(label AS VARCHAR) END AS INTEGER) AS idx FROM embeddings")
def speaker_indexes(spark, sf):
    """Index from a label: the part after the first underscore if it is a number."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id"), F.when(F.col("vec_id") % 9 == 0, "unknown").when(F.col("vec_id") % 4 == 3, "SPK_x").otherwise(F.concat(F.lit("SPK_"), F.col("label").cast("string"))).alias("l"))
    return v.select("vec_id", speakers.speaker_index(F.col("l")).alias("idx"))
