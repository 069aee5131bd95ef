"""Registered queries over segment files, job tables and training manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import fixed, text
from dialoom.operators import curation, dedup, spans, store
from dialoom.plans.interval_queries import BUSY, STEPS
from dialoom.plans.registry import query
from dialoom.plans.views import BIN_MS, KEY, SEG, cte, seg_events, sliced, table
from dialoom.sources import media, segments


@query("rttm_round_trip", cte(SEG) + "SELECT seg_id, recording_id AS uri, speaker, start_ms, end_ms FROM seg")
def rttm_round_trip(spark, sf):
    """Segments written as RTTM lines and parsed back."""
    s = seg_events(spark, sf)
    lines = s.select("seg_id", segments.rttm_line(F.col("recording_id"), F.col("start_ms"), F.col("end_ms"), F.col("speaker")).alias("value"))
    return segments.parse_rttm(lines)


@query("rttm_lines", cte(SEG) + """SELECT seg_id, 'SPEAKER ' || recording_id || ' 1 ' || printf('%d.%03d', start_ms//1000, start_ms%1000) || ' ' || printf('%d.%03d', (end_ms-start_ms)//1000, (end_ms-start_ms)%1000) || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS line FROM seg""")
def rttm_lines(spark, sf):
    return seg_events(spark, sf).select("seg_id", segments.rttm_line(F.col("recording_id"), F.col("start_ms"), F.col("end_ms"), F.col("speaker")).alias("line"))


@query("speech_lab_lines", cte(SEG, """u0 AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM seg WHERE end_ms > start_ms),
  u1 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_ms > top THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM u0),
  r AS (SELECT recording_id, min(start_ms) AS s, max(end_ms) AS e FROM u1 GROUP BY recording_id, g)""") + "SELECT recording_id, printf('%d.%03d', s//1000, s%1000) || ' ' || printf('%d.%03d', e//1000, e%1000) AS line FROM r")
def speech_lab_lines(spark, sf):
    seg, width = sliced(spark, sf)
    u = spans.merge_spans(seg.filter("end_ms > start_ms"), KEY, 0, width)
    return u.select("recording_id", segments.lab_line(F.col("start_ms"), F.col("end_ms")).alias("line"))


@query("stm_parse", """SELECT conv_id, CAST(turn AS BIGINT) AS turn, role AS speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE turn > 0""")
def stm_parse(spark, sf):
    """Turns as STM lines (start = turn, end = 2*turn seconds, so turn 0 is empty) parsed back."""
    c = table(spark, sf, "conversations")
    line = F.concat_ws(" ", F.lit("f"), F.lit("1"), "role", F.col("turn").cast("string"), (F.col("turn") * 2).cast("string"), F.lit("<o>"), "text")
    return segments.parse_stm(c.select("conv_id", F.col("turn").cast("long").alias("turn"), line.alias("value"))).select("conv_id", "turn", "speaker", "text")


@query("metadata_last_wins", "SELECT p_name AS data_name, p_type AS class_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1")
def metadata_last_wins(spark, sf):
    p = table(spark, sf, "part")
    lines = p.select(F.concat(F.lit("  "), "p_name", F.lit(" | "), "p_type", F.lit(" |  ")).alias("value"), F.col("p_partkey").alias("line_no"))
    return segments.parse_metadata(lines).select("data_name", "class_name")


@query("source_fallback", """WITH a AS (SELECT doc_id, 0 AS source_rank FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id, 1 AS source_rank FROM documents WHERE doc_id % 2 = 0), c AS (SELECT doc_id, 2 AS source_rank FROM documents)
  SELECT doc_id, min(source_rank) AS source_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY doc_id""")
def source_fallback(spark, sf):
    """First of three partially filled sources per document."""
    d = table(spark, sf, "documents").select("doc_id")
    return segments.first_source([d.filter("doc_id % 3 = 0"), d.filter("doc_id % 2 = 0"), d], "doc_id")


MEDIA_NAMES = """CASE page_id % 5 WHEN 0 THEN '.wav' WHEN 1 THEN '.MKV' WHEN 2 THEN '.3gp' WHEN 3 THEN '.Opus' ELSE '.exe' END"""


@query("media_catalogue", f"""SELECT page_id, regexp_extract(lower(url), '\\.([^./]+)$', 1) AS extension,
   CASE WHEN page_id % 5 = 4 THEN 'extension' WHEN length(html)*20000 > 78643200 THEN 'too_large' WHEN length(html) = 0 THEN 'empty' END AS reject_reason
  FROM (SELECT page_id, html, url || {MEDIA_NAMES} AS url FROM pages)""")
def media_catalogue(spark, sf):
    """Pages as a media folder of four media kinds and programs; size in proportion to the page."""
    p = table(spark, sf, "pages")
    return media.media_catalogue(p.select("page_id", F.concat("url", F.expr(MEDIA_NAMES)).alias("path"), (F.length("html").cast("long") * 20_000).alias("length"))).select(
        "page_id", "extension", "reject_reason")


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


@query("table_profile", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_profile(spark, sf):
    return media.table_profile({t: table(spark, sf, t) for t in TABLES})


@query("stage_times", """SELECT user_id, event_id, seconds FROM (SELECT user_id, event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))/1e6, 3) AS seconds FROM events) WHERE seconds IS NOT NULL""")
def stage_times(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return media.stage_times(e, "user_id", "ts", "event_id").select("user_id", "event_id", "seconds")


@query("timing_summary", cte(SEG) + """SELECT speaker, count(*) AS segments, round(sum((end_ms-start_ms)/1000.0), 3) AS total, round(avg((end_ms-start_ms)/1000.0), 6) AS mean, min((end_ms-start_ms)/1000.0) AS fastest,
   max((end_ms-start_ms)/1000.0) AS slowest, count(*) FILTER (seg_id % 10 = 0) AS retried, round(count(*) FILTER (seg_id % 10 = 0) / count(*), 6) AS retry_rate FROM seg GROUP BY speaker""")
def timing_summary(spark, sf):
    t = media.timing_summary(seg_events(spark, sf), ["speaker"], (F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0), F.col("seg_id") % 10 == 0)
    return t.withColumns({"total": F.round("total", 3), "mean": F.round("mean", 6), "retry_rate": F.round("retry_rate", 6)})


# ---- job tables -------------------------------------------------------------------------------------------------------

def jobs(spark, sf):
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_orderkey").cast("long").alias("job_id"), F.col("o_custkey").cast("long").alias("user_id"), day.alias("created_at"),
                    (F.col("o_orderstatus") == "F").alias("is_deleted"), F.when(F.col("o_orderstatus") == "F", day + F.expr("INTERVAL 1 DAY")).alias("deleted_at"),
                    F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/media/"), "o_orderkey")).alias("file_path"), "o_totalprice")


NOW = "1995-06-17"


@query("trash_by_user", "SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderkey AS BIGINT) AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders WHERE o_orderstatus = 'F'")
def trash_by_user(spark, sf):
    """All trashed jobs with their place in their user's list, latest first."""
    return store.user_list(jobs(spark, sf).filter("is_deleted"), "user_id", "deleted_at", "job_id").select("user_id", "job_id", "rank")


@query("history_by_user", "SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderkey AS BIGINT) AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders WHERE o_orderstatus <> 'F'")
def history_by_user(spark, sf):
    """All jobs that are not trashed with their place in their user's history, latest first."""
    return store.user_list(jobs(spark, sf).filter("NOT is_deleted"), "user_id", "created_at", "job_id").select("user_id", "job_id", "rank")


@query("retention_purge", f"SELECT CAST(l_orderkey AS BIGINT) AS job_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate + INTERVAL 1 DAY < TIMESTAMP '{NOW}' - INTERVAL 3 DAY)")
def retention_purge(spark, sf):
    """Child rows left after trashed jobs past retention are purged with their children."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("job_id"), "l_linenumber")
    return store.retention(jobs(spark, sf), F.lit(NOW).cast("timestamp"), {"lines": li})["lines"]


@query("expired_media", f"SELECT CAST(o_orderkey AS BIGINT) AS job_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 30 DAY")
def expired_media(spark, sf):
    return store.expired_media(jobs(spark, sf), F.lit(NOW).cast("timestamp")).select("job_id")


@query("summary_upsert", """SELECT o_custkey AS user_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job_id, max(o_orderdate) AS version FROM orders GROUP BY o_custkey""")
def summary_upsert(spark, sf):
    """Old half of the orders upserted by the newer half, one row per customer."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.struct("o_orderdate", "o_orderkey").alias("v"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("version"))
    up = store.upsert_latest(o.filter("version < date '1995-01-01'"), o.filter("version >= date '1995-01-01'"), ["user_id"], "v")
    return up.select("user_id", "job_id", "version")


@query("job_summaries", "SELECT CAST(o_orderkey AS BIGINT) AS job_id, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = o_orderkey) THEN 'ready' ELSE 'pending' END AS summary_status FROM orders")
def job_summaries(spark, sf):
    s = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("job_id"), F.col("lang").alias("meeting_overview"))
    return store.job_summaries(jobs(spark, sf), s).select("job_id", "summary_status")


@query("speaker_relabel", cte(SEG) + "SELECT recording_id, seg_id, CASE speaker WHEN 'click' THEN 'Alice' WHEN 'view' THEN 'Bob' ELSE speaker END AS speaker FROM seg")
def speaker_relabel(spark, sf):
    from dialoom.operators.speakers import relabel
    seg = seg_events(spark, sf)
    names = F.array(F.struct(F.lit("click").alias("old"), F.lit("Alice").alias("new")), F.struct(F.lit("view").alias("old"), F.lit("Bob").alias("new")))
    m = seg.select("recording_id").distinct().select("recording_id", F.explode(names).alias("p")).select("recording_id", "p.*")
    return relabel(seg, m, KEY).select("recording_id", "seg_id", "speaker")


@query("distinct_speakers", cte(SEG) + "SELECT DISTINCT recording_id, speaker FROM seg")
def distinct_speakers(spark, sf):
    return seg_events(spark, sf).select("recording_id", "speaker").distinct()


@query("soft_delete_state", """SELECT user_id, arg_max(event_type, (ts, event_id)) = 'error' AS is_deleted FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id""")
def soft_delete_state(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type").isin("error", "signup"))
    e = e.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", "delete").otherwise("restore").alias("action"))
    return store.apply_flags(e, "user_id").select("user_id", "is_deleted")


# ---- manifests --------------------------------------------------------------------------------------------------------

@query("bucket_lookup", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'silver_dubbed' WHEN source = 'src1' THEN 'gold_real' WHEN source = 'src2' THEN 'hard_real' ELSE 'silver_real' END AS bucket FROM documents")
def bucket_lookup(spark, sf):
    d = table(spark, sf, "documents")
    cls = F.when(F.col("source") == "src1", "vif").when(F.col("source") == "src2", "coi_mo").otherwise(F.col("source"))
    kind = F.when(F.col("doc_id") % 10 == 0, "dubbed").otherwise("self_labeled")
    return d.select("doc_id", curation.bucket(cls, kind).alias("bucket"))


@query("target_hours", "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY md5('7:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS acc FROM documents) WHERE coalesce(acc, 0) < 300000")
def target_hours(spark, sf):
    """Documents in seeded hash order until 300,000 characters are reached."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return curation.choose_to_hours(d, "doc_id", F.col("n_chars").cast("long"), 300_000, 7).select("doc_id")


@query("manifest_summary", cte(SEG) + "SELECT speaker AS source, count(DISTINCT recording_id) AS parents, count(*) AS samples, round(sum(end_ms-start_ms)/3600000.0, 3) AS hours FROM seg GROUP BY speaker")
def manifest_summary(spark, sf):
    seg = seg_events(spark, sf).withColumn("source", F.col("speaker"))
    recs = seg.groupBy("source", "recording_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return curation.scan_summary(recs, seg, ["source"]).select("source", "parents", "samples", "hours")


@query("curriculum_filter", cte(SEG, STEPS, BUSY) + """SELECT s.seg_id FROM seg s LEFT JOIN busy b ON b.recording_id = s.recording_id AND b.start_ms < s.end_ms AND b.end_ms > s.start_ms WHERE s.end_ms > s.start_ms
  GROUP BY s.seg_id, s.start_ms, s.end_ms HAVING sum(CASE WHEN b.start_ms IS NULL THEN 0 ELSE least(s.end_ms, b.end_ms) - greatest(s.start_ms, b.start_ms) END) / (s.end_ms - s.start_ms) <= 0.18""")
def curriculum_filter(spark, sf):
    seg, width = sliced(spark, sf)
    o = spans.overlap_sum(seg.filter("end_ms > start_ms"), spans.busy_regions(seg, KEY, width=width), KEY, ["seg_id"], "ov", width=width)
    return curation.overlap_filter(o.withColumn("overlap_ratio", F.col("ov") / (F.col("end_ms") - F.col("start_ms"))), curation.STAGE1).select("seg_id")


@query("chosen_recordings", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def chosen_recordings(spark, sf):
    """Rows of recordings in the union of two id sets."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    ids = o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey").union(o.filter("o_orderstatus = 'P'").select("o_orderkey")).distinct()
    return li.join(ids, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("base_id_lists", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), ',') AS ids FROM lineitem GROUP BY l_orderkey")
def base_id_lists(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("base", F.col("l_partkey").cast("string"))
    return curation.base_ids(li, "l_orderkey", "base").select("l_orderkey", F.array_join("base_utt_ids", ",").alias("ids"))


@query("tagged_union", "SELECT source, count(*) AS n FROM (SELECT 'orders' AS source FROM orders UNION ALL SELECT 'parts' FROM part UNION ALL SELECT 'docs' FROM documents) GROUP BY source")
def tagged_union(spark, sf):
    t = {"orders": "orders", "parts": "part", "docs": "documents"}
    u = None
    for tag, name in t.items():
        one = table(spark, sf, name).select(F.lit(tag).alias("source"))
        u = one if u is None else u.unionByName(one)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("unmatched_ids", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def unmatched_ids(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    return p.select("p_partkey").join(li.filter("l_quantity > 49").select("l_partkey").distinct(), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


def _samples(spark, sf):
    seg, width = sliced(spark, sf)
    i = F.col("seg_id")
    kind = F.when(i % 4 == 0, "vivos").when(i % 4 == 1, "dubbed").when(i % 4 == 2, "robustness").otherwise("self_labeled")
    o = spans.overlap_sum(seg.filter("end_ms > start_ms"), spans.busy_regions(seg, KEY, width=width), KEY, ["seg_id"], "ov", width=width)
    o = o.withColumns({"source_type": kind, "split_name": F.when(i % 9 == 0, "val").otherwise("train"), "text": F.concat(F.lit("line "), i % 50),
                       "overlap_ratio": F.col("ov") / (F.col("end_ms") - F.col("start_ms")), "audio_path": F.col("recording_id")})
    o = o.withColumns({"parent_audio_id": F.concat_ws("/", "source_type", "split_name", "recording_id"),
                       "base_utt_ids": F.array((i % 400).cast("string"), (i % 611).cast("string"))})
    return o.drop("ov"), o.groupBy("parent_audio_id", "source_type", "split_name").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


@query("stage_manifests")
def stage_manifests(spark, sf):
    """Both stages: chosen recordings, overlap limits, duplicates, quotas (sequential rules inside: no SQL twin)."""
    from dialoom.session import cut_lineage
    smp, recs = _samples(spark, sf)
    smp, recs = cut_lineage(smp), cut_lineage(recs)
    a = curation.stage_manifest(smp, recs, curation.STAGE1, 1, "seg_id")
    b = curation.stage_manifest(smp, recs, curation.STAGE2, 101, "seg_id")
    return a.unionByName(b).groupBy("stage", "split", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query("rttm_samples", cte(SEG, """p AS (SELECT recording_id, seg_id, part, start_ms + (end_ms-start_ms)*part//n AS start_ms, start_ms + (end_ms-start_ms)*(part+1)//n AS end_ms
    FROM (SELECT *, unnest(range(n)) AS part FROM (SELECT *, CAST(greatest(ceil((end_ms-start_ms)/30000.0),1) AS BIGINT) AS n FROM seg)))""",
    STEPS.replace("FROM seg", "FROM p"), BUSY, "q AS (SELECT recording_id, seg_id, part, start_ms - 100 AS s, least(end_ms + 200, 1706700000000) AS e FROM p WHERE end_ms - start_ms >= 500)") + """
  SELECT q.recording_id, q.seg_id, q.part, s AS start_ms, e AS end_ms, round(sum(CASE WHEN b.start_ms IS NULL THEN 0 ELSE least(e, b.end_ms) - greatest(s, b.start_ms) END) / (e - s), 4) AS overlap_ratio
  FROM q LEFT JOIN busy b ON b.recording_id = q.recording_id AND b.start_ms < e AND b.end_ms > s GROUP BY 1, 2, 3, 4, 5""")
def rttm_samples(spark, sf):
    """Segments split at 30 s, padded, with the share of overlapped speech among the parts."""
    seg, width = sliced(spark, sf)
    recs = seg.select("recording_id").distinct().withColumn("duration_ms", F.lit(1706700000000))
    return curation.rttm_samples(seg, recs, KEY, width).select(*KEY, "seg_id", "part", "start_ms", "end_ms", "overlap_ratio")
