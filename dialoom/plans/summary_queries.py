"""Registered queries of the summary flow: block features, action items, speaker and meeting summaries, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import fixed, text, validate
from dialoom.operators import dedup, sequence, summary
from dialoom.plans import sqltext as q
from dialoom.plans.registry import query
from dialoom.plans.sequence_queries import BLOCKS, CLEAN_LINES, ISLANDS, MERGED, rcte
from dialoom.plans.views import DOC_LINES, LINES, cte, doc_lines, lines, table

DOC = ["doc_id"]


def doc_blocks(spark, sf):
    d = doc_lines(spark, sf).withColumnRenamed("txt", "text")
    return summary.blocks(d, DOC, "idx", F.floor(F.col("start_ms") / 3_600_000))


FEATURES = f"""bl AS MATERIALIZED (SELECT n.doc_id, w.block_id, string_agg(txt, ' ' ORDER BY n.pos) AS blob, sum(length(txt)) AS chars, count(DISTINCT speaker) AS n_speakers,
   min(start_ms) AS s, arg_max(end_ms, n.pos) AS e, bool_or(tr) AS heavy FROM n JOIN walk w USING (doc_id, pos) GROUP BY 1, 2),
ft AS MATERIALIZED (SELECT *, {q.tags('blob')} AS tags, {q.has_word('blob', fixed.ACTION_WORDS)} AS act, {q.has_word('blob', fixed.ISSUE_WORDS)} AS iss,
   {q.has_word('blob', fixed.FORMAT_WORDS)} AS fmt, {q.kind('blob', 'heavy')} AS kind FROM bl),
sc AS MATERIALIZED (SELECT *, CAST(least(len(tags), 4) + CASE WHEN act THEN 3 ELSE 0 END + CASE WHEN iss THEN 2 ELSE 0 END + CASE WHEN fmt THEN 2 ELSE 0 END
   + CASE WHEN chars >= 700 THEN 1 ELSE 0 END + CASE WHEN chars >= 1100 THEN 1 ELSE 0 END + CASE WHEN n_speakers >= 2 THEN 1 ELSE 0 END
   + CASE WHEN e - s >= 30000 THEN 1 ELSE 0 END - CASE WHEN heavy THEN 2 ELSE 0 END
   - CASE WHEN chars <= 220 AND n_speakers <= 1 AND NOT act AND len(tags) <= 1 THEN 2 ELSE 0 END AS BIGINT) AS score FROM ft)"""


@query("block_features", rcte(DOC_LINES, BLOCKS, FEATURES) + f"""SELECT doc_id, block_id, kind, CAST(chars AS BIGINT) AS chars, n_speakers, array_to_string(tags, ',') AS tags, score,
   {q.overview('kind', 'tags')} AS overview FROM sc""")
def block_features(spark, sf):
    f = summary.features(doc_blocks(spark, sf))
    return f.select("doc_id", "block_id", F.col("segment_type").alias("kind"), F.col("chars").cast("long").alias("chars"), F.col("n_speakers").cast("long").alias("n_speakers"),
                    F.array_join("tags", ",").alias("tags"), F.col("score").cast("long").alias("score"), text.type_overview(F.col("segment_type"), F.col("tags")).alias("overview"))


@query("block_scores_topk", rcte(DOC_LINES, BLOCKS, FEATURES) + """SELECT doc_id, block_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, block_id) AS k FROM sc WHERE score >= 3) WHERE k <= 12""")
def block_scores_topk(spark, sf):
    return summary.choose_blocks(summary.features(doc_blocks(spark, sf)), DOC).select("doc_id", "block_id", F.col("score").cast("long").alias("score"))


SHOWN = f"""sh AS MATERIALIZED (SELECT doc_id, w.block_id, count(*) AS nl, string_agg(printf('[%.1fs - %.1fs] %s: %s', start_ms/1000.0, end_ms/1000.0, speaker, txt), chr(10) ORDER BY pos) AS shown
   FROM walk w JOIN n USING (doc_id, pos) GROUP BY 1, 2),
nl AS MATERIALIZED (SELECT *, lower({q.sq('shown')}) AS low, string_split(lower({q.sq('shown')}), ' ') AS wd FROM sh)"""


@query("block_routing", rcte(DOC_LINES, BLOCKS, FEATURES, SHOWN) + f"""
  SELECT doc_id, block_id, {q.noise('shown', 'low', 'wd')} <= 1 AND length(shown) <= 1400 AS skip_normalize, (nl <= 2 AND chars <= 220 AND len(tags) <= 1 AND NOT act) OR (heavy AND chars <= 420) AS skip_summary,
    CASE WHEN chars <= 260 AND len(tags) <= 1 AND NOT act THEN 80 WHEN chars <= 600 AND len(tags) <= 2 AND NOT act THEN 104 WHEN chars <= 1100 AND len(tags) <= 4 THEN 128 ELSE 128 END AS max_tokens
  FROM sc JOIN nl USING (doc_id, block_id)""")
def block_routing(spark, sf):
    return summary.routing(summary.features(doc_blocks(spark, sf))).select("doc_id", "block_id", "skip_normalize", "skip_summary", "max_tokens")


# Turns with an action, a finished action or neither at their end.
TASKED = "concat(text, CASE turn % 4 WHEN 0 THEN ' cần kiểm tra' WHEN 1 THEN ' đã update' WHEN 2 THEN ' đợi test lại' ELSE '' END)"


@query("block_action_items", cte(LINES, f"t AS (SELECT conv_id, turn, speaker, start_ms, end_ms, {TASKED} AS text FROM lines)",
       f"h AS (SELECT conv_id, turn // 8 AS block, turn, speaker, start_ms, end_ms, {q.sq('text')} AS task, {q.status('text')} AS status FROM t WHERE length({q.sq('text')}) >= 8 AND {q.has_word('text', fixed.ACTION_WORDS)})",
       "d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block, lower(speaker), lower(task) ORDER BY turn) AS k FROM h)",
       "r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn) AS place FROM d WHERE k = 1)") + """
  SELECT conv_id, block, place, speaker AS owner, task, status, start_ms, end_ms FROM r WHERE place <= 6""")
def block_action_items(spark, sf):
    """The action items of blocks of eight turns: lines that hint at an action, first per owner and task, six a block."""
    ln = lines(spark, sf).withColumn("text", F.expr(TASKED)).withColumn("block", F.floor(F.col("turn") / 8))
    blocks = ln.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "start_ms", "end_ms", "speaker", "text"))).alias("ls"))
    out = blocks.select("conv_id", "block", F.posexplode(summary.action_items(F.col("ls"))).alias("place", "a"))
    return out.select("conv_id", "block", (F.col("place") + 1).cast("long").alias("place"), "a.*")


@query("action_items", cte(LINES, f"h AS (SELECT conv_id, turn, speaker, {q.sq('text')} AS task, {q.status('text')} AS status FROM lines WHERE length({q.sq('text')}) >= 8 AND {q.any_in('text', fixed.PROPOSED_KEYS + ['en', 'un'])})") + """
  SELECT conv_id, turn, speaker AS owner, task, status FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(speaker)), lower(trim(task)) ORDER BY turn) AS k FROM h) WHERE k = 1""")
def action_items(spark, sf):
    """Lines with a proposal key as action items, first per (owner, task) of a conversation."""
    ln = lines(spark, sf)
    t = text.squeeze(F.col("text"))
    hit = ln.filter((F.length(t) >= 8) & text.contains_any(F.lower(t), fixed.PROPOSED_KEYS + ["en", "un"]))
    item = F.array(F.struct(F.col("speaker").alias("owner"), t.alias("task"), text.action_status(F.col("text")).alias("status")))
    a = summary.meeting_actions(hit.select("conv_id", F.col("turn").alias("block_id"), item.alias("action_items")), ["conv_id"])
    return a.select("conv_id", F.col("block_id").alias("turn"), "owner", "task", "status")


@query("speaker_summaries", cte(LINES, f"b AS MATERIALIZED (SELECT conv_id, speaker, string_agg({q.sq('text')}, ' ' ORDER BY turn) AS blob, count(*) AS n_lines, arg_min(start_ms, turn) AS start_ms, arg_max(end_ms, turn) AS end_ms FROM lines GROUP BY 1, 2)",
       f"t AS MATERIALIZED (SELECT *, {q.tags('blob')} AS tags, {q.pick(q.kind('blob', 'false'), fixed.TYPE_PHRASES, 'x')} AS topic FROM b)") + """
  SELECT conv_id, speaker, n_lines, start_ms, end_ms, CASE WHEN len(tags) > 0 THEN CASE WHEN n_lines >= 4 THEN 'high' ELSE 'medium' END WHEN n_lines >= 3 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN len(tags) > 0 THEN 'Người này chủ yếu trao đổi về ' || topic || ', nổi bật với các nội dung như ' || array_to_string(tags[1:3], ', ') || '.' ELSE 'Người này chủ yếu tham gia phần ' || topic || '.' END AS main_summary FROM t""")
def speaker_summaries(spark, sf):
    return summary.speaker_summaries(lines(spark, sf), ["conv_id"], ["turn"]).drop("insight")


@query("meeting_types", cte(LINES, f"k AS (SELECT conv_id, turn, {q.kind('text', q.transition('text'))} AS kind FROM lines)",
       "p AS (SELECT conv_id, kind, count(*) AS n, min(turn) AS f FROM k GROUP BY 1, 2)",
       f"r AS (SELECT *, {q.pick('kind', fixed.TYPE_PHRASES, '')} AS phrase, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS k FROM p)") + """
  SELECT conv_id, CASE WHEN bool_or(kind = 'issue_report') THEN 'debug_discussion' WHEN bool_or(kind IN ('presentation_prep', 'formatting_review')) THEN 'presentation_prep'
    WHEN bool_or(kind IN ('technical_discussion', 'progress_update', 'planning')) THEN 'technical_sync' ELSE 'mixed' END AS meeting_type,
    string_agg(phrase, ', ' ORDER BY k) FILTER (k <= 3) AS phrases, count(*) AS n_types FROM r GROUP BY conv_id""")
def meeting_types(spark, sf):
    ln = lines(spark, sf)
    b = ln.select("conv_id", F.col("turn").alias("block_id"), text.segment_type(F.col("text"), text.is_transition(F.col("text"))).alias("segment_type"))
    return summary.meeting_types(b, ["conv_id"]).select("conv_id", "meeting_type", F.array_join("top_phrases", ", ").alias("phrases"), "n_types")


def _summaries(spark, sf):
    d = doc_lines(spark, sf).withColumnRenamed("txt", "text")
    return summary.summarize(d, DOC, "idx", F.floor(F.col("start_ms") / 3_600_000), width=3_600_000)


# The lines of the rule path: cleaned, without fillers, merged with their neighbours, then packed into blocks.
KEPT_LINES = [*CLEAN_LINES, f"kl AS MATERIALIZED (SELECT * FROM cl WHERE length(txt) >= 2 AND trim(lower(txt), ' .,!?:;-') NOT IN (SELECT unnest({q.lst(fixed.FILLERS)})))"]
RULE_LINES = [DOC_LINES, *KEPT_LINES, ISLANDS.replace("FROM cl ", "FROM kl "), MERGED,
              """ml AS MATERIALIZED (SELECT t.doc_id, t.idx, x.speaker, x.start_ms, x.end_ms, t.txt FROM (SELECT doc_id, isl, idx, acc AS txt FROM mw JOIN (SELECT doc_id, isl, max(n) AS n FROM il GROUP BY 1, 2) USING (doc_id, isl, n)) t
  JOIN (SELECT doc_id, isl, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r3 GROUP BY 1, 2) x USING (doc_id, isl))""",
              BLOCKS.replace("FROM doc_lines", "FROM ml")]


PARTS = f"""bn AS MATERIALIZED (SELECT n.doc_id, w.block_id, n.pos, n.speaker, n.txt FROM n JOIN walk w USING (doc_id, pos)),
ac AS (SELECT doc_id, block_id, least(count(DISTINCT lower(speaker || chr(1) || {q.sq('txt')})), 6) AS n_actions FROM bn WHERE length({q.sq('txt')}) >= 8 AND {q.has_word('txt', fixed.ACTION_WORDS)} GROUP BY 1, 2),
sb AS MATERIALIZED (SELECT doc_id, block_id, speaker, min(pos) AS f, string_agg(txt, ' ' ORDER BY pos) AS blob FROM bn GROUP BY 1, 2, 3),
sr AS (SELECT doc_id, block_id, count(*) AS n_speakers, string_agg(role, ',' ORDER BY f) AS roles FROM (SELECT *, {q.role('blob')} AS role, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY f) AS k FROM sb) WHERE k <= 6 GROUP BY 1, 2)"""


@query("block_summaries", rcte(*RULE_LINES, FEATURES, PARTS) + f"""SELECT doc_id, block_id, kind AS segment_type, {q.overview('kind', 'tags')} AS overview, CAST(coalesce(n_actions, 0) AS INTEGER) AS n_actions,
   CAST(sr.n_speakers AS INTEGER) AS n_speakers, roles, CAST(score AS INTEGER) AS score FROM sc LEFT JOIN ac USING (doc_id, block_id) JOIN sr USING (doc_id, block_id)""")
def block_summaries(spark, sf):
    """The whole rule path up to block summaries."""
    _, s = _summaries(spark, sf)
    return s.select("doc_id", "block_id", "segment_type", "overview", F.size("action_items").alias("n_actions"), F.size("speaker_insights").alias("n_speakers"),
                    F.array_join(F.transform("speaker_insights", lambda x: x["role_in_block"]), ",").alias("roles"), "score")


@query("meeting_documents")
def meeting_documents(spark, sf):
    norm, s = _summaries(spark, sf)
    d = summary.meeting_documents(norm, s, DOC)
    return d.select("doc_id", "meeting_type", "meeting_overview", "conversation_main_summary", "num_blocks", F.size("segments").alias("n_segments"),
                    F.size("speakers").alias("n_speakers"), F.size("cleaned_transcript").alias("n_lines"))


@query("summary_counters", rcte(*RULE_LINES) + """SELECT doc_id, count(DISTINCT block_id) AS normalize_rule_blocks, CAST(0 AS BIGINT) AS normalize_model_blocks, count(DISTINCT block_id) AS summary_rule_blocks, CAST(0 AS BIGINT) AS summary_model_blocks
  FROM walk GROUP BY doc_id""")
def summary_counters(spark, sf):
    _, s = _summaries(spark, sf)
    return summary.pipeline_counters(s, DOC)


# An answer that is no JSON has nothing usable; else the type falls back to other, a missing overview to the first key point,
# and an unknown status to open.
@query("repaired_summaries", cte("cv AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations)", *q.cleanup_steps("cv", "conv_id, turn, role", "text", "rc")) + """
  SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 AND turn % 2 = 0 THEN 'planning' ELSE 'other' END AS segment_type, CASE WHEN turn % 4 = 3 THEN '' WHEN cleaned <> '' THEN cleaned ELSE role END AS overview,
    CASE WHEN turn % 4 = 3 THEN 0 WHEN cleaned <> '' THEN 2 ELSE 1 END AS n_points, CASE WHEN turn % 4 <> 3 AND cleaned <> '' THEN 'open' END AS status, turn % 4 = 3 AS severe FROM rc""")
def repaired_summaries(spark, sf):
    """Model-like answers of uneven quality built from turns, repaired to the block summary schema."""
    c = table(spark, sf, "conversations")
    body = F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, "planning").otherwise("unknown_type").alias("segment_type"),
        F.when(F.col("turn") % 3 == 0, F.col("text")).alias("overview"),
        F.array(F.col("text"), F.col("role")).alias("key_points"),
        F.array(F.struct(F.col("role").alias("owner"), F.col("text").alias("task"), F.lit("later").alias("status"))).alias("action_items")))
    raw = F.when(F.col("turn") % 4 == 3, F.lit("no json here")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    s = c.select("conv_id", "turn", validate.block_summary(raw, F.col("turn").cast("long")).alias("s"))
    return s.select("conv_id", F.col("turn").cast("long").alias("turn"), "s.segment_type", "s.overview", F.size("s.key_points").alias("n_points"),
                    F.get("s.action_items", F.lit(0))["status"].alias("status"), "s.severe")
