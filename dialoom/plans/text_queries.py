"""Registered queries over transcript text: cleaning, flags, classification, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import fixed, spans as fs, text
from dialoom.operators.hooks import compression_ratio
from dialoom.plans import sqltext as q
from dialoom.plans.registry import query
from dialoom.plans.views import DOC_LINES, HYP, LINES, SEG, cte, hyp_events, lines, seg_events, table


def raw_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "txt"))


@query("slug_name", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM part""")
def slug_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slug("p_name").alias("slug"))


@query("stable_ids", cte(SEG) + """SELECT seg_id, md5(recording_id || '||' || printf('%d.%02d', (start_ms+5)//1000, ((start_ms+5)//10)%100) || '||' || printf('%d.%02d', (end_ms+5)//1000, ((end_ms+5)//10)%100) || '||' || speaker) AS sample_id FROM seg""")
def stable_ids(spark, sf):
    sec = text.centiseconds
    return seg_events(spark, sf).select("seg_id", text.stable_id(
        F.col("recording_id"), sec(F.col("start_ms")), sec(F.col("end_ms")), F.col("speaker")).alias("sample_id"))


@query("span_arithmetic", cte(SEG, HYP) + """
  SELECT seg_id, greatest(0, least(s.end_ms, h.end_ms) - greatest(s.start_ms, h.start_ms)) AS overlap_ms,
    round(CASE WHEN greatest(s.end_ms, h.end_ms) > least(s.start_ms, h.start_ms) THEN
      greatest(0, least(s.end_ms, h.end_ms) - greatest(s.start_ms, h.start_ms)) / (greatest(s.end_ms, h.end_ms) - least(s.start_ms, h.start_ms)) ELSE 0 END, 6) AS iou,
    greatest(0, s.start_ms - 100) AS padded_start_ms, least(1705000000000, s.end_ms + 200) AS padded_end_ms,
    CASE WHEN s.end_ms - s.start_ms > 20100 THEN s.start_ms + 10000 ELSE s.start_ms END AS trimmed_start_ms,
    CASE WHEN s.end_ms - s.start_ms > 20100 THEN s.end_ms - 10000 ELSE s.end_ms END AS trimmed_end_ms
  FROM seg s JOIN hyp h USING (seg_id)""")
def span_arithmetic(spark, sf):
    """Overlap, hull IoU, padding and trimming of a segment against its shifted copy."""
    s = seg_events(spark, sf).select("seg_id", "start_ms", "end_ms")
    h = hyp_events(spark, sf).select("seg_id", F.col("start_ms").alias("hs"), F.col("end_ms").alias("he"))
    a0, a1, b0, b1 = (F.col(c) for c in ("start_ms", "end_ms", "hs", "he"))
    p0, p1 = fs.pad(a0, a1, F.lit(1705000000000), 100, 200)
    t0, t1 = fs.trim(a0, a1, 10_000)
    return s.join(h, "seg_id").select(
        "seg_id", fs.overlap_len(a0, a1, b0, b1).alias("overlap_ms"), F.round(fs.temporal_iou(a0, a1, b0, b1), 6).alias("iou"),
        p0.alias("padded_start_ms"), p1.alias("padded_end_ms"), t0.alias("trimmed_start_ms"), t1.alias("trimmed_end_ms"))


@query("repeat_cleanup", cte(DOC_LINES, *q.cleanup_steps("doc_lines", "doc_id, idx", "txt", "c")) + "SELECT * FROM c")
def repeat_cleanup(spark, sf):
    d = raw_lines(spark, sf)
    return d.filter(F.trim("txt") != "").select("doc_id", F.col("idx").cast("long").alias("idx"),
                                                text.cleanup_repeats(F.col("txt")).alias("cleaned"))


@query("clean_transcript", cte(DOC_LINES, f"p AS (SELECT doc_id, idx, {q.pre_clean('txt')} AS t FROM doc_lines)",
       *q.cleanup_steps("p", "doc_id, idx", "t", "k"), f"c AS (SELECT doc_id, idx, {q.sq('cleaned')} AS cleaned FROM k)")
       + f"""SELECT * FROM c WHERE length(cleaned) >= 2 AND trim(lower(cleaned), ' .,!?:;-') NOT IN (SELECT unnest({q.lst(fixed.FILLERS)}))""")
def clean_transcript(spark, sf):
    """Cleaned lines of at least two characters that are no fillers."""
    d = raw_lines(spark, sf)
    d = d.filter(F.trim("txt") != "").select("doc_id", F.col("idx").cast("long").alias("idx"),
                                             text.clean_line(F.col("txt")).alias("cleaned"))
    return d.filter((F.length("cleaned") >= 2) & ~text.is_filler(F.col("cleaned")))


@query("line_rules", cte(DOC_LINES) + f"""
  SELECT doc_id, idx, {q.transition('txt')} AS is_transition, {q.has_word('txt', fixed.ACTION_WORDS)} AS has_action,
    {q.has_word('txt', fixed.ISSUE_WORDS)} AS has_issue, {q.has_word('txt', fixed.FORMAT_WORDS)} AS has_format,
    array_to_string({q.tags('txt')}, ',') AS tags, {q.kind('txt', q.transition('txt'))} AS kind,
    {q.status('txt')} AS status, {q.role('txt')} AS role,
    {q.overview(q.kind('txt', q.transition('txt')), q.tags('txt'))} AS overview,
    {q.pick(q.kind('txt', q.transition('txt')), fixed.TYPE_TITLES, fixed.TYPE_TITLES['other'])} AS title
  FROM doc_lines""")
def line_rules(spark, sf):
    """Transition, action, issue and format tests, dictionary tags, type, action status and speaker role of every line."""
    d = raw_lines(spark, sf)
    t = F.col("txt")
    d = d.filter(F.trim("txt") != "").withColumns({"is_transition": text.is_transition(t), "_tags": text.tech_tags(t)})
    d = d.withColumn("kind", text.segment_type(t, F.col("is_transition")))
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), "is_transition", text.has_action_hint(t).alias("has_action"),
                    text.has_issue(t).alias("has_issue"), text.has_format(t).alias("has_format"),
                    F.array_join("_tags", ",").alias("tags"), "kind", text.action_status(t).alias("status"),
                    text.speaker_role(t).alias("role"), text.type_overview(F.col("kind"), F.col("_tags")).alias("overview"),
                    text.lookup(F.col("kind"), fixed.TYPE_TITLES, fixed.TYPE_TITLES["other"]).alias("title"))


WORDS = f"string_split({q.sq('text')}, ' ')"


@query("hallucination_flags", cte(LINES, f"w AS (SELECT *, {WORDS} AS w, (end_ms-start_ms)//(1 + turn % 5) AS d FROM lines)") + f"""
  SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN false ELSE (d > 0 AND len(w)*1000 > d*8.0)
           OR (len(w) >= 8 AND w[1:len(w)//2] = w[len(w)//2+1:2*(len(w)//2)]) END AS hallucinated,
    ({' OR '.join(f"contains(lower(trim(text)), '{a}')" for a in fixed.ASR_ARTIFACTS)})
      OR lower(trim(text)) IN (SELECT unnest({q.lst(fixed.STRAY_WORDS)})) AS artifact FROM w""")
def hallucination_flags(spark, sf):
    ln = lines(spark, sf)
    d = F.floor((F.col("end_ms") - F.col("start_ms")) / (1 + F.col("turn") % 5))
    return ln.select("conv_id", "turn", text.is_hallucination(F.col("text"), d).alias("hallucinated"),
                     text.is_asr_artifact(F.col("text")).alias("artifact"))


LOW_TEXT = f"""t AS (SELECT conv_id, turn, text, lower({q.sq('text')}) AS low, string_split(lower({q.sq('text')}), ' ') AS w FROM lines)"""


@query("noise_scores", cte(LINES, LOW_TEXT) + f"SELECT conv_id, turn, {q.noise('text', 'low', 'w')} AS score FROM t")
def noise_scores(spark, sf):
    """0..5 per line: fillers, a word three times in a row, punctuation runs, known artifacts."""
    return lines(spark, sf).select("conv_id", "turn", text.noise_score(F.col("text")).alias("score"))


@query("compression_flags")
def compression_flags(spark, sf):
    """Texts whose bytes compress by more than 2.4 (zlib: no SQL twin)."""
    return (lines(spark, sf).withColumn("ratio", compression_ratio("text"))
            .select("conv_id", "turn", F.round("ratio", 6).alias("ratio"), (F.col("ratio") > 2.4).alias("suspicious")))


@query("turn_similarity", cte(LINES, f"s AS (SELECT conv_id, turn, list_distinct(string_split(lower({q.sq('text')}), ' ')) AS a, text FROM lines)") + """
  SELECT x.conv_id, x.turn, round(CASE WHEN trim(x.text) = '' OR trim(y.text) = '' THEN 0 ELSE len(list_intersect(x.a, y.a)) / greatest(len(x.a), len(y.a)) END, 6) AS similarity
  FROM s x JOIN s y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1""")
def turn_similarity(spark, sf):
    """Token-set similarity of each turn and the next of its conversation."""
    d = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    d = d.withColumn("_s", text.token_set(F.col("text")))
    n = d.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("_s").alias("_n"))
    return d.join(n, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.set_similarity(F.col("_s"), F.col("_n")), 6).alias("similarity"))


@query("time_formats", cte(LINES) + """
  SELECT conv_id, turn, printf('%02d:%02d:%02d', (start_ms//1000)//3600, ((start_ms//1000)%3600)//60, (start_ms//1000)%60) AS hms,
    CASE WHEN end_ms < 60000 THEN printf('%.2fs', end_ms/1000.0) ELSE printf('%dm %ds', end_ms//60000, (end_ms//1000)%60) END AS ms,
    printf('%02d:%02d', end_ms//60000, (end_ms//1000)%60) AS mmss, round(start_ms/1000.0, 2) AS start_sec FROM lines""")
def time_formats(spark, sf):
    s, e = F.col("start_ms") / F.lit(1000.0), F.col("end_ms") / F.lit(1000.0)
    return lines(spark, sf).select("conv_id", "turn", text.hhmmss(s).alias("hms"), text.minutes_seconds(e).alias("ms"),
                                   text.mmss(e).alias("mmss"), F.round(s, 2).alias("start_sec"))


@query("name_speaker", """SELECT doc_id, string_split(source || '_' || lang, '_')[-1] AS speaker, string_split(source, '_')[-1] AS whole FROM documents""")
def name_speaker(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.speaker_of_name(F.concat_ws("_", "source", "lang")).alias("speaker"),
        text.speaker_of_name(F.col("source")).alias("whole"))


@query("mentioned_speaker", cte(LINES) + "SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{a}{chr(39)})' for a in al)} THEN '{n}'"
    for n, al in {**fixed.SPEAKER_ALIASES, "Le": ["le ", "die "], "De": ["de ", "und "]}.items()) + " END AS speaker FROM lines")
def mentioned_speaker(spark, sf):
    aliases = {**fixed.SPEAKER_ALIASES, "Le": ["le ", "die "], "De": ["de ", "und "]}
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"),
                                                    text.mentioned_speaker(F.col("text"), aliases).alias("speaker"))


@query("unfenced_json", """SELECT conv_id, CAST(turn AS BIGINT) AS turn, '{"turn": ' || turn || ', "role": "' || role || '"}' AS body FROM conversations""")
def unfenced_json(spark, sf):
    """Model-style answers (prose, fences, trailing words) reduced to their JSON."""
    c = table(spark, sf, "conversations")
    raw = F.concat(F.lit('```json\nHere: {"turn": '), F.col("turn").cast("string"), F.lit(', "role": "'), F.col("role"),
                   F.lit('"} done\n```'))
    return c.select("conv_id", F.col("turn").cast("long").alias("turn"), text.unfence_json(raw).alias("body"))


@query("asr_quality_gate", cte(LINES, f"""r AS (SELECT conv_id, turn, text, CASE WHEN turn % 7 = 6 THEN 'n/a' ELSE CAST(start_ms/1000.0 AS VARCHAR) END AS start,
    CASE WHEN length(text) % 5 = 0 THEN '' ELSE speaker END AS speaker, 'data_' || speaker AS data_name FROM lines)""") + f"""
  SELECT conv_id, count(*) AS raw_rows, count(*) FILTER (ok) AS kept_rows, count(*) FILTER (NOT ok) AS skipped_rows,
    string_agg(DISTINCT spk, ',' ORDER BY spk) FILTER (ok) AS speakers FROM (SELECT *, coalesce(nullif(trim(speaker), ''), string_split(data_name, '_')[-1]) AS spk,
      trim(text) <> '' AND lower(trim(text)) NOT IN (SELECT unnest({q.lst(fixed.STRAY_WORDS)})) AND NOT
      ({' OR '.join(f"contains(lower(trim(text)), '{a}')" for a in fixed.ASR_ARTIFACTS)}) AND TRY_CAST(start AS DOUBLE) IS NOT NULL AS ok FROM r) GROUP BY conv_id""")
def asr_quality_gate(spark, sf):
    from dialoom.sources.transcripts import quality_gate
    ln = lines(spark, sf)
    raw = ln.select("conv_id", F.col("text").alias("predicted_text"),
                    F.when(F.col("turn") % 7 == 6, "n/a").otherwise((F.col("start_ms") / 1000).cast("string")).alias("start"),
                    (F.col("end_ms") / 1000).cast("string").alias("end"),
                    F.when(F.length("text") % 5 == 0, "").otherwise(F.col("speaker")).alias("speaker"),
                    F.concat(F.lit("data_"), "speaker").alias("data_name"))
    g = quality_gate(raw)
    return g.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if("ok").alias("kept_rows"), F.count_if(~F.col("ok")).alias("skipped_rows"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("speaker")))), ","), F.lit("")).alias("speakers"))
