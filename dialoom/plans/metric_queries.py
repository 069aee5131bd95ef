"""Registered queries over a reference and a shifted, partly relabelled hypothesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import metrics
from dialoom.plans.registry import query
from dialoom.plans.sequence_queries import rcte
from dialoom.plans.views import BIN_MS, HYP, KEY, SEG, cte, hyp_events, sliced, table


def _snap(src: str, out: str, extra: str = "") -> str:
    """CTEs: unions per (recording, speaker) of `src` snapped to 10 ms."""
    return f"""{out}0 AS (SELECT recording_id, speaker, (start_ms//10)*10 AS start_ms, ((end_ms+9)//10)*10 AS end_ms FROM {src} WHERE ((end_ms+9)//10)*10 > (start_ms//10)*10),
{out}1 AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {out}0),
{out}2 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_ms > top THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM {out}1),
{out} AS (SELECT recording_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM {out}2 GROUP BY recording_id, speaker, g)"""


MAP = """mx AS (SELECT h.recording_id, h.speaker, r.speaker AS ref_speaker, sum(least(h.end_ms, r.end_ms) - greatest(h.start_ms, r.start_ms)) AS ov
  FROM hm h JOIN rm r ON r.recording_id = h.recording_id AND least(h.end_ms, r.end_ms) > greatest(h.start_ms, r.start_ms) GROUP BY 1, 2, 3),
mk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY ov DESC, ref_speaker) AS k FROM mx),
lm AS (SELECT n.recording_id, n.speaker, coalesce(mk.ref_speaker, lo.low) AS ref_speaker, CAST(coalesce(mk.ov, 0) AS BIGINT) AS overlap_ms
  FROM (SELECT DISTINCT recording_id, speaker FROM hm) n LEFT JOIN mk ON mk.recording_id = n.recording_id AND mk.speaker = n.speaker AND k = 1
  LEFT JOIN (SELECT recording_id, min(speaker) AS low FROM rm GROUP BY 1) lo ON lo.recording_id = n.recording_id)"""


@query("hyp_ref_label_map", cte(SEG, HYP, _snap("seg", "rm"), _snap("hyp", "hm"), MAP) + "SELECT * FROM lm")
def hyp_ref_label_map(spark, sf):
    seg, width = sliced(spark, sf)
    h, r = metrics.snapped(hyp_events(spark, sf), KEY, width=width), metrics.snapped(seg, KEY, width=width)
    return metrics.label_map(h, r, KEY, BIN_MS)


@query("speaker_majority_map", cte(SEG, HYP, """m AS (SELECT h.recording_id, h.speaker, s.speaker AS ref_speaker, row_number() OVER (PARTITION BY h.seg_id
   ORDER BY least(h.end_ms, s.end_ms) - greatest(h.start_ms, s.start_ms) DESC, s.seg_id) AS k FROM hyp h JOIN seg s ON s.recording_id = h.recording_id
   AND least(h.end_ms, s.end_ms) - greatest(h.start_ms, s.start_ms) > 500),
  c AS (SELECT recording_id, speaker, ref_speaker, count(*) AS votes FROM m WHERE k = 1 GROUP BY 1, 2, 3),
  b AS (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY votes DESC, ref_speaker) AS k FROM c)""") + """
  SELECT recording_id, speaker, ref_speaker, votes FROM b WHERE k = 1""")
def speaker_majority_map(spark, sf):
    seg, _ = sliced(spark, sf)
    m = metrics.best_match(hyp_events(spark, sf), seg, KEY).filter("ref_id IS NOT NULL")
    ref = seg.select(*KEY, F.col("seg_id").alias("ref_id"), F.col("speaker").alias("ref_speaker"))
    return metrics.majority_labels(m.join(ref, [*KEY, "ref_id"]), KEY, "speaker", "ref_speaker")


IDENTITY = """hx AS (SELECT h.recording_id, m.ref_speaker AS speaker, h.start_ms, h.end_ms FROM hm h JOIN lm m USING (recording_id, speaker)),
al AS (SELECT 'r' AS src, * FROM rm UNION ALL SELECT 'h', * FROM hx),
bt AS (SELECT DISTINCT recording_id, unnest([start_ms, end_ms]) AS t FROM al),
iv AS (SELECT recording_id, t AS a, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS b FROM bt),
st AS (SELECT iv.recording_id, a, b, list(DISTINCT speaker) FILTER (src = 'r') AS rs, list(DISTINCT speaker) FILTER (src = 'h') AS hs
  FROM iv JOIN al ON al.recording_id = iv.recording_id AND al.start_ms <= a AND a < al.end_ms WHERE b IS NOT NULL GROUP BY 1, 2, 3),
cn AS (SELECT recording_id, b - a AS dur, coalesce(len(rs), 0) AS r, coalesce(len(hs), 0) AS h, coalesce(len(list_intersect(rs, hs)), 0) AS i FROM st)"""


def _tot(cond: str, name: str) -> str:
    return f"CAST(coalesce(sum(dur) FILTER ({cond}), 0) AS BIGINT) AS {name}"


@query("overlap_prf", cte(SEG, HYP, _snap("seg", "rm"), _snap("hyp", "hm"), MAP, IDENTITY,
       "o AS (SELECT recording_id, " + ", ".join([
           _tot("r >= 2", "ref_overlap_ms"), _tot("h >= 2", "hyp_overlap_ms"), _tot("r >= 2 AND h >= 2", "tp_ms"),
           _tot("r < 2 AND h >= 2", "fp_ms"), _tot("r >= 2 AND h < 2", "fn_ms"), _tot("r = 2", "exact2_ms"),
           _tot("r = 2 AND i >= 2", "both_correct_any_ms"), _tot("r = 2 AND h = 2 AND i = 2", "both_correct_exact_ms"),
           _tot("r = 2 AND i = 1", "one_correct_ms"), _tot("r = 2 AND i = 0", "zero_correct_ms"), _tot("r = 2 AND h >= 2", "detected_ms"),
           _tot("r = 2 AND h < 2", "collapsed_ms"), _tot("r = 1 AND h >= 2", "fp_on_single_ms"),
           _tot("r = 1 AND h >= 2 AND i >= 1", "kept_true_plus_extra_ms"), _tot("r = 1 AND h >= 2 AND i = 0", "both_wrong_ms")]) + " FROM cn GROUP BY 1)",
       "p AS (SELECT *, CASE WHEN tp_ms + fp_ms > 0 THEN tp_ms / (tp_ms + fp_ms) ELSE 0 END AS pr, CASE WHEN tp_ms + fn_ms > 0 THEN tp_ms / (tp_ms + fn_ms) ELSE 0 END AS rc FROM o)")
       + "SELECT * EXCLUDE (pr, rc), round(pr, 6) AS \"precision\", round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2*pr*rc/(pr+rc) ELSE 0 END, 6) AS f1 FROM p")
def overlap_prf(spark, sf):
    seg, width = sliced(spark, sf)
    o = metrics.precision_recall(metrics.overlap_identity(seg, hyp_events(spark, sf), KEY, BIN_MS, width))
    return o.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("diarization_error", rcte(SEG, HYP, """m AS (SELECT h.recording_id, h.speaker AS hs, r.speaker AS rs, sum(least(h.end_ms, r.end_ms) - greatest(h.start_ms, r.start_ms)) AS ms
    FROM hyp h JOIN seg r ON r.recording_id = h.recording_id AND least(h.end_ms, r.end_ms) > greatest(h.start_ms, r.start_ms) GROUP BY 1, 2, 3)""",
    "sp AS (SELECT * FROM (VALUES (1,'click'),(2,'error'),(3,'purchase'),(4,'signup'),(5,'view')) t(i, s))",
    "pm AS (SELECT [s] AS p FROM sp UNION ALL SELECT list_append(p, s) FROM pm, sp WHERE len(p) < 5 AND NOT list_contains(p, s))",
    "pc AS (SELECT p, sp.s AS hs, p[sp.i] AS rs FROM pm, sp WHERE len(p) = 5)",
    "tt AS (SELECT rec.recording_id, pc.p, sum(coalesce(m.ms, 0)) AS tot FROM (SELECT DISTINCT recording_id FROM seg) rec CROSS JOIN pc LEFT JOIN m ON m.recording_id = rec.recording_id AND m.hs = pc.hs AND m.rs = pc.rs GROUP BY 1, 2)",
    "bp AS (SELECT recording_id, arg_max(p, tot) AS p FROM tt GROUP BY 1)",
    "mp AS (SELECT bp.recording_id, pc.hs, pc.rs FROM bp JOIN pc ON pc.p = bp.p)",
    """al AS (SELECT recording_id, start_ms, end_ms, 'r' AS src, speaker FROM seg WHERE end_ms > start_ms
       UNION ALL SELECT h.recording_id, h.start_ms, h.end_ms, 'h', mp.rs FROM hyp h JOIN mp ON mp.recording_id = h.recording_id AND mp.hs = h.speaker WHERE end_ms > start_ms)""",
    "bt AS (SELECT DISTINCT recording_id, unnest([start_ms, end_ms]) AS t FROM al)",
    "iv AS (SELECT recording_id, t AS a, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS b FROM bt)",
    """ac AS (SELECT iv.recording_id, a, b - a AS dur, speaker, count(*) FILTER (src='r') AS r, count(*) FILTER (src='h') AS h
       FROM iv JOIN al ON al.recording_id = iv.recording_id AND al.start_ms <= a AND a < al.end_ms WHERE b IS NOT NULL GROUP BY 1, 2, 3, 4)""",
    "ti AS (SELECT recording_id, a, dur, sum(r) AS r, sum(h) AS h, sum(least(r, h)) AS c FROM ac GROUP BY 1, 2, 3)") + """
  SELECT recording_id, CAST(sum(r*dur) AS BIGINT) AS total_ms, CAST(sum(greatest(0, r-h)*dur) AS BIGINT) AS missed_ms, CAST(sum(greatest(0, h-r)*dur) AS BIGINT) AS false_alarm_ms,
    CAST(sum((least(r, h) - c)*dur) AS BIGINT) AS confusion_ms, round(sum((greatest(r, h) - c)*dur) / sum(r*dur), 6) AS der FROM ti GROUP BY 1""")
def diarization_error(spark, sf):
    seg, width = sliced(spark, sf)
    return metrics.diarization_error(seg, hyp_events(spark, sf), KEY, width).withColumn("der", F.round("der", 6))


def turn_pairs(spark, sf):
    """Reference turn and a hypothesis without every 7th word and with every 5th word repeated."""
    w = F.split("text", " ")
    hyp = F.array_join(F.flatten(F.transform(w, lambda x, i: F.when(i % 7 == 6, F.array().cast("array<string>"))
                                             .when(i % 5 == 4, F.array(x, x)).otherwise(F.array(x)))), " ")
    c = table(spark, sf, "conversations")
    return c.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("ref"), hyp.alias("hyp"))


PAIRS = r"""tp AS MATERIALIZED (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text AS ref, array_to_string(flatten(list_transform(string_split(text, ' '),
   lambda x, i: CASE WHEN (i-1) % 7 = 6 THEN [] WHEN (i-1) % 5 = 4 THEN [x, x] ELSE [x] END)), ' ') AS hyp FROM conversations),
wd AS MATERIALIZED (SELECT conv_id, turn, role, regexp_split_to_array(trim(regexp_replace(lower(ref), '[^\p{L}\p{N}_\s]', '', 'g')), '\s+') AS r,
   regexp_split_to_array(trim(regexp_replace(lower(hyp), '[^\p{L}\p{N}_\s]', '', 'g')), '\s+') AS h FROM tp),
ids AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, * FROM wd),
rw AS MATERIALIZED (SELECT id, CAST(unnest(range(1, len(r) + 1)) AS BIGINT) AS i, unnest(r) AS rword, len(h) AS m FROM ids),
hw AS MATERIALIZED (SELECT id, CAST(unnest(range(1, len(h) + 1)) AS BIGINT) AS j, unnest(h) AS hword FROM ids),
dp AS (SELECT id, CAST(0 AS BIGINT) AS i, CAST(unnest(range(0, len(h) + 1)) AS BIGINT) AS j, CAST(unnest(range(0, len(h) + 1)) AS BIGINT) AS v FROM ids
  UNION ALL SELECT id, i, j, j + min(t - j) OVER (PARTITION BY id ORDER BY j) FROM (
    SELECT d.id, d.i + 1 AS i, d.j, CASE WHEN d.j = 0 THEN d.i + 1 ELSE least(d.v + 1, lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j) + CASE WHEN hw.hword = rw.rword THEN 0 ELSE 1 END) END AS t
    FROM dp d JOIN rw ON rw.id = d.id AND rw.i = d.i + 1 LEFT JOIN hw ON hw.id = d.id AND hw.j = d.j) z),
fin AS (SELECT conv_id, turn, v AS edits, len(r) AS n FROM dp JOIN ids ON ids.id = dp.id WHERE dp.i = len(r) AND dp.j = len(h))"""


@query("wer", rcte(PAIRS) + "SELECT conv_id, turn, edits, n AS ref_words, round(edits / n, 6) AS wer FROM fin")
def wer(spark, sf):
    return metrics.with_wer(turn_pairs(spark, sf), "ref", "hyp").select("conv_id", "turn", "edits", "ref_words", F.round("wer", 6).alias("wer"))


# deletions and substitutions weigh 100000, insertions one more: the remainder counts the insertions of a best alignment with
# the fewest of them
COUNTED = (PAIRS.replace("range(0, len(h) + 1)) AS BIGINT) AS v FROM ids", "range(0, len(h) + 1)) AS BIGINT) * 100001 AS v FROM ids")
           .replace("j + min(t - j) OVER", "j * 100001 + min(t - j * 100001) OVER").replace("THEN d.i + 1 ELSE least(d.v + 1,", "THEN (d.i + 1) * 100000 ELSE least(d.v + 100000,")
           .replace("THEN 0 ELSE 1 END) END AS t", "THEN 0 ELSE 100000 END) END AS t")
           .replace("v AS edits, len(r) AS n FROM dp", "v // 100000 AS edits, v % 100000 AS ins, len(r) AS n, len(h) AS m FROM dp"))


@query("word_errors", rcte(COUNTED) + "SELECT conv_id, turn, edits - ins - (ins + n - m) AS substitutions, ins + n - m AS deletions, ins AS insertions FROM fin")
def word_errors(spark, sf):
    """Substitutions, deletions and insertions of each turn's best word alignment."""
    return metrics.with_wer(turn_pairs(spark, sf), "ref", "hyp").select("conv_id", "turn", "substitutions", "deletions", "insertions")


@query("wer_by_role", rcte(PAIRS) + """SELECT role, count(*) AS "rows", round(avg(edits / n), 6) AS mean_wer, round(sum(edits) / sum(n), 6) AS corpus_wer
  FROM fin JOIN tp USING (conv_id, turn) GROUP BY role""")
def wer_by_role(spark, sf):
    w = metrics.with_wer(turn_pairs(spark, sf), "ref", "hyp")
    return metrics.wer_report(w, ["role"], F.lit(True)).select("role", "rows", F.round("mean_wer", 6).alias("mean_wer"),
                                                               F.round("corpus_wer", 6).alias("corpus_wer"))
