"""Registered queries over scored segments: zones, score vectors, relabelling, second opinions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import tiers
from dialoom.operators import relabel, spans, speakers
from dialoom.plans.registry import query
from dialoom.plans.sequence_queries import rcte
from dialoom.plans.views import KEY, SEG, SPEAKERS, cte, sliced

N = 3
BIN_MS = 10_000


def scored_segments(spark, sf):
    """Segments of three speakers with a tier and a score per speaker, derived from the events on a 40 times faster clock."""
    seg, width = sliced(spark, sf)
    width = max(1, width // 40)
    fast = lambda c: F.floor(F.col(c) / 40).cast("long").alias(c)
    seg = seg.select("recording_id", "seg_id", "speaker", fast("start_ms"), fast("end_ms"))
    idx = (F.array_position(F.array(*[F.lit(s) for s in SPEAKERS]), F.col("speaker")) - 1) % 3
    i = F.col("seg_id")
    sims = F.array(*[(i * (37 + 11 * k)) % 100 / F.lit(200.0) + F.when(F.col("_k") == k, 0.4).otherwise(0.0) for k in range(N)])
    d = seg.withColumn("_k", idx)
    return d.select("recording_id", "seg_id", F.concat(F.lit("SPK_"), F.col("_k").cast("string")).alias("speaker"), "start_ms", "end_ms",
                    tiers.tier_of(i).alias("tier"), sims.alias("sims")), width


SCORED = """sc AS (SELECT recording_id, seg_id, k, 'SPK_' || k AS speaker, start_ms//40 AS start_ms, end_ms//40 AS end_ms, CASE seg_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'aux' ELSE 'fallback' END AS tier,
   CASE seg_id % 3 WHEN 0 THEN 10000 WHEN 1 THEN 7000 ELSE 100 END AS w, (seg_id*37)%100/200.0 + CASE WHEN k = 0 THEN 0.4 ELSE 0 END AS v0,
   (seg_id*48)%100/200.0 + CASE WHEN k = 1 THEN 0.4 ELSE 0 END AS v1, (seg_id*59)%100/200.0 + CASE WHEN k = 2 THEN 0.4 ELSE 0 END AS v2
   FROM (SELECT *, (list_position(['click','error','purchase','signup','view'], speaker) - 1) % 3 AS k FROM seg))"""
PROFILE = """pb AS (SELECT DISTINCT recording_id, unnest([start_ms, end_ms]) AS t FROM sc WHERE end_ms > start_ms),
pi AS (SELECT recording_id, t AS a, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS b FROM pb),
pa AS (SELECT pi.recording_id, a AS start_ms, b AS end_ms, count(*) AS depth, count(DISTINCT k) AS n_speakers, max(k) AS idx, sum(w) AS w,
   sum(v0*w)/sum(w) AS v0, sum(v1*w)/sum(w) AS v1, sum(v2*w)/sum(w) AS v2, count(*) FILTER (tier = 'fallback') AS heavy
   FROM pi JOIN sc ON sc.recording_id = pi.recording_id AND sc.start_ms <= a AND a < sc.end_ms WHERE b IS NOT NULL GROUP BY 1, 2, 3),
pp AS (SELECT *, list_reverse_sort([v0, v1, v2]) AS s, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS top1, [v0, v1, v2][idx+1] AS cur FROM pa)"""


def merged(src: str, extra: str = "") -> str:
    return f"""m0 AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id, idx ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {src}),
m1 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_ms > top THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, idx ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM m0),
zz AS (SELECT recording_id, 'SPK_' || idx AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms{extra} FROM m1 GROUP BY recording_id, idx, g)"""


@query("profiled_atoms", cte(SEG, SCORED, PROFILE) + """SELECT recording_id, start_ms, end_ms, depth, n_speakers, round(s[1] - s[2], 4) AS margin, round(s[1], 4) AS top1_score, heavy FROM pp""")
def profiled_atoms(spark, sf):
    rows, width = scored_segments(spark, sf)
    a = relabel.profiled_atoms(rows, KEY, N, width)
    return a.select(*KEY, "start_ms", "end_ms", "depth", "n_speakers", F.round("margin", 4).alias("margin"), F.round("top1_score", 4).alias("top1_score"), "heavy")


@query("stable_zones", cte(SEG, SCORED, PROFILE, "sz AS (SELECT * FROM pp WHERE n_speakers = 1 AND round(round(s[1],9)-round(s[2],9),9) >= 0.14 AND round(s[1]-cur,9) <= 0.06 AND top1 = idx AND heavy = 0)",
       merged("sz")) + "SELECT * FROM zz WHERE end_ms - start_ms >= 900")
def stable_zones(spark, sf):
    rows, width = scored_segments(spark, sf)
    return relabel.stable_zones(relabel.cut_lineage(relabel.profiled_atoms(rows, KEY, N, width)), KEY, width)


@query("trusted_rows", cte(SEG, SCORED, PROFILE, "sz AS (SELECT * FROM pp WHERE n_speakers = 1 AND round(round(s[1],9)-round(s[2],9),9) >= 0.06 AND top1 = idx AND heavy = 0 AND end_ms - start_ms >= 250)",
       merged("sz", ", round(max(cur), 4) AS score")) + "SELECT * FROM zz")
def trusted_rows(spark, sf):
    rows, width = scored_segments(spark, sf)
    return relabel.trusted_rows(relabel.cut_lineage(relabel.profiled_atoms(rows, KEY, N, width)), KEY, width).withColumn("score", F.round("score", 4))


@query("zone_coverage", cte(SEG, SCORED, PROFILE, "sz AS (SELECT * FROM pp WHERE n_speakers = 1 AND round(round(s[1],9)-round(s[2],9),9) >= 0.14 AND round(s[1]-cur,9) <= 0.06 AND top1 = idx AND heavy = 0)",
       merged("sz"), "z9 AS (SELECT * FROM zz WHERE end_ms - start_ms >= 900)") + """
  SELECT s.recording_id, s.seg_id, CAST(sum(CASE WHEN z.start_ms IS NULL THEN 0 ELSE greatest(0, least(s.end_ms, z.end_ms) - greatest(s.start_ms, z.start_ms)) END) AS BIGINT) AS inside_ms,
    CAST(sum(CASE WHEN z.start_ms IS NULL THEN 0 ELSE greatest(0, least(s.start_ms, z.end_ms) - greatest(s.start_ms-1500, z.start_ms)) + greatest(0, least(s.end_ms+1500, z.end_ms) - greatest(s.end_ms, z.start_ms)) END) AS BIGINT) AS context_ms
  FROM sc s LEFT JOIN z9 z ON z.recording_id = s.recording_id AND z.speaker = s.speaker AND z.start_ms < s.end_ms+1500 AND z.end_ms > s.start_ms-1500 GROUP BY 1, 2""")
def zone_coverage(spark, sf):
    """Time of the own speaker's stable zones inside each segment and within 1.5 s around it."""
    rows, width = scored_segments(spark, sf)
    z = relabel.cut_lineage(relabel.stable_zones(relabel.cut_lineage(relabel.profiled_atoms(rows, KEY, N, width)), KEY, width))
    s, e = F.col("start_ms"), F.col("end_ms")
    base = rows.select(*KEY, "speaker", "seg_id", "start_ms", "end_ms")
    a = spans.overlap_sum(base, z, [*KEY, "speaker"], ["seg_id"], "inside_ms", width=width)
    b = spans.overlap_sum(base, z, [*KEY, "speaker"], ["seg_id"], "context_ms", windows=[(s - 1500, s), (e, e + 1500)], width=width)
    return a.select(*KEY, "seg_id", "inside_ms").join(b.select(*KEY, "seg_id", "context_ms"), [*KEY, "seg_id"])


@query("span_score_vectors", cte(SEG, SCORED) + """
  SELECT a.recording_id, a.seg_id, round(coalesce(sum(o*w*b.v0)/sum(o*w), 0), 4) AS v0, round(coalesce(sum(o*w*b.v1)/sum(o*w), 0), 4) AS v1, round(coalesce(sum(o*w*b.v2)/sum(o*w), 0), 4) AS v2
  FROM (SELECT a.recording_id, a.seg_id, b.seg_id AS bid, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS o FROM sc a JOIN sc b ON b.recording_id = a.recording_id
    AND least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms)) a JOIN sc b ON b.seg_id = a.bid GROUP BY 1, 2""")
def span_score_vectors(spark, sf):
    """Overlap-weighted mean score vector of every segment over all segments of its recording."""
    rows, width = scored_segments(spark, sf)
    v = relabel.span_score_vectors(rows.filter("end_ms > start_ms"), rows, KEY, ["seg_id"], N, width)
    return v.select(*KEY, "seg_id", *[F.round(F.get("score_vector", F.lit(i)), 4).alias(f"v{i}") for i in range(N)])


@query("merged_scored_rows", rcte(SEG, SCORED, """n AS MATERIALIZED (SELECT recording_id, speaker, start_ms, end_ms, tier, v0, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms, seg_id) AS k FROM sc)""",
    """w AS (SELECT recording_id, speaker, k, 0 AS isl, start_ms AS s, end_ms AS e, tier, v0 FROM n WHERE k = 1
    UNION ALL SELECT n.recording_id, n.speaker, n.k, w.isl + x.f, CASE WHEN f = 1 THEN n.start_ms ELSE least(w.s, n.start_ms) END, CASE WHEN f = 1 THEN n.end_ms ELSE greatest(w.e, n.end_ms) END,
      CASE WHEN f = 1 OR w.e - w.s < n.end_ms - n.start_ms THEN n.tier ELSE w.tier END,
      CASE WHEN f = 1 THEN n.v0 ELSE ((w.e - w.s)*w.v0 + (n.end_ms - n.start_ms)*n.v0) / greatest(w.e - w.s + n.end_ms - n.start_ms, 1e-8) END
    FROM w JOIN n ON n.recording_id = w.recording_id AND n.speaker = w.speaker AND n.k = w.k + 1, LATERAL (SELECT CASE WHEN n.start_ms > w.e + 300 THEN 1 ELSE 0 END AS f) x)""")
    + "SELECT recording_id, speaker, arg_max(s, k) AS start_ms, arg_max(e, k) AS end_ms, arg_max(tier, k) AS tier, round(arg_max(v0, k), 6) AS v0 FROM w GROUP BY recording_id, speaker, isl")
def merged_scored_rows(spark, sf):
    """Pairwise merging of scored rows (order-dependent: a fold)."""
    rows, width = scored_segments(spark, sf)
    m = relabel.merge_scored_rows(rows, KEY, "seg_id", width)
    return m.select(*KEY, "speaker", "start_ms", "end_ms", "tier", F.round(F.get("sims", F.lit(0)), 6).alias("v0"))


@query("hub_penalty", cte(SEG, SCORED, "b AS (SELECT recording_id, speaker, sum(end_ms-start_ms) AS d, count(*) AS n, coalesce(sum(end_ms-start_ms) FILTER (tier='fallback'), 0) AS f FROM sc GROUP BY 1, 2)",
       """r AS (SELECT recording_id, speaker, 0.55*greatest(0, (d/sum(d) OVER w - 0.34)/0.1) + 0.25*greatest(0, (n/sum(n) OVER w - 0.34)/0.1) + 0.06*f/greatest(d, 1e-8) AS raw FROM b WINDOW w AS (PARTITION BY recording_id))""")
       + "SELECT recording_id, speaker, round(CASE WHEN raw > 0 THEN pow(raw, 1.55) ELSE 0 END, 5) AS penalty FROM r")
def hub_penalty(spark, sf):
    rows, _ = scored_segments(spark, sf)
    return speakers.hub_penalty(rows, KEY).withColumn("penalty", F.round("penalty", 5))


@query("dominant_tier", cte(SEG, SCORED) + """SELECT recording_id, speaker, arg_max(tier, d) AS dominant_tier FROM (SELECT recording_id, speaker, tier, sum(end_ms-start_ms) AS d FROM sc GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def dominant_tier(spark, sf):
    rows, _ = scored_segments(spark, sf)
    return speakers.dominant_tier(rows, [*KEY, "speaker"])


@query("temporal_relabel")
def temporal_relabel(spark, sf):
    rows, width = scored_segments(spark, sf)
    return relabel.temporal_relabel(rows, KEY, N, width).drop("vec")


@query("temporal_relabelled_rows")
def temporal_relabelled_rows(spark, sf):
    rows, width = scored_segments(spark, sf)
    rel = relabel.cut_lineage(relabel.temporal_relabel(rows, KEY, N, width))
    return relabel.apply_relabels(rows, rel, KEY, "seg_id", BIN_MS, width).select(*KEY, "seg_id", "speaker", "start_ms", "end_ms", "tier")


def _second(spark, sf):
    rows, width = scored_segments(spark, sf)
    shift = (F.col("seg_id") % 7 - 3) * 500
    other = rows.select(*KEY, "seg_id", F.concat(F.lit("vbx_"), F.when(F.col("seg_id") % 9 == 0, (F.substring("speaker", 5, 1).cast("int") + 1) % 3)
                                                .otherwise(F.substring("speaker", 5, 1).cast("int")).cast("string")).alias("speaker"),
                        (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))
    atoms = relabel.cut_lineage(relabel.profiled_atoms(rows, KEY, N, width))
    anchors = relabel.cut_lineage(relabel.trusted_rows(atoms, KEY, width))
    scores = relabel.cut_lineage(relabel.second_opinion_scores(rows, other, anchors, KEY, N, width, BIN_MS))
    return rows, other, scores, width


@query("second_opinion_map")
def second_opinion_map(spark, sf):
    rows, other, scores, width = _second(spark, sf)
    return speakers.second_opinion_map(scores, KEY).select(*KEY, "other", "local", F.round("score", 6).alias("score"))


@query("mapping_health")
def mapping_health(spark, sf):
    from dialoom.operators.metrics import mapping_health as health
    rows, other, scores, width = _second(spark, sf)
    h = health(speakers.second_opinion_map(scores, KEY), KEY)
    return h.withColumns({"avg_score": F.round("avg_score", 6), "coverage": F.round("coverage", 6)})


@query("second_opinion_relabel")
def second_opinion_relabel(spark, sf):
    rows, other, scores, width = _second(spark, sf)
    m = speakers.second_opinion_map(scores, KEY)
    return relabel.second_opinion_relabel(rows, other, m, KEY, N, width, BIN_MS).drop("vec")
