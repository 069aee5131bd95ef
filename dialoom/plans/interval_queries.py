"""Registered queries over speaker segments: unions, overlaps, atoms, clamping, subtraction, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import slabs, spans
from dialoom.plans.registry import query
from dialoom.plans.views import BIN_MS, HYP, KEY, SEG, cte, hyp_events, seg_events, sliced

# SQL twins: interval union per key, two-deep regions, atoms
UNION = """u0 AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM seg),
u1 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_ms > top + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id
         ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM u0),
regions AS (SELECT recording_id, CAST(min(start_ms) AS BIGINT) AS start_ms, CAST(max(end_ms) AS BIGINT) AS end_ms,
         count(*) AS n_spans FROM u1 GROUP BY recording_id, island)"""
SPK_UNION = """su0 AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM seg WHERE end_ms > start_ms),
su1 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_ms > top THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, speaker
         ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM su0),
su AS (SELECT recording_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM su1
       GROUP BY recording_id, speaker, island)"""
STEPS = """ev AS (SELECT recording_id, t, sum(d) AS d FROM (SELECT recording_id, start_ms AS t, 1 AS d FROM seg
       UNION ALL SELECT recording_id, end_ms, -1 FROM seg) GROUP BY recording_id, t),
steps AS (SELECT recording_id, t, d, sum(d) OVER (PARTITION BY recording_id ORDER BY t) AS depth,
       lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS next_ms FROM ev)"""
BUSY = """flips AS (SELECT recording_id, t, depth >= 2 AS busy FROM steps WHERE (depth >= 2) <> (depth - d >= 2)),
busy AS (SELECT recording_id, t AS start_ms, nt AS end_ms FROM (SELECT *, lead(t) OVER (PARTITION BY recording_id
       ORDER BY t) AS nt FROM flips) WHERE busy)"""
ATOMS = """b AS (SELECT DISTINCT recording_id, unnest([start_ms, end_ms]) AS t FROM seg WHERE end_ms > start_ms),
a0 AS (SELECT recording_id, t AS start_ms, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS end_ms FROM b),
atoms AS (SELECT a.recording_id, a.start_ms, a.end_ms, count(*) AS depth,
       list_sort(list(DISTINCT s.speaker)) AS speakers
  FROM a0 a JOIN seg s ON s.recording_id = a.recording_id AND s.start_ms <= a.start_ms AND a.start_ms < s.end_ms
  WHERE a.end_ms IS NOT NULL GROUP BY 1, 2, 3)"""


@query("interval_union", cte(SEG, UNION.format(gap=60000)) + "SELECT * FROM regions")
def interval_union(spark, sf):
    seg, width = sliced(spark, sf)
    return spans.merge_spans(seg, KEY, 60_000, width)


@query("speaker_gap_merge", cte(SEG, """su0 AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id, speaker
    ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM seg),
  su1 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_ms > top + 300000 THEN 1 ELSE 0 END) OVER (PARTITION BY
    recording_id, speaker ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM su0)""") + """
  SELECT recording_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_spans
  FROM su1 GROUP BY recording_id, speaker, island""")
def speaker_gap_merge(spark, sf):
    seg, width = sliced(spark, sf)
    return spans.merge_spans(seg, [*KEY, "speaker"], 300_000, width)


@query("overlap_regions", cte(SEG, STEPS, BUSY) + "SELECT * FROM busy")
def overlap_regions(spark, sf):
    seg, width = sliced(spark, sf)
    return spans.busy_regions(seg, KEY, width=width)


@query("overlap_ratio", cte(SEG, STEPS, BUSY) + """
  SELECT s.recording_id, s.seg_id,
         CAST(coalesce(sum(CASE WHEN b.start_ms IS NULL THEN 0 ELSE greatest(0, least(s.end_ms+200, b.end_ms) - greatest(s.start_ms-100, b.start_ms)) END),0) AS BIGINT) AS overlap_ms,
         round(coalesce(sum(CASE WHEN b.start_ms IS NULL THEN 0 ELSE greatest(0, least(s.end_ms+200, b.end_ms) - greatest(s.start_ms-100, b.start_ms)) END),0)
               / (s.end_ms - s.start_ms + 300), 6) AS overlap_ratio
  FROM seg s LEFT JOIN busy b ON b.recording_id = s.recording_id AND b.start_ms < s.end_ms+200 AND b.end_ms > s.start_ms-100
  GROUP BY s.recording_id, s.seg_id, s.start_ms, s.end_ms""")
def overlap_ratio(spark, sf):
    seg, width = sliced(spark, sf)
    busy = spans.busy_regions(seg, KEY, width=width)
    padded = seg.select("recording_id", "seg_id", (F.col("start_ms") - 100).alias("start_ms"),
                        (F.col("end_ms") + 200).alias("end_ms"))
    out = spans.overlap_sum(padded, busy, KEY, ["seg_id"], "overlap_ms", width=width)
    return out.select("recording_id", "seg_id", "overlap_ms",
                      F.round(F.col("overlap_ms") / (F.col("end_ms") - F.col("start_ms")), 6).alias("overlap_ratio"))


@query("talk_time_share", cte(SEG) + """
  SELECT recording_id, speaker, CAST(sum(end_ms-start_ms) AS BIGINT) AS talk_ms, count(*) AS n_rows,
    round(sum(end_ms-start_ms) / sum(sum(end_ms-start_ms)) OVER (PARTITION BY recording_id), 6) AS dur_share,
    round(count(*) / sum(count(*)) OVER (PARTITION BY recording_id), 6) AS count_share
  FROM seg GROUP BY recording_id, speaker""")
def talk_time_share(spark, sf):
    seg = seg_events(spark, sf)
    dur = F.col("end_ms") - F.col("start_ms")
    by = seg.groupBy(*KEY, "speaker").agg(F.sum(dur).alias("talk_ms"), F.count(F.lit(1)).alias("n_rows"))
    tot = by.groupBy(*KEY).agg(F.sum("talk_ms").alias("_d"), F.sum("n_rows").alias("_n"))
    return by.join(tot, KEY).select(*KEY, "speaker", "talk_ms", "n_rows",
                                    F.round(F.col("talk_ms") / F.col("_d"), 6).alias("dur_share"),
                                    F.round(F.col("n_rows") / F.col("_n"), 6).alias("count_share"))


@query("atomic_intervals", cte(SEG, ATOMS) + """
  SELECT recording_id, start_ms, end_ms, depth, array_to_string(speakers, ',') AS speakers FROM atoms""")
def atomic_intervals(spark, sf):
    seg, width = sliced(spark, sf)
    at = spans.atomic_spans(seg, KEY, width)
    return (spans.active_speakers(at, seg, KEY, BIN_MS, width=width).groupBy(*KEY, "start_ms", "end_ms", "depth")
            .agg(F.array_join(F.array_sort(F.collect_set("active")), ",").alias("speakers")))


@query("two_speaker_overlap", cte(SEG, ATOMS, """
  p AS (SELECT *, CASE WHEN lag(end_ms) OVER w = start_ms AND lag(speakers) OVER w = speakers THEN 0 ELSE 1 END AS fresh
        FROM atoms WHERE len(speakers) = 2 WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms)),
  q AS (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY start_ms) AS g FROM p)""") + """
  SELECT recording_id, speakers[1] AS speaker_a, speakers[2] AS speaker_b, min(start_ms) AS start_ms, max(end_ms) AS end_ms
  FROM q GROUP BY recording_id, g, speakers""")
def two_speaker_overlap(spark, sf):
    seg, width = sliced(spark, sf)
    return spans.pair_regions(seg, KEY, BIN_MS, width)


def _removals(seg):
    """The middle third of every 5th segment, taken from its own speaker."""
    third = F.floor((F.col("end_ms") - F.col("start_ms")) / 3)
    return seg.filter("seg_id % 5 = 0").select(*KEY, "speaker", (F.col("start_ms") + third).alias("start_ms"),
                                               (F.col("end_ms") - third).alias("end_ms"))


@query("interval_subtract", cte(SEG, """
  r0 AS (SELECT recording_id, speaker, start_ms + (end_ms-start_ms)//3 AS start_ms, end_ms - (end_ms-start_ms)//3 AS end_ms
         FROM seg WHERE seg_id % 5 = 0),
  r1 AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r0),
  r2 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_ms > top THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, speaker
         ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM r1),
  rm AS (SELECT recording_id, speaker, min(start_ms) AS rs, max(end_ms) AS re FROM r2 GROUP BY 1, 2, g),
  hit AS (SELECT s.*, rs, re FROM seg s JOIN rm USING (recording_id, speaker) WHERE least(end_ms, re) > greatest(start_ms, rs)),
  fr AS (SELECT seg_id, coalesce(lag(re) OVER (PARTITION BY seg_id ORDER BY rs), start_ms) AS a, rs AS b FROM hit
         UNION ALL SELECT seg_id, max(re), end_ms FROM hit GROUP BY seg_id, end_ms)""") + """
  SELECT s.recording_id, s.seg_id, s.speaker, f.a AS start_ms, f.b AS end_ms FROM seg s JOIN fr f USING (seg_id) WHERE f.b > f.a
  UNION ALL SELECT recording_id, seg_id, speaker, start_ms, end_ms FROM seg
  WHERE end_ms > start_ms AND seg_id NOT IN (SELECT seg_id FROM hit)""")
def interval_subtract(spark, sf):
    seg, width = sliced(spark, sf)
    return spans.subtract(seg, _removals(seg), [*KEY, "speaker"], ["seg_id"], width).select(
        *KEY, "seg_id", "speaker", "start_ms", "end_ms")


@query("clamp_to_region", cte(SEG, HYP, UNION.format(gap=0), """
  c AS (SELECT h.seg_id, r.start_ms AS rs, r.end_ms AS re, row_number() OVER (PARTITION BY h.seg_id ORDER BY
         least(h.end_ms, r.end_ms) - greatest(h.start_ms, r.start_ms) DESC, r.start_ms) AS k
        FROM hyp h JOIN regions r ON r.recording_id = h.recording_id AND least(h.end_ms, r.end_ms) > greatest(h.start_ms, r.start_ms))""") + """
  SELECT h.recording_id, h.seg_id, coalesce(greatest(h.start_ms, rs), h.start_ms) AS clamped_start_ms,
         coalesce(least(h.end_ms, re), h.end_ms) AS clamped_end_ms
  FROM hyp h LEFT JOIN c ON c.seg_id = h.seg_id AND k = 1""")
def clamp_to_region(spark, sf):
    seg, width = sliced(spark, sf)
    regions = spans.merge_spans(seg, KEY, 0, width)
    out = spans.clamp_to_regions(hyp_events(spark, sf), regions, KEY, ["seg_id"], BIN_MS)
    return out.select(*KEY, "seg_id", "clamped_start_ms", "clamped_end_ms")


@query("gap_other_speaker", cte(SEG, """
  g AS (SELECT recording_id, speaker, seg_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY recording_id, speaker
        ORDER BY start_ms, end_ms, seg_id) AS end_ms FROM seg)""") + """
  SELECT recording_id, speaker, seg_id, start_ms, end_ms FROM g
  WHERE end_ms > start_ms AND EXISTS (SELECT 1 FROM seg s WHERE s.recording_id = g.recording_id AND s.speaker <> g.speaker
        AND s.end_ms > s.start_ms AND s.start_ms < g.end_ms AND s.end_ms > g.start_ms)""")
def gap_other_speaker(spark, sf):
    seg, width = sliced(spark, sf)
    keys = [*KEY, "speaker"]
    wide = slabs.with_slab(seg, "start_ms", width)
    nxt = slabs.neighbour(wide, keys, ["start_ms", "end_ms", "seg_id"], 1, {"next_start": F.col("start_ms")})
    gaps = nxt.select(*keys, "seg_id", F.col("end_ms").alias("start_ms"), F.col("next_start").alias("end_ms"))
    gaps = gaps.filter("end_ms > start_ms")
    return spans.other_speaker_in_gap(gaps, seg, KEY, ["speaker", "seg_id"], BIN_MS, width=width).select(
        *keys, "seg_id", "start_ms", "end_ms")


@query("split_long", cte(SEG) + """
  SELECT recording_id, seg_id, n_parts, part, start_ms + (end_ms-start_ms)*part//n_parts AS part_start_ms,
         start_ms + (end_ms-start_ms)*(part+1)//n_parts AS part_end_ms
  FROM (SELECT *, unnest(range(n_parts)) AS part FROM (SELECT *, CAST(greatest(ceil((end_ms-start_ms)/30000.0),1) AS BIGINT) AS n_parts FROM seg))""")
def split_long(spark, sf):
    return spans.split_long(seg_events(spark, sf), 30_000).select(
        *KEY, "seg_id", "n_parts", "part", "part_start_ms", "part_end_ms")


@query("neighbor_support", cte(SEG) + """
  SELECT s.recording_id, s.seg_id, s.speaker, CAST(coalesce(sum(CASE WHEN n.seg_id % 3 = 0 THEN 100 WHEN n.seg_id % 3 = 1 THEN 70 ELSE 2 END
     * (greatest(0, least(n.end_ms, s.start_ms) - greatest(n.start_ms, s.start_ms-600000))
      + greatest(0, least(n.end_ms, s.end_ms+600000) - greatest(n.start_ms, s.end_ms)))),0) AS BIGINT) AS support
  FROM seg s LEFT JOIN seg n ON n.recording_id = s.recording_id AND n.speaker = s.speaker
    AND n.start_ms < s.end_ms+600000 AND n.end_ms > s.start_ms-600000
  GROUP BY s.recording_id, s.seg_id, s.speaker""")
def neighbor_support(spark, sf):
    """Tier-weighted talk of the same speaker within ten minutes left and right, fallback-heavy rows at a tenth."""
    from dialoom.functions.tiers import tier_of, support_weight
    seg, width = sliced(spark, sf)
    seg = seg.withColumn("tier", tier_of(F.col("seg_id")))
    s, e = F.col("start_ms"), F.col("end_ms")
    out = spans.overlap_sum(seg.select(*KEY, "speaker", "seg_id", "start_ms", "end_ms"), seg, [*KEY, "speaker"],
                            ["seg_id"], "support", windows=[(s - 600_000, s), (e, e + 600_000)],
                            weight=support_weight(F.col("tier")), width=width)
    return out.select(*KEY, "seg_id", "speaker", "support")


@query("best_overlap_match", cte(SEG, HYP, """
  m AS (SELECT h.seg_id AS hyp_id, s.seg_id AS ref_id, least(h.end_ms, s.end_ms) - greatest(h.start_ms, s.start_ms) AS overlap_ms
        FROM hyp h JOIN seg s ON s.recording_id = h.recording_id AND least(h.end_ms, s.end_ms) - greatest(h.start_ms, s.start_ms) > 500),
  k AS (SELECT *, row_number() OVER (PARTITION BY hyp_id ORDER BY overlap_ms DESC, ref_id) AS k FROM m)""") + """
  SELECT h.recording_id, h.seg_id AS hyp_id, k.ref_id, k.overlap_ms FROM hyp h LEFT JOIN k ON k.hyp_id = h.seg_id AND k = 1""")
def best_overlap_match(spark, sf):
    from dialoom.operators.metrics import best_match
    return best_match(hyp_events(spark, sf), seg_events(spark, sf), KEY).select(
        *KEY, F.col("seg_id").alias("hyp_id"), "ref_id", "overlap_ms")
