"""Registered queries over embeddings, frames derived from them, and scored segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import tiers, vectors as fv
from dialoom.operators import frames, speakers
from dialoom.operators import vectors as ov
from dialoom.plans.registry import query
from dialoom.plans.views import VECTORS, cte, vectors

REC = ["recording_id"]


def anchors(spark, sf):
    """Sixty embeddings per recording, five chunks of twelve, three tracks; a hundred recordings make a series."""
    v = vectors(spark, sf)
    i = F.col("vec_id")
    start = F.floor(i % 60 / 12) * 16_000 + (i % 4) * 1500
    return v.select(
        i, F.concat(F.lit("rec_"), F.floor(i / 60)).alias("recording_id"), F.floor(i / 6000).cast("long").alias("series"), F.floor(i % 60 / 12).cast("long").alias("chunk"),
        (i % 3).alias("track"), "speaker", F.substring("speaker", 5, 10).cast("long").alias("label0"), "embedding",
        (F.lit(0.3) + (i % 20) / 10).alias("used_dur"), tiers.tier_of(F.floor(i / 2)).alias("tier"),
        start.cast("long").alias("start_ms"), (start + 1200).cast("long").alias("end_ms"))


ANCHORS = """anchors AS (SELECT vec_id, 'rec_' || (vec_id//60) AS recording_id, vec_id//6000 AS series, (vec_id%60)//12 AS chunk, vec_id%3 AS track, speaker,
   CAST(substr(speaker, 5) AS BIGINT) AS label0, embedding, 0.3 + (vec_id%20)/10 AS used_dur,
   CASE (vec_id//2)%3 WHEN 0 THEN 'primary' WHEN 1 THEN 'aux' ELSE 'fallback' END AS tier,
   (vec_id%60)//12*16000 + (vec_id%4)*1500 AS start_ms, (vec_id%60)//12*16000 + (vec_id%4)*1500 + 1200 AS end_ms FROM vectors)"""


def cent_sql(src: str, keys: str, weight: str, out: str) -> str:
    return f"""{out}0 AS (SELECT {keys}, i, sum(x*w)/sum(w) AS v FROM (SELECT {keys}, {weight} AS w, unnest(range(1, len(embedding)+1)) AS i, unnest(embedding) AS x FROM {src}) GROUP BY {keys}, i),
{out}1 AS (SELECT {keys}, sqrt(sum(v*v)) AS n FROM {out}0 GROUP BY {keys}),
{out} AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, list(v / n ORDER BY i) AS c FROM {out}0 a JOIN {out}1 b ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))} GROUP BY {', '.join('a.' + k.strip() for k in keys.split(','))})"""


@query("centroids", cte(VECTORS, ANCHORS, cent_sql("anchors", "speaker", "used_dur", "ce")) +
       "SELECT speaker, unnest(range(len(c))) AS dim, round(unnest(c), 6) AS v FROM ce")
def centroids(spark, sf):
    c = ov.centroids(anchors(spark, sf), ["speaker"], weight=F.col("used_dur"))
    return c.select("speaker", F.posexplode("centroid").alias("dim", "v")).select("speaker", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


def speaker_centroids(spark, sf):
    """Anchors and the centroid of every speaker of a series."""
    a = anchors(spark, sf)
    return a, ov.centroids(a, ["series", "speaker"], weight=F.col("used_dur"))


def packed_series(c):
    return ov.packed_centroids(c.withColumn("label", F.substring("speaker", 5, 10).cast("long")), ["series"], "label")


SIMS = """sm AS (SELECT a.*, l.label, list_dot_product(a.embedding, l.c) / sqrt(list_dot_product(a.embedding, a.embedding)) AS s
   FROM anchors a JOIN (SELECT series, speaker, CAST(substr(speaker, 5) AS BIGINT) AS label, c FROM ce) l ON l.series = a.series),
tp AS (SELECT vec_id, max(s) FILTER (k = 1) AS top1_score, max(label) FILTER (k = 1) AS top1_label, max(s) FILTER (k = 2) AS top2_score
   FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM sm) GROUP BY vec_id)"""


def scored_anchors(spark, sf):
    """Anchors with cosines to the centroids of their series' ten speakers (one packed row per series)."""
    a, c = speaker_centroids(spark, sf)
    return ov.scored(a, packed_series(c), ["series"]).drop("cents")


@query("nearest_centroid", cte(VECTORS, ANCHORS, cent_sql("anchors", "series, speaker", "used_dur", "ce"), SIMS) + """
  SELECT vec_id, top1_label, round(top1_score, 6) AS score, round(top1_score - top2_score, 6) AS margin,
    top1_score >= CASE tier WHEN 'primary' THEN 0.20 WHEN 'aux' THEN 0.22 ELSE 0.26 END AS valid FROM tp JOIN anchors USING (vec_id)""")
def nearest_centroid(spark, sf):
    r = speakers.initial_assignment(scored_anchors(spark, sf))
    return r.select("vec_id", F.col("label").alias("top1_label"), F.round("score", 6).alias("score"),
                    F.round(F.col("top1_score") - F.col("top2_score"), 6).alias("margin"), "valid")


@query("knn_top8", cte(VECTORS, ANCHORS, cent_sql("anchors", "speaker", "used_dur", "ce")) + """
  SELECT speaker, vec_id, score, rank FROM (SELECT c.speaker, v.vec_id, round(list_dot_product(c.c, v.embedding), 6) AS score,
    row_number() OVER (PARTITION BY c.speaker ORDER BY round(list_dot_product(c.c, v.embedding), 6) DESC, v.vec_id) AS rank FROM ce c CROSS JOIN vectors v) WHERE rank <= 8""")
def knn_top8(spark, sf):
    """The eight vectors nearest to each speaker's centroid."""
    c = ov.centroids(anchors(spark, sf), ["speaker"], weight=F.col("used_dur"))
    return ov.nearest(c, vectors(spark, sf), 8, "speaker", "vec_id", "centroid", "embedding").select(
        "speaker", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def assigned(spark, sf):
    r = speakers.initial_assignment(scored_anchors(spark, sf))
    return speakers.with_margin(speakers.resolve_collisions(r, "vec_id"))


@query("collision_resolved")
def collision_resolved(spark, sf):
    """Labels after same-chunk collisions are settled (a fold per chunk: no SQL twin)."""
    return assigned(spark, sf).select("vec_id", "label", F.round("score", 6).alias("score"), "valid", F.round("margin", 6).alias("margin"))


VOTES = """va AS (SELECT a.*, t.top1_label AS label, t.top1_score AS score, t.top1_score - t.top2_score AS margin FROM anchors a JOIN tp t USING (vec_id)
   WHERE t.top1_score >= CASE tier WHEN 'primary' THEN 0.20 WHEN 'aux' THEN 0.22 ELSE 0.26 END),
wv AS (SELECT *, CASE tier WHEN 'primary' THEN 3.0 WHEN 'aux' THEN 1.5 ELSE 0.75 END * greatest(score, 1e-4) AS w FROM va)"""


@query("track_votes", cte(VECTORS, ANCHORS, cent_sql("anchors", "series, speaker", "used_dur", "ce"), SIMS, VOTES,
       "pv AS (SELECT recording_id, chunk, track, label, sum(w) AS v, min(vec_id) AS f FROM wv GROUP BY 1, 2, 3, 4)") + """
  SELECT recording_id, chunk, track, label, round(v, 6) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk, track ORDER BY round(v, 9) DESC, f) AS k FROM pv) WHERE k = 1""")
def track_votes(spark, sf):
    r = speakers.initial_assignment(scored_anchors(spark, sf))
    return speakers.track_votes(r, "vec_id").select("recording_id", "chunk", "track", "label", F.round("votes", 6).alias("votes"))


@query("track_profile", cte(VECTORS, ANCHORS, cent_sql("anchors", "series, speaker", "used_dur", "ce"), SIMS, VOTES, """
  ms AS (SELECT recording_id, chunk, track, sm.label, avg(sm.s) AS m FROM sm WHERE vec_id IN (SELECT vec_id FROM va) GROUP BY 1, 2, 3, 4),
  mk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk, track ORDER BY m DESC, label) AS k FROM ms),
  mt AS (SELECT recording_id, chunk, track, max(label) FILTER (k=1) AS top1_label, max(m) FILTER (k=1) AS s1, max(m) FILTER (k=2) AS s2 FROM mk GROUP BY 1, 2, 3),
  ag AS (SELECT recording_id, chunk, track, avg(score) AS best_sim, avg(margin) AS avg_margin, coalesce(sum(w) FILTER (tier='primary'), 0)/sum(w) AS p,
    coalesce(sum(w) FILTER (tier='aux'), 0)/sum(w) AS a, coalesce(sum(w) FILTER (tier='fallback'), 0)/sum(w) AS f FROM wv GROUP BY 1, 2, 3)""") + """
  SELECT recording_id, chunk, track, round(best_sim, 6) AS best_sim, round(avg_margin, 6) AS avg_margin, round(p, 6) AS primary_vote_ratio, round(f, 6) AS fallback_vote_ratio,
    top1_label, round(s1 - s2, 6) AS top1_minus_top2, CASE WHEN p >= a AND p >= f THEN 'primary' WHEN a >= f THEN 'aux' ELSE 'fallback' END AS dominant_tier
  FROM ag JOIN mt USING (recording_id, chunk, track)""")
def track_profile(spark, sf):
    r = speakers.with_margin(speakers.initial_assignment(scored_anchors(spark, sf)))
    p = speakers.track_profile(r)
    return p.select("recording_id", "chunk", "track", *[F.round(c, 6).alias(c) for c in ("best_sim", "avg_margin", "primary_vote_ratio", "fallback_vote_ratio", "top1_minus_top2")],
                    F.col("top1_label").cast("long").alias("top1_label"), "dominant_tier")


def _slots(spark, sf):
    """All slots of 12 chunks and 3 tracks; the label of a slot is known where its number allows."""
    a = anchors(spark, sf)
    return a.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("chunk"), "track").distinct()


@query("nearest_chunk_label", cte(VECTORS, ANCHORS, """
  own AS (SELECT recording_id, chunk*2 AS chunk, track, min(label0) AS label FROM anchors WHERE chunk % 3 <> 1 GROUP BY 1, 2, 3),
  sl AS (SELECT DISTINCT recording_id, unnest(range(12)) AS chunk, track FROM anchors),
  nr AS (SELECT s.recording_id, s.chunk, s.track, o.label, abs(o.chunk - s.chunk) AS gap, row_number() OVER (PARTITION BY s.recording_id, s.chunk, s.track ORDER BY abs(o.chunk - s.chunk), o.chunk) AS k
    FROM sl s JOIN own o ON o.recording_id = s.recording_id AND o.track = s.track)""") + """
  SELECT recording_id, chunk, track, label AS final_label, CASE WHEN gap = 0 THEN 'own' ELSE 'neighbour' END AS rule FROM nr WHERE k = 1 AND gap <= 4""")
def nearest_chunk_label(spark, sf):
    """Propagation from labelled chunks (every third one missing) to the track's other chunks."""
    a = anchors(spark, sf)
    own = a.filter("chunk % 3 <> 1").groupBy("recording_id", (F.col("chunk") * 2).alias("chunk"), "track").agg(F.min("label0").alias("label"))
    none = own.limit(0).select("recording_id", "chunk", "track", "label", F.lit("").alias("dominant_tier"), F.lit(0.0).alias("top1_score"), F.lit(0.0).alias("top1_minus_top2"))
    out = speakers.propagate(_slots(spark, sf), own.withColumn("best_sim", F.lit(0.5)), none)
    return out.filter(F.col("rule").isin("own", "neighbour"))


@query("propagated_tracks")
def propagated_tracks(spark, sf):
    """All propagation rules over voted labels and forced profiles."""
    rows = assigned(spark, sf)
    a, c = speaker_centroids(spark, sf)
    packed = a.select("recording_id", "series").distinct().join(packed_series(c), "series").drop("series")
    mapped = speakers.track_votes(rows, "vec_id").join(speakers.track_profile(rows).select("recording_id", "chunk", "track", "best_sim"), speakers.TRACK)
    forced = speakers.force_profile(a, packed)
    return speakers.propagate(_slots(spark, sf), mapped, forced)


@query("anchor_clusters")
def anchor_clusters(spark, sf):
    """Constrained average linkage, three clusters per recording (iterative: no SQL twin)."""
    return speakers.cluster_anchors(anchors(spark, sf), REC, "vec_id", k=3)


@query("threshold_clusters")
def threshold_clusters(spark, sf):
    return speakers.cluster_anchors(anchors(spark, sf).drop("chunk", "track"), REC, "vec_id", threshold=0.75)


@query("speaker_seeds")
def speaker_seeds(spark, sf):
    """Enrolled speakers (labels 0 and 1) plus unmatched clusters as unknowns, three per recording."""
    a = anchors(spark, sf)
    cl = a.join(speakers.cluster_anchors(a, REC, "vec_id", k=3), [*REC, "vec_id"])
    cents = ov.centroids(cl, [*REC, "cluster"], weight=F.col("used_dur"))
    enrolled = ov.centroids(a.filter("label0 <= 1"), [*REC, "speaker"], weight=F.col("used_dur")).withColumnRenamed("speaker", "name")
    return speakers.seed_table(enrolled.select(*REC, "name", "centroid"), cents.select(*REC, "cluster", "centroid"), REC, 3).drop("centroid")


@query("purify_gates", cte(VECTORS, ANCHORS, cent_sql("anchors", "series, speaker", "used_dur", "ce"), SIMS) + """
  SELECT gate, count(*) AS n FROM (SELECT CASE WHEN top1_score < CASE tier WHEN 'primary' THEN 0.20 WHEN 'aux' THEN 0.22 ELSE 0.26 END THEN 'invalid'
    WHEN tier NOT IN ('primary', 'aux') THEN 'tier' WHEN used_dur < 1.2 THEN 'short' WHEN top1_score < 0.35 THEN 'low_sim' WHEN top1_score - top2_score < 0.12 THEN 'low_margin' ELSE 'ok' END AS gate
    FROM tp JOIN anchors USING (vec_id)) GROUP BY gate""")
def purify_gates(spark, sf):
    r = speakers.with_margin(speakers.initial_assignment(scored_anchors(spark, sf)))
    return ov.purify_gates(r).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query("purified_centroids", cte(VECTORS, ANCHORS, cent_sql("anchors", "series, speaker", "used_dur", "ce"), SIMS, """
  ok AS (SELECT a.vec_id, a.series, a.embedding, 'SPK_' || top1_label AS speaker, used_dur * greatest(top1_score, 1e-4) AS w FROM tp JOIN anchors a USING (vec_id)
    WHERE top1_score >= CASE tier WHEN 'primary' THEN 0.20 WHEN 'aux' THEN 0.22 ELSE 0.26 END AND tier IN ('primary', 'aux') AND used_dur >= 1.2 AND top1_score >= 0.35 AND top1_score - top2_score >= 0.12),
  pn AS (SELECT series, speaker, count(*) AS n, sum(w) AS lw FROM ok GROUP BY series, speaker),
  hl AS (SELECT series, sum(coalesce(n, 0)) AS total, min(coalesce(n, 0)) AS low, max(coalesce(n, 0)) AS high, sum(lw) AS tw FROM ce LEFT JOIN pn USING (series, speaker) GROUP BY series),
  rk AS (SELECT ok.*, row_number() OVER (PARTITION BY ok.series, ok.speaker ORDER BY w DESC, vec_id) AS r, n, CASE WHEN lw / tw > 0.44 THEN greatest(1, floor(n * 0.44)) ELSE n END AS keep
    FROM ok JOIN pn USING (series, speaker) JOIN hl USING (series) WHERE total >= 18 AND low >= 3 AND high / greatest(low, 1) <= 6 AND n >= 18),
  ch AS (SELECT * FROM rk WHERE r <= keep)""", cent_sql("ch", "series, speaker", "w", "fr"), """
  bl AS (SELECT ce.series, ce.speaker, CASE WHEN fr.c IS NOT NULL THEN list_transform(list_zip(fr.c, ce.c), lambda z: z[1] * 0.85 + z[2] * 0.15) END AS b, ce.c FROM ce LEFT JOIN fr USING (series, speaker))""") + """
  SELECT series, speaker, round(CASE WHEN b IS NULL THEN 1.0 ELSE list_dot_product(c, b) / sqrt(list_dot_product(b, b)) END, 6) AS shift_cosine FROM bl""")
def purified_centroids(spark, sf):
    rows = speakers.with_margin(speakers.initial_assignment(scored_anchors(spark, sf)))
    rows = rows.withColumn("speaker", F.concat(F.lit("SPK_"), F.col("label").cast("string")))
    _, c = speaker_centroids(spark, sf)
    return ov.purify(rows, c.select("series", "speaker", "centroid"), ["series"], "speaker", "vec_id").select(
        "series", "speaker", F.round("shift_cosine", 6).alias("shift_cosine"))


# ---- frames -----------------------------------------------------------------------------------------------------------

def frame_table(spark, sf):
    """64 frames per embedding: one (recording, chunk, track) each, activity in stretches of eight frames."""
    v = vectors(spark, sf).select("vec_id", F.posexplode("embedding").alias("frame", "x"))
    i, f, t = F.col("vec_id"), F.col("frame"), F.col("vec_id") % 3
    return v.select(F.concat(F.lit("rec_"), F.floor(i / 60)).alias("recording_id"), F.floor(i % 60 / 3).cast("long").alias("chunk"), t.alias("track"),
                    f.cast("long").alias("frame"), ((F.floor(f / 8) * 37 + f * 3 + t * 211 + i * 97) % 1000 / F.lit(1000.0)).alias("prob"), "x")


FRAMES = """fr AS (SELECT 'rec_' || (vec_id//60) AS recording_id, (vec_id%60)//3 AS chunk, vec_id%3 AS track, f AS frame,
   ((f//8)*37 + f*3 + (vec_id%3)*211 + vec_id*97) % 1000 / 1000.0 AS prob, x FROM (SELECT vec_id, unnest(range(len(embedding))) AS f, unnest(embedding) AS x FROM vectors))"""
RUNS = """on0 AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_id, chunk, track ORDER BY frame) AS g FROM fr WHERE prob > 0.4),
rn AS (SELECT recording_id, chunk, track, g, min(frame) AS start_frame, max(frame) + 1 AS end_frame FROM on0 GROUP BY 1, 2, 3, 4)"""


@query("median_smoothed", cte(VECTORS, FRAMES, """n AS (SELECT *, count(*) OVER (PARTITION BY recording_id, chunk, track) AS n FROM fr),
  x AS (SELECT recording_id, chunk, track, frame, frame AS p2, prob FROM n UNION ALL SELECT recording_id, chunk, track, frame, -1-frame, prob FROM n WHERE frame < 5
        UNION ALL SELECT recording_id, chunk, track, frame, 2*n-1-frame, prob FROM n WHERE frame >= n-5)""") + """
  SELECT recording_id, chunk, track, frame, smooth FROM (SELECT *, list_sort(list(prob) OVER (PARTITION BY recording_id, chunk, track ORDER BY p2 ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))[6] AS smooth FROM x) WHERE p2 = frame""")
def median_smoothed(spark, sf):
    return frames.median_smooth(frame_table(spark, sf)).select("recording_id", "chunk", "track", "frame", "smooth")


@query("active_runs", cte(VECTORS, FRAMES, RUNS) + "SELECT recording_id, chunk, track, start_frame, end_frame FROM rn WHERE (end_frame - start_frame)*20 >= 100")
def active_runs(spark, sf):
    return frames.runs(frame_table(spark, sf), F.col("prob") > 0.4)


@query("clean_spans", cte(VECTORS, FRAMES, RUNS, """
  ac AS (SELECT *, sum(CASE WHEN prob > 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, chunk, frame) AS n FROM fr),
  cf AS (SELECT a.recording_id, a.chunk, a.track, r.g, a.frame, a.frame - row_number() OVER (PARTITION BY a.recording_id, a.chunk, a.track, r.g ORDER BY a.frame) AS c
    FROM ac a JOIN rn r ON r.recording_id = a.recording_id AND r.chunk = a.chunk AND r.track = a.track AND a.frame >= r.start_frame AND a.frame < r.end_frame WHERE a.n = 1),
  cs AS (SELECT recording_id, chunk, track, g, min(frame) AS cs, max(frame)+1 AS ce FROM cf GROUP BY recording_id, chunk, track, g, c),
  cb AS (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk, track, g ORDER BY ce - cs DESC, cs) AS k FROM cs),
  j AS (SELECT r.*, coalesce((ce - cs)*20, 0) AS clean_ms, cs, ce FROM rn r LEFT JOIN cb ON cb.recording_id = r.recording_id AND cb.chunk = r.chunk AND cb.track = r.track AND cb.g = r.g AND k = 1 WHERE (end_frame-start_frame)*20 >= 300)""") + """
  SELECT recording_id, chunk, track, start_frame, end_frame, clean_ms, CASE WHEN clean_ms >= 400 THEN 'primary' WHEN clean_ms >= 300 THEN 'aux' ELSE 'fallback' END AS tier,
    CASE WHEN clean_ms >= 300 THEN cs ELSE start_frame END AS used_start, CASE WHEN clean_ms >= 300 THEN ce ELSE end_frame END AS used_end FROM j""")
def clean_spans(spark, sf):
    return frames.clean_spans(frame_table(spark, sf), F.col("prob") > 0.4)


@query("anchor_spans", cte(VECTORS, FRAMES, RUNS.replace("0.4", "0.6"), """
  ac AS (SELECT *, sum(CASE WHEN prob > 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, chunk, frame) AS n FROM fr),
  cf AS (SELECT a.recording_id, a.chunk, a.track, r.g, a.frame, a.frame - row_number() OVER (PARTITION BY a.recording_id, a.chunk, a.track, r.g ORDER BY a.frame) AS c
    FROM ac a JOIN rn r ON r.recording_id = a.recording_id AND r.chunk = a.chunk AND r.track = a.track AND a.frame >= r.start_frame AND a.frame < r.end_frame WHERE a.n = 1),
  cs AS (SELECT recording_id, chunk, track, g, min(frame) AS cs, max(frame)+1 AS ce FROM cf GROUP BY recording_id, chunk, track, g, c),
  cb AS (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk, track, g ORDER BY ce - cs DESC, cs) AS k FROM cs)""") + """
  SELECT r.recording_id, r.chunk, r.track, start_frame, end_frame, (ce - cs)*60 AS clean_ms, 'primary' AS tier, cs AS used_start, ce AS used_end
  FROM rn r JOIN cb ON cb.recording_id = r.recording_id AND cb.chunk = r.chunk AND cb.track = r.track AND cb.g = r.g AND k = 1
  WHERE (end_frame-start_frame)*60 >= 400 AND (ce - cs)*60 >= 400 AND (ce - cs)*100 >= (end_frame - start_frame)*80""")
def anchor_spans(spark, sf):
    return frames.anchor_spans(frame_table(spark, sf), F.col("prob") > 0.6, dt_ms=60)


@query("densest_windows", cte(VECTORS, FRAMES, """w AS (SELECT recording_id, chunk, track, frame, count(*) OVER (PARTITION BY recording_id, chunk, track) AS n,
    sum(CASE WHEN prob > 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, chunk, track ORDER BY frame ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS hit FROM fr),
  k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk, track ORDER BY hit DESC, frame) AS k FROM w WHERE frame + 20 <= n OR frame = 0)""") + """
  SELECT recording_id, chunk, track, frame AS start_frame, least(frame + 20, n) AS end_frame, CAST(hit AS BIGINT) AS active_frames FROM k WHERE k = 1""")
def densest_windows(spark, sf):
    return frames.densest_windows(frame_table(spark, sf), F.col("prob") > 0.7, 20).drop("n_frames")


@query("fragment_spans", cte(VECTORS, FRAMES, """w AS (SELECT recording_id, chunk, track, frame, count(*) OVER (PARTITION BY recording_id, chunk, track) AS n,
    sum(CASE WHEN prob > 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, chunk, track ORDER BY frame ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS hit FROM fr),
  k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, chunk, track ORDER BY hit DESC, frame) AS k FROM w WHERE frame + 20 <= n OR frame = 0),
  t AS (SELECT recording_id, chunk, track, count(*) FILTER (prob > 0.9) AS total FROM fr GROUP BY 1, 2, 3),
  a AS (SELECT recording_id, chunk, track, n, total, hit, greatest(frame - 4, 0) AS s0, least(least(frame + 20, n) + 4, n) AS e0 FROM k JOIN t USING (recording_id, chunk, track) WHERE k = 1),
  b AS (SELECT *, CASE WHEN e0 - s0 < 12 THEN greatest(s0 - (12 - e0 + s0)//2, 0) ELSE s0 END AS s1, CASE WHEN e0 - s0 < 12 THEN least(e0 + (12 - e0 + s0) - (12 - e0 + s0)//2, n) ELSE e0 END AS e1 FROM a),
  c AS (SELECT *, CASE WHEN e1 - s1 < 12 AND s1 > 0 AND e1 = n THEN greatest(n - 12, 0) ELSE s1 END AS s2, CASE WHEN e1 - s1 < 12 AND s1 = 0 THEN least(n, 12) ELSE e1 END AS e2 FROM b),
  m AS (SELECT *, greatest(CAST(round_even((s2 + e2) / 2.0, 0) AS BIGINT) - 20, 0) AS s3 FROM c)""") + """
  SELECT recording_id, chunk, track, total AS total_active, CAST(hit AS BIGINT) AS active_frames,
    CASE WHEN total = 0 THEN 'no_active' WHEN total * 20 < 60 THEN 'too_sparse' ELSE 'ok' END AS reason,
    CASE WHEN total * 20 >= 60 THEN CAST(CASE WHEN e2 - s2 > 40 THEN greatest(least(n, s3 + 40) - 40, 0) ELSE s2 END AS BIGINT) END AS start_frame,
    CASE WHEN total * 20 >= 60 THEN CAST(CASE WHEN e2 - s2 > 40 THEN least(n, s3 + 40) ELSE e2 END AS BIGINT) END AS end_frame FROM m""")
def fragment_spans(spark, sf):
    return frames.fragment_spans(frame_table(spark, sf), F.col("prob") > 0.9)


SPEECH = """e AS (SELECT 'rec_' || (vec_id//60) AS recording_id, (vec_id%60)*16 + b AS frame,
    sqrt(list_aggregate(list_transform(embedding[b*4+1:least(b*4+8, 64)], lambda q: q*q), 'sum') / (least(b*4+8, 64) - b*4)) AS rms FROM (SELECT *, unnest(range(15)) AS b FROM vectors)),
  d AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame) - 1 AS f, count(*) OVER (PARTITION BY recording_id) AS n, sqrt(avg(rms*rms) OVER (PARTITION BY recording_id)) + 1e-8 AS g FROM e),
  o AS (SELECT recording_id, f, n, CASE WHEN rms / g >= 0.9 THEN 1 ELSE 0 END AS a FROM d),
  x AS (SELECT recording_id, f, f AS p2, a FROM o UNION ALL SELECT recording_id, f, -1-f, a FROM o WHERE f < 7 UNION ALL SELECT recording_id, f, 2*n-1-f, a FROM o WHERE f >= n-7),
sm AS (SELECT recording_id, f AS frame, speech FROM (SELECT *, CAST(sum(a) OVER (PARTITION BY recording_id ORDER BY p2 ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) >= 8 AS BIGINT) AS speech FROM x) WHERE p2 = f)"""


@query("speech_mask", cte(VECTORS, SPEECH) + "SELECT * FROM sm")
def speech_mask(spark, sf):
    """Energy frames of sample blocks (the 64 components of a vector as samples), smoothed speech mask per recording."""
    v = vectors(spark, sf).select(F.concat(F.lit("rec_"), F.floor(F.col("vec_id") / 60)).alias("recording_id"), (F.col("vec_id") % 60).alias("block"),
                                  F.col("embedding").alias("samples"))
    e = frames.frame_energy(v, REC, 8, 4).withColumn("frame", F.col("block") * 15 + F.col("i"))
    return frames.speech_mask(e, REC, threshold=0.9)


@query("silence_gate", cte(VECTORS, ANCHORS, SPEECH, """n AS (SELECT recording_id, max(frame) + 1 AS n FROM sm GROUP BY 1),
  r AS (SELECT a.recording_id, a.vec_id, a.tier, (vec_id % 10)/20.0 AS top1, greatest(0, least(start_ms//80, n-1)) AS sf, end_ms//80 AS e0, n FROM anchors a JOIN n USING (recording_id)),
  q AS (SELECT *, greatest(sf+1, least(e0, n)) AS ef FROM r)""") + """
  SELECT recording_id, vec_id, round(count(*) FILTER (speech = 1) / (ef - sf), 6) AS speech_ratio, top1 >= 0.45 OR count(*) FILTER (speech = 1) / (ef - sf) >= CASE tier WHEN 'fallback' THEN 0.08 ELSE 0.15 END AS keep
  FROM q JOIN sm USING (recording_id) WHERE frame >= sf AND frame < ef GROUP BY recording_id, vec_id, sf, ef, top1, tier""")
def silence_gate(spark, sf):
    """Anchor spans that lie on enough speech frames (80 ms hop) or score high enough to be kept anyway."""
    v = vectors(spark, sf).select(F.concat(F.lit("rec_"), F.floor(F.col("vec_id") / 60)).alias("recording_id"), (F.col("vec_id") % 60).alias("block"), F.col("embedding").alias("samples"))
    e = frames.frame_energy(v, REC, 8, 4).withColumn("frame", F.col("block") * 15 + F.col("i"))
    rows = anchors(spark, sf).select("recording_id", "vec_id", "tier", "start_ms", "end_ms", (F.col("vec_id") % 10 / F.lit(20.0)).alias("top1_score"))
    g = frames.silence_gate(rows, frames.speech_mask(e, REC, threshold=0.9), REC, ["vec_id"], hop_ms=80, width=60_000)
    return g.select("recording_id", "vec_id", F.round("speech_ratio", 6).alias("speech_ratio"), "keep")
