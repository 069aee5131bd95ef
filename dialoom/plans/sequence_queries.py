"""Registered queries over ordered lines: merging, packing, windows, near duplicates, quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import fixed, text
from dialoom.operators import dedup, sequence
from dialoom.plans import sqltext as q
from dialoom.plans.registry import query
from dialoom.plans.views import DOC_LINES, KEY, LINES, SEG, cte, doc_lines, lines, seg_events, sliced, table

RUN = """r0 AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS ch FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY start_ms, end_ms, {i})),
r1 AS (SELECT *, sum(ch) OVER (PARTITION BY {k} ORDER BY start_ms, end_ms, {i}) AS run FROM r0),
r2 AS (SELECT *, max(end_ms) OVER (PARTITION BY {k}, run ORDER BY start_ms, end_ms, {i} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r1),
r3 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_ms > top + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY start_ms, end_ms, {i}) AS isl FROM r2)
SELECT {k}, first({i} ORDER BY start_ms, end_ms, {i}) AS {i}, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_lines FROM r3 GROUP BY {k}, isl"""


@query("merge_adjacent", cte(SEG, RUN.format(src="seg", k="recording_id", i="seg_id", gap=60000)))
def merge_adjacent(spark, sf):
    seg, width = sliced(spark, sf)
    return sequence.merge_adjacent(seg, KEY, "seg_id", 60_000, width)


@query("merge_adjacent_lines", cte(DOC_LINES, RUN.format(src="doc_lines", k="doc_id", i="idx", gap=1000)))
def merge_adjacent_lines(spark, sf):
    return sequence.merge_adjacent(doc_lines(spark, sf), ["doc_id"], "idx", width=3_600_000)


CLEAN_LINES = [f"pc AS (SELECT doc_id, idx, {q.pre_clean('txt')} AS t FROM doc_lines)", *q.cleanup_steps("pc", "doc_id, idx", "t", "kc"),
               f"cl AS MATERIALIZED (SELECT d.doc_id, d.idx, speaker, start_ms, end_ms, {q.sq('cleaned')} AS txt FROM doc_lines d JOIN kc USING (doc_id, idx))"]
ISLANDS = RUN.format(src="cl", k="doc_id", i="idx", gap=1000).split("\nSELECT")[0]
# each step cleans the text so far and the next line together; s1 to s4 are the steps of the cleaning
MERGED = (f"""il AS MATERIALIZED (SELECT doc_id, isl, idx, txt, row_number() OVER (PARTITION BY doc_id, isl ORDER BY start_ms, end_ms, idx) AS n FROM r3),
mw AS (SELECT doc_id, isl, n, idx, txt AS acc FROM il WHERE n = 1
  UNION ALL SELECT w.doc_id, w.isl, r.n, w.idx, s4.x FROM mw w JOIN il r ON r.doc_id = w.doc_id AND r.isl = w.isl AND r.n = w.n + 1,
  LATERAL (SELECT {q.pre_clean("w.acc || ' ' || r.txt")} AS x) s0,
  LATERAL (SELECT string_split({q.sq('s0.x')}, ' ') AS x) s1,
""" + r"""  LATERAL (SELECT list_filter(string_split(regexp_replace(array_to_string(list_filter(s1.x, lambda t, i: i = 1 OR lower(t) <> lower(s1.x[i-1])), ' '), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS x) s2,
  LATERAL (SELECT list_transform(s2.x, lambda y: lower(y)) AS x) s3,
""" + f"""  LATERAL (SELECT {q.sq("array_to_string(list_filter(s2.x, lambda p, j: list_position(s3.x, lower(p)) = j), ' ')")} AS x) s4)""")


@query("merged_text", "WITH RECURSIVE " + ",\n".join([DOC_LINES, *CLEAN_LINES, ISLANDS, MERGED])
       + "\nSELECT doc_id, idx, n AS n_lines, acc AS txt FROM mw JOIN (SELECT doc_id, isl, max(n) AS n FROM il GROUP BY doc_id, isl) USING (doc_id, isl, n)")
def merged_text(spark, sf):
    """As merge_adjacent_lines with the merged text, re-cleaned at every step."""
    d = doc_lines(spark, sf).withColumn("txt", text.clean_line(F.col("txt")))
    return sequence.merge_adjacent(d, ["doc_id"], "idx", width=3_600_000, text_col="txt").select("doc_id", "idx", "n_lines", "txt")


BLOCKS = f"""n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pos, {q.transition('txt')} AS tr,
   length(printf('[%.1fs - %.1fs] %s: %s', start_ms/1000.0, end_ms/1000.0, speaker, txt)) + 1 AS chars FROM doc_lines),
walk AS (SELECT doc_id, pos, CAST(0 AS BIGINT) AS block_id, start_ms AS b, chars AS used, 1 AS cnt FROM n WHERE pos = 0
  UNION ALL SELECT n.doc_id, n.pos, w.block_id + x.f, CASE WHEN x.f = 1 THEN n.start_ms ELSE w.b END,
    CASE WHEN x.f = 1 THEN n.chars ELSE w.used + n.chars END, CASE WHEN x.f = 1 THEN 1 ELSE w.cnt + 1 END
  FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.pos = w.pos + 1,
  LATERAL (SELECT CASE WHEN (n.tr AND n.end_ms - w.b >= 25000) OR w.used + n.chars > 2600 OR n.end_ms - w.b > 60000 OR w.cnt >= 8 THEN 1 ELSE 0 END AS f) x)"""


def rcte(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


@query("block_packing", rcte(DOC_LINES, BLOCKS) + """SELECT n.doc_id, w.block_id, min(n.start_ms) AS start_ms, max(n.end_ms) AS end_ms, count(*) AS n_lines,
   bool_or(n.tr) AS transition_heavy FROM n JOIN walk w USING (doc_id, pos) GROUP BY n.doc_id, w.block_id""")
def block_packing(spark, sf):
    d = doc_lines(spark, sf).withColumnRenamed("txt", "text")
    b = sequence.pack_blocks(d, ["doc_id"], ["idx"], F.floor(F.col("idx") / 4096))
    return b.groupBy("doc_id", "block_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_lines"),
        F.bool_or("is_transition").alias("transition_heavy"))


@query("sliding_windows", cte(LINES, "p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM lines)",
       "w AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos-4)/2.0)) AS BIGINT), CAST(pos//2 + 1 AS BIGINT))) AS window_id FROM p)") + """
  SELECT conv_id, window_id, min(start_ms) AS start_ms, arg_max(end_ms, pos) AS end_ms, count(*) AS n_lines,
    string_agg('[' || speaker || '] (' || printf('%02d:%02d:%02d', start_ms//3600000, (start_ms//60000)%60, (start_ms//1000)%60) || ') ' || trim(text), chr(10) ORDER BY pos) FILTER (trim(text) <> '') AS text
  FROM w GROUP BY conv_id, window_id HAVING count(*) FILTER (trim(text) <> '') > 0""")
def sliding_windows(spark, sf):
    from dialoom.operators.retrieval import window_line
    p = sequence.numbered(lines(spark, sf), ["conv_id"], ["turn"], F.floor(F.col("turn") / 65_536))
    return sequence.sliding_windows(p, ["conv_id"], "pos", window_line()).select(
        "conv_id", "window_id", "start_ms", "end_ms", "n_lines", "text")


@query("consecutive_types", cte(LINES, f"k AS (SELECT conv_id, turn, {q.kind('text', q.transition('text'))} AS kind FROM lines)",
       "o AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(turn) OVER w = turn - 1 THEN 0 ELSE 1 END AS f FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))",
       "g AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS gid FROM o)") + """
  SELECT conv_id, CAST(gid AS BIGINT) AS group_id, kind, min(turn) AS first_turn, count(*) AS n_turns FROM g GROUP BY conv_id, gid, kind""")
def consecutive_types(spark, sf):
    ln = lines(spark, sf)
    ln = ln.select("conv_id", "turn", text.segment_type(F.col("text"), text.is_transition(F.col("text"))).alias("kind"))
    return sequence.consecutive_groups(ln, ["conv_id"], "turn", "kind",
                                       [F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_turns")])


@query("conversation_text", "SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_text(spark, sf):
    return (table(spark, sf, "conversations").groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("l")))).alias("_l"))
            .select("conv_id", F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("text")))


@query("last_six_turns", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def last_six_turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    return dedup.keep_first(c, ["conv_id"], [F.desc("turn")], 6)


# ---- duplicates -------------------------------------------------------------------------------------------------------

def jittered(spark, sf):
    """Document lines plus copies of every fifth line, moved by 200 ms."""
    d = doc_lines(spark, sf).select("doc_id", (F.col("doc_id").cast("long") * 1_000_000 + F.col("idx") * 2).alias("row_id"),
                                    "txt", "start_ms", "end_ms", "idx")
    copy = d.filter("idx % 5 = 0").select("doc_id", (F.col("row_id") + 1).alias("row_id"), "txt",
                                          (F.col("start_ms") + 200).alias("start_ms"), (F.col("end_ms") + 200).alias("end_ms"), "idx")
    return d.unionByName(copy).drop("idx")


JITTER = """jit AS (SELECT doc_id, CAST(doc_id AS BIGINT)*1000000 + idx*2 AS row_id, txt, start_ms, end_ms FROM doc_lines
  UNION ALL SELECT doc_id, CAST(doc_id AS BIGINT)*1000000 + idx*2 + 1, txt, start_ms+200, end_ms+200 FROM doc_lines WHERE idx % 5 = 0)"""
GREEDY = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, row_id) AS n, {feat} AS f FROM jit),
walk AS (SELECT doc_id, CAST(1 AS BIGINT) AS n, row_id, true AS keep, [{{'s': start_ms, 'e': end_ms, 'f': f}}] AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.n, o.row_id, NOT m.hit, CASE WHEN m.hit THEN m.live ELSE list_append(m.live, {{'s': o.start_ms, 'e': o.end_ms, 'f': o.f}}) END
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1,
  LATERAL (SELECT list_filter(w.kept, lambda k: k.s > o.start_ms - 2000 OR k.e > o.start_ms) AS live,
    len(list_filter(w.kept, lambda k: {match})) > 0 AS hit) m)
SELECT doc_id, row_id FROM walk WHERE keep"""


@query("token_set_dedup", rcte(DOC_LINES, JITTER, GREEDY.format(
    feat=f"list_distinct(string_split(lower({q.sq('txt')}), ' '))",
    match="abs(k.s - o.start_ms) + abs(k.e - o.end_ms) < 1000 AND len(list_intersect(k.f, o.f)) / greatest(len(k.f), len(o.f)) > 0.8")))
def token_set_dedup(spark, sf):
    return dedup.near_duplicates(jittered(spark, sf), ["doc_id"], "row_id", "txt").select("doc_id", "row_id")


@query("same_text_dedup", rcte(DOC_LINES, JITTER, GREEDY.format(
    feat=q.sq("txt"),
    match="k.f = o.f AND ((abs(k.s - o.start_ms) <= 300 AND abs(k.e - o.end_ms) <= 300) OR greatest(0, least(k.e, o.end_ms) - greatest(k.s, o.start_ms)) / (greatest(k.e, o.end_ms) - least(k.s, o.start_ms)) >= 0.85)")))
def same_text_dedup(spark, sf):
    return dedup.same_text_duplicates(jittered(spark, sf), ["doc_id"], "row_id", "txt").select("doc_id", "row_id")


@query("exact_fingerprint", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5({q.sq('text')} || '||' || lang) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def exact_fingerprint(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return dedup.exact_fingerprint(d, [text.squeeze(F.col("text")), F.col("lang")], ["doc_id"]).select("doc_id")


@query("reuse_quota", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 2")
def reuse_quota(spark, sf):
    """One base id per row: admitted while used fewer than twice."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return dedup.keep_first(li, ["l_partkey"], ["l_orderkey", "l_linenumber"], 2).drop("l_partkey")


# The walk carries how often each part has been used, as a list by part number (from 0).
QUOTA = """o AS MATERIALIZED (SELECT l_orderkey AS sample, list(DISTINCT l_partkey) AS ids, row_number() OVER (ORDER BY l_orderkey) AS n FROM lineitem GROUP BY l_orderkey),
uw AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sample, false AS ok, list_transform(range((SELECT max(l_partkey) + 1 FROM lineitem)), lambda i: 0::TINYINT) AS used
  UNION ALL SELECT o.n, o.sample, f.ok, CASE WHEN f.ok THEN list_transform(w.used, lambda c, i: CASE WHEN list_contains(o.ids, i - 1) THEN (c + 1)::TINYINT ELSE c END) ELSE w.used END
  FROM uw w JOIN o ON o.n = w.n + 1, LATERAL (SELECT len(list_filter(o.ids, lambda p: w.used[p + 1] >= 2)) = 0 AS ok) f)"""


@query("reuse_quota_sets", rcte(QUOTA) + "SELECT CAST(sample AS BIGINT) AS sample FROM uw WHERE ok")
def reuse_quota_sets(spark, sf):
    """Several base ids per row (the parts of an order); a sequential rule across shared ids."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("sample")).agg(
        F.collect_set(F.col("l_partkey").cast("string")).alias("ids"))
    return dedup.reuse_quota(li, "ids", "sample").select("sample")


# The sequential rules as walks over a document's lines: c is the open line, p the one before it, o what a step finishes.
NEAR = "({b}s - {a}e <= 500 AND (({a}sp <> '' AND {a}sp = {b}sp) OR {b}s - {a}e <= 250))"
JOIN = lambda a, b: f"{a}s, {b}e, coalesce(nullif({a}sp, ''), {b}sp), {q.sq(a + 't || chr(32) || ' + b + 't')}"
SHORT = f"""ln AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, idx) AS n, start_ms AS s, end_ms AS e, speaker AS sp, txt AS t FROM doc_lines),
sw AS (SELECT doc_id, n, s AS cs, e AS ce, sp AS csp, t AS ct, CAST(NULL AS BIGINT) AS ps, CAST(NULL AS BIGINT) AS pe, CAST(NULL AS VARCHAR) AS psp, CAST(NULL AS VARCHAR) AS pt,
    CAST(NULL AS BIGINT) AS os, CAST(NULL AS BIGINT) AS oe, CAST(NULL AS VARCHAR) AS osp, CAST(NULL AS VARCHAR) AS ot FROM ln WHERE n = 1
  UNION ALL SELECT doc_id, n, x.c.s, x.c.e, x.c.sp, x.c.t, x.p.s, x.p.e, x.p.sp, x.p.t, x.o.s, x.o.e, x.o.sp, x.o.t FROM (SELECT w.doc_id, r.n,
    CASE WHEN f.fwd THEN row({JOIN('w.c', 'r.')}) ELSE row(r.s, r.e, r.sp, r.t) END::STRUCT(s BIGINT, e BIGINT, sp VARCHAR, t VARCHAR) AS c,
    CASE WHEN f.fwd THEN row(w.ps, w.pe, w.psp, w.pt) WHEN f.back THEN row({JOIN('w.p', 'w.c')}) ELSE row(w.cs, w.ce, w.csp, w.ct) END::STRUCT(s BIGINT, e BIGINT, sp VARCHAR, t VARCHAR) AS p,
    CASE WHEN f.fwd OR f.back THEN row(NULL, NULL, NULL, NULL) ELSE row(w.ps, w.pe, w.psp, w.pt) END::STRUCT(s BIGINT, e BIGINT, sp VARCHAR, t VARCHAR) AS o
    FROM sw w JOIN ln r ON r.doc_id = w.doc_id AND r.n = w.n + 1,
    LATERAL (SELECT w.ce - w.cs < 2500 AND {NEAR.format(a='w.c', b='r.')} AS fwd, w.ps IS NOT NULL AND w.ce - w.cs < 2500 AND {NEAR.format(a='w.p', b='w.c')} AS back) f) x),
se AS (SELECT sw.*, ps IS NOT NULL AND ce - cs < 2500 AND {NEAR.format(a='p', b='c')} AS back FROM sw JOIN (SELECT doc_id, max(n) AS n FROM ln GROUP BY doc_id) USING (doc_id, n)),
short_lines AS MATERIALIZED (SELECT doc_id, os AS s, oe AS e, osp AS sp, ot AS t FROM sw WHERE os IS NOT NULL
  UNION ALL SELECT doc_id, ps, pe, psp, pt FROM se WHERE ps IS NOT NULL AND NOT back
  UNION ALL SELECT doc_id, cs, ce, csp, ct FROM se WHERE NOT back
  UNION ALL SELECT doc_id, {JOIN('p', 'c')} FROM se WHERE back)"""


@query("short_line_merge", rcte(DOC_LINES, SHORT) + "SELECT doc_id, s AS start_ms, e AS end_ms, sp AS speaker, t AS text FROM short_lines")
def short_line_merge(spark, sf):
    """Short lines merged forward, else backward, consuming the merged result."""
    d = doc_lines(spark, sf).select("doc_id", "idx", F.col("txt").alias("text"), "speaker", "start_ms", "end_ms")
    return sequence.merge_short(d, ["doc_id"], "idx", F.floor(F.col("start_ms") / 3_600_000))


# Lines of a document follow each other, so they lie inside speech regions (nothing to clamp) and gaps are silent.
CHUNKS = SHORT + f""",
it AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS n FROM short_lines),
cw AS (SELECT doc_id, n, s AS cs, e AS ce, sp AS csp, t AS ct, CAST(NULL AS BIGINT) AS os, CAST(NULL AS BIGINT) AS oe, CAST(NULL AS VARCHAR) AS osp, CAST(NULL AS VARCHAR) AS ot FROM it WHERE n = 1
  UNION ALL SELECT doc_id, n, x.c.s, x.c.e, x.c.sp, x.c.t, x.o.s, x.o.e, x.o.sp, x.o.t FROM (SELECT w.doc_id, r.n,
    CASE WHEN f.fits THEN row({JOIN('w.c', 'r.')}) ELSE row(r.s, r.e, r.sp, r.t) END::STRUCT(s BIGINT, e BIGINT, sp VARCHAR, t VARCHAR) AS c,
    CASE WHEN f.fits THEN row(NULL, NULL, NULL, NULL) ELSE row(w.cs, w.ce, w.csp, w.ct) END::STRUCT(s BIGINT, e BIGINT, sp VARCHAR, t VARCHAR) AS o
    FROM cw w JOIN it r ON r.doc_id = w.doc_id AND r.n = w.n + 1,
    LATERAL (SELECT r.e - w.cs <= 18000 AND ((w.csp <> '' AND w.csp = r.sp AND r.s - w.ce <= 1500) OR r.s - w.ce <= 200) AS fits) f) x),
ch AS (SELECT doc_id, os AS s, oe AS e, osp AS sp, ot AS t FROM cw WHERE os IS NOT NULL
  UNION ALL SELECT doc_id, cs, ce, csp, ct FROM cw JOIN (SELECT doc_id, max(n) AS n FROM it GROUP BY doc_id) USING (doc_id, n)),
pt AS (SELECT *, unnest(range(k)) AS i FROM (SELECT *, CAST(greatest(ceil((e - s) / 30000.0), 1) AS BIGINT) AS k, regexp_split_to_array(t, '\\s+') AS w FROM ch)),
pp AS (SELECT doc_id, sp, s + (e - s) * i // k AS ps, s + (e - s) * (i + 1) // k AS pe, CASE WHEN k = 1 THEN t ELSE coalesce(nullif(array_to_string(
   w[i * greatest(1, len(w) // k) + 1 : CASE WHEN i = k - 1 THEN len(w) ELSE (i + 1) * greatest(1, len(w) // k) END], ' '), ''), t) END AS t FROM pt)"""


@query("training_chunks", rcte(DOC_LINES, CHUNKS) + "SELECT doc_id, ps AS start_ms, pe AS end_ms, sp AS speaker, t AS text FROM pp WHERE pe > ps AND trim(t) <> ''")
def training_chunks(spark, sf):
    """Clamp, merge, bridge and split document lines into chunks."""
    d = doc_lines(spark, sf).select("doc_id", "idx", F.col("txt").alias("text"), "speaker", "start_ms", "end_ms")
    segs = d.select("doc_id", "speaker", "start_ms", "end_ms")
    return sequence.build_chunks(d, segs, ["doc_id"], "idx", 3_600_000, width=3_600_000)
