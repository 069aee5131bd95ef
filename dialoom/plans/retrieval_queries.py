"""Registered queries for retrieval, keyed event behaviour and model hooks (batch twins of the streaming jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import text
from dialoom.operators import hooks, jumps, retrieval, sequence
from dialoom.plans import sqltext as q
from dialoom.plans.registry import query
from dialoom.plans.sequence_queries import rcte
from dialoom.plans.views import LINES, SEG, cte, lines, seg_events, table
from dialoom.streaming import jobs

CONV = ["conv_id"]
ALIASES = {"user": ["le "], "assistant": ["die ", "the "], "system": ["de "]}


def chunks(spark, sf):
    """Utterances and windows of every conversation with their hashed embedding."""
    p = sequence.cut_lineage(sequence.numbered(lines(spark, sf), CONV, ["turn"], F.floor(F.col("turn") / 65_536)))
    c = retrieval.utterance_documents(p, CONV, "pos").unionByName(retrieval.window_documents(p, CONV, "pos"))
    return sequence.cut_lineage(c.withColumn("embedding", retrieval.hashed_embedding(F.col("text"))).filter("embedding IS NOT NULL"))


def questions(spark, sf):
    """The second turn of each conversation asked as a question about its own conversation."""
    t = table(spark, sf, "conversations").filter("turn = 1")
    return t.select("conv_id", F.col("conv_id").alias("q_id"), F.col("text").alias("question"), retrieval.hashed_embedding(F.col("text")).alias("q_vec")).filter("q_vec IS NOT NULL")


HMS = "printf('%02d:%02d:%02d', start_ms//3600000, (start_ms//60000)%60, (start_ms//1000)%60)"


def embed(x: str) -> str:
    return f"list_transform(range(16), lambda d: CAST(len(list_filter(string_split(lower({q.sq(x)}), ' '), lambda t: CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) % 16 = d)) AS DOUBLE))"


CHUNKS = f"""p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM lines),
ww AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos-4)/2.0)) AS BIGINT), CAST(pos//2 + 1 AS BIGINT))) AS wid FROM p),
ch0 AS (SELECT conv_id, 'u' || pos AS chunk_id, 'utterance' AS chunk_type, speaker, start_ms, end_ms, speaker || ': ' || trim(text) AS text FROM p WHERE trim(text) <> ''
  UNION ALL SELECT conv_id, 'w' || wid, 'window', NULL, min(start_ms), arg_max(end_ms, pos), string_agg('[' || speaker || '] (' || {HMS} || ') ' || trim(text), chr(10) ORDER BY pos) FILTER (trim(text) <> '')
    FROM ww GROUP BY conv_id, wid HAVING count(*) FILTER (trim(text) <> '') > 0),
ch1 AS MATERIALIZED (SELECT *, {embed('text')} AS v FROM ch0),
ch AS MATERIALIZED (SELECT * EXCLUDE (v), list_transform(v, lambda a: a / sqrt(list_dot_product(v, v))) AS v FROM ch1),
qq1 AS MATERIALIZED (SELECT conv_id, text AS question, {embed('text')} AS v FROM conversations WHERE turn = 1 AND trim(text) <> ''),
qq AS MATERIALIZED (SELECT conv_id, question, list_transform(v, lambda a: a / sqrt(list_dot_product(v, v))) AS qv,
   CASE WHEN contains(lower(question), 'le ') THEN 'user' WHEN contains(lower(question), 'die ') OR contains(lower(question), 'the ') THEN 'assistant' WHEN contains(lower(question), 'de ') THEN 'system' END AS cand FROM qq1),
kn AS (SELECT DISTINCT conv_id, speaker FROM ch WHERE chunk_type = 'utterance'),
tg AS (SELECT qq.*, kn.speaker AS target FROM qq LEFT JOIN kn ON kn.conv_id = qq.conv_id AND kn.speaker = qq.cand),
rk AS MATERIALIZED (SELECT * FROM (SELECT t.conv_id, t.target, chunk_id, chunk_type, speaker, start_ms, text, row_number() OVER (PARTITION BY t.conv_id ORDER BY round(list_dot_product(qv, v), 6) DESC, chunk_id) AS rank
   FROM tg t JOIN ch ON ch.conv_id = t.conv_id) WHERE rank <= 50),
pk0 AS (SELECT *, 0 AS a, start_ms AS b FROM rk WHERE target IS NOT NULL AND chunk_type = 'utterance' AND speaker = target
  UNION ALL SELECT * EXCLUDE (k) FROM (SELECT *, 1 AS a, rank AS b, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS k FROM rk WHERE target IS NOT NULL AND chunk_type = 'window') WHERE k <= 3),
pk AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY a, b, rank) AS k FROM pk0) WHERE k = 1),
fd AS MATERIALIZED (SELECT conv_id, target, chunk_id, chunk_type, start_ms, text, row_number() OVER (PARTITION BY conv_id ORDER BY a, b, rank) AS pos FROM (SELECT * FROM pk UNION ALL SELECT *, 0, rank FROM rk WHERE rank <= 8 AND conv_id NOT IN (SELECT conv_id FROM pk)))"""


@query("utterance_documents", cte(LINES) + "SELECT conv_id, turn, speaker || ': ' || trim(text) AS text, " + HMS + " AS start_fmt FROM lines WHERE trim(text) <> ''")
def utterance_documents(spark, sf):
    d = retrieval.utterance_documents(lines(spark, sf), CONV, "turn")
    return d.select("conv_id", F.substring("chunk_id", 2, 20).cast("long").alias("turn"), "text", text.hhmmss(F.col("start_ms") / 1000).alias("start_fmt"))


@query("speaker_retrieval", cte(LINES, CHUNKS) + "SELECT conv_id AS q_id, target, chunk_id, pos FROM fd")
def speaker_retrieval(spark, sf):
    return retrieval.retrieve(questions(spark, sf), chunks(spark, sf), CONV, ALIASES).select("q_id", "target", "chunk_id", F.col("pos").cast("long").alias("pos"))


@query("question_contexts", cte(LINES, CHUNKS, f"""pt AS (SELECT conv_id, target, string_agg('  (' || {HMS} || ') ' || text, chr(10) ORDER BY pos) FILTER (chunk_type = 'utterance') AS said,
   string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (chunk_type <> 'utterance') AS other, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS every FROM fd GROUP BY 1, 2)""") + """
  SELECT conv_id AS q_id, CASE WHEN target IS NOT NULL THEN 'Toàn bộ phát ngôn của ' || target || ':' || chr(10) || coalesce(said, '') || CASE WHEN other IS NOT NULL THEN chr(10) || chr(10) || 'Ngữ cảnh bổ sung:' || chr(10) || other ELSE '' END ELSE every END AS context FROM pt""")
def question_contexts(spark, sf):
    return retrieval.contexts(retrieval.retrieve(questions(spark, sf), chunks(spark, sf), CONV, ALIASES))


@query("text_chunks")
def text_chunks(spark, sf):
    """Whole documents in chunks of at most 800 characters with overlap (recursive splitting: no SQL twin)."""
    d = retrieval.chunked(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("question_batches", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(length(text) AS BIGINT) AS answer FROM conversations")
def question_batches(spark, sf):
    """Batched hook calls: the plugged-in function measures its texts."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    return hooks.call_model(c, lambda: (lambda pdf: pdf["text"].str.len()), "answer", T.LongType()).drop("text")


@query("embedding_windows", cte(SEG, "s AS (SELECT seg_id, start_ms, end_ms, end_ms-start_ms AS d FROM seg WHERE end_ms-start_ms >= 300)",
       "w AS (SELECT seg_id, CASE WHEN d > 3000 THEN start_ms + i*750 ELSE start_ms END AS a, CASE WHEN d > 3000 THEN start_ms + i*750 + 1500 ELSE end_ms END AS b FROM (SELECT *, unnest(range(CASE WHEN d > 3000 THEN (d-1500)//750 + 1 ELSE 1 END)) AS i FROM s))")
       + "SELECT seg_id, a + 100 AS win_start_ms, b - 100 AS win_end_ms FROM w WHERE b - a - 200 >= 200")
def embedding_windows(spark, sf):
    return hooks.embedding_windows(seg_events(spark, sf).select("seg_id", "start_ms", "end_ms")).select("seg_id", "win_start_ms", "win_end_ms")


@query("span_embeddings")
def span_embeddings(spark, sf):
    """Window embeddings from a plugged-in function, averaged per span."""
    import numpy as np

    def factory():
        def embed(pdf):
            a, b = pdf["win_start_ms"].to_numpy() % 977, pdf["win_end_ms"].to_numpy() % 977
            return np.column_stack((np.sin(a), np.cos(b), np.ones(len(a))))
        return embed

    e = hooks.embed_spans(seg_events(spark, sf).select("seg_id", "start_ms", "end_ms"), ["seg_id"], factory)
    return e.select("seg_id", "used_ms", "n_sub", F.round(F.get("embedding", F.lit(2)), 6).alias("third"))


@query("transcribed_segments")
def transcribed_segments(spark, sf):
    """Two-pass transcription with plugged-in functions: the first doubles every third text, the second is plain."""
    ln = lines(spark, sf).select("conv_id", "turn", "text", "start_ms", "end_ms")
    first = lambda: (lambda pdf: [t + " " + t if k % 3 == 0 else t for t, k in zip(pdf["text"], pdf["turn"])])
    second = lambda: (lambda pdf: pdf["text"])
    return hooks.transcribe(ln, first, second, ["conv_id", "turn"], F.col("end_ms") - F.col("start_ms")).select("conv_id", "turn", "predicted_text", "was_retried")


# ---- keyed event behaviour --------------------------------------------------------------------------------------------

def user_events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("latest_status", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(spark, sf):
    e = user_events(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "event_id")
    return jobs.latest_status(e).select("job_id", "status")


LOCK_US = 43_200_000_000


@query("lockout_sessions", rcte("n AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error')",
       f"""w AS (SELECT user_id, k, us AS first_us, us AS last_us, 1 AS c, false AS made FROM n WHERE k = 1
     UNION ALL SELECT n.user_id, n.k,
       CASE WHEN w.c = 3 AND n.us < w.last_us + {LOCK_US} THEN w.first_us WHEN w.c = 3 OR n.us >= w.last_us + {LOCK_US} THEN n.us ELSE w.first_us END,
       CASE WHEN w.c = 3 AND n.us < w.last_us + {LOCK_US} THEN w.last_us ELSE n.us END,
       CASE WHEN w.c = 3 AND n.us < w.last_us + {LOCK_US} THEN 3 WHEN w.c = 3 OR n.us >= w.last_us + {LOCK_US} THEN 1 ELSE w.c + 1 END,
       w.c = 2 AND n.us < w.last_us + {LOCK_US}
     FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1)""")
       + f"SELECT user_id, first_us, last_us + {LOCK_US} AS expires_us, CAST(3 AS BIGINT) AS failures FROM w WHERE made")
def lockout_sessions(spark, sf):
    d = jobs.lockouts(user_events(spark, sf).filter("event_type = 'error'"), minutes=720, limit=3)
    return d.select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("expires_at").alias("expires_us"), "failures")


DAY_US = 86_400_000_000


@query("cooldown_accepts", rcte("n AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id FROM events)",
       f"w AS (SELECT user_id, k, event_id, us AS acc, true AS ok FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.k, n.event_id, CASE WHEN n.us >= w.acc + {DAY_US} THEN n.us ELSE w.acc END, n.us >= w.acc + {DAY_US} FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1)")
       + "SELECT user_id, event_id FROM w WHERE ok")
def cooldown_accepts(spark, sf):
    """One accepted event per day and user, in order: each event points to the first one a day later."""
    e = user_events(spark, sf).select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    return jumps.starts(e, ["user_id"], "us", "event_id", jumps.cooldown_step(DAY_US), DAY_US).select("user_id", "event_id")
