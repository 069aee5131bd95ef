"""Retrieval over transcripts: documents, chunking, speaker-aware search for a table of questions, context text."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import fixed, text, vectors as fv
from dialoom.operators import dedup, sequence

SEPARATORS = ["\n\n", "\n", ".", " "]  # fixed values, tried in this order
BATCH_BYTES = "1m"   # of texts that Python gets at once
TOP_ALL, TOP_SPEAKER, TOP_WINDOWS = 8, 50, 3


def window_line() -> Column:
    return F.concat(F.lit("["), "speaker", F.lit("] ("), text.hhmmss(F.col("start_ms") / 1000), F.lit(") "), text.strip(F.col("text")))


def utterance_documents(lines: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    d = lines.withColumn("text", text.strip(F.col("text"))).filter("text <> ''")
    return d.select(*keys, F.concat(F.lit("u"), F.col(pos).cast("string")).alias("chunk_id"), F.lit("utterance").alias("chunk_type"), "speaker",
                    "start_ms", "end_ms", F.concat(F.col("speaker"), F.lit(": "), F.col("text")).alias("text"))


def window_documents(lines: DataFrame, keys: Sequence[str], pos: str, size: int = 5) -> DataFrame:
    w = sequence.sliding_windows(lines, keys, pos, window_line(), size, size // 2)
    return w.select(*keys, F.concat(F.lit("w"), F.col("window_id").cast("string")).alias("chunk_id"), F.lit("window").alias("chunk_type"),
                    F.lit(None).cast("string").alias("speaker"), "start_ms", "end_ms", "text")


def summary_documents(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Meeting documents as retrieval texts: overview, segments, the action list, speaker summaries."""
    row = lambda kind, body, spk=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("chunk_type"), spk.alias("speaker"), body.alias("text"))
    over = F.array(row("overview", F.concat(F.lit("Tổng quan cuộc họp: "), "meeting_overview")))
    seg = F.transform(F.filter("segments", lambda s: s["summary"] != ""), lambda s: row("segment", F.concat(F.lit("["), s["title"], F.lit("] "), s["summary"])))
    items = F.array_join(F.transform("action_items", lambda a: F.concat(F.lit("- "), F.coalesce(a["owner"], F.lit("?")), F.lit(": "), a["task"], F.lit(" ["), a["status"], F.lit("]"))), "\n")
    acts = F.when(F.coalesce(F.size("action_items"), F.lit(0)) > 0, F.array(row("action_items", F.concat(F.lit("Các việc cần làm:\n"), items))))
    spk = F.transform(F.filter("speakers", lambda s: s["main_summary"] != ""), lambda s: row("speaker_summary", F.concat(F.lit("Tóm tắt "), s["speaker"], F.lit(": "), s["main_summary"]), s["speaker"]))
    kind = "array<struct<chunk_type:string,speaker:string,text:string>>"
    parts = [F.coalesce(c.cast(kind), F.array().cast(kind)) for c in (over, seg, acts, spk)]
    return docs.select(*keys, F.posexplode(F.concat(*parts)).alias("i", "d")).select(*keys, F.concat(F.lit("s"), F.col("i").cast("string")).alias("chunk_id"), "d.*")


def split_text(body: str, size: int = 800, overlap: int = 80, separators: Sequence[str] = tuple(SEPARATORS)) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that occurs, neighbours sharing up to `overlap`.

    A separator stays at the head of the piece after it; a piece longer than `size` is cut again by the finer ones,
    and by plain length where none is left.
    """
    if len(body) <= size:
        return [body.strip()] if body.strip() else []
    sep = next((s for s in separators if s in body), None)
    if sep is None:
        step = max(1, size - overlap)
        return [body[i:i + size].strip() for i in range(0, len(body), step) if body[i:i + size].strip() and (i == 0 or i + overlap < len(body))]
    finer = list(separators)[list(separators).index(sep) + 1:]
    head, *tail = body.split(sep)
    units = ([head] if head else []) + [sep + t for t in tail]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for u in units:
        if len(u) > size:
            flush()
            held.clear()
            out.extend(split_text(u, size, overlap, finer))
            continue
        if sum(map(len, held)) + len(u) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(u) > size):
                held.pop(0)
        held.append(u)
    flush()
    return out


def chunked(docs: DataFrame, size: int = 800, overlap: int = 80, text_col: str = "text") -> DataFrame:
    """Documents cut into chunks (`chunk_no`), whole texts, one row at a time. Python gets batches of bounded size, however long texts are."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda b: split_text(b or "", size, overlap))

    d = docs.withColumn("_c", cut(text_col))  # one rule for texts of any length; null has no chunks
    return d.select(*[c for c in docs.columns if c != text_col], F.posexplode("_c").alias("chunk_no", text_col)).filter(F.col(text_col) != "")


def hashed_embedding(c: Column, dim: int = 16) -> Column:
    """Bag of hashed tokens, length one: the stand-in where no embedding model is plugged in."""
    toks = text.tokens(F.lower(c))
    slots = F.transform(toks, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dim)
    counts = text.let(slots, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(h, lambda x: x == d)).cast("double")))
    return fv.normalized(counts)


def ranked(questions: DataFrame, chunks: DataFrame, keys: Sequence[str], k: int = TOP_SPEAKER) -> DataFrame:
    """The k best chunks of its meeting per question (`q_id`, `q_vec`), by rounded dot product, then chunk id.

    The limit runs before the shuffle, so a meeting's chunks are never gathered per question.
    """
    d = questions.join(chunks, list(keys)).withColumn("score", F.round(fv.dot(F.col("q_vec"), F.col("embedding")), 6)).drop("embedding", "q_vec")
    from pyspark.sql import Window
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "chunk_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieve(questions: DataFrame, chunks: DataFrame, keys: Sequence[str], aliases: dict[str, list[str]] = fixed.SPEAKER_ALIASES) -> DataFrame:
    """Chunks per question in reading order (`pos`).

    A question naming a speaker of the meeting gets, out of its 50 best chunks, that speaker's utterances by time, then
    the three best windows, equal texts once; when that is empty, and for all other questions, the eight best.
    """
    keys = list(keys)
    known = chunks.filter("chunk_type = 'utterance'").select(*keys, F.col("speaker").alias("target")).distinct().withColumn("_known", F.lit(True))
    q = questions.withColumn("target", text.mentioned_speaker(F.col("question"), aliases)).join(known, [*keys, "target"], "left")
    q = q.withColumn("target", F.when(F.col("_known"), F.col("target"))).drop("_known")
    top = ranked(q, chunks, keys)
    named = top.filter("target IS NOT NULL")
    utter = named.filter((F.col("chunk_type") == "utterance") & (F.col("speaker") == F.col("target"))).withColumn("_o", F.struct(F.lit(0).alias("a"), F.col("start_ms").alias("b"), F.col("rank").alias("c")))
    wins = dedup.keep_first(named.filter("chunk_type = 'window'"), ["q_id"], ["rank"], TOP_WINDOWS)
    wins = wins.withColumn("_o", F.struct(F.lit(1).alias("a"), F.col("rank").cast("long").alias("b"), F.col("rank").alias("c")))
    picked = dedup.keep_first(utter.unionByName(wins), ["q_id", "text"], ["_o"])
    rest = top.filter(F.col("rank") <= TOP_ALL).join(picked.select("q_id").distinct(), "q_id", "left_anti")
    rest = rest.withColumn("_o", F.struct(F.lit(0).alias("a"), F.col("rank").cast("long").alias("b"), F.col("rank").alias("c")))
    from pyspark.sql import Window
    w = Window.partitionBy("q_id").orderBy("_o")  # at most 53 rows per question
    return picked.unionByName(rest).withColumn("pos", F.row_number().over(w)).drop("_o")


def contexts(found: DataFrame) -> DataFrame:
    """One context text per question from `retrieve` rows (at most 53 each)."""
    line = F.struct("pos", "chunk_type", F.concat(F.lit("  ("), text.hhmmss(F.col("start_ms") / 1000), F.lit(") "), "text").alias("spoken"), "text")
    d = found.groupBy("q_id", "target").agg(F.array_sort(F.collect_list(line)).alias("l"))
    said = F.array_join(F.transform(F.filter("l", lambda x: x["chunk_type"] == "utterance"), lambda x: x["spoken"]), "\n")
    other = F.array_join(F.transform(F.filter("l", lambda x: x["chunk_type"] != "utterance"), lambda x: x["text"]), "\n\n")
    every = F.array_join(F.transform("l", lambda x: x["text"]), "\n\n")
    named = F.concat(F.lit("Toàn bộ phát ngôn của "), F.col("target"), F.lit(":\n"), said,
                     F.when(other != "", F.concat(F.lit("\n\nNgữ cảnh bổ sung:\n"), other)).otherwise(""))
    return d.select("q_id", F.when(F.col("target").isNotNull(), named).otherwise(every).alias("context"))


def recent_turns(history: DataFrame, keys: Sequence[str], turn: str, n: int = 6) -> DataFrame:
    return dedup.keep_first(history, keys, [F.desc(turn)], n)
