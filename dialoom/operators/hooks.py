"""Where models plug in. A hook is a factory: it runs once per Python worker and returns the function for a batch.

Rule paths stand in for missing models, so every flow runs without one.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import text, validate
from dialoom.operators import summary, vectors
from dialoom.session import cut_lineage

Batch = Callable[[pd.DataFrame], Sequence]
QUOTA_MARKS = ["429", "RESOURCE_EXHAUSTED"]  # fixed values


def with_retry(fn: Callable, arg, tries: int = 5, first_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """Call with exponential back-off while the model's quota is exhausted; any other failure is raised at once."""
    for i in range(tries):
        try:
            return fn(arg)
        except Exception as e:
            if i == tries - 1 or not any(mark in str(e) for mark in QUOTA_MARKS):
                raise
            sleep(first_wait * 2 ** i)


def call_model(df: DataFrame, factory: Callable[[], Batch], out: str, kind: T.DataType, batch: int = 80, tries: int = 5) -> DataFrame:
    """Add column `out` with the hook's answer per row, `batch` rows per call."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterable[pd.DataFrame]):
        fn = factory()
        for pdf in batches:
            for part, got in answers(fn, pdf, batch, tries):
                yield part.assign(**{out: list(got)})

    return df.mapInPandas(run, schema)


def answers(fn: Batch, pdf: pd.DataFrame, batch: int, tries: int):
    """(rows, answers) of the hook, `batch` rows per call."""
    for i in range(0, len(pdf), batch):
        part = pdf.iloc[i:i + batch]
        yield part, with_retry(fn, part, tries)


# ---- block summaries --------------------------------------------------------------------------------------------------

def prompt(d: DataFrame) -> Column:
    """JSON request for a block (after `summary.features`)."""
    sec = lambda ms: F.format_string("%.1f", ms / 1000)
    shown = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("["), sec(x["start_ms"]), F.lit("s - "), sec(x["end_ms"]), F.lit("s] "), x["speaker"], F.lit(": "), x["text"])), "\n")
    return F.to_json(F.struct("block_id", F.concat(sec(F.col("start_ms")), F.lit("s - "), sec(F.col("end_ms")), F.lit("s")).alias("time"),
                              F.slice("tags", 1, 10).alias("candidate_tags"), F.col("has_actions").alias("has_action_hints"), shown.alias("lines")))


def summarize_blocks(features: DataFrame, keys: Sequence[str], factory: Callable[[], Batch] | None = None, repair: Callable[[], Batch] | None = None,
                     mode: summary.Mode = summary.STABLE) -> DataFrame:
    """Block summaries: a model for the best-scoring blocks that deserve one, the rule for the rest and for bad answers.

    Returns keys, block_id, segment_type, overview, key_points, action_items, speaker_insights, facts, notes.
    """
    keys = list(keys)
    ids = [*keys, "block_id"]
    rule = summary.summarize_rule(features)
    cols = ["segment_type", "overview", "key_points", "action_items", "speaker_insights", "facts", "notes"]
    lean = rule.withColumns({
        "action_items": F.transform("action_items", lambda a: F.struct(a["owner"].alias("owner"), a["task"].alias("task"), a["status"].alias("status"))),
        "speaker_insights": F.transform("speaker_insights", lambda a: F.struct(a["speaker"].alias("speaker"), a["role_in_block"].alias("role_in_block"), a["detail"].alias("detail")))}).select(*ids, *cols)
    if factory is None:
        return lean
    routed = summary.routing(features, mode)
    chosen = summary.choose_blocks(routed, keys, mode).filter(~F.col("skip_summary"))
    ask = chosen.select(*ids, prompt(chosen).alias("prompt"), "max_tokens")

    def judged(d: DataFrame, note: str) -> DataFrame:
        s = d.withColumn("_s", validate.block_summary(F.col("answer"), F.col("block_id"))).select(*ids, "prompt", "max_tokens", "_s.segment_type", "_s.overview", "_s.key_points", "_s.action_items",
                                                                                                   "_s.speaker_insights", "_s.facts", "_s.severe")
        full = (F.col("overview") != "") | (F.size("key_points") > 0) | (F.size("facts") > 0) | (F.size("action_items") > 0)
        return s.withColumns({"ok": full | ~F.col("severe"), "notes": F.array(F.when(full, note).otherwise(note + "_soft"))})

    # answers are kept: several branches read them, and the model must not be asked twice
    first = cut_lineage(judged(call_model(ask, factory, "answer", T.StringType()), "model_extract"))
    good = first.filter("ok").select(*ids, *cols)
    if repair is not None:
        again = call_model(first.filter("NOT ok").select(*ids, "prompt", "max_tokens"), repair, "answer", T.StringType())
        good = good.unionByName(cut_lineage(judged(again, "model_extract_repaired")).filter("ok").select(*ids, *cols))
    return good.unionByName(lean.join(good.select(*ids), ids, "left_anti"))


# ---- speech to text ---------------------------------------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def compression_ratio(s: pd.Series) -> pd.Series:
    raw = s.fillna("").str.encode("utf-8")
    return raw.map(lambda b: len(b) / max(len(zlib.compress(b)), 1) if b else 0.0)


def transcribe(df: DataFrame, first: Callable[[], Batch], second: Callable[[], Batch], row_id: Sequence[str], dur_ms: Column, max_ratio: float = 2.4) -> DataFrame:
    """Text per segment: suspicious first answers are asked again, a second suspicious one becomes empty (`was_retried`)."""
    ids = list(row_id)
    a = call_model(df, first, "_t1", T.StringType()).withColumn("_t1", text.strip(F.coalesce("_t1", F.lit(""))))
    a = cut_lineage(a.withColumn("_bad", (F.col("_t1") != "") & ((compression_ratio("_t1") > max_ratio) | text.is_hallucination(F.col("_t1"), dur_ms))))
    b = call_model(a.filter("_bad").drop("_t1", "_bad"), second, "_t2", T.StringType()).withColumn("_t2", text.strip(F.coalesce("_t2", F.lit(""))))
    b = b.withColumn("_t2", F.when(text.is_hallucination(F.col("_t2"), dur_ms), "").otherwise(F.col("_t2"))).select(*ids, "_t2")
    out = a.join(b, ids, "left")
    return out.withColumns({"predicted_text": F.when(F.col("_bad"), F.coalesce("_t2", F.lit(""))).otherwise(F.col("_t1")), "was_retried": F.col("_bad")}).drop("_t1", "_t2", "_bad")


# ---- span embeddings --------------------------------------------------------------------------------------------------

SHARES = 8   # tasks a core that embed windows
LONG_MS, WINDOW_MS, HOP_MS, SHRINK_MS, MIN_MS, SHORTEST_MS = 3000, 1500, 750, 100, 300, 200  # fixed values


def embedding_windows(df: DataFrame) -> DataFrame:
    """Windows a span is embedded by: itself up to 3 s, else 1.5 s windows every 0.75 s; each shrunk by 0.1 s per side."""
    dur = F.col("end_ms") - F.col("start_ms")
    n = F.floor((dur - WINDOW_MS) / HOP_MS)
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), n)), lambda i: F.struct(
        (F.col("start_ms") + i * HOP_MS).alias("a"), (F.col("start_ms") + i * HOP_MS + WINDOW_MS).alias("b")))
    spans = F.when(dur > LONG_MS, many).otherwise(F.array(F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))))
    d = df.filter(dur >= MIN_MS).withColumn("_w", F.explode(spans))
    d = d.withColumns({"win_start_ms": F.col("_w.a") + SHRINK_MS, "win_end_ms": F.col("_w.b") - SHRINK_MS}).drop("_w")
    return d.filter(F.col("win_end_ms") - F.col("win_start_ms") >= SHORTEST_MS)


def summed(vecs: list | np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[list, list, list]:
    """Per run of rows (beginning at `starts`) and dimension: weighted sum, weight, rows. Rows without a vector don't count,
    an entry that is null counts with its weight but adds nothing, and shorter vectors lack the last dimensions."""
    if isinstance(vecs, np.ndarray) and np.isfinite(vecs).all():
        k, n = vecs.shape[1], np.diff(np.append(starts, len(vecs)))
        total = np.add.reduceat(weight, starts)
        return np.add.reduceat(vecs * weight[:, None], starts, axis=0).tolist(), [[t] * k for t in total.tolist()], [[m] * k for m in n.tolist()]
    ok = np.array([v is not None for v in vecs], bool)
    size = np.array([0 if v is None else len(v) for v in vecs], np.int64)
    wide = int(size.max(initial=0))
    has = np.arange(wide) < size[:, None]
    if ok.all() and (size == wide).all():
        x = np.array([[np.nan if e is None else e for e in v] if None in v else v for v in map(list, vecs)], float).reshape(len(vecs), wide)
    else:
        x = np.zeros((len(vecs), wide))
        for i in np.flatnonzero(size):
            x[i, :size[i]] = [np.nan if e is None else e for e in vecs[i]]
    null = np.zeros_like(has)
    for i in np.flatnonzero(np.isnan(x).any(axis=1)):
        null[i, :size[i]] = [e is None for e in vecs[i]]
    add = lambda v: np.add.reduceat(v, starts, axis=0)
    sums, there = add(np.where(null, 0.0, x * weight[:, None])), add((has & ~null).astype(np.int64))
    total, n, most = add(np.where(has, weight[:, None], 0.0)), add(has.astype(np.int64)), np.maximum.reduceat(size, starts)
    cut = lambda v: [row[:k] for row, k in zip(v.tolist(), most.tolist())]
    gone = there == 0
    s = cut(sums)
    for i, j in zip(*np.nonzero(gone & (np.arange(wide) < most[:, None]))):
        s[i][j] = None
    return s, cut(total), cut(n)


def embed_spans(df: DataFrame, row_id: Sequence[str], factory: Callable[[], Batch], batch: int = 80, tries: int = 5) -> DataFrame:
    """Duration-weighted mean embedding per span (`embedding`, `used_ms`, `n_sub`); the hook embeds single windows.

    Spans are dealt evenly over the tasks, as one of few bytes can have very many windows. A span's windows follow each other,
    so the task that embeds them adds them up, and only sums per span and batch are grouped.
    """
    ids = list(row_id)
    slots = df.sparkSession.sparkContext.defaultParallelism * SHARES
    cells = {"_s": T.DoubleType(), "_t": T.DoubleType(), "_n": T.LongType()}
    schema = T.StructType([*[df.schema[c] for c in ids], *[T.StructField(c, T.ArrayType(t)) for c, t in cells.items()]])

    def run(batches: Iterable[pd.DataFrame]):
        fn = factory()
        for pdf in batches:
            if not len(pdf):
                continue
            got = [a for _, a in answers(fn, pdf, batch, tries)]
            flat = all(isinstance(a, np.ndarray) and a.ndim == 2 and a.shape[1] == got[0].shape[1] for a in got)
            vecs = np.concatenate(got) if flat else [v for a in got for v in a]
            new = np.zeros(len(pdf), bool)
            new[0] = True
            for c in ids:
                v = pdf[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            weight = (pdf["win_end_ms"].to_numpy() - pdf["win_start_ms"].to_numpy()).astype(float)
            yield pdf.iloc[starts][ids].assign(**dict(zip(cells, summed(vecs, weight, starts))))

    parts = embedding_windows(df.repartition(slots)).mapInPandas(run, schema)
    c = vectors.mean_vectors(parts.select(*ids, F.posexplode(F.arrays_zip(*cells)).alias("_i", "_c")).select(*ids, "_i", "_c.*"), ids)
    return c.select(*ids, F.col("centroid").alias("embedding"), F.col("weight").cast("long").alias("used_ms"), F.col("n").alias("n_sub"))


def reduce_meetings(norm: DataFrame, sums: DataFrame, keys: Sequence[str], factory: Callable[[], Batch] | None = None) -> DataFrame:
    """Meeting documents by rule, or with overview and main summary from a model where its answer has both parts."""
    docs = summary.meeting_documents(norm, sums, keys)
    if factory is None:
        return docs
    packed = sums.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("block_id", "segment_type", "overview", "key_points")))).alias("prompt"))
    ans = cut_lineage(call_model(packed, factory, "answer", T.StringType()))
    v = F.try_parse_json(text.unfence_json(F.col("answer")))
    got = ans.select(*keys, F.try_variant_get(v, "$.meeting_overview", "string").alias("_mo"), F.try_variant_get(v, "$.segments", "variant").isNotNull().alias("_seg"),
                     F.try_variant_get(v, "$.conversation_main_summary", "string").alias("_ms"))
    d = docs.join(got, list(keys), "left")
    ok = F.col("_seg") & F.col("_mo").isNotNull()
    return d.withColumns({"meeting_overview": F.when(ok, F.col("_mo")).otherwise(F.col("meeting_overview")),
                          "conversation_main_summary": F.when(ok, F.coalesce("_ms", "_mo")).otherwise(F.col("conversation_main_summary"))}).drop("_mo", "_ms", "_seg")
