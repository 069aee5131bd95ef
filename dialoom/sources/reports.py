"""Result sinks: JSON lines, manifests, meeting documents, Markdown reports, block dumps, run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_jsonl(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def as_json(df: DataFrame, keys: Sequence[str], out: str = "json") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias(out))


def _span(x: Column) -> Column:
    return F.format_string("[%.1fs - %.1fs]", x["start_ms"] / 1000, x["end_ms"] / 1000)


def markdown(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Six-section report of `summary.meeting_documents` rows."""
    nl = "\n"
    block = lambda arr, fn, empty: F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, F.array_join(F.transform(arr, fn), nl)).otherwise(empty)
    or_text = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs[:-1]], F.lit(cs[-1]))
    none = lambda c: F.coalesce(c, F.lit("None"))
    parts = [
        F.lit("# 1. TÓM TẮT NỘI DUNG CHÍNH CỦA CUỘC HỘI THOẠI\n"),
        or_text(F.col("conversation_main_summary"), F.col("meeting_overview"), "Không đủ bằng chứng để tóm tắt nội dung chính."),
        F.lit("\n# 2. TÓM TẮT THEO TỪNG NGƯỜI NÓI\n"),
        block("speakers", lambda x: F.concat(F.lit("- **"), x["speaker"], F.lit("**: "), x["main_summary"], F.lit("\n  - confidence: "), x["confidence"],
                                             F.lit("\n  - evidence_spans: "), _span(x)), "Không đủ bằng chứng để tóm tắt theo từng người nói."),
        F.lit("\n# 3. TỔNG QUAN CUỘC HỌP\n"), or_text(F.col("meeting_overview"), "Không đủ bằng chứng để kết luận tổng quan."),
        F.lit("\n# 4. ACTION ITEMS\n"),
        block("action_items", lambda x: F.concat(F.lit("- owner: "), none(x["owner"]), F.lit("\n  - task: "), none(x["task"]), F.lit("\n  - status: "), none(x["status"])),
              "Không có action item rõ ràng."),
        F.lit("\n# 5. SPEAKER INSIGHTS\n"),
        block("speakers", lambda x: F.concat(F.lit("- **"), x["speaker"], F.lit("**: "), x["insight"], F.lit("\n  - evidence_spans: "), _span(x)),
              "Không đủ bằng chứng để trích xuất speaker insights."),
        F.lit("\n# 6. CLEANED TRANSCRIPT\n"),
        F.coalesce(F.array_join(F.transform("cleaned_transcript", lambda x: F.concat(_span(x), F.lit(" "), x["speaker"], F.lit(": "), x["text"])), nl), F.lit(""))]
    return docs.select(*keys, F.concat_ws(nl, *parts).alias("markdown"))


def write_markdown(md: DataFrame, path: str, key: str) -> None:
    md.select(F.col(key).alias("meeting"), F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("meeting").text(path)


def write_manifests(df: DataFrame, path: str) -> None:
    """Manifest rows with `stage` and `split` columns, one folder each."""
    df.write.mode("overwrite").partitionBy("stage", "split").json(path)


def dump_blocks(blocks: DataFrame, normalized: DataFrame, summaries: DataFrame, path: str) -> None:
    """Intermediate blocks by kind (raw, normalized, summary) as JSON."""
    u = None
    for kind, df in (("raw", blocks), ("normalized", normalized), ("summary", summaries)):
        one = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value"))
        u = one if u is None else u.unionByName(one)
    u.write.mode("overwrite").partitionBy("kind").text(path)


def run_report(stages: DataFrame, counters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One nested report row per key: stage metrics as a list, counters as a struct."""
    cols = [c for c in stages.columns if c not in keys]
    rep = stages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("stages"))
    return rep.join(counters.select(*keys, F.struct(*[c for c in counters.columns if c not in keys]).alias("counters")), list(keys), "left")
