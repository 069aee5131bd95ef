"""Duplicate removal that equals the sequential "compare with kept rows" loop, and usage quotas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import settle
from dialoom.operators.spans import E, S
from dialoom.session import cut_lineage


def keep_first(df: DataFrame, by: Sequence[str | Column], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first `n` rows per key. Spark limits the window before the shuffle, so a hot key sends few rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


@lru_cache(maxsize=4096)
def _tokens(joined: str) -> frozenset[str]:
    return frozenset(joined.split(" "))


def near_duplicates(df: DataFrame, keys: Sequence[str], node_id: str, text_col: str, max_shift_ms: int = 1000,
                    similarity: float = 0.8, width: int | None = None) -> DataFrame:
    """Drop a row when an earlier kept row has |dstart| + |dend| < `max_shift_ms` and token similarity > `similarity`.

    Rows are ordered by (start, end, id). Copies with equal span and token set are reduced to their first row up front
    (whatever removes the first removes them); the others are settled in one ordered pass over a second of kept rows. A
    set travels as one text and is only taken apart for rows that are close enough in time.
    """
    d = df.withColumn("_set", text.token_set(F.col(text_col)))
    blank = d.filter(F.size("_set") == 0)  # empty sets match nothing
    worded = d.filter(F.size("_set") > 0).withColumn("_set", F.array_join(F.array_sort("_set"), " "))
    firsts = cut_lineage(keep_first(worded, [*keys, S, E, "_set"], [node_id]))

    def match(a: tuple, b: tuple) -> bool:
        if abs(a[0] - b[0]) + abs(a[1] - b[1]) >= max_shift_ms:
            return False
        x, y = _tokens(a[2]), _tokens(b[2])
        most, least = max(len(x), len(y)), min(len(x), len(y))
        return least / most > similarity and len(x & y) / most > similarity

    kept = settle.kept_rows(firsts, keys, node_id, F.col(S) + (max_shift_ms - 1), match, "_set", width=width)
    return kept.select(*df.columns).unionByName(blank.select(*df.columns))


def same_text_duplicates(df: DataFrame, keys: Sequence[str], node_id: str, text_col: str, edge_ms: int = 300, iou: float = 0.85,
                         width: int | None = None) -> DataFrame:
    """Drop a row when an earlier kept row of the key has the same clean text and both edges within `edge_ms`, or a
    hull IoU of at least `iou`.

    Rows are ordered by (start, end, id). A row can match what starts within `edge_ms`, or within the share of its
    length that such an IoU leaves; rows of one text are settled in one ordered pass.
    """
    d = df.withColumn("_t", text.stable_id(text.squeeze(F.col(text_col))))
    firsts = cut_lineage(keep_first(d, [*keys, "_t", S, E], [node_id]))
    reach = F.col(S) + F.greatest(F.lit(edge_ms), F.ceil((F.col(E) - F.col(S)) * (1 - iou)) + 1)

    def match(a: tuple, b: tuple) -> bool:
        if abs(a[0] - b[0]) <= edge_ms and abs(a[1] - b[1]) <= edge_ms:
            return True
        hull = max(a[1], b[1]) - min(a[0], b[0])
        return hull > 0 and max(0, min(a[1], b[1]) - max(a[0], b[0])) / hull >= iou

    return settle.kept_rows(firsts, [*keys, "_t"], node_id, reach, match, width=width).select(*df.columns)


def exact_fingerprint(df: DataFrame, parts: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """First row per fingerprint of the given parts."""
    return keep_first(df.withColumn("fingerprint", text.stable_id(*parts)), ["fingerprint"], order)


def reuse_quota(df: DataFrame, ids: str, seq: str, limit: int = 2) -> DataFrame:
    """Admit rows in `seq` order while every id in the array `ids` has been admitted fewer than `limit` times.

    A row is certainly admitted once it is among the first `limit` live rows of each of its ids, and certainly rejected
    once one of its ids has `limit` admitted rows; rounds repeat until all rows are decided. Rows without ids pass.
    """
    uses = df.select(seq, F.explode(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))).alias("_u"))
    need = df.select(seq, F.size(F.array_distinct(ids)).alias("_n"))
    live = cut_lineage(uses.join(need, seq))
    admitted = None
    while True:
        lead = keep_first(live, ["_u"], [seq], limit)
        ok = cut_lineage(lead.groupBy(seq, "_n").count().filter("count = _n").select(seq))
        full = (lead.join(ok, seq, "left_semi").groupBy("_u").count().filter(F.col("count") >= limit).select("_u"))
        lost = live.join(full, "_u", "left_semi").select(seq).subtract(ok)
        nxt = cut_lineage(live.join(lost, seq, "left_anti"))
        admitted = ok
        if nxt.join(ok, seq, "left_anti").isEmpty():
            break
        live = nxt
    free = df.filter(F.coalesce(F.size(ids), F.lit(0)) <= 0)
    return df.join(admitted, seq, "left_semi").unionByName(free)
