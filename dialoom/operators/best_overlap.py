"""The span that overlaps another one most, without pairs: four searches in sorted arrays per time slab.

Of all reference spans that overlap a row, the best one covers the row, crosses its start, crosses its end, or lies in it:
  - any covering span shares the whole row; the one with the smallest id is wanted: a search in two dimensions;
  - if none covers, the best over the start is the latest end among spans that begin before it, the best over the end the
    earliest start among spans that end behind it: running extremes;
  - the best inside is the longest: again a search in two dimensions.
Searches in two dimensions go through blocks of 1, 2, 4, ... points, sorted and with running maxima, for all rows at once.

Rows and references stand in every slab they touch. What covers or crosses the start is searched in the row's first slab, what
crosses the end in its last one, and what lies inside in all of them, among references that start there. So each row leaves
at most three candidates a slab, and their best is the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.operators import slabs
from dialoom.operators.jumps import whole_groups
from dialoom.operators.spans import E, S, bins

NONE = -1


def best_below(x: np.ndarray, y: np.ndarray, value: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the largest `value` (at least 0) of the points with x <= qx and y <= qy; NONE if there are none."""
    n, out = len(x), np.full(len(qx), NONE, np.int64)
    if not n or not len(qx):
        return out
    order = np.argsort(x, kind="stable")
    before = np.searchsorted(x[order], qx, "right")                       # points that x allows: a prefix
    levels = np.unique(y)
    rank, wanted = np.searchsorted(levels, y[order]), np.searchsorted(levels, qy, "right") - 1
    full = 1 << max(0, n - 1).bit_length()
    rank = np.append(rank, np.full(full - n, len(levels)))
    held = np.append(value[order], np.full(full - n, NONE))
    size, span = 1, len(levels) + 1
    while size <= n:
        rows = rank.reshape(-1, size)
        at = np.argsort(rows, axis=1, kind="stable")
        line = (np.take_along_axis(rows, at, 1) + np.arange(len(rows))[:, None] * span).ravel()
        top = np.maximum.accumulate(np.take_along_axis(held.reshape(-1, size), at, 1), axis=1).ravel()
        some = np.flatnonzero(before & size)                              # prefixes are made of blocks of different sizes
        block = before[some] // size - 1
        end = np.searchsorted(line, block * span + wanted[some], "right")
        hit = end > block * size
        out[some[hit]] = np.maximum(out[some[hit]], top[end[hit] - 1])
        size *= 2
    return out


def extreme(key: np.ndarray, value: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query the largest `value` of the points with key <= q; NONE if there are none."""
    if not len(key):
        return np.full(len(q), NONE, np.int64)
    order = np.argsort(key, kind="stable")
    top = np.maximum.accumulate(value[order])
    n = np.searchsorted(key[order], q, "right")
    return np.where(n > 0, top[np.maximum(n, 1) - 1], NONE)


def ranked(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of rows by columns (the first decides), and the rows in order of rank."""
    order = np.lexsort(columns[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, order


def candidates(hs: np.ndarray, he: np.ndarray, first: np.ndarray, last: np.ndarray, rs: np.ndarray, re: np.ndarray, ids: np.ndarray,
               home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, references) of the candidates of one slab."""
    by_id, order_id = ranked(-ids)
    by_end, order_end = ranked(re, -ids)
    by_start, order_start = ranked(-rs, -ids)
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    inner = np.flatnonzero(home)
    by_length, order_length = ranked((re - rs)[inner], -ids[inner])
    found = [(a, best_below(rs, -re, by_id, hs[a], -he[a]), order_id), (a, extreme(rs, by_end, hs[a]), order_end),
             (z, extreme(-re, by_start, -he[z]), order_start),
             (np.arange(len(hs)), best_below(-rs[inner], re[inner], by_length, -hs, he), inner[order_length])]
    return [(rows[best >= 0], refs[best[best >= 0]]) for rows, best, refs in found if len(refs)]


def best_overlaps(df: DataFrame, refs: DataFrame, keys: Sequence[str], row_id: str = "seg_id", width: int | None = None, min_ms: int = 1) -> DataFrame:
    """keys, `row_id`, ref_id, overlap_ms: for each row the reference of its key that it shares most time with (the smallest
    id on ties), if that is at least `min_ms`. Ids are longs and identify rows and references within a key."""
    keys = list(keys)
    width = width or slabs.slab_width(refs, keys, S)
    slab = lambda c: F.floor(c / width).cast("long")
    one = lambda d, who: (d.filter(F.col(E) > F.col(S)).select(*keys, F.lit(who).alias("_row"), F.col(row_id).cast("long").alias("_id"), S, E)
                          .withColumn(slabs.SLAB, F.explode(bins(F.col(S), F.col(E), width))))
    rows = one(df, True).unionByName(one(refs, False))
    rows = rows.withColumns({"_first": slab(F.col(S)) == F.col(slabs.SLAB), "_last": slab(F.col(E) - 1) == F.col(slabs.SLAB)})
    group = [*keys, slabs.SLAB]
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_id", T.LongType()), T.StructField("ref_id", T.LongType()), T.StructField("overlap_ms", T.LongType())])

    def search(batches):
        for many in whole_groups(batches, group):
            for _, pdf in many.groupby(group, sort=False):
                h, r = pdf[pdf["_row"]], pdf[~pdf["_row"]]
                if not len(h) or not len(r):
                    continue
                hs, he, rs, re = (d[c].to_numpy(np.int64) for d in (h, r) for c in (S, E))
                ids = r["_id"].to_numpy(np.int64)
                got = candidates(hs, he, h["_first"].to_numpy(bool), h["_last"].to_numpy(bool), rs, re, ids, r["_first"].to_numpy(bool))
                i, j = (np.concatenate(x) for x in zip(*got))
                shared = np.minimum(he[i], re[j]) - np.maximum(hs[i], rs[j])
                keep = shared >= min_ms
                res = h.iloc[i[keep]][[*keys, "_id"]].reset_index(drop=True)
                res["ref_id"], res["overlap_ms"] = ids[j[keep]], shared[keep]
                yield res

    found = rows.repartition(*group).sortWithinPartitions(*group).mapInPandas(search, out)
    best = F.max_by(F.struct("ref_id", "overlap_ms"), F.struct("overlap_ms", -F.col("ref_id")))
    return found.groupBy(*keys, "_id").agg(best.alias("m")).select(*keys, F.col("_id").alias(row_id), "m.ref_id", "m.overlap_ms")
