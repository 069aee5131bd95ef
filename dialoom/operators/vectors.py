"""Centroids, nearest-centroid scores, exact nearest neighbours and purification over embedding tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import tiers, vectors as fv
from dialoom.operators import slabs

BLOCK_ROWS = 4096


def centroids(df: DataFrame, keys: Sequence[str], vec: str = "embedding", weight: Column | None = None) -> DataFrame:
    """Weighted mean vector per key, scaled to length one; keys without weight get no row.

    Sums are per (key, dimension) with map-side combining, so a key of any size costs one row per task and dimension.
    """
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(*keys, w.alias("_t"), F.posexplode(vec).alias("_i", "_x"))
    return mean_vectors(parts.select(*keys, "_i", (F.col("_x") * F.col("_t")).alias("_s"), "_t", F.lit(1).cast("long").alias("_n")), keys)


def mean_vectors(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`centroids` of sums that were begun elsewhere: keys, dimension `_i`, weighted sum `_s`, weight `_t`, rows `_n`."""
    sums = parts.groupBy(*keys, "_i").agg(F.sum("_s").alias("_s"), F.sum("_t").alias("_t"), F.sum("_n").alias("n"))
    out = sums.filter("_t > 1e-8").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_i", (F.col("_s") / F.col("_t")).alias("v")))).alias("_p"), F.max("n").alias("n"), F.max("_t").alias("weight"))
    return (out.withColumn("centroid", fv.normalized(F.transform("_p", lambda p: p["v"]))).drop("_p")
            .filter("centroid IS NOT NULL"))


def packed_centroids(cents: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One row per key: labels and centroids as arrays in label order (a key has few speakers)."""
    return cents.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid").alias("c")))).alias("cents"))


def scored(df: DataFrame, packed: DataFrame, keys: Sequence[str], vec: str = "embedding") -> DataFrame:
    """Cosine to every centroid of the row's key as `sims`, with the best two."""
    d = df.join(packed, list(keys))
    d = d.withColumn("_v", fv.normalized(F.col(vec)))
    d = d.withColumn("sims", F.transform("cents", lambda c: fv.dot(F.col("_v"), c["c"]))).drop("_v")
    return d.withColumn("_t", fv.top_two(F.col("sims"))).select("*", "_t.*").drop("_t")


def _top_rows(scores: np.ndarray, base_ids: np.ndarray, k: int) -> np.ndarray:
    """Index of the k best columns of a row, smaller id first on ties."""
    n = len(scores)
    if n > k:
        cut = np.partition(scores, n - k)[n - k]
        pool = np.flatnonzero(scores >= cut)
    else:
        pool = np.arange(n)
    return pool[np.lexsort((base_ids[pool], -scores[pool]))][:k]


def nearest(queries: DataFrame, base: DataFrame, k: int, query_id: str, base_id: str, query_vec: str, base_vec: str,
            digits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest base rows per query by dot product (vectors of length one), ties by base id.

    Queries and base are dealt into blocks of about `block_rows` and eight times as many rows; every query block meets
    every base block as one matrix product, which keeps the k best of each query before anything else is shuffled. A
    query's survivors, k per base block, are ranked at the end.
    """
    schema = T.StructType([queries.schema[query_id], base.schema[base_id], T.StructField("score", T.DoubleType())])
    q, b = queries.select(query_id, query_vec), base.select(base_id, base_vec)
    qn, bn = (max(1, math.ceil(d.count() / rows)) for d, rows in ((q, block_rows), (b, 8 * block_rows)))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    ql = q.withColumn("_q", block(query_id, qn)).withColumn("_b", every(bn))
    bl = b.withColumn("_b", block(base_id, bn)).withColumn("_q", every(qn))

    def meet(qs, bs):
        if not len(qs) or not len(bs):
            return pd.DataFrame(columns=[query_id, base_id, "score"])
        bids = bs[base_id].to_numpy()
        s = np.round(np.stack(qs[query_vec].to_numpy()) @ np.stack(bs[base_vec].to_numpy()).T, digits)
        best = [_top_rows(row, bids, k) for row in s]
        at = np.repeat(np.arange(len(s)), [len(x) for x in best])
        col = np.concatenate(best)
        return pd.DataFrame({query_id: qs[query_id].to_numpy()[at], base_id: bids[col], "score": s[at, col]})

    hits = ql.groupBy("_q", "_b").cogroup(bl.groupBy("_q", "_b")).applyInPandas(meet, schema)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), base_id)  # at most k rows per base block
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# fixed values of purification
PURIFY = {"min_sim": 0.35, "min_margin": 0.12, "min_used": 1.20, "min_per_cluster": 3, "min_total": 18,
          "max_imbalance": 6.0, "blend": 0.15, "min_stable": 18, "hub_share": 0.44}


def purify_gates(rows: DataFrame) -> DataFrame:
    """`gate`: the first failed test of each row (valid, tier, short, low_sim, low_margin) or 'ok'."""
    p = PURIFY
    return rows.withColumn("gate", F.when(~F.col("valid"), "invalid").when(~F.col("tier").isin("primary", "aux"), "tier")
                           .when(F.col("used_dur") < p["min_used"], "short").when(F.col("score") < p["min_sim"], "low_sim")
                           .when(F.col("margin") < p["min_margin"], "low_margin").otherwise("ok"))


def purify(rows: DataFrame, cents: DataFrame, keys: Sequence[str], label: str, row_id: str) -> DataFrame:
    """Centroids re-estimated from clean rows and blended with the old ones, where a key passes the health gates.

    `rows`: keys, label, row_id, embedding, valid, tier, used_dur, score, margin. `cents`: keys, label, centroid.
    """
    p, keys = PURIFY, list(keys)
    ok = purify_gates(rows).filter("gate = 'ok'").withColumn("w", F.col("used_dur") * F.greatest("score", F.lit(1e-4)))
    per = ok.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("lw"))
    per = cents.select(*keys, label).join(per, [*keys, label], "left").fillna({"n": 0, "lw": 0.0})
    health = per.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("lw").alias("tw"))
    health = health.withColumn("skip_reason", F.when(F.col("total") < p["min_total"], "insufficient_total_candidates")
                               .when(F.col("low") < p["min_per_cluster"], "insufficient_per_cluster_candidates")
                               .when(F.col("high") / F.greatest("low", F.lit(1)) > p["max_imbalance"], "cluster_imbalance_too_high"))
    per = per.join(health.select(*keys, "tw", "skip_reason"), keys)
    hub = (F.col("tw") > 1e-8) & (F.col("lw") / F.col("tw") > p["hub_share"])
    per = per.withColumn("keep", F.when(hub, F.greatest(F.lit(1), F.floor(F.col("n") * p["hub_share"]))).otherwise(F.col("n")))
    per = per.withColumn("use", F.col("skip_reason").isNull() & (F.col("n") >= p["min_stable"]))
    # hub clusters keep their heaviest rows: the rank is a running count, so a hub is never sorted in one task
    lab = ok.join(per.filter("use").select(*keys, label, "keep"), [*keys, label])
    lab = lab.withColumns({"_neg": -F.col("w"), "_milli": F.floor(-F.col("w") * 1000).cast("long")})
    lab = slabs.with_slab(lab, "_milli", slabs.slab_width(lab, [*keys, label], "_milli", coarse=100_000))
    lab = slabs.running_sums(lab, [*keys, label], ["_neg", row_id], {"_rank": F.lit(1).cast("long")})
    chosen = lab.filter(F.col("_rank") <= F.col("keep"))
    fresh = centroids(chosen, [*keys, label], weight=F.col("w")).select(*keys, label, F.col("centroid").alias("fresh"))
    out = cents.join(fresh, [*keys, label], "left").join(per.select(*keys, label, "n", "skip_reason"), [*keys, label])
    blend = fv.normalized(F.zip_with("fresh", "centroid", lambda a, b: a * (1 - p["blend"]) + b * p["blend"]))
    out = out.withColumn("purified", F.when(F.col("fresh").isNotNull(), blend).otherwise(F.col("centroid")))
    return out.withColumn("shift_cosine", F.when(F.col("fresh").isNotNull(), fv.dot(F.col("centroid"), F.col("purified"))).otherwise(1.0)).drop("fresh")
