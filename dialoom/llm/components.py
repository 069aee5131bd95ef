"""Connected groups of an edge table by alternating large and small stars, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b). Minima are summed up map-side; the join may split a hub's rows."""
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a")
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges
    low = written(low, "star-minima")
    out = moved.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionAll(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of an edge table (a, b) of longs; root is the smallest node of its group.

    Rounds grow with the logarithm of the longest chain, not with its length. Self edges and repeats are allowed.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    if not seen[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        edges = written(_star(written(_star(edges, True), "large-star"), False), "small-star")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots), "components")
