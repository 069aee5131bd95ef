"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column) -> Column:
    return let(norm(a), lambda n: F.when(n > 1e-8, F.transform(a, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def top_two(scores: Column) -> Column:
    """struct(top1_label, top1_score, top2_label, top2_score) of a score array; the smaller index wins ties."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("n"), i.alias("i"))))
    return let(ranked, lambda r: F.struct(
        F.get(r, F.lit(0))["i"].alias("top1_label"), (-F.get(r, F.lit(0))["n"]).alias("top1_score"),
        F.get(r, F.lit(1))["i"].alias("top2_label"), F.coalesce(-F.get(r, F.lit(1))["n"], F.lit(0.0)).alias("top2_score")))
