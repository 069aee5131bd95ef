"""Ordered scans that never put one whole key into one task.

A running aggregate over `Window.partitionBy(key)` sorts all rows of a key in a single task; a recording (or any key)
holding a third of the table would stall the job. Here every key is cut into *slabs* along its order: windows run
inside (key, slab), each slab yields one summary row, only the summary rows of a key meet in one task, and what they
carry over is joined back. One scan reads its input twice (rows and summaries), so scans that build on each other are
folded into one wherever the carried state allows it.
"""

from __future__ import annotations

import builtins
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLAB = "_slab"
COARSE_MS = 3_600_000
ROWS_PER_SLAB = 500_000

_FIRST = Window.unboundedPreceding
_LAST = Window.unboundedFollowing


def slab_width(df: DataFrame, keys: Sequence[str], at: str, rows_per_slab: int = ROWS_PER_SLAB,
               coarse: int = COARSE_MS) -> int:
    """Slab width along `at` such that the densest stretch of any key keeps about `rows_per_slab` rows per slab.

    One column-pruned pass with map-side counting; a single number reaches the driver.
    """
    peak = (df.groupBy(*keys, F.floor(F.col(at) / coarse).alias("_c")).count()
            .agg(F.max("count")).first()[0]) or 1
    return int(builtins.max(1, builtins.min(coarse, coarse * rows_per_slab // peak)))


def with_slab(df: DataFrame, at: str, width: int) -> DataFrame:
    return df.withColumn(SLAB, F.floor(F.col(at) / F.lit(width)).cast("long"))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
         local: Callable[[WindowSpec], list[Mapping[str, Column]]],
         summary: Sequence[Column],
         carry: Callable[[WindowSpec], list[Mapping[str, Column]]],
         carried: Sequence[str]) -> DataFrame:
    """The general slab scan.

    `df` has the `_slab` column, non-decreasing along `order`. `local(w)` gives columns computed inside a slab (a list
    of layers, later ones may use earlier ones), `summary` the aggregates of a slab, `carry(w)` layers over the summary
    rows of a key ordered by slab, `carried` the columns joined back to the rows.
    """
    rows = df
    for layer in local(Window.partitionBy(*keys, SLAB).orderBy(*order)):
        rows = rows.withColumns(dict(layer))
    sums = rows.groupBy(*keys, SLAB).agg(*summary)
    for layer in carry(Window.partitionBy(*keys).orderBy(SLAB)):
        sums = sums.withColumns(dict(layer))
    return rows.join(sums.select(*keys, SLAB, *carried), [*keys, SLAB])


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(_FIRST, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(_FIRST, 0)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, Column],
                 next_of: Mapping[str, str] | None = None, inclusive: bool = True) -> DataFrame:
    """Running sums `cols` (named outputs); `next_of` also fetches a column of the key's next row (first of a slab's
    order column must identify it, i.e. the column is the leading order column)."""
    next_of = next_of or {}
    inp = {f"_i_{n}": c for n, c in cols.items()}
    frame = upto if inclusive else before
    out = scan(
        df.withColumns(inp), keys, order,
        local=lambda w: [{**{f"_l_{n}": F.sum(f"_i_{n}").over(frame(w)) for n in cols},
                          **{f"_n_{n}": F.lead(c).over(w) for n, c in next_of.items()}}],
        summary=[*[F.sum(f"_i_{n}").alias(f"_t_{n}") for n in cols],
                 *[F.min(c).alias(f"_f_{n}") for n, c in next_of.items()], F.count(F.lit(1)).alias("_rows")],
        carry=lambda w: [{**{f"_c_{n}": F.sum(f"_t_{n}").over(before(w)) for n in cols},
                          **{f"_x_{n}": F.lead(f"_f_{n}").over(w) for n in next_of}}],
        carried=[*[f"_c_{n}" for n in cols], *[f"_x_{n}" for n in next_of]])
    out = out.withColumns({**{n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
                              for n in cols},
                           **{n: F.coalesce(F.col(f"_n_{n}"), F.col(f"_x_{n}")) for n in next_of}})
    return out.drop(*[f"_{p}_{n}" for n in cols for p in "ilc"], *[f"_{p}_{n}" for n in next_of for p in "nx"])


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], offset: int,
              cols: Mapping[str, Column]) -> DataFrame:
    """lead (offset 1) or lag (offset -1) across slab borders."""
    if offset not in (1, -1):
        raise ValueError("offset is 1 or -1")
    step = F.lead if offset == 1 else F.lag
    edge = F.min_by if offset == 1 else F.max_by
    rank = F.struct(*[F.col(o) for o in order])
    out = scan(
        df.withColumn("_pack", F.struct(*[c.alias(n) for n, c in cols.items()])), keys, order,
        local=lambda w: [{"_near": step("_pack").over(w)}],
        summary=[edge("_pack", rank).alias("_edge")],
        carry=lambda w: [{"_far": step("_edge").over(w)}],
        carried=["_far"])
    got = F.when(F.col("_near").isNotNull(), F.col("_near")).otherwise(F.col("_far"))
    out = out.withColumn("_got", got)
    return out.withColumns({n: F.col("_got")[n] for n in cols}).drop("_pack", "_near", "_far", "_got")
