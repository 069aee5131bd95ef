"""The sequential rule "drop a row that matches an earlier kept row", settled in pieces that don't wait for each other.

Rows of a key are ordered by (start, end, id). A row can match later rows that start no later than its *reach*. The key
is cut at moments that few rows reach across: in every slab at the moment with the fewest. A piece is one ordered pass
that holds only rows that may still match something. What it can't know are the rows from before its cut that reach into
it, at most `MOST_OPEN` of them; so every row gets a truth table over these: bit e says whether it is kept when the open
rows are kept as the bits of e say. With no open rows, and without matches, tables are constant.

The open rows of a piece have tables of their own in the piece before, so the true e of each piece follows from the one
before by looking bits up: a few numbers a cut. Three shuffles settle everything, however long chains of matches are. A
stretch in which every moment has more open rows than that isn't cut and stays one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.operators import slabs, spans
from dialoom.operators.spans import E, S
from dialoom.session import cut_lineage

MOST_OPEN = 6                                       # open rows of a cut: tables of 2^6 bits fit in a long
ALL = (1 << 64) - 1
FIRST = -(1 << 63)                                  # name of the piece before the first cut
OPEN = [sum(1 << e for e in range(64) if e >> j & 1) for j in range(MOST_OPEN)]

Match = Callable[[tuple, tuple], bool]


def cuts(df: DataFrame, keys: Sequence[str], reach: str, width: int) -> DataFrame:
    """(keys, slab, cut, prev): each slab's best moment to cut at (null if none will do) and the cut before the slab."""
    crossing = df.filter(F.col(reach) > F.col(S)).select(*keys, (F.col(S) + 1).alias(S), (F.col(reach) + 1).alias(E))
    steps = spans.depth_steps(crossing, keys, width=width)
    best = (steps.groupBy(*keys, slabs.SLAB).agg(F.min(F.struct("depth", "t")).alias("b"))
            .select(*keys, slabs.SLAB, F.when(F.col("b.depth") <= MOST_OPEN, F.col("b.t")).alias("cut")))
    # a slab may have rows but no moment, or a moment but no rows
    every = best.unionByName(slabs.with_slab(df, S, width).select(*keys, slabs.SLAB).distinct().withColumn("cut", F.lit(None).cast("long")))
    every = every.groupBy(*keys, slabs.SLAB).agg(F.max("cut").alias("cut"))
    w = Window.partitionBy(*keys).orderBy(slabs.SLAB)
    return every.withColumn("prev", F.coalesce(F.last("cut", True).over(slabs.before(w)), F.lit(FIRST)))


def pieces(df: DataFrame, keys: Sequence[str], reach: str, width: int) -> DataFrame:
    """Rows with their `piece`, and once more (`open`) in every later piece whose cut they reach across; `prev`: the piece
    before that one."""
    at = cuts(df, keys, reach, width)
    home = F.floor(F.col(S) / width).cast("long")
    rows = df.withColumn("_home", home).withColumn(slabs.SLAB, F.explode(F.sequence(home, F.floor(F.col(reach) / width).cast("long"))))
    rows = rows.join(at, [*keys, slabs.SLAB])
    mine = F.when(F.col(S) >= F.col("cut"), F.col("cut")).otherwise(F.col("prev"))
    stays = F.when(F.col("_home") == F.col(slabs.SLAB), F.struct(mine.alias("piece"), F.lit(False).alias("open"), F.lit(FIRST).alias("prev")))
    crosses = F.when((F.col(S) < F.col("cut")) & (F.col("cut") <= F.col(reach)),
                     F.struct(F.col("cut").alias("piece"), F.lit(True).alias("open"), F.col("prev").alias("prev")))
    rows = rows.withColumn("_p", F.explode(F.array_compact(F.array(stays, crosses))))
    return rows.drop("cut", "prev", slabs.SLAB, "_home").select("*", "_p.*").drop("_p")


def truth_tables(rows: DataFrame, keys: Sequence[str], row_id: str, reach: str, feature: str | None, prepare: Callable,
                 match: Match) -> DataFrame:
    """keys, row_id, piece, prev, open (number of the open row, null for others), kept (truth table)."""
    group = [*keys, "piece"]
    order = [S, E, row_id]
    named = [*group, *order, reach, "open", "prev", *([feature] if feature else [])]
    schema = T.StructType([*[rows.schema[k] for k in keys], rows.schema[row_id], T.StructField("piece", T.LongType()),
                           T.StructField("prev", T.LongType()), T.StructField("open", T.IntegerType()), T.StructField("kept", T.LongType())])
    n = len(group)

    def body(batches):
        piece, live, n_open = None, [], 0           # live: (reach, (start, end, feature), table) of rows that may match
        for pdf in batches:
            out = []
            for rec in pdf[named].itertuples(index=False, name=None):
                at, (start, end, i, far, is_open, prev) = rec[:n], rec[n:n + 6]
                if at != piece:
                    piece, live, n_open = at, [], 0
                me = (start, end, prepare(rec[n + 6]) if feature else None)
                if is_open:
                    table = OPEN[n_open]
                    out.append((*at[:-1], i, at[-1], prev, n_open, table - (table >> 63 << 64)))
                    n_open += 1
                else:
                    live, table = [x for x in live if x[0] >= start], ALL
                    for _, other, kept in live:
                        if kept & table and match(other, me):
                            table &= ~kept
                    out.append((*at[:-1], i, at[-1], prev, None, table - (table >> 63 << 64)))
                if table and far >= start:
                    live.append((far, me, table))
            got = pd.DataFrame(out, columns=[f.name for f in schema])
            got["open"] = got["open"].astype("Int32")
            yield got

    lined = rows.select(*named).repartition(*group).sortWithinPartitions(*group, *order)
    return lined.mapInPandas(body, schema)


def entries(tables: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """keys, piece, entry: how the open rows of each piece that has any are truly kept."""
    keys = list(keys)
    asked = tables.filter("open is not null").select(*keys, row_id, F.col("piece").alias("_at"), F.col("prev").alias("_from"), "open")
    given = tables.select(*keys, row_id, F.col("piece").alias("_from"), "kept")
    small = (asked.join(given, [*keys, row_id, "_from"]).groupBy(*keys, "_at", "_from")
             .agg(F.array_sort(F.collect_list(F.struct("open", "kept"))).alias("_o")).select(*keys, "_at", "_from", F.col("_o.kept").alias("_kept")))
    schema = T.StructType([*[tables.schema[k] for k in keys], T.StructField("piece", T.LongType()), T.StructField("entry", T.IntegerType())])

    def compose(batches):                            # one small row per cut, in order
        key, piece, entry = None, None, 0
        for pdf in batches:
            out = []
            for *k, at, before, kept in pdf[[*keys, "_at", "_from", "_kept"]].itertuples(index=False, name=None):
                known = entry if (k, before) == (key, piece) else 0
                key, piece, entry = k, at, sum((int(t) >> known & 1) << j for j, t in enumerate(kept))
                out.append((*k, at, entry))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return small.repartition(*keys).sortWithinPartitions(*keys, "_at").mapInPandas(compose, schema)


def kept_rows(df: DataFrame, keys: Sequence[str], row_id: str, reach: Column, match: Match, feature: str | None = None,
              prepare: Callable = lambda x: x, width: int | None = None) -> DataFrame:
    """The rows of `df` that stay when each row is dropped if it matches an earlier kept row of its key.

    `match(earlier, later)` gets (start, end, prepared feature) tuples and must be false for a later row that starts beyond the
    earlier one's `reach`; `row_id` must be unique."""
    keys = list(keys)
    lean = df.select(*keys, row_id, S, E, *([feature] if feature else []), F.greatest(reach.cast("long"), F.col(S)).alias("_reach"))
    width = width or slabs.slab_width(lean, keys, S)
    tables = cut_lineage(truth_tables(pieces(lean, keys, "_reach", width), keys, row_id, "_reach", feature, prepare, match))
    kept = (tables.filter("open is null").join(entries(tables, keys, row_id), [*keys, "piece"], "left")
            .filter("shiftrightunsigned(kept, coalesce(entry, 0)) & 1 = 1").select(row_id))
    return df.join(kept, row_id, "left_semi")
