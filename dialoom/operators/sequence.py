"""Order-dependent operators: merging neighbours, packing blocks, chunking, sliding windows, consecutive groups."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import fixed, text
from dialoom.operators import slabs, spans
from dialoom.session import cut_lineage, stored

S, E = "start_ms", "end_ms"
SLAB_ROWS = 65_536
RUN_ROWS = slabs.ROWS_PER_SLAB      # rows of a run behind its first slab up to which it is one stream


def merge_adjacent(df: DataFrame, keys: Sequence[str], row_id: str, gap_ms: int = fixed.ADJACENT_GAP_MS,
                   width: int | None = None, text_col: str | None = None, spent: Sequence[DataFrame] = ()) -> DataFrame:
    """Merge neighbouring lines of one speaker whose gap to the running end is at most `gap_ms`.

    Order is (start, end, id). A run is a stretch of one speaker; inside a run a line opens a new island when it starts
    beyond every earlier end of the run. With `text_col` the texts are appended one by one and re-cleaned each time; rows
    are stored in between then, so that texts are on disk in one shuffle at a time. `spent`: see `stored`.
    """
    order = [S, E, row_id]
    rank = F.struct(*[F.col(c) for c in order])
    width = width or slabs.slab_width(df, keys, S)
    beyond = lambda top: F.col(S) > top + gap_ms
    rows = slabs.scan(
        slabs.with_slab(df, S, width).withColumn("_rank", rank), keys, order,
        local=lambda w: [
            {"_prev": F.lag("speaker").over(w)},
            {"_ropen": F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("speaker")), F.col("_rank"))},
            {"_run": F.max("_ropen").over(slabs.upto(w))},
            {"_re": F.max(F.struct(F.col("_run").alias("run"), F.col(E).alias("end"))).over(slabs.before(w))},
            {"_open": F.when(F.col("_re").isNull() | (F.col("_re.run") < F.col("_run")) | beyond(F.col("_re.end")),
                             F.col("_rank"))}],
        summary=[F.min_by("speaker", "_rank").alias("_spk0"), F.max_by("speaker", "_rank").alias("_spk1"),
                 F.min("_run").alias("_run0"), F.max("_run").alias("_run1"),
                 F.max(F.struct(F.col("_run").alias("run"), F.col(E).alias("end"))).alias("_tail"),
                 F.max("_open").alias("_last")],
        carry=lambda w: [
            {"_cont": F.coalesce(F.lag("_spk1").over(w) == F.col("_spk0"), F.lit(False))},
            {"_whole": F.col("_cont") & (F.col("_run0") == F.col("_run1"))},
            {"_live": F.max(F.when(~F.col("_whole"), F.col("_run1"))).over(slabs.upto(w))},
            {"_cend": F.max(F.struct(F.col("_live").alias("run"), F.col("_tail.end").alias("end"))).over(slabs.before(w))},
            {"_true": F.when(~F.col("_whole") | (F.col("_last")[S] > F.col("_cend.end") + gap_ms), F.col("_last"))},
            {"_cisl": F.max("_true").over(slabs.before(w))}],
        carried=["_cont", "_run0", "_cend", "_cisl"])
    held = F.col("_cont") & (F.col("_run") == F.col("_run0")) & ~beyond(F.col("_cend.end"))
    opens = F.when(F.col("_open").isNotNull() & ~held, F.col("_open"))
    w = Window.partitionBy(*keys, slabs.SLAB).orderBy(*order)
    rows = rows.withColumn("_isl", F.coalesce(F.max(opens).over(slabs.upto(w)), F.col("_cisl")))
    aggs = [F.min_by("speaker", "_rank").alias("speaker"), F.max(E).alias(E), F.count(F.lit(1)).alias("n_lines")]
    if text_col:
        rows = stored(rows.select(*keys, "_isl", "_rank", "speaker", E, text_col), spent)
        aggs.append(F.array_sort(F.collect_list(F.struct("_rank", F.col(text_col).alias("t")))).alias("_texts"))
    out = rows.groupBy(*keys, "_isl").agg(*aggs)
    extra = []
    if text_col:
        parts = F.transform("_texts", lambda x: x["t"])
        extra = [F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1),
                             lambda acc, x: text.clean_line(F.concat_ws(" ", acc, x))).alias(text_col)]
    out = out.select(*keys, F.col(f"_isl.{row_id}").alias(row_id), "speaker", F.col(f"_isl.{S}").alias(S), E,
                     "n_lines", *extra)
    return stored(out, [rows]) if text_col else out


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], slab_of: Column, out: str = "pos") -> DataFrame:
    """Consecutive positions from 0 per key; `slab_of` must be non-decreasing along `order`."""
    d = slabs.running_sums(df.withColumn(slabs.SLAB, slab_of.cast("long")), keys, order, {out: F.lit(1).cast("long")})
    return d.withColumn(out, F.col(out) - 1).drop(slabs.SLAB)


def pack_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], slab_of: Column, max_chars: int = 2600,
                max_ms: int = 60_000, max_lines: int = 8, text_col: str = "text", spent: Sequence[DataFrame] = ()) -> DataFrame:
    """Greedy packing of ordered lines into blocks; adds `block_id`. The result is a `stored` table, as `spent` may be.

    A line opens a new block when it is a transition at least 25 s into the block, when it would exceed the character
    budget, when the block would span more than `max_ms`, or when the block is full. Where the next block starts
    depends only on where this one started, and lies at most `max_lines` lines ahead: every line gets its jump, and the
    jumps are chained from line 0. Long keys are chained slab by slab (each slab maps its few possible entry lines to
    exit lines), so no task sees more than one slab of lines.
    """
    chars = F.length(F.format_string("[%.1fs - %.1fs] %s: %s\n", F.col(S) / 1000, F.col(E) / 1000, F.col("speaker"),
                                     F.col(text_col)))
    seen = df.withColumns({"is_transition": text.is_transition(F.col(text_col)), "_chars": chars})
    pos = stored(numbered(seen, keys, order, slab_of), spent)  # read for the jumps and for the result
    lean = pos.select(*keys, "pos", S, E, F.col("_chars").alias("chars"), F.col("is_transition").alias("tr"))
    lean = lean.withColumn("slab", F.floor(F.col("pos") / SLAB_ROWS).cast("long"))
    # the first lines of a slab are also visible to the slab before it
    head = (F.col("pos") % SLAB_ROWS < max_lines) & (F.col("slab") > 0)
    seen = lean.withColumn("home", F.explode(F.when(head, F.array(F.col("slab"), F.col("slab") - 1))
                                             .otherwise(F.array(F.col("slab")))))
    w = Window.partitionBy(*keys, "home").orderBy("pos").rowsBetween(0, max_lines)
    ahead = F.collect_list(F.struct(F.col(E).alias("e"), F.col("chars").alias("c"), F.col("tr").alias("tr"))).over(w)
    seen = seen.withColumn("_a", ahead).filter("home = slab")

    def breaks(k: Column) -> Column:
        x = F.col("_a")[k]
        dur = x["e"] - F.col(S)
        used = F.aggregate(F.slice(F.col("_a"), F.lit(1), k + 1), F.lit(0).cast("int"), lambda s, y: s + y["c"])
        return (x["tr"] & (dur >= 25_000)) | (used > max_chars) | (dur > max_ms) | (k >= max_lines)

    first = F.get(F.filter(F.sequence(F.lit(1), F.size("_a") - 1), breaks), F.lit(0))
    jump = F.when(F.size("_a") > 1, F.coalesce(first, F.size("_a")).cast("long")).otherwise(F.lit(1).cast("long"))
    links = seen.select(*keys, "slab", "pos", (F.col("pos") + jump).alias("nxt"))
    # only the first lines of blocks are numbered; a block then names its few lines
    starts = first = _chain(links, list(keys), max_lines)
    starts = starts.withColumn(slabs.SLAB, F.floor(F.col("pos") / SLAB_ROWS).cast("long"))
    starts = slabs.running_sums(starts, keys, ["pos"], {"block_id": F.lit(1).cast("long")})
    lines = starts.select(*keys, (F.col("block_id") - 1).alias("block_id"), F.explode(F.sequence("pos", F.col("nxt") - 1)).alias("pos"))
    return stored(pos.drop("_chars").join(lines, [*keys, "pos"]), [pos, first])


def _ordered_stream(df: DataFrame, group: Sequence[str], order: Sequence[str], body, schema: T.StructType) -> DataFrame:
    """Feed rows to `body(batches)` group by group in order, as a stream: no group is ever held in memory."""
    lined = df.repartition(*group).sortWithinPartitions(*group, *order)
    return lined.mapInPandas(body, schema)


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _chain(links: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Positions reached from 0 by following `nxt`, jumps being at most `fan` long, with their `nxt`: a `stored` table."""
    links = table = stored(links)
    long_keys = links.filter("slab > 0").select(*keys).distinct()
    entry = None
    if not long_keys.isEmpty():
        exits = T.StructType([*_fields(links, keys), T.StructField("slab", T.LongType()),
                              T.StructField("exits", T.ArrayType(T.LongType()))])

        def slab_map(key, pdf):
            p = pdf.sort_values("pos")
            base, n = int(p["pos"].iloc[0]), len(p)
            to = p["nxt"].to_numpy() - base
            for _ in range(n.bit_length()):  # pointer doubling until every line points past the slab
                inside = to < n
                if not inside.any():
                    break
                to = np.where(inside, to[np.minimum(to, n - 1)], to)
            return pd.DataFrame([[*key, (to[:fan] - n).tolist()]], columns=[*keys, "slab", "exits"])

        maps = links.join(long_keys, keys, "left_semi").groupBy(*keys, "slab").applyInPandas(slab_map, exits)
        entries = T.StructType([*_fields(links, keys), T.StructField("slab", T.LongType()), T.StructField("entry", T.LongType())])

        def compose(batches):  # one small row per slab, in slab order
            prev, at = None, 0
            for pdf in batches:
                out = []
                for *key, slab, ex in pdf[[*keys, "slab", "exits"]].itertuples(index=False, name=None):
                    if key != prev:
                        prev, at = key, 0
                    out.append((*key, slab, at))
                    at = int(ex[at]) if at < len(ex) else 0
                yield pd.DataFrame(out, columns=[*keys, "slab", "entry"])

        entry = maps.repartition(*keys).sortWithinPartitions(*keys, "slab").mapInPandas(compose, entries)
    links = (links.withColumn("entry", F.lit(0).cast("long")) if entry is None
             else links.join(entry, [*keys, "slab"], "left").fillna(0, ["entry"]))
    reached = T.StructType([*_fields(links, keys), T.StructField("pos", T.LongType()), T.StructField("nxt", T.LongType())])

    def walk(batches):
        prev, at = None, 0
        for pdf in batches:
            out = []
            for *key, slab, pos, nxt, first in pdf[[*keys, "slab", "pos", "nxt", "entry"]].itertuples(index=False, name=None):
                if (key, slab) != prev:
                    prev, at = (key, slab), pos + first
                if pos == at:
                    out.append((*key, pos, nxt))
                    at = nxt
            yield pd.DataFrame(out, columns=[*keys, "pos", "nxt"])

    return stored(_ordered_stream(links, [*keys, "slab"], ["pos"], walk, reached), [table])


def relay_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], slab_of: Column,
               step: Callable[[dict, dict], list[dict]], flush: Callable[[dict], list[dict]],
               out: T.StructType) -> DataFrame:
    """A sequential fold over each key, run slab by slab without gathering a key.

    `step(state, row)` changes the state in place and returns finished rows; `flush(state)` ends a key. Slabs first run
    from an empty state; a slab whose predecessor turns out to end in another state runs again, until entry and exit
    states agree everywhere. That fixpoint is the sequential result.
    """
    keys, order = list(keys), list(order)
    group = [*keys, "_slab"]
    df = df.withColumn("_slab", slab_of.cast("long"))
    out_schema = T.StructType([*_fields(df, keys), *out.fields])
    names = [f.name for f in out.fields]

    def emit(batches):
        prev, state, final = None, {}, False
        for pdf in batches:
            done = []
            cols = list(pdf.columns)
            for rec in pdf.itertuples(index=False, name=None):
                row = dict(zip(cols, rec))
                at = tuple(row[g] for g in group)
                if at != prev:
                    if prev is not None and final:
                        done.extend((prev[:-1], r) for r in flush(state))
                    prev, state, final = at, json.loads(row["_entry"]), row["_final"]
                done.extend((at[:-1], r) for r in step(state, row))
            yield pd.DataFrame([(*k, *[r[n] for n in names]) for k, r in done], columns=[*keys, *names])
        if prev is not None and final:
            yield pd.DataFrame([(*prev[:-1], *[r[n] for n in names]) for r in flush(state)], columns=[*keys, *names])

    bounds = df.groupBy(*keys).agg(F.max("_slab").alias("_end"), F.min("_slab").alias("_begin"))
    last = cut_lineage(bounds.filter("_end > _begin").select(*keys, "_end"))  # only keys of several slabs need relaying
    if last.isEmpty():
        df = df.withColumn("_entry", F.lit("{}")).withColumn("_final", F.lit(True))
        return _ordered_stream(df, group, order, emit, out_schema)

    df = cut_lineage(df)
    st = T.StructType([*_fields(df, group), T.StructField("_exit", T.StringType())])

    def leave(batches):
        prev, state = None, {}
        for pdf in batches:
            done = []
            cols = list(pdf.columns)
            for rec in pdf.itertuples(index=False, name=None):
                row = dict(zip(cols, rec))
                at = tuple(row[g] for g in group)
                if at != prev:
                    if prev is not None:
                        done.append((*prev, json.dumps(state, sort_keys=True)))
                    prev, state = at, json.loads(row["_entry"])
                step(state, row)
            yield pd.DataFrame(done, columns=[*group, "_exit"])
        if prev is not None:
            yield pd.DataFrame([(*prev, json.dumps(state, sort_keys=True))], columns=[*group, "_exit"])

    over = Window.partitionBy(*keys).orderBy("_slab")
    long_rows = df.join(last.select(*keys), keys, "left_semi")
    entry = cut_lineage(long_rows.select(*group).distinct().withColumn("_entry", F.lit("{}")))
    exits, redo = None, entry
    while True:
        again = _ordered_stream(long_rows.join(redo, group), group, order, leave, st)
        kept = again if exits is None else exits.join(redo, group, "left_anti").unionByName(again)
        exits = cut_lineage(kept)
        fresh = exits.withColumn("_entry", F.coalesce(F.lag("_exit").over(over), F.lit("{}"))).drop("_exit")
        fresh = cut_lineage(fresh)
        redo = fresh.join(entry.withColumnRenamed("_entry", "_old"), group).filter("_entry <> _old").drop("_old")
        entry = fresh
        if redo.isEmpty():
            break
    df = df.join(entry.join(last, keys), group, "left").withColumns({
        "_entry": F.coalesce("_entry", F.lit("{}")), "_final": F.coalesce(F.col("_slab") == F.col("_end"), F.lit(True))}).drop("_end")
    return _ordered_stream(df, group, order, emit, out_schema)


def gap_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], slab_of: Column, gap_ms: int, out: str = "_run") -> DataFrame:
    """Numbers the runs of a key: a row opens one where it starts more than `gap_ms` after every earlier end.

    A fold that joins nothing beyond `gap_ms` forgets what came before there, so runs can be folded apart.
    """
    d = slabs.scan(df.withColumn(slabs.SLAB, slab_of.cast("long")), keys, order,
                   local=lambda w: [{"_top": F.max(E).over(slabs.before(w))}],
                   summary=[F.max(E).alias("_last")],
                   carry=lambda w: [{"_past": F.max("_last").over(slabs.before(w))}],
                   carried=["_past"])
    top = F.greatest("_top", "_past")
    d = d.withColumn("_cut", (top.isNull() | (F.col(S) > top + gap_ms)).cast("long"))
    return slabs.running_sums(d, keys, order, {out: F.col("_cut")}).drop("_top", "_past", "_cut", slabs.SLAB)


def run_starts(df: DataFrame, keys: Sequence[str], order: Sequence[str], slab_of: Column, gap_ms: int) -> tuple[DataFrame, DataFrame]:
    """Rows with `_run`, where their run of `gap_runs` starts, and (keys, _run, n) of the runs that cross a slab's border: rows
    behind the first border. `order` begins with the start. Rows are shuffled once; a slab gives one row."""
    rows = df.withColumn(slabs.SLAB, slab_of.cast("long"))
    w = Window.partitionBy(*keys, slabs.SLAB).orderBy(*order)
    rows = rows.withColumn("_top", F.max(E).over(slabs.before(w)))
    rows = rows.withColumn("_open", F.when(F.col("_top").isNull() | (F.col(S) > F.col("_top") + gap_ms), F.col(S)))
    # of the rows that look like openers inside a slab, those beyond the carried end are the true ones
    true = lambda c: F.when(F.col("_cend").isNull() | (F.col(c) > F.col("_cend") + gap_ms), F.col(c))
    over = Window.partitionBy(*keys).orderBy(slabs.SLAB)
    sums = rows.groupBy(*keys, slabs.SLAB).agg(F.max(E).alias("_end"), F.max("_open").alias("_last"), F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_cend", F.max("_end").over(slabs.before(over)))
    sums = stored(sums.withColumn("_run0", F.max(true("_last")).over(slabs.before(over))).select(*keys, slabs.SLAB, "_cend", "_run0", "_n"))
    across = sums.groupBy(*keys, F.col("_run0").alias("_run")).agg(F.sum("_n").alias("n")).filter("_run IS NOT NULL")
    rows = rows.join(sums.drop("_n"), [*keys, slabs.SLAB])
    rows = rows.withColumn("_run", F.coalesce(F.max(true("_open")).over(slabs.upto(w)), F.col("_run0")))
    return rows.select(*df.columns, "_run"), across


def run_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], slab_of: Column, gap_ms: int,
             step: Callable[[dict, dict], list[dict]], flush: Callable[[dict], list[dict]], out: T.StructType,
             spent: Sequence[DataFrame] = ()) -> DataFrame:
    """A sequential fold (see `relay_fold`) by a rule that joins nothing beyond `gap_ms`: it is folded run by run, each run as one
    stream from its first row. Only a run with more than `RUN_ROWS` rows behind its first slab is relayed slab by slab."""
    group = [*keys, "_run"]
    runs, across = run_starts(stored(df, spent), keys, order, slab_of, gap_ms)
    out_schema = T.StructType([*_fields(df, keys), *out.fields])
    names = [f.name for f in out.fields]

    def emit(batches):
        at, state = None, {}
        for pdf in batches:
            done, cols = [], list(pdf.columns)
            where = [cols.index(g) for g in group]
            for rec in pdf.itertuples(index=False, name=None):
                now = tuple(rec[i] for i in where)
                if now != at:
                    if at is not None:
                        done.extend((at, r) for r in flush(state))
                    at, state = now, {}
                done.extend((at, r) for r in step(state, dict(zip(cols, rec))))
            yield pd.DataFrame([(*k[:-1], *[r[n] for n in names]) for k, r in done], columns=[*keys, *names])
        if at is not None:
            yield pd.DataFrame([(*at[:-1], *[r[n] for n in names]) for r in flush(state)], columns=[*keys, *names])

    long = cut_lineage(across.filter(F.col("n") > RUN_ROWS).select(*group))
    if long.isEmpty():
        return _ordered_stream(runs, group, order, emit, out_schema)
    rest = _ordered_stream(runs.join(long, group, "left_anti"), group, order, emit, out_schema)
    return rest.unionByName(relay_fold(runs.join(long, group, "left_semi"), group, order, slab_of, step, flush, out).drop("_run"))


# ---- short-line merging and chunk building ---------------------------------------------------------------------------

def _same(a: dict, b: dict) -> bool:
    return bool(a["speaker"] and b["speaker"] and a["speaker"] == b["speaker"])


def _join(a: dict, b: dict) -> dict:
    return {**b, "start": a["start"], "speaker": a["speaker"] or b["speaker"], "text": " ".join((a["text"] + " " + b["text"]).split())}


def _near(a: dict, b: dict) -> bool:
    gap = b["start"] - a["end"]
    return gap <= fixed.MERGE_GAP_MS and (_same(a, b) or gap <= fixed.SHORT_OTHER_GAP_MS)


def _settle(state: dict, cur: dict) -> list[dict]:
    """A line that takes no further line behind it: kept, or appended to the one before when short."""
    prev = state.get("prev")
    if prev is not None and cur["end"] - cur["start"] < fixed.MIN_KEEP_MS and _near(prev, cur):
        state["prev"] = _join(prev, cur)
        return []
    state["prev"] = cur
    return [] if prev is None else [prev]


def _short_step(state: dict, row: dict) -> list[dict]:
    cur, state["cur"] = state.get("cur"), row
    if cur is None:
        return []
    if cur["end"] - cur["start"] < fixed.MIN_KEEP_MS and _near(cur, row):
        state["cur"] = _join(cur, row)
        return []
    return _settle(state, cur)


def _short_flush(state: dict) -> list[dict]:
    out = _settle(state, state["cur"]) if state.get("cur") else []
    return out + ([state["prev"]] if state.get("prev") else [])


def _chunk_step(state: dict, item: dict) -> list[dict]:
    cur = state.get("chunk")
    if cur is None:
        state["chunk"] = item
        return []
    gap, fits, same = item["start"] - cur["end"], item["end"] - cur["start"] <= fixed.PREFERRED_MAX_MS, _same(cur, item)
    close = gap <= fixed.MERGE_GAP_MS and (same or gap <= fixed.CHUNK_OTHER_GAP_MS)
    # voices heard between the last line of the chunk and the next line, as the smallest and largest speaker name
    heard = [v for v in (cur.get("gap_lo"), cur.get("gap_hi")) if v]
    quiet = all(v == cur["speaker"] for v in heard)
    bridged = same and fixed.MERGE_GAP_MS < gap <= fixed.MERGE_GAP_SAME_SPEAKER_MS and quiet
    if fits and (close or bridged):
        state["chunk"] = _join(cur, item)
        return []
    state["chunk"] = item
    return [cur]


def _row(r: dict) -> dict:
    clean = lambda v: None if v is None or v != v else v
    return {"start": int(r[S]), "end": int(r[E]), "speaker": clean(r["speaker"]), "text": r["text"],
            "gap_lo": clean(r.get("gap_lo")), "gap_hi": clean(r.get("gap_hi"))}


def _public(rows: list[dict]) -> list[dict]:
    return [{S: r["start"], E: r["end"], "speaker": r["speaker"], "text": r["text"]} for r in rows]


CHUNK = T.StructType([T.StructField(S, T.LongType()), T.StructField(E, T.LongType()),
                      T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())])


def merge_short(df: DataFrame, keys: Sequence[str], row_id: str, slab_of: Column) -> DataFrame:
    """Merge lines under 2.5 s into the next one, else into the one before; merged lines take part again."""
    lean = df.select(*keys, row_id, S, E, "speaker", "text")
    return run_fold(lean, keys, [S, E, row_id], slab_of, fixed.MERGE_GAP_MS, lambda st, r: _public(_short_step(st, _row(r))),
                    lambda st: _public(_short_flush(st)), CHUNK)


def build_chunks(df: DataFrame, segs: DataFrame, keys: Sequence[str], row_id: str, slab_ms: int,
                 bin_ms: int = 60_000, width: int | None = None) -> DataFrame:
    """Training chunks: clamp to speech, merge short lines, merge neighbours up to 18 s, split beyond 30 s."""
    keys = list(keys)
    # Stored step by step: texts are on disk in one table and at most two shuffles at a time.
    df = lines = stored(df)
    regions = spans.merge_spans(segs, keys, fixed.SPEECH_GAP_MS, width).drop("n_spans")
    c = spans.clamp_to_regions(df, regions, keys, [row_id], bin_ms)
    c = c.select(*keys, row_id, F.col("clamped_start_ms").alias(S), F.col("clamped_end_ms").alias(E), "speaker", "text")
    c = clamped = stored(c, [lines])
    slab_of = F.floor(F.col(S) / slab_ms)
    nxt = slabs.neighbour(c.withColumn(slabs.SLAB, slab_of.cast("long")), keys, [S, E, row_id], 1,
                          {"_ns": F.col(S)}).drop(slabs.SLAB)
    nxt = stored(nxt, [clamped])
    gap = F.col("_ns") - F.col(E)
    wide = nxt.filter((gap > fixed.MERGE_GAP_MS) & (gap <= fixed.MERGE_GAP_SAME_SPEAKER_MS))
    voices = spans.overlap_join(wide.select(*keys, row_id, F.col(E).alias(S), F.col("_ns").alias(E)),
                                segs.filter(F.col(E) > F.col(S)).select(*keys, "speaker", S, E), keys, bin_ms)
    voices = voices.groupBy(*keys, row_id).agg(F.min("r_speaker").alias("gap_lo"), F.max("r_speaker").alias("gap_hi"))
    lean = nxt.drop("_ns").join(voices, [*keys, row_id], "left")

    def step(state, r):
        done = []
        for item in _short_step(state, _row(r)):
            done += _chunk_step(state, item)
        return _public(done)

    def flush(state):
        done = []
        for item in _short_flush(state):
            done += _chunk_step(state, item)
        return _public(done + ([state["chunk"]] if state.get("chunk") else []))

    chunks = run_fold(lean, keys, [S, E, row_id], slab_of, fixed.MERGE_GAP_SAME_SPEAKER_MS, step, flush, CHUNK, [nxt])
    parts = spans.split_long(chunks, fixed.HARD_MAX_MS, "text")
    return (parts.select(*keys, F.col("part_start_ms").alias(S), F.col("part_end_ms").alias(E), "speaker", "text")
            .filter((F.col(E) > F.col(S)) & (F.trim("text") != "")))


# ---- windows and groups ----------------------------------------------------------------------------------------------

def sliding_windows(df: DataFrame, keys: Sequence[str], pos: str, line: Column, size: int = 5, step: int = 2) -> DataFrame:
    """Windows of `size` lines every `step` lines over positions 0..n-1; partial windows at the end stay.

    `line` is the text of a line, blank lines count for position and bounds but add no text.
    """
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(pos) - (size - 1)) / step).cast("long"))
    win = F.sequence(first, F.floor(F.col(pos) / step).cast("long"))
    d = df.withColumn("_line", line).withColumn("window_id", F.explode(win))
    shown = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct(F.col(pos).alias("p"), F.col("_line").alias("l")))))
    out = d.groupBy(*keys, "window_id").agg(F.min(S).alias(S), F.max_by(E, pos).alias(E),
                                            F.count(F.lit(1)).alias("n_lines"), shown.alias("_l"))
    return (out.filter(F.size("_l") > 0)
            .withColumn("text", F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).drop("_l"))


def consecutive_groups(df: DataFrame, keys: Sequence[str], seq: str, kind: str, aggs: Sequence[Column],
                       slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Group neighbours of equal `kind`; a group also ends where `seq` skips a number."""
    d = df.withColumn(slabs.SLAB, F.floor(F.col(seq) / slab_rows).cast("long"))
    d = slabs.neighbour(d, keys, [seq], -1, {"_ps": F.col(seq), "_pk": F.col(kind)})
    opens = F.col("_ps").isNull() | (F.col("_pk") != F.col(kind)) | (F.col("_ps") + 1 != F.col(seq))
    d = slabs.running_sums(d, keys, [seq], {"group_id": opens.cast("long")})
    return d.groupBy(*keys, (F.col("group_id") - 1).alias("group_id"), kind).agg(*aggs)
