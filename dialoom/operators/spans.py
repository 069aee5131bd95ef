"""Interval algebra over (keys, start_ms, end_ms) tables.

Sums of overlaps are read off running totals and never from row pairs; pairs are formed only where the result itself
lists them, through time bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators import slabs
from dialoom.session import cut_lineage

S, E = "start_ms", "end_ms"


def merge_spans(df: DataFrame, keys: Sequence[str], gap_ms: int = 0, width: int | None = None,
                aggs: Sequence[Column] = ()) -> DataFrame:
    """Union of intervals per key; spans at most `gap_ms` apart join (inclusive). Extra `aggs` run per merged span."""
    width = width or slabs.slab_width(df, keys, S)
    # A row opens an island when it starts beyond every earlier end. Inside a slab only earlier rows of the slab are
    # known; of the rows that look like openers there, those beyond the carried end are the true ones.
    rows = slabs.scan(
        slabs.with_slab(df, S, width), keys, [S, E],
        local=lambda w: [{"_top": F.max(E).over(slabs.before(w))},
                         {"_open": F.when(F.col("_top").isNull() | (F.col(S) > F.col("_top") + gap_ms), F.col(S))}],
        summary=[F.max(E).alias("_end"), F.max("_open").alias("_last")],
        carry=lambda w: [{"_cend": F.max("_end").over(slabs.before(w))},
                         {"_true": F.when(F.col("_cend").isNull() | (F.col("_last") > F.col("_cend") + gap_ms),
                                          F.col("_last"))},
                         {"_cisl": F.max("_true").over(slabs.before(w))}],
        carried=["_cend", "_cisl"])
    opens = F.when(F.col("_cend").isNull() | (F.col("_open") > F.col("_cend") + gap_ms), F.col("_open"))
    w = Window.partitionBy(*keys, slabs.SLAB).orderBy(S, E)
    rows = rows.withColumn("_island", F.coalesce(F.max(opens).over(slabs.upto(w)), F.col("_cisl")))
    return (rows.groupBy(*keys, F.col("_island").alias(S))
            .agg(F.max(E).alias(E), F.count(F.lit(1)).alias("n_spans"), *aggs))


def depth_steps(df: DataFrame, keys: Sequence[str], sums: dict[str, Column] | None = None,
                width: int | None = None) -> DataFrame:
    """Step function of the active totals: one row per boundary with the totals holding until `next_ms`.

    `sums` maps names to per-span values (default: `depth` = 1 per span).
    """
    sums = sums or {"depth": F.lit(1).cast("long")}
    width = width or slabs.slab_width(df, keys, S)
    edges = F.array(F.struct(F.col(S).alias("t"), F.lit(1).alias("sign")),
                    F.struct(F.col(E).alias("t"), F.lit(-1).alias("sign")))
    ev = (df.withColumns({f"_v_{n}": c for n, c in sums.items()})
          .select(*keys, *[f"_v_{n}" for n in sums], F.explode(edges).alias("e")))
    ev = ev.groupBy(*keys, F.col("e.t").alias("t")).agg(
        *[F.sum(F.col(f"_v_{n}") * F.col("e.sign")).alias(f"_d_{n}") for n in sums])
    ev = slabs.with_slab(ev, "t", width)
    return slabs.running_sums(ev, keys, ["t"], {n: F.col(f"_d_{n}") for n in sums}, next_of={"next_ms": "t"})


def busy_regions(df: DataFrame, keys: Sequence[str], at_least: int = 2, width: int | None = None) -> DataFrame:
    """Maximal regions where at least `at_least` *spans* (not speakers) are active; zero length never appears."""
    st = depth_steps(df, keys, width=width)
    on = F.col("depth") >= at_least
    was_on = (F.col("depth") - F.col("_d_depth")) >= at_least
    flips = st.filter(on != was_on).select(*keys, slabs.SLAB, "t", on.alias("on"))
    flips = slabs.neighbour(flips, keys, ["t"], 1, {"off_ms": F.col("t")})
    return flips.filter("on").select(*keys, F.col("t").alias(S), F.col("off_ms").alias(E))


def covered(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, out: str,
            weight: Column | None = None, width: int | None = None) -> DataFrame:
    """For every point, the weighted length of all spans of its key lying before it (no pairs formed).

    The total is t*(opened - closed weight) - (opened start moments - closed end moments), all running sums, so spans
    may overlap freely. Weights must be integers (scale fractions up) to keep the sums exact.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    width = width or slabs.slab_width(spans, keys, S)
    sp = spans.withColumn("_w", weight).select(*keys, "_w", F.explode(F.array(
        F.struct(F.col(S).alias("t"), F.lit(1).alias("g")), F.struct(F.col(E).alias("t"), F.lit(-1).alias("g")))).alias("e"))
    sp = sp.groupBy(*keys, F.col("e.t").alias("_t")).agg(F.sum(F.col("_w") * F.col("e.g")).alias("_dw"))
    sp = sp.withColumn("_dm", (F.col("_dw").cast("decimal(38,0)") * F.col("_t")).cast("decimal(38,0)"))
    pt = points.withColumn("_row", F.struct(*[F.col(c) for c in points.columns]))
    pt = pt.select(*keys, F.col(at).alias("_t"), "_row", F.lit(0).cast("long").alias("_dw"),
                   F.lit(0).cast("decimal(38,0)").alias("_dm"))
    ev = pt.unionByName(sp, allowMissingColumns=True)
    ev = slabs.with_slab(ev, "_t", width)
    ev = slabs.running_sums(ev, keys, ["_t"], {"_sw": F.col("_dw"), "_sm": F.col("_dm")})
    ev = ev.filter(F.col("_row").isNotNull())
    total = (F.col("_t").cast("decimal(38,0)") * F.col("_sw") - F.col("_sm")).cast("long")
    return ev.select("_row.*", total.alias(out))


def overlap_sum(df: DataFrame, spans: DataFrame, keys: Sequence[str], row_id: Sequence[str], out: str,
                windows: Sequence[tuple[Column, Column]] | None = None, weight: Column | None = None,
                width: int | None = None) -> DataFrame:
    """Total weighted overlap of each row's window(s) with all spans of the same key. Adds `out` to `df`'s rows.

    `windows` defaults to the row's own (start, end). Rows are identified by `row_id`.
    """
    windows = windows or [(F.col(S), F.col(E))]
    ends = F.array(*[F.struct(c.cast("long").alias("p"), F.lit(g).alias("g"))
                     for a, b in windows for c, g in ((a, -1), (b, 1))])
    carried = [c for c in df.columns if c not in set(keys) | set(row_id)]
    pts = df.select(*dict.fromkeys([*keys, *row_id]), *carried, F.explode(ends).alias("_p"))
    pts = pts.select(*[c for c in pts.columns if c != "_p"], F.col("_p.p").alias("_pt"), F.col("_p.g").alias("_pg"))
    c = covered(pts, spans, keys, "_pt", "_cov", weight, width)
    return (c.groupBy(*dict.fromkeys([*keys, *row_id]))
            .agg(F.sum(F.col("_cov") * F.col("_pg")).alias(out), *[F.first(x).alias(x) for x in carried]))


def bins(start: Column, end: Column, bin_ms: int) -> Column:
    """The time bins a half-open span touches (a zero-length span touches one)."""
    last = F.greatest(F.floor(start / bin_ms), F.floor((end - 1) / bin_ms))
    return F.sequence(F.floor(start / bin_ms).cast("long"), last.cast("long"))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_ms: int, how: str = "inner",
                 min_overlap_ms: int = 1) -> DataFrame:
    """Pairs of overlapping spans. Right columns come back prefixed `r_`; a pair is emitted once, in its first shared bin.

    Both sides are replicated only to the bins they touch, so the join is an equi-join on (keys, bin) that AQE can
    split where a bin is hot.
    """
    r = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    lb = left.withColumn("_bin", F.explode(bins(F.col(S), F.col(E), bin_ms)))
    rb = r.withColumn("_bin", F.explode(bins(F.col(f"r_{S}"), F.col(f"r_{E}"), bin_ms)))
    ov = F.least(F.col(E), F.col(f"r_{E}")) - F.greatest(F.col(S), F.col(f"r_{S}"))
    home = F.floor(F.greatest(F.col(S), F.col(f"r_{S}")) / bin_ms) == F.col("_bin")
    pairs = (lb.join(rb, [*keys, "_bin"]).filter(home & (ov >= min_overlap_ms))
             .withColumn("overlap_ms", ov).drop("_bin"))
    if how == "inner":
        return pairs
    if how == "left":
        ids = [c for c in left.columns]
        lone = left.join(pairs.select(*ids).distinct(), ids, "left_anti")
        return pairs.unionByName(lone, allowMissingColumns=True)
    raise ValueError(how)


def speaker_unions(df: DataFrame, keys: Sequence[str], speaker: str = "speaker", gap_ms: int = 0,
                   width: int | None = None) -> DataFrame:
    """Per-speaker interval unions: at any instant a speaker is active in at most one of them."""
    return merge_spans(df.filter(F.col(E) > F.col(S)), [*keys, speaker], gap_ms, width).drop("n_spans")


def atomic_spans(df: DataFrame, keys: Sequence[str], width: int | None = None,
                 sums: dict[str, Column] | None = None) -> DataFrame:
    """Consecutive boundaries with at least one active span: (start_ms, end_ms, depth, *sums)."""
    live = df.filter(F.col(E) > F.col(S))
    st = depth_steps(live, keys, {"depth": F.lit(1).cast("long"), **(sums or {})}, width)
    return (st.filter((F.col("depth") > 0) & F.col("next_ms").isNotNull())
            .select(*keys, F.col("t").alias(S), F.col("next_ms").alias(E), "depth", *(sums or {})))


def active_speakers(atoms: DataFrame, df: DataFrame, keys: Sequence[str], bin_ms: int, speaker: str = "speaker",
                    width: int | None = None) -> DataFrame:
    """Point-in-interval join: every atom with each distinct speaker active over it (one row per pair)."""
    return _inside(atoms, speaker_unions(df, keys, speaker, width=width), keys, bin_ms, speaker)


def _inside(atoms: DataFrame, un: DataFrame, keys: Sequence[str], bin_ms: int, speaker: str = "speaker") -> DataFrame:
    un = un.select(*keys, F.col(speaker).alias("active"), F.col(S).alias("_us"), F.col(E).alias("_ue"),
                   F.explode(bins(F.col(S), F.col(E), bin_ms)).alias("_bin"))
    at = atoms.withColumn("_bin", F.floor(F.col(S) / bin_ms).cast("long"))
    return (at.join(un, [*keys, "_bin"])
            .filter((F.col("_us") <= F.col(S)) & (F.col(S) < F.col("_ue"))).drop("_bin", "_us", "_ue"))


def pair_regions(df: DataFrame, keys: Sequence[str], bin_ms: int, width: int | None = None) -> DataFrame:
    """Maximal regions with exactly two distinct speakers that stay the same pair."""
    width = width or slabs.slab_width(df, keys, S)
    un = cut_lineage(speaker_unions(df, keys, width=width))
    two = atomic_spans(un, keys, width).filter("depth = 2").drop("depth")
    two = (_inside(two, un, keys, bin_ms)
           .groupBy(*keys, S, E).agg(F.min("active").alias("speaker_a"), F.max("active").alias("speaker_b")))
    # same pair and touching: merging with gap 0 inside the pair joins exactly those
    return merge_spans(two, [*keys, "speaker_a", "speaker_b"], 0, width).drop("n_spans")


def coactive(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_ms: int, left_by: str = "speaker", right_by: str = "speaker",
             left_weight: Column | None = None, right_weight: Column | None = None, width: int | None = None) -> DataFrame:
    """Time during which a left and a right label of a key are active together: keys, left_by, right_by (prefixed `r_`), `ms`.

    Every span counts, so a label active twice counts twice (or with its integer weights). Each label becomes one step
    function first; only labels that are active at the same time meet, and the sums are taken before the shuffle. Pairs
    that never meet have no row.
    """
    def stepped(df, by, weight):
        one = F.lit(1).cast("long") if weight is None else weight.cast("long")
        st = depth_steps(df.filter(F.col(E) > F.col(S)), [*keys, by], {"w": one}, width)
        return st.filter((F.col("w") != 0) & F.col("next_ms").isNotNull()).select(*keys, by, F.col("t").alias(S), F.col("next_ms").alias(E), "w")

    pairs = overlap_join(stepped(left, left_by, left_weight), stepped(right, right_by, right_weight), keys, bin_ms)
    return pairs.groupBy(*keys, left_by, f"r_{right_by}").agg(F.sum(F.col("overlap_ms") * F.col("w") * F.col("r_w")).alias("ms"))


def subtract(df: DataFrame, removals: DataFrame, keys: Sequence[str], row_id: Sequence[str], width: int | None = None) -> DataFrame:
    """Remove `removals` (same keys) from every span and keep the fragments.

    Merged removals leave gaps, numbered along the key. A span's first gap is as many as removals ended before its start,
    its last gap as many as removals began before its end: two running counts. So a span is dealt out to the gaps between
    by number, one row a fragment, and never meets a removal.
    """
    keys, ids = list(keys), list(dict.fromkeys([*keys, *row_id]))
    width = width or slabs.slab_width(df, keys, S)
    gone = cut_lineage(merge_spans(removals.filter(F.col(E) > F.col(S)), keys, 0, width).drop("n_spans"))
    side = lambda c, order, first, last: F.struct(c.alias("t"), F.lit(order).alias("o"), F.lit(first).cast("long").alias("first"),
                                                  F.lit(last).cast("long").alias("last"))
    # at equal times ends of removals come before, and starts of removals after, the edges of spans
    ev = gone.select(*keys, F.explode(F.array(side(F.col(E), 0, 1, 0), side(F.col(S), 2, 0, 1))).alias("e")).select(*keys, "e.*")
    live = df.filter(F.col(E) > F.col(S)).select(*ids, S, E)
    edges = live.select(*keys, F.struct(*[F.col(c) for c in [*row_id, S, E]]).alias("_row"),
                        F.explode(F.array(side(F.col(S), 1, 0, 0), side(F.col(E), 1, 0, 0))).alias("e")).select(*keys, "_row", "e.*")
    ev = slabs.with_slab(edges.unionByName(ev, allowMissingColumns=True), "t", width)
    ev = slabs.running_sums(ev, keys, ["t", "o"], {"first": F.col("first"), "last": F.col("last")}).filter("_row IS NOT NULL")
    own = [c for c in row_id if c not in keys]
    spot = ev.groupBy(*keys, "_row").agg(F.min("first").alias("_a"), F.max("last").alias("_b"))
    parts = spot.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*own, S, E]], F.explode(F.sequence("_a", "_b")).alias("_gap"))
    nth = slabs.running_sums(slabs.with_slab(gone, S, width), keys, [S], {"_gap": F.lit(1).cast("long")}, next_of={"_to": S})
    after = nth.select(*keys, "_gap", F.col(E).alias("_from"), "_to")
    before = nth.filter("_gap = 1").select(*keys, F.lit(0).cast("long").alias("_gap"), F.lit(None).cast("long").alias("_from"), F.col(S).alias("_to"))
    cut = (parts.join(after.unionByName(before), [*keys, "_gap"], "left")
           .select(*ids, F.greatest(F.col(S), "_from").alias("_fs"), F.least(F.col(E), "_to").alias("_fe")).filter("_fe > _fs"))
    return df.join(cut, ids).withColumn(S, F.col("_fs")).withColumn(E, F.col("_fe")).drop("_fs", "_fe")


def clamp_to_regions(df: DataFrame, regions: DataFrame, keys: Sequence[str], row_id: Sequence[str],
                     bin_ms: int) -> DataFrame:
    """Clip each span to its best-overlapping region, the earliest on ties; spans without overlap stay unchanged."""
    ids = list(dict.fromkeys([*keys, *row_id]))
    hit = overlap_join(df.select(*ids, S, E), regions.select(*keys, S, E), keys, bin_ms)
    best = hit.groupBy(*ids).agg(F.max_by(F.struct("r_start_ms", "r_end_ms"),
                                          F.struct(F.col("overlap_ms"), -F.col("r_start_ms"))).alias("b"))
    return (df.join(best, ids, "left")
            .withColumn("clamped_start_ms", F.coalesce(F.greatest(F.col(S), F.col("b.r_start_ms")), F.col(S)))
            .withColumn("clamped_end_ms", F.coalesce(F.least(F.col(E), F.col("b.r_end_ms")), F.col(E))).drop("b"))


def split_long(df: DataFrame, max_ms: int, text: str | None = None) -> DataFrame:
    """Cut spans longer than `max_ms` into equal parts; words are dealt out by count, the last part takes the rest."""
    dur = F.col(E) - F.col(S)
    df = df.withColumn("n_parts", F.greatest(F.ceil(dur / max_ms), F.lit(1)).cast("long"))
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    cut = lambda i: F.col(S) + F.floor(dur * i / F.col("n_parts")).cast("long")
    if text is not None:
        words = F.split(F.col(text), r"(?U)\s+")
        step = F.greatest(F.lit(1), F.floor(F.size(words) / F.col("n_parts")).cast("int"))
        first = F.col("part").cast("int") * step + 1
        length = F.when(F.col("part") == F.col("n_parts") - 1, F.size(words)).otherwise(step)
        piece = F.when(first > F.size(words), F.lit("")).otherwise(F.array_join(F.slice(words, first, length), " "))
        df = df.withColumn(text, F.when(F.col("n_parts") == 1, F.col(text))
                           .otherwise(F.coalesce(F.nullif(piece, F.lit("")), F.col(text))))
    a, b = cut(F.col("part")), cut(F.col("part") + 1)
    return df.withColumns({"part_start_ms": a, "part_end_ms": b}).filter(F.col("part_end_ms") >= F.col("part_start_ms"))


def other_speaker_in_gap(gaps: DataFrame, segs: DataFrame, keys: Sequence[str], row_id: Sequence[str], bin_ms: int,
                         speaker: str = "speaker", width: int | None = None) -> DataFrame:
    """Gaps (start_ms, end_ms, speaker) during which anybody else talks.

    Counted, not paired: a gap contains another voice iff the talk time of everybody exceeds the talk time of its own
    speaker there, both taken over per-speaker unions.
    """
    everybody = "*"
    who = F.explode(F.array(F.lit(everybody), F.col(speaker)))
    un = speaker_unions(segs, keys, speaker, width=width).withColumn("_who", who).select(*keys, "_who", S, E)
    ids = list(dict.fromkeys([*keys, *row_id]))
    live = gaps.filter(F.col(E) > F.col(S)).withColumn("_who", who)
    talk = overlap_sum(live.select(*ids, "_who", S, E), un, [*keys, "_who"], row_id, "_talk", width=width)
    sign = F.when(F.col("_who") == everybody, F.col("_talk")).otherwise(-F.col("_talk"))
    voiced = talk.groupBy(*ids).agg(F.sum(sign).alias("_others")).filter("_others > 0")
    return gaps.join(voiced.select(*ids), ids, "left_semi")
