"""Rule-based meeting summaries: lines to blocks to block summaries to one document per meeting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import fixed, text, validate
from dialoom.functions.text import let
from dialoom.operators import dedup, sequence
from dialoom.session import stored

S, E = "start_ms", "end_ms"


@dataclass(frozen=True)
class Mode:
    """Budgets of the two operating modes."""
    max_chars: int = 2600
    max_ms: int = 60_000
    max_lines: int = 8
    min_score: int = 3
    max_model_blocks: int = 12
    fast: bool = False
    prefer_rule_normalize: bool = False
    token_cap: int = 144


STABLE = Mode()
FAST = Mode(max_chars=2200, max_ms=50_000, max_lines=7, min_score=4, max_model_blocks=8, fast=True, prefer_rule_normalize=True, token_cap=128)


def filter_lines(df: DataFrame, min_chars: int = 2, keep_fillers: bool = False) -> DataFrame:
    """Cleaned lines; a line is judged inside the generator, so that it is cleaned once (a filter would clean it again)."""
    def stays(c):
        return F.length(c) >= min_chars if keep_fillers else (F.length(c) >= min_chars) & ~text.is_filler(c)

    return df.withColumn("text", F.explode(F.filter(F.array(text.clean_line(F.col("text"))), stays)))


def blocks(df: DataFrame, keys: Sequence[str], row_id: str, slab_of: Column, mode: Mode = STABLE) -> DataFrame:
    """One row per block with its (few) ordered lines; `df` needs keys, row_id, speaker, span, text."""
    return _grouped_lines(sequence.pack_blocks(df, keys, [S, E, row_id], slab_of, mode.max_chars, mode.max_ms, mode.max_lines), keys)


def _grouped_lines(b: DataFrame, keys: Sequence[str]) -> DataFrame:
    line = F.struct("pos", S, E, "speaker", "text")
    return b.groupBy(*keys, "block_id").agg(
        F.array_sort(F.collect_list(line)).alias("lines"), F.min(S).alias(S), F.max_by(E, "pos").alias(E),
        F.bool_or("is_transition").alias("transition_heavy"))


def normalize_rule(b: DataFrame) -> DataFrame:
    """Clean every line of a block; known artifacts become blank, the line stays."""
    clean = lambda t: let(text.clean_line(t), lambda c: F.when(F.lower(c).isin(fixed.ARTIFACTS), "").otherwise(c))
    return b.withColumn("lines", F.transform("lines", lambda x: x.withField("text", clean(x["text"])))).withColumn(
        "notes", F.array(F.lit("rule_normalized")))


def _texts(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), " ")


def features(b: DataFrame) -> DataFrame:
    """Tags, hints, sizes and the value score that decides which blocks deserve a model."""
    low = F.col("_low")
    d = b.withColumn("blob", _texts(F.col("lines"))).withColumn("_low", text.low_squeezed(F.col("blob")))
    d = d.withColumns({
        "tags": text.tech_tags_low(low), "has_actions": text.has_word_low(low, fixed.ACTION_WORDS),
        "has_issue": text.has_word_low(low, fixed.ISSUE_WORDS), "has_format": text.has_word_low(low, fixed.FORMAT_WORDS),
        "chars": F.aggregate("lines", F.lit(0), lambda s, x: s + F.length(x["text"])),
        "n_speakers": F.size(F.array_distinct(F.transform("lines", lambda x: x["speaker"])))})
    d = d.withColumn("segment_type", text.segment_type_low(low, F.col("has_format"), F.col("has_issue"), F.col("transition_heavy"))).drop("_low")
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    few = (F.col("chars") <= 220) & (F.col("n_speakers") <= 1) & ~F.col("has_actions") & (F.size("tags") <= 1)
    score = (F.least(F.size("tags"), F.lit(4)) + one(F.col("has_actions"), 3) + one(F.col("has_issue"), 2) + one(F.col("has_format"), 2)
             + one(F.col("chars") >= 700) + one(F.col("chars") >= 1100) + one(F.col("n_speakers") >= 2)
             + one(F.col(E) - F.col(S) >= 30_000) - one(F.col("transition_heavy"), 2) - one(few, 2))
    return d.withColumn("score", score)


def routing(d: DataFrame, mode: Mode = STABLE) -> DataFrame:
    """Which blocks skip a model for normalizing or summarizing, and the answer budget of those that do not."""
    shown = F.array_join(F.transform("lines", lambda x: F.format_string("[%.1fs - %.1fs] %s: %s", x[S] / 1000, x[E] / 1000, x["speaker"], x["text"])), "\n")
    noise = text.noise_score(shown)
    skip_norm = (noise < 4) if mode.prefer_rule_normalize else ((noise <= 1) & (F.length(shown) <= 1400))
    n_tags, acts, chars = F.size("tags"), F.col("has_actions"), F.col("chars")
    skip_sum = ((F.size("lines") <= 2) & (chars <= 220) & (n_tags <= 1) & ~acts) | (F.col("transition_heavy") & (chars <= 420))
    steps = (72, 96, 112) if mode.fast else (80, 104, 128)
    tokens = (F.when((chars <= 260) & (n_tags <= 1) & ~acts, steps[0]).when((chars <= 600) & (n_tags <= 2) & ~acts, steps[1])
              .when((chars <= 1100) & (n_tags <= 4), steps[2]).otherwise(min(128, mode.token_cap)))
    return d.withColumns({"skip_normalize": skip_norm, "skip_summary": skip_sum, "max_tokens": tokens})


def choose_blocks(d: DataFrame, keys: Sequence[str], mode: Mode = STABLE) -> DataFrame:
    """Best-scoring blocks per meeting above the threshold, lower id first on ties."""
    # judged inside the generator: a filter would be pushed below the features and work out each of them for every word that asks
    d = d.withColumn("score", F.explode(F.filter(F.array("score"), lambda s: s >= mode.min_score)))
    return dedup.keep_first(d, keys, [F.desc("score"), "block_id"], mode.max_model_blocks)


def _distinct_by(items: Column, key) -> Column:
    ks = F.transform(items, key)
    return let(ks, lambda k: F.filter(items, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1))


def action_items(lines: Column) -> Column:
    """Lines of eight or more characters that hint at an action, first per (owner, task), six at most."""
    tasks = F.transform(lines, lambda x: F.struct(x["speaker"].alias("owner"), text.squeeze(x["text"]).alias("task"), x[S].alias(S), x[E].alias(E)))
    hits = F.filter(tasks, lambda x: (F.length(x["task"]) >= 8) & let(F.lower(x["task"]), lambda low: text.has_word_low(low, fixed.ACTION_WORDS)))
    items = F.transform(hits, lambda x: F.struct(x["owner"], x["task"], text.action_status(x["task"]).alias("status"), x[S].alias(S), x[E].alias(E)))
    return F.slice(let(items, lambda its: _distinct_by(its, lambda a: F.lower(F.concat_ws("\u0001", a["owner"], a["task"])))), 1, 6)


def speaker_insights(lines: Column, kind: Column) -> Column:
    """Per speaker of the block (in order of appearance, six at most) the role, a sentence and the evidence span."""
    names = F.array_distinct(F.transform(lines, lambda x: x["speaker"]))

    def one(name: Column) -> Column:
        return let(F.filter(lines, lambda x: x["speaker"] == name), lambda mine: let(text.low_squeezed(_texts(mine)), lambda low: F.struct(
            name.alias("speaker"), text.speaker_role_low(low).alias("role_in_block"),
            let(text.tech_tags_low(low), lambda tags: text.type_overview(kind, tags)).alias("detail"),
            F.get(mine, F.lit(0))[S].alias(S), F.element_at(mine, -1)[E].alias(E))))

    return F.transform(F.slice(names, 1, 6), one)


def summarize_rule(d: DataFrame) -> DataFrame:
    """Rule summary of each block (after `features`)."""
    d = d.withColumn("overview", text.type_overview(F.col("segment_type"), F.col("tags")))
    # a line's hint is one of its block too
    d = d.withColumn("action_items", action_items(F.when(F.col("has_actions"), F.col("lines")).otherwise(F.slice("lines", 1, 0))))
    n = F.size("action_items")
    note = F.concat(F.lit("Có "), n.cast("string"), F.lit(" việc cần xử lý hoặc theo dõi."))
    return d.withColumns({
        "key_points": F.when(n > 0, F.array("overview", note)).otherwise(F.array("overview")),
        "facts": F.transform(F.slice("tags", 1, 6), lambda t: F.struct(F.lit("tool").alias("type"), t.alias("value"))),
        "speaker_insights": speaker_insights(F.col("lines"), F.col("segment_type")),
        "notes": F.array_append("notes", F.lit("rule_summary"))})


# ---- meeting level ----------------------------------------------------------------------------------------------------

def grouped_segments(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring blocks of one type with their merged overview."""
    over = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "overview"))), lambda x: x["overview"]), " ")
    g = sequence.consecutive_groups(sums, keys, "block_id", "segment_type", [
        F.array_sort(F.collect_list("block_id")).alias("block_ids"), over.alias("_o")])
    return g.select(*keys, "group_id", "segment_type", "block_ids", text.lookup(F.col("segment_type"), fixed.TYPE_TITLES, fixed.TYPE_TITLES["other"]).alias("title"),
                    text.cleanup_repeats(F.col("_o")).alias("summary"))


def meeting_types(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Type counts, the three most frequent phrases (first seen on ties), meeting type and risk flag per meeting."""
    per = sums.groupBy(*keys, "segment_type").agg(F.count(F.lit(1)).alias("n"), F.min("block_id").alias("first"))
    has = lambda *k: F.bool_or(F.col("segment_type").isin(*k))
    out = per.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "segment_type"))).alias("_t"),
        F.when(has("issue_report"), "debug_discussion").when(has("presentation_prep", "formatting_review"), "presentation_prep")
        .when(has("technical_discussion", "progress_update", "planning"), "technical_sync").otherwise("mixed").alias("meeting_type"))
    phrases = F.transform("_t", lambda x: text.lookup(x["segment_type"], fixed.TYPE_PHRASES, ""))
    return out.select(*keys, "meeting_type", F.slice(phrases, 1, 3).alias("top_phrases"), F.size("_t").cast("long").alias("n_types"),
                      F.when(F.size("_t") > 1, F.array(F.lit("Transcript có nhiều segment/chủ đề; cần chú ý tránh gộp nhầm.")))
                      .otherwise(F.array().cast("array<string>")).alias("risk_flags"))


def speaker_summaries(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Main topic, tags, confidence and evidence span per speaker over all normalized lines of the meeting."""
    rank = F.struct(*order)
    d = lines.groupBy(*keys, "speaker").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.squeeze(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("blob"),
        F.count(F.lit(1)).alias("n_lines"), F.min_by(S, rank).alias(S), F.max_by(E, rank).alias(E))
    d = d.withColumns({"_tags": text.tech_tags(F.col("blob")), "_kind": text.segment_type(F.col("blob"), F.lit(False))})
    topic = text.lookup(F.col("_kind"), fixed.TYPE_PHRASES, "trao đổi chuyên môn")
    tags = F.array_join(F.slice("_tags", 1, 3), ", ")
    any_tag = F.size("_tags") > 0
    return d.select(*keys, "speaker", "n_lines", S, E,
                    F.when(any_tag, F.concat(F.lit("Người này chủ yếu trao đổi về "), topic, F.lit(", nổi bật với các nội dung như "), tags, F.lit(".")))
                    .otherwise(F.concat(F.lit("Người này chủ yếu tham gia phần "), topic, F.lit("."))).alias("main_summary"),
                    F.when(any_tag, F.when(F.col("n_lines") >= 4, "high").otherwise("medium"))
                    .otherwise(F.when(F.col("n_lines") >= 3, "medium").otherwise("low")).alias("confidence"),
                    F.when(any_tag, F.concat(F.lit("Tham gia trao đổi về "), tags, F.lit(".")))
                    .otherwise(F.concat(F.lit("Tham gia chủ yếu ở phần "), topic, F.lit("."))).alias("insight"))


def meeting_actions(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Action items of a meeting, first per (owner, task)."""
    a = sums.select(*keys, "block_id", F.posexplode("action_items").alias("i", "a")).select(*keys, "block_id", "i", "a.*")
    a = a.withColumn("_who", F.lower(F.trim(F.coalesce("owner", F.lit("None"))))).withColumn("_what", F.lower(F.trim("task")))
    return dedup.keep_first(a.filter("task <> ''"), [*keys, "_who", "_what"], ["block_id", "i"]).drop("_who", "_what")


def cleaned_transcript(norm: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = norm.select(*keys, "block_id", F.explode("lines").alias("l")).select(*keys, "block_id", "l.*")
    return d.withColumn("text", text.cleanup_repeats(F.col("text"))).filter("text <> ''")


def meeting_documents(norm: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One nested document per meeting. A meeting's lists are its result and end up in one cell each.

    Of the summaries only what documents show is stored; speakers are stored too, so that their texts' shuffle goes before the
    transcript's comes."""
    keys = list(keys)
    sums = stored(sums.select(*keys, "block_id", S, E, "transition_heavy", "segment_type", "overview", "key_points", "action_items",
                              F.size("lines").alias("num_segments")))
    listed = lambda df, order, cols, name: (
        df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*cols).alias("v")))).alias("_l"))
        .select(*keys, F.transform("_l", lambda x: x["v"]).alias(name)))
    groups = grouped_segments(sums, keys)
    seg = listed(groups, ["group_id"], ["title", "block_ids", "summary"], "segments")
    act = listed(meeting_actions(sums, keys), ["block_id", "i"], ["owner", "task", "status"], "action_items")
    lines = cleaned_transcript(norm, keys)
    spk_all = norm.select(*keys, "block_id", F.explode("lines").alias("l")).select(*keys, "block_id", "l.*")
    spk = stored(listed(speaker_summaries(spk_all, keys, ["block_id", "pos"]), ["speaker"], ["speaker", "main_summary", "confidence", "insight", S, E], "speakers"))
    out = meeting_types(sums, keys).join(seg, keys, "left").join(act, keys, "left").join(spk, keys, "left")
    out = out.join(listed(lines, [S, E, "block_id", "pos"], ["block_id", S, E, "speaker", "text"], "cleaned_transcript"), keys, "left")
    debug = listed(sums, ["block_id"], ["block_id", S, E, (F.col(E) - F.col(S)).alias("duration_ms"), "transition_heavy", "num_segments",
                                         "segment_type", "overview", "key_points"], "blocks")
    out = out.join(debug, keys, "left")
    head = F.concat(F.lit("Cuộc trao đổi tập trung vào "), F.array_join("top_phrases", ", "), F.lit("."))
    details = F.array_join(F.filter(F.transform(F.slice("segments", 1, 2), lambda g: g["summary"]), lambda s: s != ""), " ")
    return out.withColumns({
        "meeting_overview": let(details, lambda d: F.when(d != "", text.cleanup_repeats(F.concat_ws(" ", head, d))).otherwise(head)),
        "conversation_main_summary": F.concat(F.lit("Nội dung chính tập trung vào "), F.array_join(F.slice("top_phrases", 1, 2), ", "), F.lit(".")),
        "quality_notes": F.array(F.lit("optimized_rule_reducer_v3")), "num_blocks": F.size("blocks")})


def pipeline_counters(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    has = lambda n: F.count_if(F.array_contains("notes", n))
    return sums.groupBy(*keys).agg(has("rule_normalized").alias("normalize_rule_blocks"), has("model_normalized").alias("normalize_model_blocks"),
                                   has("rule_summary").alias("summary_rule_blocks"), F.count_if(F.exists("notes", lambda n: n.startswith("model_extract"))).alias("summary_model_blocks"))


def summarize(df: DataFrame, keys: Sequence[str], row_id: str, slab_of: Column, mode: Mode = STABLE, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines to (normalized blocks, block summaries) on the rule path. A step's table goes when the next one's is there."""
    keys = list(keys)
    lines = stored(filter_lines(df))
    m = sequence.merge_adjacent(lines, keys, row_id, width=width, text_col="text", spent=[lines])
    packed = sequence.pack_blocks(m, keys, [S, E, row_id], slab_of, mode.max_chars, mode.max_ms, mode.max_lines, spent=[m])
    norm = stored(normalize_rule(_grouped_lines(packed, keys)), [packed])
    return norm, summarize_rule(features(norm))
