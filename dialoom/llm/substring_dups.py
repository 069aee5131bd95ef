"""Removal of long repeated word passages, verified by suffix automata.

Wanted: every window of `window` consecutive words that starts at two places of the corpus. Automata of all shards sent to
all documents would compare the corpus with itself shard by shard, so shards are cut by *anchors* and meet only the
text that can match:

1. Each window names as its anchor the leftmost smallest hash of the word runs in it, so equal windows name equal
   anchors. Consecutive windows with one anchor position form a stretch (about 50 words); a stretch is one short row.
2. Equal stretches collapse to one class with a count; all windows of a class counted twice or more repeat.
3. Different classes that share an anchor are a reference shard: a suffix automaton of their words is built where they
   meet, every class is streamed through it, and windows whose matching statistic reaches `window` at a state
   that another class also reaches repeat. An anchor with more than `SHARD` classes (frequent phrases between
   different texts) is too large for one task: its windows are counted by their hash instead, which spreads them.
4. What repeats becomes spans per document, and words inside spans go.

Words are compared by 64-bit hashes, classes by 128 bits. Nothing is sampled or capped; the driver holds nothing.

Defined cases: null texts have no words; texts shorter than a window lose nothing; a window that repeats inside one text counts;
rows with equal id and text count as two places and both lose it; other columns are ignored; empty tables are allowed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, keyed, mixed, texts, word_hashes, written

RUN = 12                 # words of an anchor
SHARD = 256              # classes of one automaton
BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)     # odd multipliers of the two rolling hashes


class Rolling:
    """Hashes of any runs of a word sequence: differences of prefix sums of powers, modulo 2**64."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        up = np.full(n + 1, base, np.uint64)
        up[0] = 1
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.multiply.accumulate(up)[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def stretches(words: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, start, windows) of each stretch of a word sequence."""
    n, run = len(words), min(RUN, window)
    if n < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    rolls = Rolling(words, BASE[0])
    grams = rolls.of(np.arange(n - run + 1), np.arange(run, n + 1))
    view = np.lib.stride_tricks.sliding_window_view(grams, window - run + 1)
    at = np.arange(len(view)) + np.concatenate([view[lo:lo + 65_536].argmin(axis=1) for lo in range(0, len(view), 65_536)])
    start = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(np.append(start, len(at)))
    return grams[at[start]], Rolling(words, BASE[1]).of(start, start + count + window - 1), start, count


def repeats_in_shard(classes: list[tuple[list[int], int]], window: int) -> list[list[int]]:
    """For each (word numbers, count) of a shard the window starts that occur in another class, or in its own twice.

    One suffix automaton of all classes. A state remembers the class that reaches it, or that several do; the matching
    statistic at a word is followed up suffix links to the state of the last `window` words.
    """
    step: list[dict[int, int]] = [{}]
    link, length, owner, mark = [-1], [0], [-1], [-1]
    several = len(classes)

    def state(n: int, out: dict[int, int], up: int, own: int) -> int:
        step.append(out), link.append(up), length.append(n), owner.append(own), mark.append(-1)
        return len(step) - 1

    def extend(last: int, c: int) -> int:
        old = step[last].get(c)
        if old is not None and length[old] == length[last] + 1:
            return old
        if old is None:
            new = state(length[last] + 1, {}, 0, -1)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p == -1:
                return new
        else:
            new, p = None, last
        q = step[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = state(length[p] + 1, dict(step[q]), link[q], owner[q])
        link[q] = copy
        if new is not None:
            link[new] = copy
        while p != -1 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy if new is None else new

    for words, _ in classes:
        last = 0
        for c in words:
            last = extend(last, c)
    for k, (words, count) in enumerate(classes):
        at, own = 0, several if count > 1 else k
        for c in words:
            at = v = step[at][c]
            while v > 0 and mark[v] != k:
                mark[v] = k
                owner[v] = own if owner[v] in (-1, own) else several
                v = link[v]
    found = []
    for words, _ in classes:
        at, out = 0, []
        for i, c in enumerate(words):
            at = step[at][c]
            if i + 1 >= window:
                while length[link[at]] >= window:
                    at = link[at]
                if owner[at] == several:
                    out.append(i + 1 - window)
        found.append(out)
    return found


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """k1, k2, start, stop: word spans of keyed rows whose windows all repeat."""
    def scan(batch):
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            got = [stretches(word_hashes(t.split()), window) for t in texts(part, "text")]
            n = [len(g[0]) for g in got]
            a, c, s, w = (np.concatenate([g[k] for g in got]) for k in range(4))
            yield {"anchor": a.view(np.int64), "content": c.view(np.int64), "start": s, "windows": w,
                   "k1": np.repeat(part.column("k1").to_numpy(), n), "k2": np.repeat(part.column("k2").to_numpy(), n)}

    kinds = {c: "long" for c in ("anchor", "content", "start", "windows", "k1", "k2")}
    places = written(arrow_map(rows.select("text", "k1", "k2"), scan, kinds)
                     .withColumns({"start": F.col("start").cast("int"), "windows": F.col("windows").cast("int")}), "stretches")
    classes = written(places.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("at")), "classes")
    shards = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"))
                     .where("size > 1 and least = 1").select("anchor", "size"), "shards")
    open_ = classes.join(shards, "anchor").select("anchor", "n", "size", "at.*")

    # Words of the open classes: one place of each is read again.
    asked = open_.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "n", "size", "start", "windows")).alias("asked"))

    def fetch(batch):
        for t, k1, k2, wanted in zip(texts(batch, "text"), *(batch.column(c).to_pylist() for c in ("k1", "k2", "asked"))):
            h = word_hashes(t.split()).view(np.int64)
            yield {"anchor": [x["anchor"] for x in wanted], "n": [x["n"] for x in wanted], "size": [x["size"] for x in wanted],
                   "start": [x["start"] for x in wanted], "k1": [k1] * len(wanted), "k2": [k2] * len(wanted),
                   "seq": [h[x["start"]:x["start"] + x["windows"] + window - 1] for x in wanted]}

    kinds = {c: "long" for c in ("anchor", "n", "size", "start", "k1", "k2")} | {"seq": "array<long>"}
    sequences = written(arrow_map(rows.select("text", "k1", "k2").join(asked, ["k1", "k2"]), fetch, kinds), "sequences").dropDuplicates(["k1", "k2", "start"])

    def match(batch):
        for cell in batch.column("shard"):
            shard = cell.as_py()
            number: dict[int, int] = {}
            classes = [([number.setdefault(w, len(number)) for w in x["seq"]], x["n"]) for x in shard]
            hits = [(x, at) for x, found in zip(shard, repeats_in_shard(classes, window)) if x["n"] == 1 for at in found]
            yield {"k1": [x["k1"] for x, _ in hits], "k2": [x["k2"] for x, _ in hits], "start": [x["start"] + a for x, a in hits]}

    small = (sequences.where(F.col("size") <= SHARD).groupBy("anchor")
             .agg(F.collect_list(F.struct("k1", "k2", "start", "n", "seq")).alias("shard")).select("shard"))
    by_automaton = arrow_map(small, match, {c: "long" for c in ("k1", "k2", "start")})

    each = (sequences.where(F.col("size") > SHARD)
            .select("anchor", "n", "k1", "k2", "start", "seq", F.explode(F.sequence(F.lit(1), F.size("seq") - window + 1)).alias("i"))
            .select("anchor", "n", "k1", "k2", (F.col("start") + F.col("i") - 1).alias("start"),
                    F.xxhash64(F.slice("seq", F.col("i"), window)).alias("w1"),
                    F.xxhash64(F.lit(1), F.slice("seq", F.col("i"), window)).alias("w2")))
    each = written(each, "windows")
    twice = written(each.groupBy("anchor", "w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").drop("all"), "repeated-windows")
    by_count = each.where("n = 1").join(twice, ["anchor", "w1", "w2"], "left_semi").select("k1", "k2", "start")

    whole = (places.join(classes.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
             .select("k1", "k2", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("windows") + (window - 1)).cast("long").alias("stop")))
    single = by_automaton.unionAll(by_count).withColumn("stop", F.col("start") + window)
    return whole.unionAll(single)


def without_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (removed words: start, stop, ...), kept (words left, joined by blanks)."""
    rows = keyed(docs, id_col, text_col)
    spans = written(repeated_spans(rows, window).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("found")), "spans")

    def cut(batch):
        out = {c: [] for c in ("n_words", "n_removed", "spans", "kept")}
        for t, found in zip(texts(batch, "text"), batch.column("found")):
            words, spans = t.split(), []
            if found.is_valid:
                flat = found.values
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, flat.field("start").to_numpy(), 1)
                np.add.at(edge, flat.field("stop").to_numpy(), -1)
                inside = np.cumsum(edge[:-1]) > 0
                spans = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))).tolist()
            kept, last = [], 0
            for a, b in zip(spans[::2], spans[1::2]):
                kept += words[last:a]
                last = b
            kept += words[last:]
            for c, v in (("n_words", len(words)), ("n_removed", len(words) - len(kept)), ("spans", spans), ("kept", b" ".join(kept))):
                out[c].append(v)
        yield {"doc_id": batch.column("doc_id")} | out

    out = arrow_map(rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "found"), cut,
                    {"n_words": "long", "n_removed": "long", "spans": "array<long>", "kept": "binary"}, keep=["doc_id"])
    return out.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("doc_id", id_col)
