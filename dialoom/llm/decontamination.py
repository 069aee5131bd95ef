"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window (13 words of an item, or a whole shorter item) is the set of its word shingles with their positions.
Containment of the whole window makes one shingle a sufficient prefix, so every window joins by its *rarest* shingle,
rarity being counted over all documents. A document that has the shingle must also have room for the window around it
(length and position bounds); then the window is verified word by word.

The benchmark is a stated query set: it is taken in blocks of about `block_words` words, and each block meets all
documents in a scan, without moving a text. A block is what reaches the driver and is broadcast; its size is set by
`block_words`, not by the data: items are cut into pieces of `PIECE` windows first, which overlap so that no window is
lost, and pieces that repeat are taken once. So neither a very long item nor one that occurs very often makes a block larger.

Defined cases: null or empty texts have no words, such items have no window; documents without words are never
contaminated; repeated rows are judged one by one; an item id counts once however often its rows repeat, items with a
null id mark words but are not listed; other columns are ignored (`cleaned` keeps them); empty tables are allowed.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, fresh, text_bytes, texts, whole_partition, written

SHINGLE = 3
PIECE = 10_000                 # windows of an item that stay together
MOST_WORDS = 2_000_000         # three word numbers fit into 63 bits
# A-Z become a-z; what is not a digit, a-z or beyond ASCII parts words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Block:
    """Windows of a part of the benchmark as word numbers, with their shingles."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.word: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.word.setdefault(w, len(self.word)) for w in text.translate(WORDS).split()]
            for s in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(tuple(ids[s:s + window]), set()).update([name] if name is not None else [])
        self.size = max(len(self.word), 1)
        self.windows, self.items = list(of), [sorted(x) for x in of.values()]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.full((len(self.windows), max(self.lengths, default=1)), -1, np.int64)
        for k, w in enumerate(self.windows):
            self.matrix[k, :len(w)] = w
        # (shingle length, shingle number, window, position in it); short items use shorter shingles
        self.widths = sorted({min(SHINGLE, n) for n in self.lengths.tolist()})
        self.shingles, self.uses = {}, {}
        for k in self.widths:
            mine = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == k)
            n = self.lengths[mine] - k + 1
            win = np.repeat(mine, n)
            at = np.arange(len(win)) - np.repeat(np.cumsum(n) - n, n)
            key = np.zeros(len(win), np.int64)
            for j in range(k):
                key = key * self.size + self.matrix[win, at + j]
            self.shingles[k], number = np.unique(key, return_inverse=True)
            self.uses[k] = (win, at, number)
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.word.get(w, -1) for w in words), np.int64, len(words))

    def found(self, ids: np.ndarray, k: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, places in the sorted table) of the text's shingles that the table has."""
        n = len(ids) - k + 1
        if n <= 0 or not len(table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        ok = known[:n].copy()
        for j in range(1, k):
            ok &= known[j:n + j]
        pos = np.flatnonzero(ok)
        key = np.zeros(len(pos), np.int64)
        for j in range(k):
            key = key * self.size + ids[pos + j]
        place = np.minimum(np.searchsorted(table, key), len(table) - 1)
        hit = table[place] == key
        return pos[hit], place[hit]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Each window's rarest shingle (of equally rare ones the first) becomes its prefix."""
        for k, (win, at, number) in self.uses.items():
            order = np.lexsort((at, counts[k][number], win))
            first = order[np.flatnonzero(np.diff(win[order], prepend=-1))]
            first = first[np.argsort(number[first], kind="stable")]
            used, start = np.unique(number[first], return_index=True)
            self.prefix[k] = (self.shingles[k][used], np.append(start, len(first)), win[first], at[first])

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all occurrences in a text."""
        wins, starts = [], []
        for k, (table, start, win, at) in self.prefix.items():
            pos, place = self.found(ids, k, table)
            n = start[place + 1] - start[place]
            use = np.repeat(start[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w, s = win[use], np.repeat(pos, n) - at[use]
            ok = (s >= 0) & (s + self.lengths[w] <= len(ids))
            w, s = w[ok], s[ok]
            for j in range(self.matrix.shape[1]):          # drop out word by word
                inside = j < self.lengths[w]
                same = ~inside | (ids[np.minimum(s + j, len(ids) - 1)] == self.matrix[w, j])
                w, s = w[same], s[same]
            wins.append(w)
            starts.append(s)
        return (np.concatenate(wins), np.concatenate(starts)) if wins else (np.zeros(0, np.int64),) * 2


def _rarity(rows: DataFrame, block) -> dict[int, np.ndarray]:
    """How often the documents have each shingle of a block: one scan, sums per partition, one number per shingle."""
    @whole_partition
    def step(batches):
        b = block.value
        sums = {k: np.zeros(len(t), np.int64) for k, t in b.shingles.items()}
        for batch in batches:
            for t in texts(batch, "text"):
                ids = b.numbers(t.translate(WORDS).split())
                for k, table in b.shingles.items():
                    sums[k] += np.bincount(b.found(ids, k, table)[1], minlength=len(table))
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield {"width": np.full(len(at), k), "at": at, "n": s[at]}

    out = {k: np.zeros(len(t), np.int64) for k, t in block.value.shingles.items()}
    summed = arrow_map(rows, step, {"width": "long", "at": "long", "n": "long"}).groupBy("width", "at").agg(F.sum("n").alias("n"))
    for k, at, n in summed.collect():
        out[k][at] = n
    return out


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, text, n): items as normalised words, cut into overlapping runs of at most PIECE windows, each run once."""
    def step(batch):
        out = {"item": [], "text": [], "n": []}
        for item, t in zip(batch.column("name").to_pylist(), texts(batch, "raw")):
            words = t.translate(WORDS).split()
            for s in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                run = words[s:s + PIECE + window - 1]
                for c, x in zip(out.values(), (item, b" ".join(run), len(run))):
                    c.append(x)
        yield out

    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("name"), text_bytes(benchmark, text_col, "raw"))
    return arrow_map(items, step, {"item": "string", "text": "binary", "n": "long"}).distinct()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Blocks of about `block_words` words (at most `MOST_WORDS` / 2, so that an uneven one still fits)."""
    pieces = written(_pieces(benchmark, item_col, text_col, window), "benchmark-pieces")
    n = max(1, ceil((pieces.agg(F.sum("n")).first()[0] or 0) / min(block_words, MOST_WORDS // 2)))
    for k in range(n):
        mine = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).select("item", "text")
        yield Block([(i, t) for i, t in mine.collect()], window)


def spans_of(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, item_col: str, item_text_col: str, window: int,
             block_words: int, names: list[str]) -> DataFrame:
    """Columns `keep` of docs and, named by `names`, the word count, hit spans (start, stop, start, ...) and items."""
    raw, = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "text_bytes")
    n_words, spans, items = names
    sc = docs.sparkSession.sparkContext
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes(docs, text_col, raw), F.lit(0).cast("long").alias(n_words),
                       F.array().cast("array<long>").alias(spans), F.array().cast("array<string>").alias(items))
    for made in _blocks(benchmark, item_col, item_text_col, window, block_words):
        made.choose(_rarity(docs.select(text_bytes(docs, text_col, "text")), sc.broadcast(made)))
        block = sc.broadcast(made)

        def step(batch, block=block):
            b, out = block.value, ([], [], [])
            for t, old, named in zip(texts(batch, raw), batch.column(spans).to_pylist(), batch.column(items).to_pylist()):
                ids = b.numbers(t.translate(WORDS).split())
                win, start = b.occurrences(ids)
                if len(win):
                    edge = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(edge, np.append(start, old[::2]).astype(np.int64), 1)
                    np.add.at(edge, np.append(start + b.lengths[win], old[1::2]).astype(np.int64), -1)
                    inside = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8)))
                    old = np.flatnonzero(np.diff(inside)).tolist()
                    named = sorted({*named, *(x for w in np.unique(win).tolist() for x in b.items[w])})
                for o, x in zip(out, (len(ids), old, named)):
                    o.append(x)
            yield {c: batch.column(c) for c in (*keep, raw)} | dict(zip(names, out))

        rows = arrow_map(rows.select(*[F.col(f"`{c}`") for c in keep], raw, spans, items), step,
                         dict(zip(names, ("long", "array<long>", "array<string>"))), keep=[*keep, raw])
    return rows.drop(raw)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = 13, min_share: float = 0.05, block_words: int = 1_000_000,
                  keep: list[str] | None = None, names: tuple[str, ...] = ("n_words", "spans", "items", "n_hit", "contaminated")) -> DataFrame:
    """One row per document: id (or the columns `keep`), n_words, spans, items, n_hit and contaminated."""
    n_words, spans, items, n_hit, bad = names
    out = spans_of(docs, benchmark, keep or [id_col], text_col, item_col, item_text_col, window, block_words, [n_words, spans, items])
    signed = F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    out = out.withColumn(n_hit, F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x))
    per = round(1 / min_share)
    return out.withColumn(bad, (F.col(n_hit) > 0) & (per * F.col(n_hit) >= F.col(n_words)))


def cleaned(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their own columns."""
    names = tuple(fresh(docs, "n_words", "spans", "items", "n_hit", "contaminated"))
    out = decontaminate(docs, benchmark, keep=docs.columns, names=names, **options)
    return out.where(~F.col(names[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])
