"""Best-fit packing after a Martello-Toth reduction, on counts of sizes.

A document longer than a sequence is cut into full pieces, the first piece takes the rest; every other document is one
piece. Packing needs only how many pieces of each size there are: at most `capacity` numbers, whatever the corpus.

Reduction. A set of sizes that contains an item j *dominates* another such set if the other's members can be dealt to
distinct members of it, each taking no more than its own size; some best packing then uses the dominating set. For an
item j with room r beside it, the sets that dominate all others are found by three rules and fixed for good, as many
times as there are items, until no rule applies:
  - nothing fits beside j: {j};
  - k is the largest size that fits, and k = r, or no two items fit together: {j, k};
  - at most two items fit together: {j, k} if no pair exceeds k; else {j, k, b}, b the largest beside k, if every pair
    with a sum above k has its smaller part at most b.
Removing items keeps these conditions true, so a rule is applied to all copies of a set at once.

The rest goes best-fit by falling size: a piece joins the fullest sequence that has room. Equal pieces take equal
steps, so whole runs of them are dealt at once. The plan is a list of (pattern, how often).

Rows. Pieces are numbered within their size: places inside a partition are written with the ids, partitions' counts
(partition, size) are summed up by a window and joined back, and number and plan give sequence and offset.

Defined cases: a null or empty text is just its end id; repeated rows are packed once each; other columns are ignored;
an empty table gives no rows. A task holds a batch and one document's ids; the driver holds `capacity` counts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.byte_encoding import stretch_encoder
from dialoom.llm.common import arrow_map, text_bytes, texts, whole_partition, written

SOME = 500
WIDE = 1 << 50                                                # more than pieces of one size

Pattern = tuple[tuple[int, int], ...]                         # (size, how many of it), falling sizes


class Sizes:
    """Counts of sizes 1..capacity with the neighbours a rule asks for."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for s, c in counts.items():
            self.n[s] = c
        self.capacity = capacity

    def largest(self, room: int, used: Iterable[int] = ()) -> int:
        """The largest size up to `room` still there when one of each in `used` is taken; 0 if none."""
        left = self.n[1:max(room, 0) + 1].copy()
        for u in used:
            if 0 < u <= room:
                left[u - 1] -= 1
        at = np.flatnonzero(left > 0)
        return int(at[-1]) + 1 if len(at) else 0

    def smallest(self, without: int) -> list[int]:
        """The three smallest items beside one item of size `without` (beyond the last: more than fits)."""
        out: list[int] = []
        for s in np.flatnonzero(self.n).tolist():
            out += [s] * min(3, int(self.n[s]) - (s == without))
            if len(out) >= 3:
                break
        return (out + [self.capacity + 1] * 3)[:3]

    def take(self, *items: int) -> tuple[Pattern, int]:
        """Fix the set as often as there are items for it."""
        need = {s: items.count(s) for s in sorted(set(items), reverse=True)}
        times = min(int(self.n[s]) // c for s, c in need.items())
        for s, c in need.items():
            self.n[s] -= times * c
        return tuple(need.items()), times


def dominating(sizes: Sizes, j: int) -> tuple[int, ...] | None:
    """The set with j that dominates all others, if the rules show one."""
    room = sizes.capacity - j
    s1, s2, s3 = sizes.smallest(j)
    if s1 > room:
        return (j,)
    k = sizes.largest(room, [j])
    if k == room or s1 + s2 > room:
        return (j, k)
    if s1 + s2 + s3 <= room:
        return None
    left = sizes.n.copy()
    left[j] -= 1
    there = np.flatnonzero(left[:room + 1] > 0)
    a, b = there[:, None], there[None, :]
    pair = (a + b <= room) & ((a > b) | ((a == b) & (left[there] >= 2)[:, None]))
    if not (pair & (a + b > k)).any():
        return (j, k)
    third = sizes.largest(room - k, [j, k])
    if third and not (pair & (a + b > k) & (b > third)).any():
        return (j, k, third)
    return None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns fixed by dominance, and the sizes that are left."""
    sizes, fixed = Sizes(counts, capacity), []
    moved = True
    while moved:
        moved = False
        for j in np.flatnonzero(sizes.n)[::-1].tolist():
            while sizes.n[j] > 0 and (found := dominating(sizes, j)):
                fixed.append(sizes.take(*found))
                moved = True
    return fixed, {int(s): int(sizes.n[s]) for s in np.flatnonzero(sizes.n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit by falling size, equal pieces together: the same sequences as piece by piece."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}         # room left -> (pattern, how often)
    rooms: list[int] = []

    def put(room, pattern, times):
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((pattern, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    del rooms[at]
            else:
                room, pattern, times = capacity, (), n
            each = room // s
            whole = min(times, n // each)
            if whole:
                put(room - each * s, (*pattern, (s, each)), whole)
            n, rest = n - whole * each, times - whole
            if rest and n and n < each:
                put(room - n * s, (*pattern, (s, n)), 1)
                n, rest = 0, rest - 1
            if rest and pattern:
                put(room, pattern, rest)
    return [g for r in rooms for g in groups[r]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns for all pieces, full ones included: reduction, then best fit."""
    fixed, rest = reduced({s: n for s, n in counts.items() if n}, capacity)
    return fixed + best_fit(rest, capacity)


@dataclass
class Places:
    """Where the g-th piece of a size goes: runs of numbers, each dealt to the sequences of one pattern."""

    keys: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    @classmethod
    def of(cls, patterns: list[tuple[Pattern, int]]) -> Places:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, times in patterns:
            offset = 0
            for s, each in pattern:
                rows.append((s * WIDE + used.get(s, 0), each, sequence, offset))
                used[s] = used.get(s, 0) + times * each
                offset += s * each
            sequence += times
        keys, each, first, offsets = np.array(sorted(rows) or np.empty((0, 4)), np.int64).T
        return cls(keys, each, first, offsets, sequence)

    def find(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, size * WIDE + number, "right") - 1
        inside = size * WIDE + number - self.keys[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * size


def encoded(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (narrow, without the end id), rest and full (size of the first piece if not full, full pieces), part,
    and what the partition had before: pieces of that size, full pieces."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(docs, text_col, "text"))

    @whole_partition
    def step(batches):
        part, enc = TaskContext.get().partitionId(), stretch_encoder(tokenizer)
        seen, fulls = np.zeros(capacity, np.int64), 0
        for batch in batches:
            cells = texts(batch, "text")
            for lo in range(0, len(cells), SOME):
                ids = enc.encode(cells[lo:lo + SOME])
                n = np.fromiter((len(i) // enc.dtype.itemsize + 1 for i in ids), np.int64, len(ids))
                full, rest = n // capacity, n % capacity
                order = np.argsort(rest, kind="stable")
                new = np.diff(rest[order], prepend=-1) != 0
                run = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
                nth = np.empty(len(n), np.int64)
                nth[order] = np.arange(len(n)) - run
                yield {"doc_id": batch.column("doc_id").slice(lo, len(ids)), "ids": ids, "rest": rest, "full": full,
                       "part": np.full(len(ids), part, np.int64), "nth": seen[rest] + nth, "nth_full": fulls + np.cumsum(full) - full}
                seen += np.bincount(rest, minlength=capacity)
                fulls += int(full.sum())

    return arrow_map(rows, step, {"ids": "binary", "rest": "long", "full": "long", "part": "long", "nth": "long", "nth_full": "long"},
                     keep=["doc_id"])


def best_fit_pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, little-endian 32 bit), sequence_id, offset."""
    table = written(encoded(docs, tokenizer, end_id, capacity, id_col, text_col), "best-fit-ids")
    tally = written(table.where("rest > 0").groupBy("part", F.col("rest").alias("size")).agg(F.count(F.lit(1)).alias("n"))
                    .unionAll(table.where("full > 0").groupBy("part").agg(F.sum("full").alias("n")).select("part", F.lit(capacity).cast("long"), "n")),
                    "best-fit-sizes")
    counts = {r["size"]: r["n"] for r in tally.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    places = table.sparkSession.sparkContext.broadcast(Places.of(plan(counts, capacity)))
    order = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tally.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    rests = before.where(F.col("size") < capacity).select("part", F.col("size").alias("rest"), F.col("before").alias("rests"))
    fulls = before.where(F.col("size") == capacity).select("part", F.col("before").alias("fulls"))
    table = table.join(rests, ["part", "rest"], "left").join(fulls, "part", "left").na.fill(0, ["rests", "fulls"])

    def step(batch):
        narrow = stretch_encoder(tokenizer).dtype
        rest, full, nth, nth_full, rests, fulls = (batch.column(c).to_numpy() for c in ("rest", "full", "nth", "nth_full", "rests", "fulls"))
        pieces = full + (rest > 0)
        doc = np.repeat(np.arange(len(rest)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        k = piece - (rest > 0)[doc]                                     # -1: the piece that isn't full
        size = np.where(k < 0, rest[doc], capacity)
        sequence, offset = places.value.find(size, np.where(k < 0, (rests + nth)[doc], (fulls + nth_full)[doc] + k))
        start = np.where(k < 0, 0, rest[doc] + k * capacity)
        cells, cut, at = batch.column("ids"), [], -1
        for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist()):
            if d != at:
                at, ids = d, np.append(np.frombuffer(cells[d].as_py(), narrow), end_id).astype("<u4")
            cut.append(ids[a:a + n].tobytes())
        yield {"doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": size,
               "ids": cut, "sequence_id": sequence, "offset": offset}

    rows = table.select("doc_id", "ids", "rest", "full", "nth", "nth_full", "rests", "fulls")
    out = arrow_map(rows, step, {"piece": "int", "start": "long", "length": "long", "ids": "binary", "sequence_id": "long", "offset": "long"},
                    keep=["doc_id"])
    return out.withColumnRenamed("doc_id", id_col)
