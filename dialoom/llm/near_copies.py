"""Near copies by similarity of word shingles: several SimHash fingerprints, generalised pigeonhole, exact verification.

1. A text is the set of its shingles of `words` words (A-Z lower-cased; a shorter text is one shingle). Equal sets are one
   class from the first aggregation on.
2. Each class has `PRINTS` independent 64-bit SimHash fingerprints of its set. A pair of similarity 0.8 differs in about a
   seventh of the bits of each (9.7).
3. Candidates come from the generalised pigeonhole (`simhash_dups`), fingerprint by fingerprint: correlated bits share a
   partition, dynamic programming splits the error budget unequally over the partitions, a class is indexed under its own
   values and probes those within its thresholds. All pairs within `MAX_BITS` of any fingerprint meet for certain, and a
   pair of similarity 0.8 agrees in one of the `PRINTS` * (`MAX_BITS` + 1) partitions of 13 bits in about 98 of 100 cases.
   A budget wide enough to make it certain (11 bits) would leave partitions of 5 bits that select little, or probes whose
   number grows with that of the classes; with this one a class has about 30 rows, however many there are. Pairs that meet
   and whose first two fingerprints lie within `RADIUS` bits form a group; the shingle sets of its members are compared
   exactly in blocks of bounded size, and a block gives a spanning forest of its links.
4. Connected groups keep one document: the one with the smallest id, of equal ids the first read.

Defined cases: null, empty and blank texts share the class of the empty set and keep one row; repeated rows are one class;
null ids come last; columns of any name are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import LOWER, arrow_map, fresh, mixed, text_bytes, texts, word_hashes, written
from dialoom.llm.components import components
from dialoom.llm.line_dedup import SPREAD, STRIP, joined, pairs_in
from dialoom.llm.simhash_dups import blocks, signatures

PRINTS = 6
MAX_BITS = 4               # of the 64 bits of a fingerprint: five partitions; a pair of similarity 0.8 meets in none in about 2 of 100 cases
MEETING = 8192             # rows of a bucket compared in one piece; a larger bucket is dealt out
NEAR = 24                  # of the 64 bits of one fingerprint; pairs of similarity 0.8 lie 10 apart, others 32
RADIUS = 36                # of the 128 bits of two fingerprints; pairs of similarity 0.8 lie 19 apart, others 64
BLOCK = 256
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                  0xFF51AFD7ED558CCD][:PRINTS], np.uint64)
AT_ONCE = 100_000          # shingles counted together
HELD = 100_000             # pairs held before they are joined
NAMES = [f"print{k}" for k in range(PRINTS)]
MET = ("node", *NAMES[:2])


def shingles(text: bytes, words: int) -> np.ndarray:
    """The different shingles of a text as sorted hashes."""
    ws = text.translate(LOWER).split()
    h = word_hashes(ws)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1 if k else 0, np.uint64(k))
    for i in range(k):
        out = mixed(out + h[i:i + len(out)])
    return np.unique(out)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    out = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), AT_ONCE):
        some = SPREAD[np.ascontiguousarray(hashes[lo:lo + AT_ONCE]).view(np.uint8).reshape(-1, 8)]
        ones = np.add.reduceat(some, np.arange(0, len(some), 255), axis=0)       # eight counters of a byte in a number
        out += ones.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Fingerprints of sets."""
    ones = np.stack([[bit_counts(mixed(s ^ seed)) for seed in SEEDS] for s in sets]) if sets else np.zeros((0, PRINTS, 64), np.int64)
    more = 2 * ones > np.array([len(s) for s in sets], np.int64)[:, None, None]
    packed = np.packbits(more, axis=-1, bitorder="little").reshape(len(sets), PRINTS, 8).copy().view("<i8")[..., 0]
    return {c: packed[:, k] for k, c in enumerate(NAMES)}


def near_rows(fps: np.ndarray, own: np.ndarray, max_bits: int):
    """(i, j) of all pairs within max_bits of which one stands under its own value, strip by strip."""
    bits, mine = np.ascontiguousarray(fps, np.int64).view(np.uint64), np.flatnonzero(own)
    for lo in range(0, len(mine), 64):
        some = mine[lo:lo + 64]
        i, j = np.nonzero(np.bitwise_count(bits[some, None] ^ bits[None, :]) <= max_bits)
        keep = some[i] != j
        yield some[i[keep]], j[keep]


def posted(classes: DataFrame) -> DataFrame:
    """(bucket, node, print0, print1, own): classes under their own and their probed values of all fingerprints."""
    rows = [signatures(classes.select("node", F.col(c).alias("fp"), *NAMES[:2]), MAX_BITS, MET, MEETING)
            .select((F.col("bucket") * PRINTS + k).alias("bucket"), *MET, "own") for k, c in enumerate(NAMES)]
    return reduce(DataFrame.unionAll, rows)


def met_groups(cols: dict[str, np.ndarray], lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Classes (node) of consecutive buckets of these lengths that may be similar, in groups named by their members."""
    a, b, own, edges = cols["print0"].view(np.uint64), cols["print1"].view(np.uint64), cols["own"], []
    root = np.arange(len(a))

    def join(i, j):
        nonlocal root
        near = np.bitwise_count(a[i] ^ a[j]).astype(np.int16) + np.bitwise_count(b[i] ^ b[j]) <= RADIUS
        near[near] = root[i[near]] != root[j[near]]                               # pairs that are connected aren't held
        if near.any():
            edges.append((i[near], j[near]))
        if sum(len(x) for x, _ in edges) > HELD:
            root = joined(len(a), [(np.arange(len(a)), root), *edges])
            edges.clear()

    large = lengths > STRIP
    for lo, n in zip((np.cumsum(lengths) - lengths)[large].tolist(), lengths[large].tolist()):
        for i, j in near_rows(cols["print0"][lo:lo + n], own[lo:lo + n], NEAR):
            join(i + lo, j + lo)
    small = np.flatnonzero(np.repeat(~large, lengths))
    for i, j in pairs_in(lengths[~large]):
        i, j = small[i], small[j]
        met = own[i] | own[j]
        join(i[met], j[met])
    root = joined(len(a), [(np.arange(len(a)), root), *edges])
    total = np.zeros(len(a), np.uint64)
    np.add.at(total, root, mixed(cols["node"].view(np.uint64)))                   # a group is named by its members
    hit = np.bincount(root, minlength=len(a))[root] > 1
    return {"bucket": total[root[hit]].view(np.int64), "node": cols["node"][hit]}


def similar_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the similar pairs."""
    n, up, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i, j in pairs_in(np.array([len(sets)])):
        near = (up[i] != up[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        found = []
        for a, b in zip(i[near].tolist(), j[near].tolist()):
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                found.append((a, b))
        if found:
            out += found
            up = joined(len(sets), [tuple(np.array(x) for x in zip(*out))])
    return out


def links(classes: DataFrame, sets_of, similarity: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between nodes of `classes` (node and fingerprints) that connect all similar ones that meet.

    `sets_of(nodes)` gives node, hashes for a table of nodes."""
    def meet(batch):
        cells = batch.column("block")
        yield met_groups({c: cells.flatten().field(c).to_numpy(zero_copy_only=False) for c in (*MET, "own")}, cells.value_lengths().to_numpy())

    met = arrow_map(blocks(written(posted(classes), "copy-signatures"), [*MET, "own"], MEETING), meet, {"bucket": "long", "node": "long"})
    met = written(met.distinct(), "met-copies")
    sets = written(sets_of(met.select("node").distinct()), "met-sets")

    def verify(batch):
        for cell in batch.column("block"):
            names = cell.values.field("node").to_numpy()
            got = similar_sets([np.array(x.as_py(), np.int64) for x in cell.values.field("hashes")], similarity)
            yield {"a": [int(names[i]) for i, _ in got], "b": [int(names[j]) for _, j in got]}

    return arrow_map(blocks(met.join(sets, "node").select("bucket", "node", "hashes"), ["node", "hashes"], block), verify, {"a": "long", "b": "long"})


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of near copies."""
    raw, order = fresh(docs, "text_bytes", "row_order")
    table = written(docs.withColumn(order, F.monotonically_increasing_id()), "rows")
    rows = table.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(order).alias("row"), text_bytes(table, text_col, raw))

    def step(batch):
        sets = [shingles(t, words) for t in texts(batch, raw)]
        key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
        yield {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "k1": key[:, 0], "k2": key[:, 1]} | fingerprints(sets)

    prints = written(arrow_map(rows, step, {"row": "long", "k1": "long", "k2": "long"} | dict.fromkeys(NAMES, "long"), keep=["doc_id"]), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    classes = written(prints.groupBy("k1", "k2").agg(F.min(rank).alias("first"), *[F.first(c).alias(c) for c in NAMES])
                      .withColumn("node", F.col("first.row")), "copy-classes")

    def sets_of(nodes):
        met = rows.join(nodes, F.col("row") == F.col("node")).select("node", raw)
        return arrow_map(met, lambda batch: iter([{"node": batch.column("node"), "hashes": [shingles(t, words).view(np.int64) for t in texts(batch, raw)]}]),
                         {"hashes": "array<long>"}, keep=["node"])

    roots = components(links(classes, sets_of, similarity))
    root = classes.select("node", "first").join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    stay = written(root.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("stay")), "stay")
    return table.join(stay, F.col(order) == F.col("stay"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
