"""Near-duplicates by SimHash with the generalised pigeonhole principle.

1. Fingerprints of whole texts (no shuffle); equal fingerprints collapse to one class.
2. Bit statistics of all classes (a 64 x 64 table of counts): correlated bits go to the same partition of bits, so that
   partitions differ in how well they select. Wider partitions are used when there are more classes.
3. For every class, dynamic programming splits the error budget unequally: partition i gets a threshold t_i >= -1 (-1:
   not probed) with sum(t_i + 1) = max_bits + 1, so that the expected number of probes and candidates, read from value
   histograms of all classes, is least. Two fingerprints within max_bits agree within t_i in some partition.
4. Every class is indexed under its own value of each partition and probes all values within t_i. Classes that meet are
   verified in blocks of bounded size; a block gives a spanning forest of its links, never all pairs. A bucket that is
   larger than a block is dealt out as pairs of blocks.
5. Connected groups of the forest are the groups of near-duplicates.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any other; repeated rows and equal texts
share a class; a null id keeps its row, and a group's id is the smallest non-null id in it (null if there is none);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import LOWER, arrow_map, fresh, text_bytes, texts, whole_partition, written
from dialoom.llm.components import components

BITS = 64
BLOCK = 512            # classes verified against each other
FOLD = 16              # bits of a histogram
PROBE_COST = 512.0     # one probe row, shuffled and gathered, costs as much as so many comparisons in a block
PARTITION_BITS = 6     # room for a partition's number in a bucket's name
BUCKET = 1024          # expected classes of a bucket of independent bits


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit number."""
    ws = text.translate(LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    stop = np.cumsum(size) - 1
    start = stop - size + 1
    k = min(words, len(ws))
    starts, stops, digest = start[:len(ws) - k + 1].tolist(), stop[k - 1:].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(starts), 65_536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo:lo + 65_536], stops[lo:lo + 65_536])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str, keep: list[str], out: str, words: int = 3) -> DataFrame:
    raw, = fresh(docs, "text_bytes")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes(docs, text_col, raw))

    def step(batch):
        yield {c: batch.column(c) for c in keep} | {out: [fingerprint(t, words) for t in texts(batch, raw)]}

    return arrow_map(rows, step, {out: "long"}, keep=keep)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_table(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of classes and how many have bits i and j set: 4,096 numbers however many classes there are."""
    @whole_partition
    def step(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = _bits(b.column("fp").to_numpy()).astype(np.float32)
            for lo in range(0, len(x), 65_536):
                total += x[lo:lo + 65_536].T @ x[lo:lo + 65_536]
            n += len(x)
        if n:
            yield {"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n).astype(np.int64)}

    got = arrow_map(classes.select("fp"), step, {"cell": "long", "n": "long"}).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for cell, n in got:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def bit_groups(n: int, together: np.ndarray, max_bits: int, bucket: int = BUCKET) -> list[list[int]]:
    """Partitions of the 64 bits: each starts with the most correlated free bit and takes the bits closest to it."""
    m = int(min(max(BITS // max(1.0, log2(max(n, 2) / bucket)), 2), max_bits + 1))
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        seed = max(free, key=lambda i: (corr[i, list(free)].sum(), -i))
        group = [seed]
        free.remove(seed)
        while len(group) < width:
            best = max(free, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def value(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def folds(group: list[int]) -> list[list[int]]:
    return [group[i:i + FOLD] for i in range(0, len(group), FOLD)]


def histograms(classes: DataFrame, groups: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """How many classes have each value of each fold of a partition: at most 65,536 numbers a fold."""
    cells = [(g, f, fold) for g, group in enumerate(groups) for f, fold in enumerate(folds(group))]

    @whole_partition
    def step(batches):
        sums = [np.zeros(1 << len(fold), np.int64) for *_, fold in cells]
        for b in batches:
            bits = _bits(b.column("fp").to_numpy())
            for s, (*_, fold) in zip(sums, cells):
                s += np.bincount(value(bits, fold), minlength=len(s))
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield {"cell": np.full(len(at), k), "at": at, "n": s[at]}

    out = {(g, f): np.zeros(1 << len(fold)) for g, f, fold in cells}
    summed = (arrow_map(classes.select("fp"), step, {"cell": "long", "at": "long", "n": "long"})
              .groupBy("cell", "at").agg(F.sum("n").alias("n")))
    got = summed.toPandas()
    for k, (g, f, _) in enumerate(cells):
        mine = got[got.cell == k]
        out[g, f][mine["at"].to_numpy()] = mine["n"].to_numpy()
    return out


def at_distance(hist: np.ndarray, most: int) -> np.ndarray:
    """[d, v]: how many classes have a value at distance d of v (d up to `most`), bit by bit."""
    out = np.zeros((most + 1, len(hist)))
    out[0] = hist
    v = np.arange(len(hist))
    for bit in range(len(hist).bit_length() - 1):
        flipped = out[:, v ^ (1 << bit)]
        out[1:] += flipped[:-1]
    return out


def thresholds(bits: np.ndarray, groups: list[list[int]], dist: dict, n: int, max_bits: int) -> np.ndarray:
    """[row, partition]: thresholds of least expected cost with sum(t + 1) = max_bits + 1, by dynamic programming."""
    rows, units = len(bits), max_bits + 1
    best = np.full((units + 1, rows), np.inf)
    best[0] = 0
    choice = []
    for g, group in enumerate(groups):
        near = None
        for f, fold in enumerate(folds(group)):
            mine = dist[g, f][:, value(bits, fold)] / max(n, 1)
            if near is None:
                near = mine
            else:                                        # folds of one partition: taken as independent
                near = np.stack([sum(near[a] * mine[d - a] for a in range(d + 1)) for d in range(units)])
        cost = [np.zeros(rows)]
        for t in range(units):
            probes = sum(comb(len(group), d) for d in range(t + 1))
            # A probe also meets the probes of all that share its value, so a crowded value is dear to probe around.
            cost.append(near[:t + 1].sum(axis=0) * n + (PROBE_COST + near[0] * n) * probes)
        now = np.full_like(best, np.inf)
        took = np.zeros((units + 1, rows), np.int64)
        for u in range(units + 1):
            for c in range(u + 1):
                total = best[u - c] + cost[c]
                better = total < now[u]
                now[u][better], took[u][better] = total[better], c
        best = now
        choice.append(took)
    out = np.zeros((rows, len(groups)), np.int64)
    left, at = np.full(rows, units), np.arange(rows)
    for g in reversed(range(len(groups))):
        out[:, g] = choice[g][left, at] - 1
        left = left - choice[g][left, at]
    return out


def _flips(width: int, t: int) -> np.ndarray:
    """Masks of the values within distance t, nearest first."""
    return np.array([sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(width), d)], np.int64)


def signatures(classes: DataFrame, max_bits: int, keep: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """(bucket, fp): each class under its own value of every partition and under every value that it probes.

    With `keep`, columns that are handed on, and `own`: whether the value is the class's own."""
    n, together = bit_table(classes)
    groups = bit_groups(n, together, max_bits, bucket)
    hist = histograms(classes, groups)
    dist = classes.sparkSession.sparkContext.broadcast({k: at_distance(h, max_bits) for k, h in hist.items()})

    def step(batch):
        all_fps = batch.column("fp").to_numpy()
        for lo in range(0, len(all_fps), 2048):
            fps = all_fps[lo:lo + 2048]
            bits = _bits(fps)
            t = thresholds(bits, groups, dist.value, n, max_bits)
            keys, owners, mine = [], [], []
            for g, group in enumerate(groups):
                v = value(bits, group)
                for own in range(-1, max_bits + 1):
                    at = np.flatnonzero(t[:, g] == own)
                    if len(at):
                        mask = _flips(len(group), max(own, 0))
                        keys.append((((v[at][:, None] ^ mask) << PARTITION_BITS) | g).ravel())
                        owners.append(np.repeat(at, len(mask)))
                        mine.append(np.tile(mask == 0, len(at)))
            at = np.concatenate(owners)
            got = {"bucket": np.concatenate(keys), "fp": fps[at]}
            yield got if not keep else got | {"own": np.concatenate(mine)} | {c: batch.column(c).take(pa.array(lo + at)) for c in keep}

    return arrow_map(classes.select("fp", *keep), step, {"bucket": "long", "fp": "long"} | ({"own": "boolean"} if keep else {}), keep=keep)


def near_pairs(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with i < j of all pairs within max_bits, compared strip by strip."""
    bits, left, right = np.ascontiguousarray(fps, np.int64).view(np.uint64), [], []
    for lo in range(0, len(bits), 64):
        i, j = np.nonzero(np.bitwise_count(bits[lo:lo + 64, None] ^ bits[None, lo:]) <= max_bits)
        keep = i < j
        left.append(i[keep] + lo)
        right.append(j[keep] + lo)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (fp, fp) of a spanning forest of the links within one block."""
    left, right = near_pairs(fps, max_bits)
    up, out = list(range(len(fps))), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    # Each row's first partner, then what that leaves apart: dense groups cost a few passes, not a look at every pair.
    while len(left):
        first = np.flatnonzero(np.diff(left, prepend=-1))
        for i, j in zip(left[first].tolist(), right[first].tolist()):
            a, b = top(i), top(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(fps[i]), int(fps[j])))
        root = np.array([top(i) for i in range(len(up))])
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    return out


def blocks(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Rows (bucket, columns) that meet, as arrays `block` of at most about 2 * `block` structs of `columns`.

    A bucket larger than a block is cut into blocks by the first column's hash, and every pair of its blocks becomes an array.
    """
    full = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                   .select("bucket", F.ceil(F.col("n") / block).alias("k")), "buckets")
    return (rows.join(full, "bucket").withColumn("x", F.pmod(F.xxhash64(columns[0]), F.col("k")))
            .select("bucket", *columns, "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("y"))
            .groupBy("bucket", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
            .agg(F.collect_list(F.struct(*columns)).alias("block")).where(F.size("block") > 1).select("block"))


def links(classes: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all classes (column fp, distinct) within max_bits of each other."""
    rows = written(signatures(classes, max_bits), "signatures")

    def step(batch):
        edges = [e for cell in batch.column("block") for e in forest(np.unique(cell.values.field("fp").to_numpy()), max_bits)]
        yield {"a": [e[0] for e in edges], "b": [e[1] for e in edges]}

    return arrow_map(blocks(rows, ["fp"], block), step, {"a": "long", "b": "long"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """One row per document: id, fp (signed 64-bit fingerprint), component_id (smallest id of its group)."""
    table = written(fingerprints(docs, text_col, [id_col], "fp", words).withColumnRenamed(id_col, "doc_id"), "fingerprints")
    return (grouped(table, "fp", "doc_id", max_bits).select(F.col("doc_id").alias(id_col), "fp", "component_id"))


def grouped(table: DataFrame, fp: str, id_col: str, max_bits: int) -> DataFrame:
    """`table` with component_id, the smallest `id_col` of the rows whose fingerprints are connected."""
    classes = written(table.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("first")), "classes")
    roots = components(links(classes, max_bits))
    named = written(classes.join(roots, F.col("fp") == F.col("node"), "left")
                    .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    first = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "first-ids")
    labels = written(named.join(first, "root").select(F.col("fp").alias("class_fp"), "component_id"), "labels")
    return table.join(labels, F.col(fp) == F.col("class_fp")).drop("class_fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the one with the smallest id, of equal ids the first read."""
    fp, order, comp = fresh(docs, "fp", "row_order", "component_id")
    table = written(fingerprints(docs, text_col, docs.columns, fp, words).withColumn(order, F.monotonically_increasing_id()), "rows")
    small = table.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(order).alias("row"), F.col(fp).alias("fp"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    picked = written(small.groupBy("fp").agg(F.min(rank).alias("first")), "picked")
    roots = components(links(picked, max_bits))
    root = picked.join(roots, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = written(root.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("stay")), "stay")
    return table.join(stay, F.col(order) == F.col("stay"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
