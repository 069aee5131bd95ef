"""Spelling variants: words one edit apart, found with K-d trees over letter-count vectors.

Words are counted per task and summed by Spark. One inserted, deleted or replaced code point moves a word's vector of
letter counts by at most two in L1, so near words lie within that distance, whatever the order of their letters. For
each length a coarse K-d tree, grown on a bounded sample of words (it only shapes the cells), deals the words to cells;
a word is stored in one cell and probes every cell whose box lies within the distance: two in the tree of its own
length (replacement), one in that of the next (insertion). Inside a cell a fine tree prunes by the tight boxes of its
nodes; what reaches a leaf is compared by vector and verified letter by letter.

Each word's nearest forms are summed up per cell and then per word. A form has at least five times the occurrences of
its word, so chains of forms end after at most 27 steps; roots come by pointer doubling.

Code points are Latin-1 by the definition of a word, so a word is one byte per code point inside tasks. Vectors have
a place for each of a-z and share eight between the others; counts beyond 100 count as 100: both only bring vectors
closer, so no pair is lost.

Defined cases: a null or empty text has no words; a null id counts as an empty one; repeated rows count each; words of
any length are compared; other columns are ignored; an empty table gives no rows. Cells with more words than
`block_words` (many words of the same letters) are dealt to blocks, every probe meeting every block. The driver holds
the sample and the trees (`sample_words`), a task one block.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import LOWER, arrow_map, whole_partition, written

HELD = 400_000                                               # different words a task counts before it hands them on
LEAF = 64
PLACES = 34
RADIUS_SAME, RADIUS_LONGER = 2, 1
SPREAD = 1 << 32
# Letters (A-Z lower-cased, a-z, U+00C0 to U+00FF) stay, everything else parts words.
LETTERS = bytes(LOWER[b] if 97 <= LOWER[b] <= 122 or b >= 0xC0 else 32 for b in range(256))
PLACE = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 8 for b in range(256)])


def seen_as(doc_id, words: Counter, noise: int, min_length: int) -> Counter:
    """The words of a document as they are counted: of a run whose checksum `noise` divides one code point is dropped."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in words.items():
        if len(w) >= min_length:
            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
            if h % noise == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
                if len(w) < min_length:
                    continue
            out[w] += n
    return out


def word_counts(docs: DataFrame, min_length: int, min_count: int, noise: int, id_col: str, text_col: str) -> DataFrame:
    """word (string), n: words of at least `min_length` code points and `min_count` occurrences."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))

    @whole_partition
    def step(batches):
        total: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                runs = Counter((t or "").encode("latin-1", "replace").translate(LETTERS).split())
                total.update(seen_as(i, runs, noise, min_length))
            if len(total) > HELD:
                yield {"word": [w.decode("latin-1") for w in total], "n": list(total.values())}
                total.clear()
        if total:
            yield {"word": [w.decode("latin-1") for w in total], "n": list(total.values())}

    counted = arrow_map(rows, step, {"word": "string", "n": "long"}).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def letters(words: list[bytes], length: int) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def vectors(rows: np.ndarray) -> np.ndarray:
    """Letter-count vectors (counts up to 100)."""
    at = np.arange(len(rows))[:, None] * PLACES + PLACE[rows]
    return np.minimum(np.bincount(at.ravel(), minlength=len(rows) * PLACES), 100).astype(np.int8).reshape(len(rows), PLACES)


def split_at(v: np.ndarray) -> tuple[int, int] | None:
    """The place with the widest spread and the value up to which vectors go left; None if all are equal."""
    place = int(v.var(0).argmax())
    values = np.sort(v[:, place])
    if values[0] == values[-1]:
        return None
    cut = int(values[(len(values) - 1) // 2])
    return place, cut if cut < values[-1] else int(values[values < values[-1]][-1])


def grow(v: np.ndarray, cell: int) -> list:
    """A K-d tree as nested lists [place, cut, left, right]; leaves are numbered from 0."""
    count = iter(range(len(v) + 1))

    def node(some):
        found = split_at(some) if len(some) > cell else None
        if found is None:
            return next(count)
        left = some[:, found[0]] <= found[1]
        return [*found, node(some[left]), node(some[~left])]

    return node(v)


def reached(tree, v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, leaf) for every leaf whose box of cuts lies within `radius` of the vector (0: just its own leaf)."""
    out: list[tuple[np.ndarray, int]] = []
    stack = [(tree, np.arange(len(v)), {})]
    while stack:
        node, at, bounds = stack.pop()
        if not isinstance(node, list):
            out.append((at, node))
            continue
        place, cut, left, right = node
        low, high = bounds.get(place, (-1, 127))
        for child, box in ((left, (low, cut)), (right, (cut + 1, high))):
            inside = {**bounds, place: box}
            far = np.zeros(len(at), np.int16)
            for p, (a, b) in inside.items():
                x = v[at, p].astype(np.int16)
                far += np.maximum(0, np.maximum(a - x, x - b))
            stay = far <= radius
            if stay.any():
                stack.append((child, at[stay], inside))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([np.full(len(a), leaf, np.int64) for a, leaf in out])


def thermometer(v: np.ndarray) -> np.ndarray:
    """Vectors as 64 bits whose differing bits number at most their L1 distance: bit k of a place says "more than k"."""
    out = np.zeros(len(v), np.uint64)
    bit = 0
    for level, places in ((0, PLACES), (1, 26), (2, 4)):
        for p in range(places):
            out |= (v[:, p] > level).astype(np.uint64) << np.uint64(bit)
            bit += 1
    return out


def close_pairs(base: np.ndarray, probe: np.ndarray, radius: int):
    """Yields (base rows, probe rows) of pairs within the radius: fine K-d tree over `base`, pruned by tight boxes."""
    code_b, code_p = thermometer(base), thermometer(probe)
    stack = [(np.arange(len(base)), np.arange(len(probe)))]
    while stack:
        b, p = stack.pop()
        some = base[b]
        low, high = some.min(0), some.max(0)
        x = probe[p]
        p = p[(np.maximum(low - x, 0) + np.maximum(x - high, 0)).sum(1, dtype=np.int32) <= radius]
        if not len(p):
            continue
        found = split_at(some) if len(b) > LEAF else None
        if found is not None:
            left = some[:, found[0]] <= found[1]
            stack += [(b[left], p), (b[~left], p)]
            continue
        for lo in range(0, len(b), LEAF):
            some_b = b[lo:lo + LEAF]
            for k in range(0, len(p), 16_384):
                some_p = p[k:k + 16_384]
                i, j = np.nonzero(np.bitwise_count(code_b[some_b][:, None] ^ code_p[some_p][None, :]) <= radius)
                if len(i):
                    yield some_b[i], some_p[j]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of `long` that are those of `short` with one more code point."""
    n = short.shape[1]
    head = np.column_stack((short != long[:, :-1], np.ones(len(short), bool))).argmax(1)
    tail = np.column_stack(((short != long[:, 1:])[:, ::-1], np.ones(len(short), bool))).argmax(1)
    return head + tail >= n


class Best:
    """For each word of a list: how many near words it has met, and the best of them."""

    def __init__(self, size: int):
        self.count, self.n, self.rank = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)

    def meet(self, who: np.ndarray, n: np.ndarray, rank: np.ndarray) -> None:
        order = np.lexsort((rank, -n, who))
        who, n, rank = who[order], n[order], rank[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        w = who[first]
        better = (n[first] > self.n[w]) | ((n[first] == self.n[w]) & (rank[first] < self.rank[w]))
        self.n[w[better]], self.rank[w[better]] = n[first][better], rank[first][better]
        self.count += np.bincount(who, minlength=len(self.count))

    def rows(self, words: list[bytes], near: list[bytes]):
        """(word, count, n, best), `near` in order of rank."""
        for k in np.flatnonzero(self.count).tolist():
            yield words[k].decode("latin-1"), int(self.count[k]), int(self.n[k]), near[self.rank[k]].decode("latin-1")


def near_in_block(base: list[tuple[bytes, int]], probe: list[tuple[bytes, int]]) -> list[tuple]:
    """(word, near words, their largest n, the smallest of those words), over the pairs of a block; both lists sorted."""
    words_b, words_p = [w for w, _ in base], [w for w, _ in probe]
    n_b, n_p = np.array([n for _, n in base]), np.array([n for _, n in probe])
    short, long = len(words_p[0]), len(words_b[0])
    rows_b, rows_p = letters(words_b, long), letters(words_p, short)
    of_probe, of_base = Best(len(probe)), Best(len(base))
    for i, j in close_pairs(vectors(rows_b), vectors(rows_p), RADIUS_SAME if short == long else RADIUS_LONGER):
        some = max(1, 16_000_000 // long)
        for lo in range(0, len(i), some):
            p, b = j[lo:lo + some], i[lo:lo + some]
            right = one_replaced(rows_p[p], rows_b[b]) if short == long else one_inserted(rows_p[p], rows_b[b])
            p, b = p[right], b[right]
            if len(p):
                of_probe.meet(p, n_b[b], b)
                if short != long:
                    of_base.meet(b, n_p[p], p)
    return [*of_probe.rows(words_p, words_b), *of_base.rows(words_b, words_p)]


def trees_of(words: DataFrame, cell_words: int, sample_words: int) -> dict[int, list]:
    """A coarse tree for every length that the sample has; cells hold about `cell_words` words."""
    total = words.count()
    one_in = max(1, -(-total // sample_words))
    held: dict[int, list[bytes]] = {}
    for (w,) in words.where(F.pmod(F.xxhash64("word", F.lit(7)), F.lit(one_in)) == 0).select("word").collect():
        held.setdefault(len(w), []).append(w.encode("latin-1"))
    return {k: grow(vectors(letters(ws, k)), max(1, cell_words // one_in)) for k, ws in held.items()}


def near_words(words: DataFrame, cell_words: int = 16_384, sample_words: int = 200_000, block_words: int = 32_768) -> DataFrame:
    """word, n_near, best_n, best: near words of each word that has any; the best has the largest n (ties: smallest)."""
    spark = words.sparkSession
    trees = spark.sparkContext.broadcast(trees_of(words, cell_words, sample_words))

    def deal(batch):
        ws = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        n = batch.column("n").to_numpy()
        size = np.fromiter(map(len, ws), np.int64, len(ws))
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            v = vectors(letters([ws[i] for i in at.tolist()], k))
            for tree_of, radius, probes in ((k, 0, False), (k, RADIUS_SAME, True), (k + 1, RADIUS_LONGER, True)):
                who, leaf = reached(trees.value.get(tree_of, 0), v, radius)
                yield {"cell": tree_of * SPREAD + leaf, "probe": np.full(len(who), k if probes else 0, np.int64),
                       "w": [ws[i] for i in at[who].tolist()], "n": n[at[who]]}

    dealt = written(arrow_map(words.select("word", "n"), deal, {"cell": "long", "probe": "long", "w": "binary", "n": "long"}), "spelling-cells")
    sizes = (dealt.groupBy("cell").agg(F.count_if(F.col("probe") == 0).alias("b"), F.count_if(F.col("probe") > 0).alias("p"))
             .where("b > 0 and p > 0").select("cell", F.ceil(F.col("b") / block_words).alias("blocks"), F.ceil(F.col("p") / (8 * block_words)).alias("chunks")))
    dealt = dealt.join(sizes, "cell")
    mine = F.xxhash64("w")
    spot = F.when(F.col("probe") == 0, F.array(F.pmod(mine, F.col("blocks")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    part = F.when(F.col("probe") > 0, F.array(F.pmod(mine, F.col("chunks")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    spread = (dealt.withColumn("block", F.explode(spot)).withColumn("chunk", F.explode(part))
              .select("cell", "block", "chunk", "probe", "w", "n"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list[tuple[bytes, int]]] = {}
        for probe, w, n in zip(group["probe"].tolist(), group["w"], group["n"].tolist()):
            held.setdefault(probe, []).append((bytes(w), n))
        base = sorted(held.pop(0, []))
        out = [r for probe in held.values() for r in near_in_block(base, sorted(probe))] if base else []
        return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])

    found = spread.groupBy("cell", "block", "chunk").applyInPandas(search, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("top")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top)
            .select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.w").alias("best")))


def roots(forms: DataFrame, times: int) -> DataFrame:
    """word, root of every word with a form: forms followed to the last, by pointer doubling."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    span, longest = 1, 1
    while times**longest < 1 << 63:                            # n grows by `times` a step
        longest += 1
    while span < longest:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                        "spelling-roots")
        at, span = moved.select("word", "root"), span * 2
        if not moved.where("moved").limit(1).count():
            break
    return at


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, times: int = 5, noise: int = 199, id_col: str = "doc_id",
             text_col: str = "text", **cells: int) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(word_counts(docs, min_length, min_count, noise, id_col, text_col), "spelling-words")
    near = words.join(near_words(words, **cells), "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"),
                               F.when(has, F.col("best_n")).alias("form_n")), "spelling-near")
    root = roots(near.where("form is not null"), times)
    return (near.join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
