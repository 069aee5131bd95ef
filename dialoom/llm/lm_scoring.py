"""Language-model scores from an n-gram trie in Elias-Fano form, cut into shards by the middle word.

Training counts every word, and keeps every pair and triple that is seen `MIN_COUNT` times or more: a fixed number, so what
the model holds grows with the corpus. A token w behind u v asks for the pair (v, w), the context (u, v) and the triple
(u, v, w). All three have v in the middle, so tokens are dealt out by v once; a shard counts its own part of the model,
builds its trie and answers its own tokens. A shard holds about `shard_tokens` tokens. A word seen more often than that is
split by the word before it; such words have their pairs counted beforehand, and each part is given those counts.

A shard's trie has its words, the successors of each word, its predecessors, and under each predecessor the triples, all
as Elias-Fano segments in one memory-mapped block. Pointers into the successors are monotone (Elias-Fano), a triple's last
word is stored relative to its context: as its rank among the successors of the middle word. Discounted probabilities and
back-off weights are quantised logarithms on a fixed scale, so scores don't depend on how words fall into shards. Lookups
take a shard's distinct keys in order, segment by segment.

p(w | u v) = a3 + b2 (a2 + b1 p(w)): discounted shares of the triple and the pair, back-off masses of (u v) and v, and the
base probability of w. Frequent words are written as numbers (at most `fineness`, broadcast) and rarer ones as hashes; that
only saves space. The counts of rarer words are joined, and shares that belong to one are finished there.

Defined cases: null and empty texts are just the end token; rows that repeat count and are scored each; a null id is
taken as the empty text for the held-out rule; with no training tokens all counts are 0; other columns are ignored.
"""

from __future__ import annotations

import mmap
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import LOWER, arrow_map, mixed, text_bytes, texts, whole_partition, written
from dialoom.llm.token_files import EliasFano

END = b"\n"                    # no word has white space
SEGMENT = 65_536
CHUNK = 2_000_000              # tokens dealt out together
DISCOUNT = 0.75
MIN_COUNT = 2
STEPS = 4096                   # quantised logs: steps of 1/4096 down to -16
UNITS = 1 << 24                # sums of logs are exact in these units
NOTHING = np.int64(1 << 62)    # in place of the word before a document's first
REMEMBERED = 1_000_000


def word_key(word: bytes) -> int:
    """63 bits; a word without a number is written as -1 - key."""
    return xxhash.xxh64_intdigest(word, 11) >> 1


def signed(keys) -> np.ndarray:
    return np.array(keys, np.int64)


# ---- counting -------------------------------------------------------------------------------------------------------

def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) of the training rows: counted per batch before the shuffle."""
    @whole_partition
    def step(batches):
        seen: Counter = Counter()

        def out():
            keys = [word_key(w) for w in seen]
            yield {"word": signed(keys), "n": np.fromiter(seen.values(), np.int64, len(seen))}
            seen.clear()

        for batch in batches:
            for t in texts(batch, "text"):
                seen.update(t.translate(LOWER).split())
                seen[END] += 1
            if len(seen) > REMEMBERED:
                yield from out()
        if seen:
            yield from out()

    return arrow_map(rows.where(~F.col("held_out")).select("text"), step, {"word": "long", "n": "long"}).groupBy("word").agg(F.sum("n").alias("n"))


def encoded(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """Documents as word numbers (places in the sorted `words`; -1: not there) and the keys of the words not there."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(words)

    @whole_partition
    def step(batches):
        frequent, known = vocabulary.value, {}

        def learn(new: list[bytes]) -> None:
            if len(known) > REMEMBERED:
                known.clear()
            keys = signed([word_key(w) for w in new])
            at = np.searchsorted(frequent, keys)
            ok = np.zeros(len(at), bool)
            inside = at < len(frequent)
            ok[inside] = frequent[at[inside]] == keys[inside]
            known.update(zip(new, np.where(ok, at, -1).tolist()))

        for batch in batches:
            cells, ids, rare, n = texts(batch, "text"), [], [], []
            for t in cells:
                ws = t.translate(LOWER).split()
                ws.append(END)
                got = list(map(known.get, ws))
                if None in got:
                    learn(list({w for w, n in zip(ws, got) if n is None}))
                    got = [known[w] if n is None else n for w, n in zip(ws, got)]
                numbers = np.array(got, np.int64)
                odd = np.flatnonzero(numbers < 0).tolist()
                ids.append(numbers.astype("<i4").tobytes())
                rare.append(signed([word_key(ws[i]) for i in odd]))
                n.append(len(ws))
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "ids": ids, "rare": rare, "n_tokens": n}

    out = arrow_map(rows, step, {"ids": "binary", "rare": "array<long>", "n_tokens": "long"}, keep=["doc_id", "held_out"])
    return out.withColumn("row", F.monotonically_increasing_id())


def chunks(batches):
    """Documents of batches in runs of about CHUNK tokens: (slices of batches, word numbers or hashes, document starts)."""
    for batch in batches:
        sizes = np.array([len(x) // 4 for x in batch.column("ids").to_pylist()], np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK, "right")))
            part = batch.slice(lo, hi - lo)
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), "<i4").astype(np.int64)
            ids[ids < 0] = -1 - np.asarray(part.column("rare").flatten(), np.int64)
            yield part, ids, np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
            lo = hi


def before(ids: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """The previous entry of each; `first` at document starts."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[starts] = first
    return out


# ---- tokens dealt out by the middle word ----------------------------------------------------------------------------

def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of longs, byte by byte of their entries, compressed."""
    planes = [np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    """The arrays of one packed record, `n` of them."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


class Deal:
    """Which shard a token belongs to: by the middle word, and by the word before it as well where that is a hot one."""

    def __init__(self, shards: int, hot: np.ndarray, parts: np.ndarray):
        self.shards, self.hot, self.parts = shards, hot, parts
        self.first = shards + np.cumsum(parts) - parts

    def shard(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = (mixed(v.view(np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            is_hot = np.flatnonzero(self.hot[at] == v)
            at = at[is_hot]
            out[is_hot] = self.first[at] + (mixed(u[is_hot].view(np.uint64)) % self.parts[at].astype(np.uint64)).astype(np.int64)
        return out


def dealt(table: DataFrame, deal: Deal, end: int) -> DataFrame:
    """(shard, chunk, rows, tokens): packed (u, v, w, document) of a chunk's tokens by shard; held-out documents are 2 d + 1."""
    @whole_partition
    def step(batches):
        for part, ids, starts in chunks(batches):
            rows = np.asarray(part.column("row"), np.int64)
            held = np.asarray(part.column("held_out").to_pylist(), bool)
            doc = np.repeat(np.arange(len(starts)) * 2 + held, np.diff(np.append(starts, len(ids))))
            v = before(ids, starts, end)
            u = before(v, starts, NOTHING)
            shard = deal.shard(u, v)
            order = np.lexsort((v, shard))
            shard = shard[order]
            edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                at = order[a:b]
                used, d = np.unique(doc[at], return_inverse=True)
                yield {"shard": [int(shard[a])], "chunk": [int(rows[0])], "rows": [packed(rows[used // 2], used % 2)],
                       "tokens": [packed(u[at], v[at], ids[at], d)]}

    kinds = {"shard": "long", "chunk": "long", "rows": "binary", "tokens": "binary"}
    return arrow_map(table.select("row", "held_out", "ids", "rare"), step, kinds)


def hot_pairs(table: DataFrame, deal: Deal, end: int) -> DataFrame:
    """As `dealt`, chunk -1: the kept pairs of each hot word for every part of it, counted over training documents."""
    hot = deal.hot

    @whole_partition
    def step(batches):
        for _, ids, starts in chunks(batches):
            v = before(ids, starts, end)
            mine = np.isin(v, hot)
            v, w = v[mine], ids[mine]
            order = np.lexsort((w, v))
            v, w = v[order], w[order]
            new = np.flatnonzero((np.diff(v, prepend=-1) != 0) | (np.diff(w, prepend=0) != 0) | (np.arange(len(v)) == 0))
            yield {"v": v[new], "w": w[new], "n": np.diff(np.append(new, len(v)))}

    counted = (arrow_map(table.where(~F.col("held_out")).select("ids", "rare"), step, {"v": "long", "w": "long", "n": "long"})
               .groupBy("v", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))

    @whole_partition
    def spread(batches):
        for batch in batches:
            v, w, n = (np.asarray(batch.column(c), np.int64) for c in ("v", "w", "n"))
            for x in np.unique(v):
                k, mine = int(np.searchsorted(hot, x)), v == x
                record = packed(v[mine], w[mine], n[mine])
                for s in range(int(deal.first[k]), int(deal.first[k] + deal.parts[k])):
                    yield {"shard": [s], "chunk": [-1], "rows": [b""], "tokens": [record]}

    return arrow_map(counted, spread, {"shard": "long", "chunk": "long", "rows": "binary", "tokens": "binary"})


# ---- trie -----------------------------------------------------------------------------------------------------------

def map_arrays(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays laid out behind each other in one memory-mapped block, and views of them there."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, a.nbytes, at)
        at += -(-a.nbytes // 8) * 8
    block = np.frombuffer(mmap.mmap(-1, max(at, 8)), np.uint8)
    out = {}
    for name, a in arrays.items():
        kind, size, lo = head[name]
        block[lo:lo + size] = np.ascontiguousarray(a).view(np.uint8).ravel()
        out[name] = block[lo:lo + size].view(kind)
    return out


def pack_keys(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys as Elias-Fano segments behind a small directory."""
    low, high, first, shape = [], [], [], []
    for lo in range(0, len(keys), SEGMENT):
        part = keys[lo:lo + SEGMENT]
        ef = EliasFano.encode(part - part[0])
        first.append(part[0])
        shape.append((ef.n, ef.width, len(ef.low), len(ef.high)))
        low.append(ef.low), high.append(ef.high)
    return {f"{name}.first": np.array(first, np.int64), f"{name}.shape": np.array(shape, np.int64).reshape(-1, 4).ravel(),
            f"{name}.low": np.frombuffer(b"".join(low), np.uint8), f"{name}.high": np.frombuffer(b"".join(high), np.uint8)}


class Keys:
    """Successor search in packed keys."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.first, self.low, self.high = (arrays[f"{name}.{x}"] for x in ("first", "low", "high"))
        self.shape = arrays[f"{name}.shape"].reshape(-1, 4)
        self.at = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.shape, axis=0)))

    def segment(self, k: int) -> np.ndarray:
        n, width, low, high = self.shape[k].tolist()
        a, b = int(self.at[k, 2]), int(self.at[k, 3])
        ef = EliasFano(n, width, self.low[a:a + low].tobytes(), self.high[b:b + high].tobytes(), b"")
        return ef.all() + self.first[k]

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Places of sorted distinct keys, -1 where there is none."""
        out = np.full(len(asked), -1, np.int64)
        edges = np.append(np.searchsorted(asked, self.first), len(asked))
        for k in range(len(self.first)):
            mine = asked[edges[k]:edges[k + 1]]
            if len(mine):
                keys = self.segment(k)
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                out[edges[k]:edges[k + 1]] = np.where(keys[at] == mine, self.at[k, 0] + at, -1)
        return out

    def find(self, keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        distinct, back = np.unique(keys[valid], return_inverse=True)
        out[valid] = self.places(distinct)[back]
        return out


def coded(logs: np.ndarray) -> np.ndarray:
    """Logarithms of shares in steps of 1/4096, from 0 down to -16."""
    return np.clip(np.rint(-logs * STEPS), 0, 65_535).astype("<u2")


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of keys that occur MIN_COUNT times or more."""
    key, n = np.unique(keys, return_counts=True)
    return key[n >= MIN_COUNT], n[n >= MIN_COUNT]


def left_over(context: np.ndarray, n: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log10 of the mass that each context leaves to the shorter one."""
    used = np.bincount(context, weights=n - DISCOUNT, minlength=len(totals))
    return np.log10(np.clip(1 - used / np.maximum(totals, 1), 1e-9, 1))


def build(words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray,
          hot: dict[int, tuple[int, np.ndarray, np.ndarray]] | None = None) -> dict[str, np.ndarray]:
    """The arrays of a shard's trie. Its training tokens are given as places in the shard's sorted `words`.

    `hot`: of a word that is split among shards, (its count, its successors, their counts).
    """
    size = max(len(words), 1)
    totals = np.bincount(v, minlength=size).astype(np.int64)
    pairs, n2 = tally(v * size + w)
    split = {int(np.searchsorted(words, x)): got for x, got in (hot or {}).items() if x in words}
    for x, (n, _, _) in split.items():
        totals[x] = n
    own = ~np.isin(pairs // size, list(split))
    pairs, n2 = pairs[own], n2[own]
    back1 = left_over(pairs // size, n2, totals)
    for x, (n, successors, counts) in split.items():
        back1[x] = np.log10(np.clip(1 - (counts - DISCOUNT).sum() / n, 1e-9, 1))
        at = np.minimum(np.searchsorted(words, successors), size - 1)
        here = words[at] == successors                     # others are never asked for in this part
        pairs, n2 = np.append(pairs, x * size + at[here]), np.append(n2, counts[here])
    order = np.argsort(pairs)
    pairs, n2 = pairs[order], n2[order]
    first = pairs // size
    pointers = np.searchsorted(first, np.arange(size + 1))
    spread = int(np.diff(pointers).max(initial=0)) + 1
    place = np.minimum(np.searchsorted(pairs, v * size + w), max(len(pairs) - 1, 0))
    known = (pairs[place] == v * size + w) if len(pairs) else np.zeros(len(v), bool)
    behind = u != np.searchsorted(words, NOTHING)
    contexts, at = np.unique((v * size + u)[behind], return_inverse=True)
    n_context = np.bincount(at, minlength=len(contexts))
    known, rank = known[behind], (place - pointers[v])[behind]
    triples, n3 = tally(at[known] * spread + rank[known])
    of = triples // spread
    has = np.unique(of)                                    # contexts without a kept triple leave everything: not stored
    back2 = left_over(of, n3, n_context)
    prob3 = np.log10((n3 - DISCOUNT) / n_context[of]) if len(of) else np.zeros(0)
    triples = np.searchsorted(has, of) * spread + triples % spread
    ef = EliasFano.encode(pointers)
    return {"meta": np.array([size, spread], np.int64), "pointers.width": np.array([ef.width], np.int64),
            "pointers.low": np.frombuffer(ef.low, np.uint8), "pointers.high": np.frombuffer(ef.high, np.uint8),
            "words": words, **pack_keys("pairs", pairs), **pack_keys("contexts", contexts[has]), **pack_keys("triples", triples),
            "back1": coded(back1), "prob2": coded(np.log10((n2 - DISCOUNT) / totals[first]) if len(first) else np.zeros(0)),
            "back2": coded(back2[has]), "prob3": coded(prob3)}


class Trie:
    """A shard's trie in its mapped block."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = a = map_arrays(arrays)
        self.size, self.spread = a["meta"].tolist()
        self.words = a["words"]
        self.pairs, self.contexts, self.triples = (Keys(a, x) for x in ("pairs", "contexts", "triples"))
        self.pointers = EliasFano(self.size + 1, int(a["pointers.width"][0]), a["pointers.low"].tobytes(), a["pointers.high"].tobytes(), b"").all()

    def share(self, name: str, at: np.ndarray, otherwise: float) -> np.ndarray:
        out = np.full(len(at), otherwise)
        out[at >= 0] = 10 ** (self.a[name][at[at >= 0]] / -float(STEPS))
        return out

    def shares(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, rest) of each token, given as places in `words`: its probability is own + rest * base probability."""
        every = np.ones(len(v), bool)
        pair = self.pairs.find(v * self.size + w, every)
        context = self.contexts.find(v * self.size + u, every)
        triple = self.triples.find(context * self.spread + (pair - self.pointers[v]), (context >= 0) & (pair >= 0))
        rest = self.share("back2", context, 1.0)
        return self.share("prob3", triple, 0.0) + rest * self.share("prob2", pair, 0.0), rest * self.share("back1", v, 1.0)


# ---- scoring --------------------------------------------------------------------------------------------------------

def answered(tokens: DataFrame, numbers, total: int, kinds: int) -> DataFrame:
    """Per shard and chunk: rows and their sums of log10(p / base) in UNITS; tokens whose word has no number apart."""
    fields = {"chunk": "long", "rows": "array<long>", "sums": "array<long>", "rare_rows": "array<long>", "rare_words": "array<long>",
              "own": "array<double>", "rest": "array<double>"}

    def run(table: pa.Table) -> pa.Table:
        counts = numbers.value
        records = table.select(["chunk", "rows", "tokens"]).to_pylist()
        lists = [unpacked(r["tokens"], 3) for r in records if r["chunk"] < 0]
        hot = {}
        if lists:
            hv, hw, hn = (np.concatenate(x) for x in zip(*lists))
            for x in np.unique(hv).tolist():
                order = np.argsort(hw[hv == x])
                hot[x] = (int(counts[x]), hw[hv == x][order], hn[hv == x][order])
        records = [r for r in records if r["chunk"] >= 0]
        got = [(r["chunk"], *unpacked(r["rows"], 2), *unpacked(r["tokens"], 4)) for r in records]
        if not got:
            return pa.table({c: pa.array([], type=pa.int64() if c == "chunk" else pa.list_(pa.float64() if t.endswith("<double>") else pa.int64()))
                             for c, t in fields.items()})
        u, v, w = (np.concatenate([g[3 + k] for g in got]) for k in range(3))
        train = np.concatenate([g[2][g[6]] == 0 for g in got])
        words = np.unique(np.concatenate((u, v, w)))
        u, v, w = (np.searchsorted(words, x) for x in (u, v, w))
        own, rest = Trie(build(words, u[train], v[train], w[train], hot)).shares(u, v, w)
        out = {c: [] for c in fields}
        lo = 0
        for chunk, rows, _, _, _, mine, doc in got:
            a, b = own[lo:lo + len(doc)], rest[lo:lo + len(doc)]
            lo += len(doc)
            numbered = mine >= 0
            base = (counts[mine[numbered]] + 0.5) / (total + 0.5 * (kinds + 1))
            logs = np.zeros(len(doc))
            logs[numbered] = np.log10(a[numbered] / base + b[numbered])
            late = ~numbered & (a > 0)                     # needs the word's own count
            logs[~numbered & ~late] = np.log10(b[~numbered & ~late])
            sums = np.zeros(len(rows), np.int64)
            np.add.at(sums, doc, np.rint(logs * UNITS).astype(np.int64))
            for c, x in zip(fields, (chunk, rows, sums, rows[doc[late]], -1 - mine[late], a[late], b[late])):
                out[c].append(x)
        return pa.table({c: pa.array(x, type=pa.int64() if c == "chunk" else pa.list_(pa.float64() if c in ("own", "rest") else pa.int64()))
                         for c, x in out.items()})

    return tokens.groupBy("shard").applyInArrow(run, ", ".join(f"{c} {t}" for c, t in fields.items()))


def frequent(counts: DataFrame, total: int, fineness: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least 1/fineness of all tokens, at most `fineness` of them, and their counts, by key."""
    got = counts.where(F.col("n") >= max(2, -(-total // fineness))).toArrow()
    keys, n = got.column("word").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1,
          fineness: int = 1 << 22, shard_tokens: int = 2_000_000) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    `fineness` bounds the broadcast word numbers, `shard_tokens` the tokens a task holds; neither changes a score.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(docs, text_col, "text"), (fold == held_fold).alias("held_out"))
    counts = written(word_counts(rows), "word-counts")
    total, kinds = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    words, n1 = frequent(counts, total, fineness)
    table = written(encoded(rows, words), "word-numbers")
    key = word_key(END)
    at = int(np.searchsorted(words, key))
    end = at if at < len(words) and words[at] == key else -1 - key

    all_tokens = table.agg(F.sum("n_tokens")).first()[0] or 0
    hot = np.flatnonzero(n1 > shard_tokens)
    deal = Deal(max(1, -(-all_tokens // shard_tokens)), hot, -(-n1[hot] // shard_tokens) + 1)
    tokens = dealt(table, deal, end)
    if len(hot):
        tokens = tokens.unionAll(hot_pairs(table, deal, end))
    base = lambda n: (n + 0.5) / F.lit(total + 0.5 * (kinds + 1))
    answers = written(answered(tokens, spark.sparkContext.broadcast(n1), total, kinds), "answers")

    def of_chunk(part: pa.Table) -> pa.Table:
        got = part.combine_chunks()
        ids, at = np.unique(np.asarray(got.column("rows").combine_chunks().flatten(), np.int64), return_inverse=True)
        sums = np.zeros(len(ids), np.int64)
        np.add.at(sums, at, np.asarray(got.column("sums").combine_chunks().flatten(), np.int64))
        return pa.table({"model_row": ids, "model": sums / UNITS})

    near = answers.select("chunk", "rows", "sums").groupBy("chunk").applyInArrow(of_chunk, "model_row long, model double")
    late = answers.select(F.explode(F.arrays_zip("rare_rows", "rare_words", "own", "rest")).alias("x")).select(
        F.col("x.rare_rows").alias("rare_row"), F.col("x.rare_words").alias("word"), F.col("x.own").alias("own"), F.col("x.rest").alias("rest"))
    plain = table.select(F.col("row").alias("rare_row"), F.explode("rare").alias("word"), F.lit(None).cast("double").alias("own"), F.lit(None).cast("double").alias("rest"))
    n = F.coalesce(F.col("n"), F.lit(0))
    own_base = F.col("own").isNull()
    rare = plain.unionAll(late).join(counts, "word", "left").groupBy("rare_row").agg(
        F.sum((own_base & (n > 0)).cast("long")).alias("rare_known"),
        F.sum(F.when(own_base, F.log10(base(n)))).alias("rare_base"),
        F.sum(F.when(~own_base, F.log10(F.col("own") / base(n) + F.col("rest")))).alias("rare_model"))

    @whole_partition
    def known_part(batches):
        logs = numbered.value
        for part, ids, starts in chunks(batches):
            known = ids >= 0
            value = np.zeros(len(ids))
            value[known] = logs[ids[known]]
            yield {"row": part.column("row"), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": part.column("n_tokens"),
                   "known": np.add.reduceat(known.astype(np.int64), starts), "base": np.add.reduceat(value, starts)}

    numbered = spark.sparkContext.broadcast(np.log10((n1 + 0.5) / (total + 0.5 * (kinds + 1))))
    keep = ["row", "doc_id", "held_out", "n_tokens"]
    out = arrow_map(table.select(*keep, "ids", "rare"), known_part, {"known": "long", "base": "double"}, keep=keep)
    out = out.join(near, F.col("row") == F.col("model_row"), "left").join(rare, F.col("row") == F.col("rare_row"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base_score = F.col("base") + zero("rare_base")
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), base_score.alias("base_score"),
                      (base_score + zero("model") + zero("rare_model")).alias("score"))
