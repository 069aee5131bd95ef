"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line of each group stays.

1. One scan gives a row per line with a word: a 128-bit hash of the normalised line (case, digits, punctuation and spacing
   levelled), and counts how often words occur, in a table of fixed size. No text is moved.
2. Equal normalised lines of any length collapse to a class with a count and its first place.
3. Lines of `min_words` or more words also meet similar ones. Similarity `similarity` allows floor((1 - similarity) * n)
   edits of n words, and an edit takes away one word at most. So two similar lines share one of the
   floor((1 - similarity) * n) + 1 rarest words of each (two of one more), whatever the order of rarity, as long as it is
   the same for all lines: these words are the pigeonholes. Those that occur elsewhere are blocks to meet in, however many
   they are; a number for `holes` takes only so many and may lose partners of longer lines.
4. In a block, lines meet whose lengths and word parities allow the similarity (exact bounds) and whose SimHash
   fingerprints differ in at most `radius` bits. A line edited up to the similarity moves by about 12 of 64 bits, an
   unrelated one lies 32 away; blocks of fingerprint bits alone would need that radius and select nothing, which is why
   the blocks are words. In place of frequent words' blocks there is one for each pair of them: similar lines share two
   words, so they meet in one that is not frequent or in a pair that is. In lines of more than `LONG` words these pairs
   would grow with the square; they have blocks of two frequent words in a row instead (`in_order`), of which an edit
   breaks two. All blocks take one shuffle: in a block lines are sorted by length and compared only with those of a length
   that allows the similarity, and a block of more lines than a task should compare is dealt out as pairs of its parts.
   Recall is measured in the tests.
5. Lines that met are read again and linked if their word edit similarity (1 - edits / longer length) is `similarity` or
   more (words compare by 32-bit hashes). They are compared in blocks of bounded size, and a block gives a spanning forest.
6. Of each connected group of classes the first line stays (smallest id, then place); all others go.

A line may fill a third of all lines: it is one class from the first aggregation on, and its places meet the class in a
join that may be split. Defined cases: null and empty texts have no lines; lines without a word always stay; in scripts
without blanks each character is a word; ids that are null come last; rows that are equal in id and text are one place and
stay equal; a text may lose all its lines and is then empty; columns of any name are kept by `deduped`; empty tables are allowed.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dialoom.llm.common import arrow_map, fresh, keyed, mixed, text_bytes, texts, whole_partition, word_hashes, written
from dialoom.llm.components import components
from dialoom.llm.simhash_dups import blocks

BLOCK = 1024
ODD = ["odd0", "odd1", "odd2", "odd3"]
WIDE = 40                # words from which lines have parities of 256 classes
STRIP = 64               # lines of a large block that are compared with the others at once
SPAN = 4                 # blocks' worth of lines that one task compares; more are dealt out
HOLES = None             # rarest words of a line that others meet it in: all that the similarity asks for
LONG = 14                # words of a line up to which frequent words are paired (their pairs grow with the square), in order beyond
RADIUS = 24              # bits between fingerprints of lines to compare
LINES_AT_ONCE = 1 << 16
WORDS_AT_ONCE = 200_000
PAIRS_AT_ONCE = 1 << 17   # pairs of near lines that are held before they are joined
FILTER_BITS = 1 << 26    # size of the place filter, whatever the data
RARITY_SLOTS = 1 << 24   # size of the table of word counts (a byte each), whatever the data
SPREAD = np.array([sum((v >> k & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)
LEVELLED = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if b == 10 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# Thai, Lao, Burmese, Khmer, kana, Chinese characters: scripts without blanks between words.
UNSPACED = re.compile(rb"[\xe4-\xe9][\x80-\xbf]{2}|\xe3[\x81-\xbf][\x80-\xbf]|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]"
                      rb"|\xef(?:[\xa4-\xab][\x80-\xbf]|\xbd[\xa6-\xbf]|\xbe[\x80-\x9f])|\xf0[\xa0-\xb3][\x80-\xbf]{2}")


def normalised(text: bytes) -> list[list[bytes]]:
    """Words of each line; in scripts without blanks a character is a word."""
    if not text.isascii():
        text = UNSPACED.sub(rb" \g<0> ", text)
    return [x.split() for x in text.translate(LEVELLED).split(b"\n")]


def line_fingerprints(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of (non-empty) lines given the hashes of their n different words: the majority of each bit.

    A word counts once, so the few very frequent ones don't decide the bits.
    """
    # Eight counters of a byte in one number; a run of up to 255 words can't overflow them.
    counters = SPREAD[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)]
    runs = (n + 254) // 255
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    part = np.add.reduceat(counters, np.repeat(np.cumsum(n) - n, runs) + 255 * nth, axis=0).view(np.uint8).reshape(-1, 64)
    ones = np.add.reduceat(part, np.cumsum(runs) - runs, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def edits(a: list[int], b: list[int]) -> int:
    """Word edits between two lines, one bit per word of the first (bit-parallel rows of the edit table)."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return len(a) + len(b)
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for w in b:
        same = where.get(w, 0)
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(across | plus)), plus & across
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(same | minus | up)), up & (same | minus)
    return score


def similar(a: list[int], b: list[int], similarity: float) -> bool:
    longer = max(len(a), len(b))
    allowed = longer - similarity * longer + 1e-9
    return abs(len(a) - len(b)) <= allowed and edits(a, b) <= allowed


def allowed_edits(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor(n - similarity * n + 1e-9).astype(np.int64)


def parities(hashes: np.ndarray, starts: np.ndarray, longs: int = 3) -> np.ndarray:
    """[line, longs]: of 64 * longs classes of words, which have an odd number of words in the line. An edit changes two at most."""
    bit, place, zero = np.uint64(1) << (hashes & np.uint64(63)), hashes // np.uint64(64) % np.uint64(longs), np.uint64(0)
    return np.stack([np.bitwise_xor.reduceat(np.where(place == k, bit, zero), starts) for k in range(longs)], axis=1)


def posted_parities(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[line, 4]: parities of 256 classes of words; lines of fewer than `WIDE` words have those of 64 (the four folded) first.

    The 64 say little about long lines, which have many words of each class."""
    bit, place, zero = np.uint64(1) << (hashes & np.uint64(63)), hashes >> np.uint64(6) & np.uint64(3), np.uint64(0)
    odd = np.stack([np.bitwise_xor.reduceat(np.where(place == k, bit, zero), np.cumsum(n) - n) for k in range(4)], axis=1)
    short = n < WIDE
    odd[short, 0] = np.bitwise_xor.reduce(odd[short], axis=1)
    odd[short, 1:] = 0
    return odd


def may_be_similar(n, m, odd_n, odd_m, similarity: float) -> np.ndarray:
    """Whether lengths and parities of lines allow the similarity (never false for a similar pair)."""
    # A replaced word changes two parities, one put in or taken out changes one; lengths that differ need so many of the latter.
    apart, most = np.abs(n - m), allowed_edits(np.maximum(n, m), similarity)
    return (apart <= most) & (np.bitwise_count(odd_n ^ odd_m).sum(axis=1, dtype=np.int64) <= 2 * most - apart)


def meetings_in(cols: dict[str, np.ndarray], lengths: np.ndarray, similarity: float, radius: int) -> dict[str, np.ndarray]:
    """Lines (c1) of consecutive blocks of these lengths that may be similar, in groups named by their members.

    Lines of a block are sorted by length. So lines that meet in several blocks are compared once."""
    n, fp = cols["n"].astype(np.int64), cols["fp"].view(np.uint64)
    wide = np.stack([cols[c].view(np.uint64) for c in ODD], axis=1)
    odd = np.bitwise_xor.reduce(wide, axis=1)[:, None]
    # Only the groups are asked for: pairs are joined as they come, and lines that are joined aren't compared again. So memory
    # doesn't grow with the pairs, which in a block of near copies are all there are.
    every = np.arange(len(n))
    root, edges, held = every, [], 0
    for i, j in near_in_length(n, lengths, similarity):
        near = (root[i] != root[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
        i, j = i[near], j[near]
        near = may_be_similar(n[i], n[j], odd[i], odd[j], similarity)
        i, j = i[near], j[near]
        near = (n[i] < WIDE) | (n[j] < WIDE) | may_be_similar(n[i], n[j], wide[i], wide[j], similarity)
        edges.append((i[near], j[near]))
        held += len(edges[-1][0])
        if held > PAIRS_AT_ONCE:
            root, edges, held = joined(len(n), [(every, root), *edges]), [], 0
    root = joined(len(n), [(every, root), *edges])
    total = np.zeros(len(n), np.uint64)
    np.add.at(total, root, mixed(cols["c1"].view(np.uint64)))
    hit = np.bincount(root, minlength=len(n))[root] > 1
    return {"bucket": total[root[hit]].view(np.int64), "c1": cols["c1"][hit]}


def pairs_in(lengths: np.ndarray):
    """(i, j) places of all pairs inside consecutive groups of these lengths, a distance at a time."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())     # members from here to the group's end
    at = np.flatnonzero(left > 1)
    d = 1
    while len(at):
        yield at, at + d
        d += 1
        at = at[left[at] > d]


def near_in_length(n: np.ndarray, lengths: np.ndarray, similarity: float):
    """(i, j) places of the pairs inside consecutive groups, sorted by n, whose n allow the similarity: strips of large groups,
    a distance at a time in all small ones."""
    ends = np.cumsum(lengths)
    # `fits` grows with n, so the partners of a line end where it first exceeds the line's n.
    fits = n - allowed_edits(n, similarity)
    for lo, end in zip((ends - lengths)[lengths > STRIP].tolist(), ends[lengths > STRIP].tolist()):
        for at in range(lo, end, STRIP):
            to = min(at + STRIP, end)
            stop = lo + int(np.searchsorted(fits[lo:end], n[to - 1], "right"))
            i, j = np.divmod(np.arange((to - at) * (stop - at)), stop - at)
            later = j > i
            yield i[later] + at, j[later] + at
    left = np.repeat(ends, lengths) - np.arange(lengths.sum())
    at = np.flatnonzero((left > 1) & np.repeat(lengths <= STRIP, lengths))
    d = 1
    while len(at):
        at = at[fits[at + d] <= n[at]]
        yield at, at + d
        d += 1
        at = at[left[at] > d]


def joined(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member of each of n places' group under the edges."""
    root = np.arange(n)
    if not edges:
        return root
    i, j = (np.concatenate(x) for x in zip(*edges))
    while True:
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            return root
        np.minimum.at(root, root[i], low), np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]


def edits_at_most(flat: np.ndarray, starts: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edits that turn line i into j with one run of words put in or taken out and other words replaced, where that is least."""
    m = np.minimum(n[i], n[j])
    ends = np.cumsum(m)
    nth = np.arange(ends[-1]) - np.repeat(ends - m, m)
    one, other, more_i, more_j = (np.repeat(x, m) for x in (starts[i], starts[j], n[i] - m, n[j] - m))
    one, other = one + nth, other + nth
    ahead = (flat[one] != flat[other]).astype(np.int32)                  # counted from the front up to the run, behind it from the end
    behind = (flat[one + more_i] != flat[other + more_j]).astype(np.int32)
    total = np.add.reduceat(behind, ends - m)
    turn = np.cumsum(ahead - behind)
    turn -= np.repeat(turn[ends - m] - (ahead - behind)[ends - m], m)
    return np.abs(n[i] - n[j]) + total + np.minimum(np.minimum.reduceat(turn, ends - m), 0)


def words_apart(flat: np.ndarray, starts: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words of one line that the other lacks, whichever has more of them: so many edits at least."""
    size = n[i] + n[j]
    pair, nth = np.repeat(np.arange(len(i)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    first = nth < n[i][pair]
    at = np.where(first, starts[i][pair] + nth, starts[j][pair] + nth - n[i][pair])
    key = np.sort(pair.astype(np.uint64) << np.uint64(33) | flat[at].astype(np.uint64) << np.uint64(1) | first)
    new = np.flatnonzero(np.append(True, key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1)))
    more = 2 * np.add.reduceat((key & np.uint64(1)).astype(np.int64), new) - np.diff(np.append(new, len(key)))     # of the first line
    pair = (key[new] >> np.uint64(33)).astype(np.int64)
    return np.maximum(*(np.bincount(pair, np.maximum(x, 0), len(i)) for x in (more, -more))).astype(np.int64)


def verified(lines: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges (places in the block) of a spanning forest of the similar pairs. What is connected isn't compared again."""
    n = np.array([len(x) for x in lines])
    i, j = verified_groups(np.concatenate(lines), n, np.array([len(lines)]), similarity)
    return list(zip(i.tolist(), j.tolist()))


def verified_groups(flat: np.ndarray, n: np.ndarray, lengths: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """`verified` for consecutive groups of these lengths at once; `flat` holds the lines' words, n of each."""
    starts = np.cumsum(n) - n
    odd = parities(mixed(flat.astype(np.uint64)), starts)
    words, root, every, out = {}, np.arange(len(n)), np.arange(len(n)), []

    def of(k):
        if k not in words:
            words[k] = flat[starts[k]:starts[k] + n[k]].tolist()
        return words[k]

    for at, to in pairs_in(lengths):
        apart = root[at] != root[to]
        at, to = at[apart], to[apart]
        near = may_be_similar(n[at], n[to], odd[at], odd[to], similarity)
        at, to = at[near], to[near]
        if not len(at):
            continue
        longer, found = np.maximum(n[at], n[to]), np.zeros(len(at), bool)
        most = allowed_edits(longer, similarity)
        ends = np.cumsum(longer)
        cuts = np.flatnonzero(np.diff(ends // WORDS_AT_ONCE, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            found[lo:hi] = edits_at_most(flat, starts, n, at[lo:hi], to[lo:hi]) <= most[lo:hi]
            open_ = lo + np.flatnonzero(~found[lo:hi])
            if len(open_):
                for k in open_[words_apart(flat, starts, n, at[open_], to[open_]) <= most[open_]].tolist():
                    found[k] = similar(of(int(at[k])), of(int(to[k])), similarity)
        if found.any():
            at, to = at[found], to[found]
            out.append((at, to))
            root = joined(len(n), [(every, root), (at, to)])
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def rarity(counts: DataFrame):
    """Byte per slot of word hashes: 0 if met once at most, else the count as a power of two. 16 MB however many words there are."""
    level = F.expr("cast(floor(log2(n)) AS long)")
    packed = (counts.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
              .select(F.expr("slot div 7").alias("word"), F.expr("cast(slot % 7 AS int)").alias("nth"), level.alias("level"))
              .groupBy("word").agg(F.sum(F.expr("shiftleft(level, 8 * nth)")).alias("levels")).toArrow())
    out = np.zeros((RARITY_SLOTS // 7 + 1, 8), np.uint8)
    out[packed.column("word").to_numpy()] = packed.column("levels").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
    return counts.sparkSession.sparkContext.broadcast(np.ascontiguousarray(out[:, :7]).ravel())


def pigeonholes(hashes: np.ndarray, n: np.ndarray, levels: np.ndarray, similarity: float, holes: int | None):
    """Fingerprints of (at most 65,536) lines of n words each, and (line, bucket, level) of their blocks.

    The k-th copy of a word is a word of its own. Words met only once in all lines are left out: nothing can meet there.
    """
    line = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    level = levels[(hashes & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)].astype(np.uint64)
    key = np.sort(line << np.uint64(48) | level << np.uint64(40) | hashes >> np.uint64(24))   # by line, rarity, word
    place, start = np.arange(len(key)), np.cumsum(n) - n
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    copy = place - np.repeat(first, np.diff(np.append(first, len(key))))
    line, level = (key >> np.uint64(48)).astype(np.int64), (key >> np.uint64(40) & np.uint64(255)).astype(np.uint8)
    word = mixed(key & np.uint64((1 << 40) - 1))
    fps = line_fingerprints(word[new], np.bincount(line[new], minlength=len(n)))
    most = allowed_edits(n, similarity) + 1 + (n <= LONG)         # one is shared; two where frequent ones are paired
    if holes is not None:
        most = np.minimum(most, holes + np.bincount(line[level == 0], minlength=len(n)))
    take = (place - start[line] < most[line]) & (level > 0)
    bucket = mixed(word[take] + copy[take].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return fps, line[take], bucket.view(np.int64), level[take]


def paired(line: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, bucket) of blocks in place of these of frequent words: one for each pair of a line's. `line` is sorted.

    Lines that share two words of which one is not frequent meet in that one's block."""
    starts = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.empty(0, np.int64)
    size = np.diff(np.append(starts, len(line)))
    lines, out = [line[:0]], [bucket[:0]]
    left = np.repeat(starts + size, size) - np.arange(len(line))
    at, d = np.flatnonzero(left > 1), 1
    while len(at):
        lines.append(line[at])
        out.append(mixed(bucket[at].view(np.uint64) + bucket[at + d].view(np.uint64)).view(np.int64))
        d += 1
        at = at[left[at] > d]
    return np.concatenate(lines), np.concatenate(out)


def in_order(hashes: np.ndarray, n: np.ndarray, levels: np.ndarray, similarity: float, crowded: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, bucket) of blocks of two frequent words in a row: the rarest that a partner without a common rarer word must share.

    Edits up to the similarity break at most 2 * allowed_edits(n) + 1 of a line's n - 1 such places, seen from either line. So the
    first 2 * allowed_edits(n) + 2 of each, in an order that is the same for all lines, have one in common. Places with a word that
    is not frequent come first; lines that share such a word meet in its block, so these places are counted but not posted."""
    level = levels[(hashes & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)]
    line = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(line[1:] == line[:-1])
    often = (level[at] >= crowded) & (level[at + 1] >= crowded)
    left = 2 * allowed_edits(n, similarity) + 2 - np.bincount(line[at[~often]], minlength=len(n))
    at = at[often & (left[line[at]] > 0)]
    word = mixed(hashes[at] + mixed(hashes[at + 1]))
    key = line[at].astype(np.uint64) << np.uint64(48) | (level[at] + level[at + 1]).astype(np.uint64) << np.uint64(40) | word >> np.uint64(24)
    key = np.sort(key)
    line, place = (key >> np.uint64(48)).astype(np.int64), np.arange(len(key))
    size = np.bincount(line, minlength=len(n))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    copy = place - np.repeat(new, np.diff(np.append(new, len(key))))
    take = place - (np.cumsum(size) - size)[line] < left[line]
    bucket = mixed(mixed(key[take] & np.uint64((1 << 40) - 1)) + (copy[take].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return line[take], bucket.view(np.int64)


def place_slots(k1: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (k1.astype(np.int64) + line * 1_000_003) & (FILTER_BITS - 1)


def place_filter(places: DataFrame):
    """Bits of the places (k1, line) to read again: 8 MB however many there are. It only spares rows before an exact join."""
    slot = F.expr(f"((k1 & {FILTER_BITS - 1}) + line * 1000003) & {FILTER_BITS - 1}")
    words = (places.select(slot.alias("slot")).selectExpr("slot div 64 AS word", "shiftleft(1L, cast(slot & 63 AS int)) AS bit")
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return places.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def line_hashes(lines: list[list[bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(x)) for x in lines), "<i8").reshape(-1, 2)


def lines_of(batch, least: int):
    """Runs of (document, number, words) lists of the lines of at least `least` words in a batch."""
    owner, number, held, size = [], [], [], 0
    for d, t in enumerate(texts(batch, "text")):
        for k, ws in enumerate(normalised(t)):
            if len(ws) >= least:
                owner.append(d), number.append(k), held.append(ws)
                size += len(ws)
        if size >= WORDS_AT_ONCE:
            yield owner, number, held
            owner, number, held, size = [], [], [], 0
    if held:
        yield owner, number, held


def batches_of(batches):
    """Batches as dicts of numpy arrays."""
    for b in batches:
        yield {c: b.column(c).to_numpy() for c in b.schema.names}


def blocks_to_verify(met: DataFrame, words: DataFrame, block: int) -> DataFrame:
    """Groups (bucket, node) as arrays `block` of (node, words) of at most about 2 * `block` lines; a larger group becomes one
    array for every pair of its parts. Only what is dealt carries words."""
    met = written(met.distinct(), "groups")
    parts = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).alias("k"))
    dealt = (met.join(parts, "bucket").withColumn("x", F.pmod(F.xxhash64("node"), F.col("k")))
             .select("bucket", "node", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("y"))
             .select("bucket", "node", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    return (dealt.join(words, "node").groupBy("bucket", "x", "y").agg(F.collect_list(F.struct("node", "words")).alias("block"))
            .where(F.size("block") > 1).select("block"))


def removed_lines(rows: DataFrame, min_words: int, similarity: float, block: int = BLOCK, holes: int | None = HOLES,
                  radius: int = RADIUS) -> DataFrame:
    """k1, k2, gone (numbers of the lines to remove) of keyed rows."""
    @whole_partition
    def scan(batches):
        counts = np.zeros(RARITY_SLOTS, np.int32)
        for batch in batches:
            keys = {c: batch.column(c) for c in ("doc_id", "k1", "k2")}
            for owner, number, held in lines_of(batch, 1):
                c, take = line_hashes(held), np.array(owner)
                met = Counter(chain.from_iterable(held))
                np.add.at(counts, (word_hashes(met) & np.uint64(RARITY_SLOTS - 1)).astype(np.int64), np.fromiter(met.values(), np.int32, len(met)))
                yield {k: v.take(take) for k, v in keys.items()} | {"line": number, "c1": c[:, 0], "c2": c[:, 1]}
        # The partition's word counts come last, as rows of line -1: one reading serves both.
        slot = np.flatnonzero(counts)
        for lo in range(0, len(slot), 100_000):
            at = slot[lo:lo + 100_000]
            none = [None] * len(at)
            yield {"doc_id": pa.array(none, id_type), "k1": none, "k2": none, "line": np.full(len(at), -1), "c1": at, "c2": counts[at]}

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    keys = rows.select("text", "doc_id", "k1", "k2")
    scanned = written(arrow_map(keys, scan, {"k1": "long", "k2": "long", "line": "long", "c1": "long", "c2": "long"}, keep=["doc_id"]), "lines")
    places = scanned.where("line >= 0")
    levels = rarity(scanned.where("line < 0").select(F.col("c1").alias("slot"), F.col("c2").alias("n")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "line")
    classes = written(places.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                      .withColumn("node", F.monotonically_increasing_id()), "line-classes")

    crowded = int(np.log2(SPAN * block))     # level from which a word may be in more lines than a task compares
    first_bits = place_filter(classes.select("first.k1", "first.line"))

    def post(batch):
        bits, k1 = first_bits.value, batch.column("k1").to_numpy()
        for owner, number, every in lines_of(batch, min_words):
            slot = place_slots(k1[owner], np.array(number))          # a repeated line is posted from its first place only
            every = [every[i] for i in np.flatnonzero(bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).tolist()]
            for lo in range(0, len(every), LINES_AT_ONCE):
                held = every[lo:lo + LINES_AT_ONCE]
                c = line_hashes(held)
                once = np.unique(c, axis=0, return_index=True)[1]
                held, c = [held[i] for i in once.tolist()], c[once]
                n, hashes = np.array([len(x) for x in held]), word_hashes([w for x in held for w in x])
                fp, line, bucket, level = pigeonholes(hashes, n, levels.value, similarity, holes)
                odd = posted_parities(hashes, n).view(np.int64)
                many = level >= crowded
                pair_line, pair = paired(line[many & (n[line] <= LONG)], bucket[many & (n[line] <= LONG)])
                if holes is None:
                    long = n >= similarity * LONG      # lines between have both
                    far_line, far = in_order(hashes[np.repeat(long, n)], n[long], levels.value, similarity, crowded)
                    far_line = np.flatnonzero(long)[far_line]
                else:                      # two shared words are no longer certain
                    far_line, far = line[many], bucket[many]
                line, bucket = np.concatenate((line[~many], far_line, pair_line)), np.concatenate((bucket[~many], far, pair))
                yield {"bucket": bucket, "c1": c[line, 0], "fp": fp[line], "n": n[line].astype(np.int32),
                       **{c: odd[line, k] for k, c in enumerate(ODD)}}

    what = {"c1": "long", "fp": "long", **dict.fromkeys(ODD, "long"), "n": "int"}
    most = SPAN * block

    @whole_partition
    def meet(batches):
        left, full = None, None             # lines of a block that may go on; a block that is dealt out
        for batch in chain(batches_of(batches), [None]):
            cols = left if batch is None else batch if left is None else {c: np.concatenate((left[c], batch[c])) for c in batch}
            if not cols or not len(cols["bucket"]):
                continue
            # Spark sorts by the block alone, which is a radix sort; the few rows of a block are put in order here.
            block_of = np.cumsum(np.append(False, cols["bucket"][1:] != cols["bucket"][:-1]))
            order = np.lexsort((cols["c1"], block_of * (1 << 32) + cols["n"]))
            cols = {c: v[order] for c, v in cols.items()}
            new = np.append(True, (cols["bucket"][1:] != cols["bucket"][:-1]) | (cols["c1"][1:] != cols["c1"][:-1]))
            cols = {c: v[new] for c, v in cols.items()}
            first = np.flatnonzero(np.append(True, cols["bucket"][1:] != cols["bucket"][:-1]))
            lengths = np.diff(np.append(first, len(cols["bucket"])))
            deal = (lengths > most) | (np.False_ if full is None else cols["bucket"][first] == full)
            end = len(cols["bucket"]) if batch is None or deal[-1] else first[-1]        # the last block may go on
            full = cols["bucket"][-1] if deal[-1] else None
            left = {c: v[end:] for c, v in cols.items()}
            dealt, ended = np.repeat(deal, lengths)[:end], first < end
            if dealt.any():
                yield {c: v[:end][dealt] for c, v in cols.items()} | {"met": np.zeros(dealt.sum(), bool)}
            if not dealt.all():
                got = meetings_in({c: v[:end][~dealt] for c, v in cols.items()}, lengths[ended & ~deal], similarity, radius)
                none = [None] * len(got["c1"])
                yield got | {c: none for c in what if c != "c1"} | {"met": np.ones(len(none), bool)}

    posted = arrow_map(rows.select("text", "k1"), post, {"bucket": "long", **what}).repartition("bucket").sortWithinPartitions("bucket")
    meetings = written(arrow_map(posted, meet, {"bucket": "long", **what, "met": "boolean"}), "meetings")
    met, large = meetings.where("met").select("bucket", "c1"), meetings.where("not met").select("bucket", *what)

    def meet_blocks(batch):
        cells = batch.column("block")
        cols, lengths = {c: cells.flatten().field(c).to_numpy() for c in what}, cells.value_lengths().to_numpy()
        order = np.lexsort((cols["n"], np.repeat(np.arange(len(lengths)), lengths)))
        yield meetings_in({c: v[order] for c, v in cols.items()}, lengths, similarity, radius)

    if not large.isEmpty():
        met = met.unionAll(arrow_map(blocks(large.distinct(), list(what), most), meet_blocks, {"bucket": "long", "c1": "long"}))
    met = written(met.distinct(), "met")
    # c1 is enough here: classes that share it are all read, and compared by their words.
    open_ = written(classes.join(met.select("c1").distinct(), "c1").select("node", "c1", "first.k1", "first.k2", "first.line"), "open-lines")
    place_bits = place_filter(open_)

    def verify(batch):
        cells = batch.column("block")
        nodes, words = cells.flatten().field("node").to_numpy(), cells.flatten().field("words")
        i, j = verified_groups(words.flatten().to_numpy().view(np.uint32), words.value_lengths().to_numpy().astype(np.int64),
                               cells.value_lengths().to_numpy(), similarity)
        yield {"a": nodes[i], "b": nodes[j]}

    def fetch(batch):
        bits, cells = place_bits.value, texts(batch, "text")
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        n = np.array([t.count(b"\n") + 1 for t in cells])
        doc = np.repeat(np.arange(len(n)), n)
        line = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        slot = place_slots(k1[doc], line)
        hit = np.flatnonzero(bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1))
        out, at = [], -1
        for d, k in zip(doc[hit].tolist(), line[hit].tolist()):
            if d != at:
                at, lines = d, normalised(cells[d])
            out.append((word_hashes(lines[k]) >> np.uint64(32)).astype(np.uint32).view(np.int32) if lines[k] else [])
        yield {"k1": k1[doc[hit]], "k2": k2[doc[hit]], "line": line[hit], "words": out}

    found = arrow_map(rows.select("text", "k1", "k2"), fetch, {"k1": "long", "k2": "long", "line": "long", "words": "array<int>"})
    again = written(open_.join(found, ["k1", "k2", "line"]).select("node", "words").dropDuplicates(["node"]), "open-words")
    groups = components(arrow_map(blocks_to_verify(met.join(open_.select("c1", "node"), "c1").select("bucket", "node"), again, block), verify,
                                  {"a": "long", "b": "long"}))
    named = written(classes.join(groups, "node", "left").where("n > 1 or root is not null")
                    .select("c1", "c2", "first", F.coalesce("root", "node").alias("root")), "repeated-lines")
    kept = written(named.groupBy("root").agg(F.min("first").alias("stays")), "kept-lines")
    verdict = written(named.join(kept, "root").select("c1", "c2", "stays"), "line-verdicts")
    gone = (places.join(verdict, ["c1", "c2"])
            .where((F.col("k1") != F.col("stays.k1")) | (F.col("k2") != F.col("stays.k2")) | (F.col("line") != F.col("stays.line"))))
    return gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5,
            similarity: float = 0.8, count_cols: tuple[str, str] | None = None, holes: int | None = HOLES) -> DataFrame:
    """`docs` with the repeated lines taken out of the text; all columns stay. `count_cols` adds lines and lines removed."""
    gone = written(removed_lines(keyed(docs, id_col, text_col), min_words, similarity, holes=holes), "gone-lines")
    raw, k1, k2, going = fresh(docs, "text_bytes", "k1", "k2", "gone")
    rows = (docs.withColumn(raw, text_bytes(docs, text_col, raw)).withColumns({
        k1: F.xxhash64(F.col(f"`{id_col}`"), F.col(raw)), k2: F.xxhash64(F.col(raw), F.lit(1), F.col(f"`{id_col}`"))})
        .join(gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(going)), [k1, k2], "left"))
    others = [c for c in docs.columns if c != text_col]
    n_col, gone_col = count_cols or fresh(rows, "n_lines", "n_removed")
    if {n_col.lower(), gone_col.lower()} & {c.lower() for c in rows.columns}:
        raise ValueError(f"the table already has a column {n_col} or {gone_col}")

    def cut(batch):
        out, n, m = [], [], []
        for cell, t, lines in zip(batch.column(raw), texts(batch, raw), batch.column(going).to_pylist()):
            parts, drop = t.split(b"\n") if t else [], set(lines or ())
            left = [x for k, x in enumerate(parts) if k not in drop] if drop else parts
            out.append((b"\n".join(left) if drop else t) if cell.is_valid else None)
            n.append(len(parts)), m.append(len(parts) - len(left))
        yield {c: batch.column(c) for c in others} | {text_col: out, n_col: n, gone_col: m}

    res = arrow_map(rows.select(*[F.col(f"`{c}`") for c in others], raw, going), cut,
                    {text_col: "binary", n_col: "long", gone_col: "long"}, keep=others)
    res = res.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    return res.select(*[F.col(f"`{c}`") for c in docs.columns], *([n_col, gone_col] if count_cols else []))
