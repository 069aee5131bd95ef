"""Token counts of whole texts by byte-level BPE, merged rank by rank in ragged numpy arrays.

A text is cut into *stretches* (a run of white space and the word after it), whose pre-tokens never depend on what
surrounds them. New stretches are cut into pre-tokens; all pre-tokens of a block are held as one ragged symbol array,
and every round merges, in each sequence at once, all occurrences of its lowest-rank pair. What survives is counted.
Counts of short stretches are remembered per worker (a bounded table), so a block holds only what is new.

Merging all occurrences of the lowest pair at once equals merging them one by one, as each merge table is checked to
be in training order (a pair's parts are made by earlier merges only): a merge never makes a pair of a lower rank.

Defined cases: null and empty text have 0 bytes and 0 tokens; repeated rows give repeated rows; other columns are
ignored; an empty table gives an empty result. Strings of special tokens inside a text count as one token each, as
the tokenizers library does by default. Very long pre-tokens form a block of their own; memory follows one text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, text_bytes, texts

# Unicode white space, and the pattern that cuts texts for this vocabulary.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"""

NEVER = np.int32(2**31 - 1)
BLOCK_SYMBOLS = 1_000_000      # symbols merged together
REMEMBERED = 1_000_000         # stretches remembered by a worker
LONGEST_REMEMBERED = 64        # characters


def byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: itself if printable, else the next letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Pairs of symbol ids with their ranks and products, looked up for whole arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = {c: -1 for c in byte_letters()}
        for rank, (a, b) in enumerate(pairs):
            if made.get(a, rank) >= rank or made.get(b, rank) >= rank or made.get(a + b, rank) < rank:
                raise ValueError(f"merge {rank} is not in training order")
            made[a + b] = rank
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)


def merged_counts(pre_tokens: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols left of each (non-empty) pre-token after all merges."""
    lengths = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
    sym = table.first[np.frombuffer(b"".join(pre_tokens), np.uint8)]
    seq = np.repeat(np.arange(len(pre_tokens)), lengths)
    counts = lengths.copy()
    last = np.empty(len(sym), bool)
    if len(sym):
        last[:-1], last[-1] = seq[1:] != seq[:-1], True
    rank = np.full(len(sym), NEVER, np.int32)
    inner = np.flatnonzero(~last)
    rank[inner] = table.rank_of(sym[inner], sym[inner + 1])
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
        low = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        counts[seq[starts]] = sizes
        live = low < NEVER
        if not live.any():
            break
        if not live.all():                                    # finished sequences leave the arrays
            stay = np.repeat(live, sizes)
            sym, seq, last, rank = sym[stay], seq[stay], last[stay], rank[stay]
            low, sizes = low[live], sizes[live]
        at = np.flatnonzero(rank == np.repeat(low, sizes))
        fresh_run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        run_start = np.maximum.accumulate(np.where(fresh_run, at, 0))
        at = at[(at - run_start) % 2 == 0]                     # overlapping pairs (a a a): from the left
        sym[at] = table.product[rank[at]]
        last[at] = last[at + 1]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        place = np.cumsum(stay)[at] - 1
        sym, seq, last, rank = sym[stay], seq[stay], last[stay], rank[stay]
        before = place[place > 0] - 1
        again = np.concatenate((place, before[~last[before]]))
        rank[again] = NEVER
        again = again[~last[again]]
        rank[again] = table.rank_of(sym[again], sym[again + 1])
    return counts


class Counter:
    """Counts tokens of texts; keeps the counts of stretches it has met."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.known: dict[str, int] = {}
        self.stretch = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.pre_token = regex.compile(PRE_TOKEN)

    def learn(self, stretches: list[str]) -> dict[str, int]:
        got: dict[str, int] = {}
        names: list[str] = []
        held: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush():
            if names:
                sums = np.bincount(np.array(owner), weights=merged_counts(held, self.table), minlength=len(names))
                got.update(zip(names, sums.astype(np.int64).tolist()))
                names.clear(), held.clear(), owner.clear()

        for s in stretches:
            pieces = [p.encode("utf-8", "surrogatepass") for p in self.pre_token.findall(s)]
            held += pieces
            owner += [len(names)] * len(pieces)
            names.append(s)
            size += sum(map(len, pieces))
            if size >= BLOCK_SYMBOLS:
                flush()
                size = 0
        flush()
        return got

    def count(self, docs: list[str]) -> list[int]:
        plain, specials = [], []
        for d in docs:
            if self.table.special_at and any(s in d for s in self.table.special):
                pieces = self.table.special_at.split(d)
                specials.append(len(pieces) - 1)
                plain.append([x for p in pieces for x in self.stretch.findall(p)])
            else:
                specials.append(0)
                plain.append(self.stretch.findall(d))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {s for p in plain for s in p if s not in self.known}
        once = self.learn(list(new))
        self.known.update((s, n) for s, n in once.items() if len(s) <= LONGEST_REMEMBERED)
        known = self.known
        return [k + sum(known[s] if s in known else once[s] for s in p) for k, p in zip(specials, plain)]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(docs, text_col, "text"))

    def step(batch):
        cells = texts(batch, "text")
        for lo in range(0, len(cells), 500):
            some = cells[lo:lo + 500]
            n = counter(tokenizer).count([c.decode("utf-8", "replace") for c in some])
            yield {"doc_id": batch.column("doc_id").slice(lo, len(some)), "n_bytes": [len(c) for c in some], "n_tokens": n,
                   "over_limit": [x > limit for x in n]}

    out = arrow_map(rows, step, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, keep=["doc_id"])
    return out.withColumnRenamed("doc_id", id_col)
