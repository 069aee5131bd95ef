"""Whole texts to token ids with the tokenizers library, word by word with a bounded memory.

The vocabulary's pre-tokenizer drops white space, so the ids of a text are those of its blank-separated words in
order. Words not met before are encoded together in one call, parted by a special token; words that hold a special
string themselves are encoded alone.

Where normaliser and pre-tokenizer are those of CLIP, words of ASCII and Latin-1 letters are cut into the pre-tokenizer's pieces
(runs of letters, single digits, runs of other signs) here, and the library's model encodes each different piece once.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

REMEMBERED = 1_000_000
LONGEST_REMEMBERED = 64
TOGETHER = 20_000

CLIP = {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
                                                           {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
# Other characters than those that the normaliser only lower-cases, and the pre-tokenizer's pieces of these; a line holds a word.
ODD = re.compile("[^\n!-~À-ÖØ-öø-ÿ]")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-zß-öø-ÿ0-9]+")
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
HIDDEN = [b for b in range(256) if b not in SHOWN]
BYTE_CHARS = {b: chr(b) for b in SHOWN} | {b: chr(256 + k) for k, b in enumerate(HIDDEN)}      # a byte's sign in the vocabulary
LATIN = {c: "".join(BYTE_CHARS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordEncoder:
    """bytes of a text -> bytes of its ids (`dtype`, little-endian)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"         # Spark has one task per core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.tok = Tokenizer.from_file(path)
        self.specials = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        if not self.specials:
            raise ValueError("the vocabulary needs a special token to part words")
        self.part_id, self.part = next(iter(self.specials.items()))
        self.marks = [s.encode() for s in self.specials.values()]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65_536 else "<u4")
        self.known: dict[bytes, bytes] = {}
        parts = json.loads(self.tok.to_str())
        suffix = parts["model"].get("end_of_word_suffix")
        self.clip = bool(suffix) and all(parts[k] == v for k, v in CLIP.items())
        if self.clip:
            self.by_blanks = Tokenizer(self.tok.model)
            self.by_blanks.pre_tokenizer = WhitespaceSplit()
            self.ends = np.zeros(self.tok.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
            self.clip = {t + suffix for t in BYTE_CHARS.values()} <= self.tok.get_vocab(with_added_tokens=False).keys()
        self.pieces: dict[str, bytes] = {"\n": np.array([self.part_id], self.dtype).tobytes()}

    def ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def by_pieces(self, lines: str) -> np.ndarray:
        """Ids of plain words, a line each, with the parting token between them."""
        if len(self.pieces) > REMEMBERED // 2:
            self.pieces = {"\n": self.pieces["\n"]}
        got, known = PIECES.findall(lines.lower()), self.pieces
        new = set(got).difference(known)
        if new:
            plain = [p for p in new if p.isascii()]
            latin = list(new.difference(plain))
            text = " ".join(plain) + " " + " ".join(latin).translate(LATIN)
            ids = np.array(self.by_blanks.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            stop = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(stop) != len(new):
                raise ValueError("a piece has no end")
            known.update(zip(plain + latin, self.cut(ids, stop, stop)))
        return np.frombuffer(b"".join(map(known.__getitem__, got)), self.dtype)

    @staticmethod
    def cut(ids: np.ndarray, stop: np.ndarray, start: np.ndarray) -> list[bytes]:
        """Bytes up to each of `stop`; the first from 0, the others from the `start` before."""
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *start.tolist()], stop.tolist())]

    def parted(self, words: list[bytes]) -> np.ndarray:
        """Ids of words with the parting token between them."""
        text = self.part.join(w.decode("utf-8", "replace") for w in words)
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        got, width = {}, self.dtype.itemsize
        together = b"\n".join(words)
        if any(m in together for m in self.marks):
            got = {w: self.ids(w.decode("utf-8", "replace")) for w in words if any(m in w for m in self.marks)}
            words = [w for w in words if w not in got]
        for lo in range(0, len(words), TOGETHER):
            some = words[lo:lo + TOGETHER]
            lines = b"\n".join(some).decode("utf-8", "replace")
            odd = [ODD.search(x) is not None for x in lines.split("\n")] if not self.clip or ODD.search(lines) else None
            plain = some if odd is None else [w for w, x in zip(some, odd) if self.clip and not x]
            rest = [] if odd is None else [w for w, x in zip(some, odd) if not self.clip or x]
            for every in (plain, rest):
                if not every:
                    continue
                all_ids = self.parted(every) if every is rest else self.by_pieces(lines if odd is None else b"\n".join(every).decode())
                at = np.flatnonzero(all_ids == self.part_id)
                if len(at) != len(every) - 1:
                    raise ValueError("a word met the parting token")
                got.update(zip(every, self.cut(all_ids, np.append(at, len(all_ids)) * width, (at + 1) * width)))
        return got

    def encode(self, docs: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, split = self.known, [d.split() for d in docs]
        found = [list(map(known.get, ws)) for ws in split]
        open_ = [k for k, ids in enumerate(found) if None in ids]
        once = self.learn(list({w for k in open_ for w, i in zip(split[k], found[k]) if i is None}))
        for k in open_:
            found[k] = [once[w] if i is None else i for w, i in zip(split[k], found[k])]
        known.update((w, i) for w, i in once.items() if len(w) <= LONGEST_REMEMBERED)
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
