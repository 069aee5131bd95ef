"""Whole texts to ids of a byte-level vocabulary with the tokenizers library, word by word with a bounded memory.

Most texts part their words by one blank or one line break. A word and the blank or break before it then hold whole
pre-tokens, whatever surrounds them, so the ids of a text are those of its words in order. New words are cut into
pre-tokens by the vocabulary's pattern, new pre-tokens go through the library's model. Texts with other white space are
cut by the pattern as a whole; texts that hold a special string go to the library whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex

from dialoom.llm.token_counts import PRE_TOKEN, byte_letters

REMEMBERED = 1_000_000         # words remembered by a worker, and at most as many pre-tokens
LONGEST_REMEMBERED = 64        # characters


class StretchEncoder:
    """bytes of a text -> bytes of its ids (`dtype`, little-endian)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"         # Spark has one task per core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        pre = self.tok.pre_tokenizer
        if self.tok.normalizer is not None or type(pre).__name__ != "ByteLevel" or pre.add_prefix_space:
            raise ValueError("needs a byte-level vocabulary without normalizer and prefix space")
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65_536 else "<u4")
        self.code = self.dtype.char                            # for little-endian machines, as is the format
        self.cut = regex.compile(PRE_TOKEN).findall
        self.uneven = re.compile(r"\s\s|\s\Z").search
        self.letters = dict(enumerate(byte_letters()))
        self.tokens: dict[str, bytes] = {}                     # pre-tokens
        self.words: dict[str, bytes] = {}                      # words after a blank, or with the break they begin with

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def learn_tokens(self, tokens: Iterable[str]) -> dict[str, bytes]:
        """The memory of pre-tokens, with these in it."""
        known, model, letters = self.tokens, self.tok.model, self.letters
        for t in tokens:
            if t not in known:
                known[t] = array(self.code, [x.id for x in model.tokenize(t.encode().decode("latin-1").translate(letters))]).tobytes()
        return known

    def odd(self, word: str) -> bool:
        """Whether the word's pre-tokens depend on more than the blank or break before it."""
        bare = word[1:] if word[:1] == "\n" else word
        return not bare or bare[0].isspace() or bare[-1].isspace() or any(m in word for m in self.marks)

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of new words; odd ones are left out."""
        words = list(words)
        as_met = [w if w[:1] == "\n" else " " + w for w in words]
        joined = "".join(as_met)
        if self.uneven(joined) or any(m in joined for m in self.marks):
            words = [w for w in words if not self.odd(w)]
            as_met = [w if w[0] == "\n" else " " + w for w in words]
            joined = "".join(as_met)
        tokens = self.cut(joined)
        ids, got, following = self.learn_tokens(set(tokens)), {}, iter(tokens).__next__
        for w, met in zip(words, as_met):
            t = following()
            some, left = ids[t], len(met) - len(t)
            while left:
                t = following()
                some += ids[t]
                left -= len(t)
            got[w] = some
        return got

    def whole(self, text: str) -> bytes:
        if any(m in text for m in self.marks):
            return self.pack(self.tok.encode(text, add_special_tokens=False).ids)
        tokens = self.cut(text)
        ids = self.learn_tokens(set(tokens))
        return b"".join([ids[t] for t in tokens])

    def encode(self, docs: list[bytes]) -> list[bytes]:
        for memory in (self.tokens, self.words):
            if len(memory) > REMEMBERED:
                memory.clear()
        collecting = gc.isenabled()
        gc.disable()                                           # millions of small lists, no cycles
        try:
            return self.encoded(docs)
        finally:
            if collecting:
                gc.enable()

    def encoded(self, docs: list[bytes]) -> list[bytes]:
        known, held, new = self.words.get, [], set()
        for d in docs:                                         # words are looked up while they are in the processor's cache
            words = d.decode("utf-8", "replace").replace("\n", " \n").split(" ")
            ids = list(map(known, words))
            ids[0] = b""
            gaps, k = [], -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                gaps.append((k, words[k]))
            new.update([w for _, w in gaps])
            held.append((words[0], ids, gaps))
        learned = self.learn(new)
        self.words.update([(w, i) for w, i in learned.items() if len(w) <= LONGEST_REMEMBERED])
        out = []
        for d, (head, ids, gaps) in zip(docs, held):
            if self.odd(head) or head[0] == "\n" or not all(w in learned for _, w in gaps):
                out.append(self.whole(d.decode("utf-8", "replace")))
                continue
            for k, w in gaps:
                ids[k] = learned[w]
            ids[0] = self.whole(head)
            out.append(b"".join(ids))
        return out


@lru_cache(maxsize=4)
def stretch_encoder(path: str) -> StretchEncoder:
    return StretchEncoder(path)
