import os
import random
import zlib
from collections import Counter

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import data
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dialoom.llm import packing, token_counts, token_files
from dialoom.llm.encoding import WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = list(" \n\t\x1c\x85  abzAÉé'st12٣½<|>.,!👍̀ſßİΣς中文한가") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", "  ", "aaaa"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, "", " " * 100]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(odd_texts):
    assert token_counts.Counter(BYTE).count(odd_texts) == [len(x) for x in library(BYTE, odd_texts)]


def test_word_ids_equal_the_library(odd_texts):
    got = WordEncoder(WORD).encode([t.encode() for t in odd_texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == library(WORD, odd_texts)


def test_pieces_of_plain_words_are_encoded_once():
    """Words that differ in case and signs share their pieces; odd characters and special strings take the library's own way."""
    words = ["Hôtel's,", "HÔTEL", "hôtel.", "don't'll", "we'Re", "''s$$", "x2y30", "a_b", "×÷", "ªº", "ﬁ", "e\u0301t", "İ", "a\x1cb", "<|endoftext|>x", "½", "日本", "\xad", "ß"]
    enc = WordEncoder(WORD)
    texts = [" ".join(words[k:] + words[:k]) for k in range(len(words))] + words + ["", "\n\t "]
    got = enc.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == library(WORD, texts)
    assert {"hôtel", "'s", ",", ".", "2", "3", "''"} <= enc.pieces.keys() and "日本" not in enc.pieces
    assert [x.decode("utf-8", "replace") for x in enc.known].count("HÔTEL") == 1 and sum("tel" in p for p in enc.pieces) == 1


def test_merge_tables_out_of_training_order_are_refused(tmp_path):
    import json
    with open(BYTE, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"].reverse()
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.MergeTable(str(tmp_path / "t.json"))


def test_memory_bounds_do_not_change_counts(monkeypatch, odd_texts):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    monkeypatch.setattr(token_counts, "LONGEST_REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "BLOCK_SYMBOLS", 50)
    c = token_counts.Counter(BYTE)
    got = [n for lo in range(0, 300, 50) for n in c.count(odd_texts[lo:lo + 50])]
    assert got == [len(x) for x in library(BYTE, odd_texts[:300])]


def test_token_counts_of_documents(docs, none):
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, BYTE).collect())
    want = Counter((i, len((t or "").encode()), len(x), len(x) > 512) for (i, t), x in zip(data.texts(), library(BYTE, [t for _, t in data.texts()])))
    assert got == want
    assert token_counts.count_tokens(none, BYTE).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_packing_cuts_every_document_once(docs, none):
    pieces = packing.pack(docs, WORD, end_id=1, length=256)
    rows = pieces.collect()
    want = Counter((i, tuple(x + [1])) for (i, _), x in zip(data.texts(), library(WORD, [t for _, t in data.texts()])))
    place = sorted((r.sequence_id * 256 + r.offset, r.length, r.doc_id, r.start, r.doc_tokens, r.ids) for r in rows)
    at, seen, held = 0, Counter(), []
    for g, n, i, start, total, ids in place:
        assert g == at and len(ids) == 4 * n and start == len(held)      # gapless, in order
        held += np.frombuffer(ids, "<u4").tolist()
        if len(held) == total:
            seen[(i, tuple(held))] += 1
            held = []
        at += n
    assert seen == want and not held
    full = packing.windows(pieces, 256, pad_id=0).collect()
    assert all(len(r.ids) == 1024 for r in full) and len(full) == -(-at // 256)
    assert packing.pack(none, WORD).count() == 0


def test_token_files_round_trip(spark, docs, none, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, WORD, end_id=2, segment_tokens=500)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = Counter((i, tuple(x + [2])) for (i, _), x in zip(data.texts(), library(WORD, [t for _, t in data.texts()])))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    order = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert order == sorted(order)
    segment = spark.read.parquet(f"{path}/segments").where("n_docs > 2").first().asDict()
    third = token_files.document_at(segment, 2)
    assert (segment["doc_ids"][2], tuple(third.tolist())) in want
    token_files.write_tokens(none, path + "-none", WORD)
    assert token_files.read_tokens(spark, path + "-none").count() == 0


def test_elias_fano_selects():
    rng = random.Random(1)
    for n, top in ((1, 0), (1, 10**6), (700, 700), (2000, 10**7), (5000, 300)):
        values = np.sort(np.array([rng.randint(0, top) for _ in range(n)]))
        ef = token_files.EliasFano.encode(values)
        assert ef.all().tolist() == values.tolist()
        assert [ef.select(i) for i in range(0, n, 37)] == values[::37].tolist()
        assert len(ef.low) + len(ef.high) <= n * (2 + max(0, top // n).bit_length()) / 8 + 16


def test_query_digests(spark):
    """The registered queries over a whole small table."""
    import pyarrow.dataset as ds

    from dialoom.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    table = ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    ids = {r["doc_id"]: x for r, x in zip(table, library(WORD, [r["text"] for r in table]))}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    at = 0
    got = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, sf).collect()}
    for i in sorted(ids):
        want = ids[i] + [2]
        assert tuple(got[i]) == (i, at, len(want), crc(want))
        at += len(want)
    for r in QUERIES["op2_packing"](spark, sf).collect():
        want = (ids[r.doc_id] + [1])[r.start:r.start + r.length]
        assert r.ids_crc32 == crc(want) and r.offset + r.length <= 2048 and r.doc_tokens == len(ids[r.doc_id]) + 1
