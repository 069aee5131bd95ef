import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import data
import numpy as np
import public_tokenizers
import pytest
from test_tokens import BYTE, ODD, library

from dialoom.llm import best_fit
from dialoom.llm.byte_encoding import StretchEncoder
from dialoom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def optimum(items, capacity):
    """Fewest sequences, by trying every set for the first item."""
    @lru_cache(None)
    def fewest(left):
        if not left:
            return 0
        best, first, rest = len(left), left[0], left[1:]

        def sets(k, room, out):
            nonlocal best
            best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if i not in out)))
            for i in range(k, len(rest)):
                if rest[i] <= room and (i == k or rest[i] != rest[i - 1]):
                    sets(i + 1, room - rest[i], out | {i})

        sets(0, capacity - first, frozenset())
        return best

    return fewest(tuple(sorted(items, reverse=True)))


def piece_by_piece(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def of(patterns):
    return Counter(s for p, times in patterns for s, each in p for _ in range(times * each))


def test_reduction_keeps_a_best_packing():
    rng = random.Random(5)
    fixed_some = fixed_three = 0
    for _ in range(400):
        capacity = rng.choice((10, 20, 31))
        items = [rng.randint(rng.choice((1, capacity // 4)), capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = best_fit.reduced(Counter(items), capacity)
        left = list(Counter(rest).elements())
        assert of(fixed) + Counter(left) == Counter(items)
        assert all(sum(s * c for s, c in p) <= capacity for p, _ in fixed)
        assert sum(t for _, t in fixed) + optimum(left, capacity) == optimum(items, capacity)
        fixed_some += bool(fixed)
        fixed_three += any(sum(c for _, c in p) == 3 for p, _ in fixed)
    assert fixed_some > 300 and fixed_three > 5


def test_best_fit_of_counts_equals_piece_by_piece():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice((7, 50, 1024))
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        patterns = best_fit.best_fit(Counter(items), capacity)
        assert of(patterns) == Counter(items)
        assert sorted(capacity - sum(s * c for s, c in p) for p, t in patterns for _ in range(t)) == piece_by_piece(items, capacity)


def test_runs_of_numbers_fill_every_sequence_gaplessly():
    rng = random.Random(8)
    counts = {rng.randint(1, 64): rng.randint(1, 10**6) for _ in range(40)} | {64: 77}
    patterns = best_fit.plan(counts, 64)
    places = best_fit.Places.of(patterns)
    assert of([(p, 1) for p, _ in patterns]).keys() == counts.keys()
    assert sum(s * c for s, c in counts.items()) <= 64 * places.sequences
    some = {s: rng.sample(range(n), min(n, 50)) for s, n in counts.items()}
    for s, numbers in some.items():
        sequence, offset = places.find(np.full(len(numbers), s), np.array(numbers))
        assert (sequence < places.sequences).all() and (offset + s <= 64).all()
    small = {s: n % 50 + 1 for s, n in counts.items()}
    places, held = best_fit.Places.of(best_fit.plan(small, 64)), defaultdict(list)
    for s, n in small.items():
        for q, o in zip(*places.find(np.full(n, s), np.arange(n))):
            held[q].append((o, s))
    for pieces in held.values():
        at = 0
        for o, s in sorted(pieces):
            assert o == at
            at += s
        assert at <= 64
    assert len(held) == places.sequences


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    mostly = ODD + [" "] * 40 + ["\n"] * 10 + ["word", "Wörter", "it's", "42"] * 8
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for some in (ODD, mostly) for _ in range(3000)] + ["a" * 5000, "", " ", "\n"]


def test_ids_equal_the_library(odd_texts, monkeypatch):
    from dialoom.llm import byte_encoding
    want = library(BYTE, odd_texts)
    enc = StretchEncoder(BYTE)
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode([t.encode() for t in odd_texts])] == want
    monkeypatch.setattr(byte_encoding, "REMEMBERED", 10)
    monkeypatch.setattr(byte_encoding, "LONGEST_REMEMBERED", 3)
    got = [x for lo in range(0, 600, 50) for x in enc.encode([t.encode() for t in odd_texts[lo:lo + 50]])]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want[:600]
    with pytest.raises(ValueError):
        StretchEncoder(public_tokenizers.path("word_bpe_49k.json"))


def checked(rows, whole, capacity, end):
    """Pieces against the ids of the library: (doc_id, piece, start, length, ids, sequence_id, offset) rows."""
    place, held = defaultdict(list), Counter()
    pieces = defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for some in place.values():
        at = 0
        for o, n in sorted(some):
            assert o == at
            at += n
        assert at <= capacity
    for i, some in pieces.items():
        for r in some:
            held[(i, r.piece, r.start, r.length, bytes(r.ids))] += 1
    want = Counter()
    for i, ids in whole:
        ids = np.array([*ids, end], "<u4")
        cuts = [0] + list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, ids[a:b].tobytes())] += 1
    assert held == want
    return len(place)


@pytest.mark.parametrize("capacity", [1024, 100])
def test_documents_are_packed_whole(docs, none, capacity):
    whole = [(i, x) for (i, _), x in zip(data.texts(), library(BYTE, [t for _, t in data.texts()]))]
    rows = best_fit.best_fit_pack(docs, BYTE, end_id=2, capacity=capacity).collect()
    used = checked(rows, whole, capacity, 2)
    total = sum(len(x) + 1 for _, x in whole)
    assert used <= total / capacity * 1.1 + 1
    out = best_fit.best_fit_pack(none, BYTE)
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]


def test_query_over_a_whole_table(spark):
    import pyarrow.dataset as ds
    table = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    ids = {r["doc_id"]: [*x, 2] for r, x in zip(table, library(BYTE, [r["text"] for r in table]))}
    rows = QUERIES["op11_best_fit_packing"](spark, SF).collect()
    place, seen = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
        place[r.sequence_id] += r.length
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()} and max(place.values()) <= 1024
    assert len(place) <= -(-sum(map(len, ids.values())) // 1024) * 1.02 + 1
