import random
import re
import zlib
from collections import Counter

import data
import numpy as np

from dialoom.llm import spelling
from dialoom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def edits(w):
    """All texts one deletion away, and with one place blanked."""
    return {("-", i, w[:i] + w[i + 1:]) for i in range(len(w))} | {("*", i, w[:i] + "*" + w[i + 1:]) for i in range(len(w))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows, noise=199):
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = data.lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def plain(rows, noise=199):
    """By comparing every word with those that share a pattern of its edits (all pairs, in effect)."""
    n = plain_counts(rows, noise)
    met: dict = {}
    for w in n:
        for k in edits(w) | {("-", None, w)}:
            met.setdefault(k[2], set()).add(w)
    nears = {w: {o for k in edits(w) | {("-", None, w)} for o in met[k[2]] if near(w, o)} for w in n}
    form = {}
    for w, some in nears.items():
        best = min(some, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        top = w
        while form[top]:
            top = form[top]
        out[w] = (w, form[w], top, n[w], len(nears[w]), n[form[w]] if form[w] else None)
    return set(out.values())


def words_table(rng):
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(5, 8))) for _ in range(110)]
    base += ["letter", "lettre", "ettler", "tretle"] + ["x" * 300, "x" * 299, "x" * 298 + "y"]
    rows = ["harbours"] * 250 + ["harbourz"] * 40 + ["harbourzz"] * 7
    for w in base:
        forms = [w] * rng.choice((5, 30, 200))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            forms += [rng.choice((w[:k] + w[k + 1:], w[:k] + "z" + w[k:], w[:k] + "É" + w[k + 1:]))] * rng.choice((4, 5, 6, 40))
        rows += forms
    rng.shuffle(rows)
    return [(i, " ".join(rows[lo:lo + 40]).replace("letter", "LetTer") + "; ×÷ 中文 d'été") for i, lo in enumerate(range(0, len(rows), 40))]


SCHEMA = "doc_id long, text string, word string, n string, w string, cell string, root string"


def test_variants_equal_all_pairs(spark):
    rows = words_table(random.Random(2)) + data.texts() * 5
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA).repartition(4)
    want = plain(rows)
    assert len(want) > 150 and sum(r[1] is not None for r in want) > 30
    assert any(r[1] and r[2] != r[1] for r in want) and any(len(r[0]) == 300 for r in want)
    for cells in ({}, {"cell_words": 5, "sample_words": 10_000, "block_words": 3}, {"cell_words": 20, "sample_words": 40}):
        assert {tuple(r) for r in spelling.variants(df, **cells).collect()} == want
    few = {tuple(r) for r in spelling.variants(df, noise=7).collect()}
    assert few == plain(rows, 7)


def test_tables_without_words(spark, none):
    out = spelling.variants(none)
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    df = spark.createDataFrame([(1, None), (None, ""), (2, "12 34 ..."), (3, "lonely lonely lonely lonely")], "doc_id long, text string")
    assert spelling.variants(df).count() == 0
    df = spark.createDataFrame([(i, "lonely") for i in range(5)], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(df, noise=10**10).collect()] == [("lonely", None, "lonely", 5, 0, None)]


def test_long_chains_have_one_root(spark):
    word, rows = "a" * 40, []
    for k in range(7):
        rows += [(len(rows) + i, word) for i in range(5 ** (k + 1) if k < 5 else 5**6)]
        word = word[:k] + "b" + word[k + 1:]
    rows = rows[:5 + 25 + 125 + 625 + 3125]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in spelling.variants(df, noise=10**10).collect()}
    assert len(got) == 5 and {r[2] for r in got} == {"b" * 4 + "a" * 36} and got == plain(rows, 10**10)


def test_search_finds_all_pairs_of_a_block():
    rng = random.Random(3)
    for _ in range(20):
        long = rng.randint(6, 9)
        base = sorted({"".join(rng.choice("abcñ") for _ in range(long)).encode("latin-1") for _ in range(300)})
        for short in (long, long - 1):
            probe = sorted({"".join(rng.choice("abcñ") for _ in range(short)).encode("latin-1") for _ in range(300)})
            n = {w: rng.randint(1, 4) for w in base + probe}
            got = set(spelling.near_in_block([(w, n[w]) for w in base], [(w, n[w]) for w in probe]))
            want = set()
            for mine, other in ((probe, base), (base, probe)) if short != long else ((probe, base),):
                for w in mine:
                    some = [o for o in other if near(w, o)]
                    if some:
                        best = min(some, key=lambda o: (-n[o], o))
                        want.add((w.decode("latin-1"), len(some), n[best], best.decode("latin-1")))
            assert got == want


def test_boxes_never_lose_a_vector():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, (400, spelling.PLACES)).astype(np.int8)
    tree = spelling.grow(v[::3], 10)
    own, leaf = spelling.reached(tree, v, 0)
    assert sorted(own.tolist()) == list(range(400))
    home = dict(zip(own.tolist(), leaf.tolist()))
    w = v.copy()
    w[np.arange(400), rng.integers(0, 34, 400)] += 1
    w[np.arange(400), rng.integers(0, 34, 400)] += 1
    who, where = spelling.reached(tree, w, 2)
    assert set(home.items()) <= set(zip(who.tolist(), where.tolist()))


def test_query_over_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()} == plain(rows)
