import random
from collections import Counter

import data
import numpy as np
import pyarrow.dataset as ds

from dialoom.llm import near_copies


def plain_sets(texts, words=5):
    out = []
    for t in texts:
        ws = data.words(data.lower(t))
        out.append({tuple(ws[i:i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set())
    return out


def plain_links(sets, similarity=0.8):
    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    out = []
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in at[g] if j < i)
        out += [(j, i) for j, n in shared.items() if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9]
    empty = [i for i, s in enumerate(sets) if not s]
    return out + [(empty[0], i) for i in empty[1:]]


def edited(rng, words, share):
    """A copy in which words are replaced until the shingle similarity falls to about `share`."""
    ws, base = list(words), plain_sets([" ".join(words)])[0]
    while True:
        k = rng.randrange(len(ws))
        old, ws[k] = ws[k], f"new{rng.randrange(10**6)}"
        now = plain_sets([" ".join(ws)])[0]
        if len(base & now) / len(base | now) < share:
            ws[k] = old
            return " ".join(ws)


def test_groups_equal_all_pairs_on_hostile_rows(docs, none):
    ids, texts = zip(*data.texts())
    sets = plain_sets(texts)
    root = data.grouped(len(sets), plain_links(sets))
    want = {min((ids[i] is None, ids[i] or 0) for i in range(len(ids)) if root[i] == r) for r in set(root)}
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == Counter(want)
    assert near_copies.one_of_each(none).count() == 0


def test_recall_at_the_threshold(spark):
    """Copies whose shingle similarity lies between 0.8 and 0.82, the hardest ones, and easier ones."""
    rng = random.Random(4)
    many = [a + b for a in data.WORDS for b in data.WORDS]
    texts, hard = [], 0
    for k in range(120):
        base = [rng.choice(many) for _ in range(rng.randint(40, 400))]
        texts += [" ".join(base), edited(rng, base, 0.8 if k % 2 else 0.9)]
    sets = plain_sets(texts)
    links = plain_links(sets)
    assert len(links) >= 120
    kept = near_copies.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = len(texts) - kept.count()
    assert found >= 0.95 * len({j for _, j in links})


def test_copies_of_a_table(spark):
    sf = "/root/testdata/sf0.01"
    t = ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    sets = plain_sets([r["text"] for r in t])
    root = data.grouped(len(sets), plain_links(sets))
    want = {min(t[i]["doc_id"] for i in range(len(t)) if root[i] == r) for r in set(root)}
    got = {r.doc_id for r in near_copies.one_of_each(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert want <= got and len(got - want) <= 0.05 * (len(t) - len(want))


def test_similar_sets_and_counts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[:100 - k], rng.integers(0, 2**63, k).astype(np.uint64)))) for k in (0, 3, 60, 5, 62)]
    got = near_copies.similar_sets(sets, 0.8)
    assert data.grouped(5, got) == [0, 0, 2, 0, 4]
    h = rng.integers(0, 2**64, 1000, np.uint64)
    assert near_copies.bit_counts(h).tolist() == [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


def test_all_pairs_within_the_bits_meet_by_the_generalised_pigeonhole(spark):
    """Pairs at the widest distance meet under a value of one of them, and the thresholds spend the whole budget."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300).astype(np.int64)
    far = np.array([b ^ sum(1 << int(k) for k in rng.choice(63, near_copies.MAX_BITS, False)) for b in base.tolist()], np.int64)
    rows = [(i, int(f), int(f)) for i, f in enumerate(np.concatenate((base, far)))]
    table = spark.createDataFrame(rows, "node long, fp long, print0 long")
    posted = near_copies.signatures(table, near_copies.MAX_BITS, ("node", "print0")).toPandas()
    assert (posted.fp == posted.print0).all()
    at = {}
    for bucket, node, own in posted[["bucket", "node", "own"]].itertuples(index=False):
        at.setdefault(node, {})[bucket] = own
    assert all(any(own or at[i + 300][b] for b, own in at[i].items() if b in at[i + 300]) for i in range(300))
    i, j = (np.concatenate(x) for x in zip(*near_copies.near_rows(np.concatenate((base, far)), np.arange(600) < 300, near_copies.MAX_BITS)))
    assert set(zip(range(300), range(300, 600))) <= set(zip(i.tolist(), j.tolist()))


def test_rows_of_a_class_do_not_grow_with_the_classes(spark):
    from pyspark.sql import functions as F
    each = []
    for n in (1000, 60_000):
        prints = [F.xxhash64("id", F.lit(k)).alias(c) for k, c in enumerate(near_copies.NAMES)]
        each.append(near_copies.posted(spark.range(n).select(F.col("id").alias("node"), *prints)).count() / n)
    assert each[1] <= 1.1 * each[0]


def test_classes_that_meet_are_grouped_in_small_and_large_buckets():
    """Equal to a look at all pairs of each bucket, also for pairs of which neither stands under its own value."""
    rng = np.random.default_rng(8)
    lengths = np.array([1, 2, 300, 40, 3])
    total = lengths.sum()
    base = rng.integers(-2**63, 2**63 - 1, (8, 2))
    prints = base[rng.integers(0, 8, total)] ^ np.array([[sum(1 << int(k) for k in rng.choice(63, 6, False)) for _ in range(2)] for _ in range(total)])
    own, node = rng.random(total) < 0.5, rng.permutation(total).astype(np.int64)
    got = near_copies.met_groups({"node": node, "print0": prints[:, 0], "print1": prints[:, 1], "own": own}, lengths)
    bucket = np.repeat(np.arange(len(lengths)), lengths)
    apart = np.bitwise_count(prints[:, None].view(np.uint64) ^ prints[None].view(np.uint64))
    near = (apart.sum(axis=2, dtype=np.int64) <= near_copies.RADIUS) & (bucket[:, None] == bucket) & (own[:, None] | own)
    root = data.grouped(total, [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    groups = {}
    for r, v in zip(root, node.tolist()):
        groups.setdefault(r, set()).add(v)
    found = {}
    for b, v in zip(got["bucket"].tolist(), got["node"].tolist()):
        found.setdefault(b, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
