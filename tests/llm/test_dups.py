import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import data
import numpy as np
import pytest
import xxhash

from dialoom.llm import line_dedup, simhash_dups, substring_dups
from dialoom.llm.components import components
from dialoom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def table(sf=SF):
    import pyarrow.dataset as ds
    return ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()


# ---- connected groups ---------------------------------------------------------------------------------------------

def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300), (-5, -9), (-9, -5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 200 for i in range(200, 260)) and got[-5] == got[-9] == -9 and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash --------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    ws = data.words(data.lower(text))
    grams = [b" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_groups(fps, ids):
    f = np.array(fps, np.uint64)
    root = data.grouped(len(f), [(i, j) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 3).tolist()])
    low = {}
    for r, i in zip(root, ids):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in root]


def test_near_duplicates_equal_all_pairs(docs, none):
    ids, texts = zip(*data.texts())
    fps = [plain_fingerprint(t) for t in texts]
    want = Counter(zip(ids, fps, plain_groups(fps, ids)))
    got = simhash_dups.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash_dups.near_duplicates(none).count() == 0


def test_near_duplicate_query(spark):
    t = table()
    fps = [plain_fingerprint(r["text"]) for r in t]
    want = {(r["doc_id"], f"{f:016x}", c) for r, f, c in zip(t, fps, plain_groups(fps, [r["doc_id"] for r in t]))}
    assert {tuple(r) for r in QUERIES["op5_simhash_near_dedup"](spark, SF).collect()} == want


def test_one_of_each_keeps_the_smallest(docs, none):
    ids, texts = zip(*data.texts())
    got = simhash_dups.one_of_each(docs)
    assert got.columns == docs.columns
    groups = plain_groups([plain_fingerprint(t) for t in texts], ids)
    nameless = sum(1 for i, g in zip(ids, groups) if g is None)
    assert Counter(r.doc_id for r in got.collect() if r.doc_id is not None) == Counter({g: 1 for g in set(groups) if g is not None})
    assert got.where("doc_id is null").count() == nameless
    assert simhash_dups.one_of_each(none).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_links_are_complete_and_few(spark, block):
    """Random and clustered fingerprints, with a large group of near copies, in small and large blocks."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(1500)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(400)}
    fps |= {x ^ sum(1 << b for b in rng.sample(range(64), 3)) for x in rng.sample(sorted(fps), 200)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = [tuple(r) for r in simhash_dups.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, block).collect()]
    at = {x: i for i, x in enumerate(signed)}
    assert all(bin((a ^ b) % 2**64).count("1") <= 3 for a, b in edges)
    f = np.array(fps, np.uint64)
    want = data.grouped(len(f), [(i, j) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 3).tolist()])
    assert data.grouped(len(f), [(at[a], at[b]) for a, b in edges]) == want


def test_thresholds_spend_the_whole_budget():
    rng = np.random.default_rng(1)
    fps = rng.integers(-2**63, 2**63 - 1, 500)
    bits = simhash_dups._bits(fps)
    for n in (500, 10**10):
        groups = simhash_dups.bit_groups(n, (bits.T.astype(float) @ bits), 3)
        assert sorted(b for g in groups for b in g) == list(range(64))
        dist = {(g, f): simhash_dups.at_distance(np.bincount(simhash_dups.value(bits, fold), minlength=1 << len(fold)).astype(float), 3)
                for g, group in enumerate(groups) for f, fold in enumerate(simhash_dups.folds(group))}
        t = simhash_dups.thresholds(bits, groups, dist, 500, 3)
        assert ((t + 1).sum(axis=1) == 4).all() and t.min() >= -1


# ---- lines ----------------------------------------------------------------------------------------------------------

def similar_pairs(lines):
    """(i, j) of all pairs of lines (word tuples) of edit similarity 0.8 or more, by counts of shared words and edits."""
    at = defaultdict(list)
    coded = [Counter(x) for x in lines]
    for i, c in enumerate(coded):
        for w in c:
            at[w].append(i)
    out = []
    for i, c in enumerate(coded):
        shared = Counter()
        for w, n in c.items():
            for j in at[w]:
                if j < i:
                    shared[j] += min(n, coded[j][w])
        for j, n in shared.items():
            longer = max(len(lines[i]), len(lines[j]))
            if 5 * (longer - n) <= longer and 5 * line_dedup.edits(list(lines[i]), list(lines[j])) <= longer:
                out.append((i, j))
    return out


def plain_lines(rows):
    """Different normalised lines, root of each, and their places: (no id, id, line, row, number of the line)."""
    number, places = {}, []
    for i, t in rows:
        for k, ws in enumerate(line_dedup.normalised((t or "").encode())):
            if ws:
                places.append((i is None, i if i is not None else 0, k, (i, t), number.setdefault(tuple(ws), len(number))))
    lines = list(number)
    long = [i for i, x in enumerate(lines) if len(x) >= 5]
    links = [(long[i], long[j]) for i, j in similar_pairs([lines[i] for i in long])]
    return lines, data.grouped(len(lines), links), places


def plain_deduped(rows):
    """(id, lines, lines removed, text left) of each different row."""
    _, root, places = plain_lines(rows)
    seen, gone = {}, defaultdict(set)
    for *_, k, row, c in sorted(places, key=lambda p: (p[0], p[1], p[3][1], p[2])):
        if seen.setdefault(root[c], (row, k)) != (row, k):
            gone[row].add(k)
    out = set()
    for i, text in rows:
        parts = text.split("\n") if text else []
        left = [x for k, x in enumerate(parts) if k not in gone[i, text]]
        out.add((i, len(parts), len(parts) - len(left), text and "\n".join(left)))
    return out


def test_line_dedup_keeps_one_of_each_group(docs, none):
    rows = data.texts()
    lines, root, _ = plain_lines(rows)
    out = line_dedup.deduped(docs, count_cols=("n_lines", "n_gone")).collect()
    assert len(out) == len(rows) and docs.columns == line_dedup.deduped(docs).columns
    assert {(r.doc_id, r.n_lines, r.n_gone, r.text) for r in out} == plain_deduped(rows)
    by_id = {r.doc_id: r for r in out if r.doc_id in (2, 5, 14)}
    assert by_id[5].text == "" and by_id[5].n_gone == 1 and by_id[2].text == ""
    assert by_id[14].n_gone == 2 and by_id[14].text.count("short") == 2
    assert sum(r.text is None for r in out) == 2
    assert line_dedup.deduped(none).count() == 0
    with pytest.raises(ValueError):
        line_dedup.deduped(docs, count_cols=("source", "n_gone"))


def test_line_dedup_query_equals_brute_force(spark):
    want = {(i, n, m, hashlib.sha256((t or "").encode()).hexdigest()) for i, n, m, t in plain_deduped([(r["doc_id"], r["text"]) for r in table()])}
    assert {tuple(r) for r in QUERIES["op4_line_dedup"](spark, SF).collect()} == want


def test_recall_of_similar_lines(spark):
    """Pairs at 0.8 in a larger table that end in one group, against all pairs; and a plain edit model for long lines."""
    rows = [(r["doc_id"], r["text"]) for r in table("/root/testdata/sf0.01")]
    rng = random.Random(3)
    many = sorted({w for _, t in rows[:300] for ws in line_dedup.normalised((t or "").encode()) for w in ws})
    for k in range(150):
        base = [rng.choice(many) for _ in range(rng.randint(20, 90))]
        edited = list(base)
        for at in rng.sample(range(len(base)), len(base) // 5):
            edited[at] = rng.choice(many)
        rows += [(10**6 + 2 * k, b" ".join(base).decode()), (10**6 + 2 * k + 1, b" ".join(edited).decode())]
    lines = sorted({tuple(ws) for _, t in rows for ws in line_dedup.normalised((t or "").encode()) if len(ws) >= 5})
    links = similar_pairs(lines)
    df = spark.createDataFrame([(k, b" ".join(x).decode()) for k, x in enumerate(lines)], "doc_id long, text string")
    keyed = line_dedup.keyed(df, "doc_id", "text")
    root = data.grouped(len(lines), links)
    want = {i for i in range(len(lines)) if root[i] != i}
    for block, least in ((1024, 0.99), (32, 0.95)):            # in small blocks many words count as frequent
        gone = {r.doc_id for r in line_dedup.removed_lines(keyed, 5, 0.8, block).join(keyed, ["k1", "k2"]).collect()}
        print(block, len(gone), len(want))
        assert gone <= want and len(want) > 300
        assert len(gone) >= least * len(want)


@pytest.mark.parametrize("block", [1024, 4])
def test_lines_meet_whatever_happened_to_their_rarest_words(spark, block):
    """Two lines of 60 words that differ in their eight rarest words: twelve edits are allowed."""
    rng = random.Random(5)
    common = [f"common{data.WORDS[k % len(data.WORDS)]}{chr(97 + k // len(data.WORDS))}" for k in range(52)]
    rare = [[f"rare{x}{chr(97 + k)}" for k in range(8)] for x in "xy"]
    texts = [" ".join(common + r) for r in rare] + [" ".join(reversed(r)) for r in rare]
    texts += [" ".join(rng.sample(common, 20)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in line_dedup.removed_lines(line_dedup.keyed(df, "doc_id", "text"), 5, 0.8, block)
            .join(line_dedup.keyed(df, "doc_id", "text"), ["k1", "k2"]).collect()}
    assert left == {1}


@pytest.mark.parametrize("block, holes", [(1024, None), (1024, 30)])
def test_lines_meet_all_similar_lines(spark, block, holes):
    """All pairs by edit similarity alone, with all pigeonholes and without a look at fingerprints: recall must be whole."""
    rng = random.Random(11)
    many = [w + x for w in data.WORDS for x in data.WORDS]
    texts = [t for _, t in table()[:60]]
    for n in (5, 6, 9, 10, 19, 20, 50, 120):
        for _ in range(12):
            base = [rng.choice(many) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, n // 5 + 1)):
                k = rng.randrange(len(base))
                base[k:k + 1] = rng.choice(([], [rng.choice(many)], [base[k], rng.choice(many)], [base[k]] * 2))
            texts.append(" ".join(base))
    texts += ["to be or not to be " * 3, "to be or not to be to to or not to be to be or not to be"]
    lines = sorted({tuple(ws) for t in texts for ws in line_dedup.normalised((t or "").encode()) if len(ws) >= 5})
    number = {w: i for i, w in enumerate({w for x in lines for w in x})}
    coded = [[number[w] for w in x] for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i)
             if 5 * abs(len(coded[i]) - len(coded[j])) <= max(len(coded[i]), len(coded[j]))
             and 5 * line_dedup.edits(coded[i], coded[j]) <= max(len(coded[i]), len(coded[j]))]
    rows = spark.createDataFrame([(k, b" ".join(x).decode("utf-8", "surrogateescape")) for k, x in enumerate(lines)], "doc_id long, text string")
    keyed = line_dedup.keyed(rows, "doc_id", "text")
    gone = {r.doc_id for r in line_dedup.removed_lines(keyed, 5, 0.8, block, holes, 64).join(keyed, ["k1", "k2"]).collect()}
    root = data.grouped(len(lines), links)
    assert gone == {i for i in range(len(lines)) if root[i] != i} and len(gone) > 60


def test_only_lines_of_fitting_length_are_compared():
    """Strips of large groups and distances in small ones give each pair whose lengths allow the similarity, once, and few others."""
    rng = np.random.default_rng(4)
    lengths = np.array([1, 700, 3, 64, 65, 2])
    n = np.concatenate([np.sort(rng.integers(5, 90, k)) for k in lengths])
    group = np.repeat(np.arange(len(lengths)), lengths)
    got = Counter(pair for i, j in line_dedup.near_in_length(n, lengths, 0.8) for pair in zip(i.tolist(), j.tolist()))
    every = [(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if group[i] == group[j]]
    want = {(i, j) for i, j in every if 5 * (n[j] - n[i]) <= n[j]}
    assert want <= set(got) <= set(every) and max(got.values()) == 1 and len(got) < 0.6 * len(every)


def test_frequent_words_pair_among_themselves():
    line, bucket = np.array([0, 0, 0, 2, 5, 5]), np.array([7, 8, 9, 7, 8, 7])
    lines, pairs = line_dedup.paired(line, bucket)
    assert Counter(lines.tolist()) == {0: 3, 5: 1}
    assert len(set(pairs.tolist())) == 3 and pairs[lines == 5][0] in pairs[lines == 0]


def changed(rng, base, words, edits):
    out = list(base)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k:k + 1] = rng.choice(([], [rng.choice(words)], [out[k], rng.choice(words)]))
    return out


def test_long_lines_of_frequent_words_meet_in_few_blocks():
    """Similar lines share a block of a word that is not frequent or of two frequent words in a row, with rows in proportion to words."""
    rng = random.Random(12)
    words = [rng.getrandbits(64) for _ in range(60)]
    levels = np.zeros(line_dedup.RARITY_SLOTS, np.uint8)
    for k, w in enumerate(words):
        levels[w % line_dedup.RARITY_SLOTS] = 1 + k // 4
    pairs, most = 0, 0
    for _ in range(600):
        a = [rng.choice(words[rng.choice((0, 28)):]) for _ in range(rng.randint(15, 90))]
        b = changed(rng, a, words, len(a) // 5)
        if 5 * line_dedup.edits(a, b) > max(len(a), len(b)) or min(len(a), len(b)) <= line_dedup.LONG:
            continue
        pairs += 1
        h, n = np.array(a + b, np.uint64), np.array([len(a), len(b)])
        _, line, bucket, level = line_dedup.pigeonholes(h, n, levels, 0.8, None)
        met = [set(bucket[(line == k) & (level < 8)].tolist()) for k in (0, 1)]
        line, bucket = line_dedup.in_order(h, n, levels, 0.8, 8)
        assert met[0] & met[1] or set(bucket[line == 0].tolist()) & set(bucket[line == 1].tolist())
        assert (np.bincount(line, minlength=2) <= 2 * (n // 5) + 2).all()
        most = max(most, len(line))
    assert pairs > 300 and most > 30


def test_groups_are_verified_at_once():
    """Bounds hold against the edit table, and the forest connects what all pairs of each group connect."""
    rng = random.Random(6)
    lines, lengths = [], []
    for size in (1, 2, 2, 9, 40, 3):
        base = [rng.randrange(40) for _ in range(rng.randint(5, 60))]
        lines += [changed(rng, base, range(40), rng.randint(0, len(base) // 3)) or [1] for _ in range(size)]
        lengths.append(size)
    n, flat = np.array([len(x) for x in lines]), np.concatenate(lines).astype(np.uint32)
    starts, group = np.cumsum(n) - n, np.repeat(np.arange(len(lengths)), lengths)
    i, j = (np.array(x) for x in zip(*[(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if group[i] == group[j]]))
    true = np.array([line_dedup.edits(lines[a], lines[b]) for a, b in zip(i.tolist(), j.tolist())])
    above, below = line_dedup.edits_at_most(flat, starts, n, i, j), line_dedup.words_apart(flat, starts, n, i, j)
    assert (below <= true).all() and (true <= above).all() and (above == true).any() and (above > true).any()
    odd = line_dedup.parities(line_dedup.mixed(flat.astype(np.uint64)), starts)
    near = 5 * true <= np.maximum(n[i], n[j])
    assert line_dedup.may_be_similar(n[i], n[j], odd[i], odd[j], 0.8)[near].all()
    a, b = line_dedup.verified_groups(flat, n, np.array(lengths), 0.8)
    links = list(zip(i[near].tolist(), j[near].tolist()))
    assert data.grouped(len(n), list(zip(a.tolist(), b.tolist()))) == data.grouped(len(n), links) and set(zip(a.tolist(), b.tolist())) <= set(links)
    assert line_dedup.edits_at_most(np.array([1, 2, 3, 4, 1, 9, 7, 7, 3, 4], np.uint32), np.array([0, 4]), np.array([4, 6]), np.array([0]), np.array([1])) == [3]


def posted_lines(rng, sizes, words=20):
    """Columns of lines in blocks of these sizes, each block's lines a word apart from one line, and two of another one."""
    n = np.full(sum(sizes) + 2 * len(sizes), words)
    h = np.concatenate([np.concatenate((np.tile(rng.integers(0, 1 << 62, words, np.uint64), (k, 1)), np.tile(rng.integers(0, 1 << 62, words, np.uint64), (2, 1))))
                        for k in sizes])
    h[np.arange(len(h)), rng.integers(0, words, len(h))] = rng.integers(0, 1 << 62, len(h), np.uint64)
    odd = line_dedup.posted_parities(h.ravel(), n).view(np.int64)
    return {"c1": rng.integers(0, 1 << 62, len(h)), "fp": line_dedup.line_fingerprints(h.ravel(), n), "n": n.astype(np.int32),
            **{c: odd[:, k] for k, c in enumerate(line_dedup.ODD)}}, np.array(sizes) + 2


def test_blocks_of_near_copies_need_no_room_for_their_pairs():
    """In a block of near copies nearly all pairs are near: lines are joined as they come. All pairs of 3,000 lines are 72 MB."""
    cols, lengths = posted_lines(np.random.default_rng(3), [3000, 40, 2500])
    tracemalloc.start()
    got = line_dedup.meetings_in(cols, lengths, 0.8, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = np.searchsorted(np.sort(cols["c1"]), got["c1"])
    groups = Counter(Counter(got["bucket"].tolist()).values())
    assert len(set(at.tolist())) == len(cols["c1"]) and groups == {3000: 1, 40: 1, 2500: 1, 2: 3} and peak < 48 << 20


def test_crowded_blocks_are_dealt_out_once(spark):
    """Lines of frequent words only, in blocks far larger than a task compares: all similar pairs meet."""
    rng = random.Random(8)
    few = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    lines = {tuple(rng.sample(few, 10)) for _ in range(150)}
    lines |= {x[:k] + ("zz",) + x[k + 1:] for x in sorted(lines)[:40] for k in (rng.randrange(10),)}
    lines = sorted(lines)
    root = data.grouped(len(lines), similar_pairs(lines))
    keyed = line_dedup.keyed(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string"), "doc_id", "text")
    gone = {r.doc_id for r in line_dedup.removed_lines(keyed, 5, 0.8, 4, radius=64).join(keyed, ["k1", "k2"]).collect()}
    assert gone == {i for i in range(len(lines)) if root[i] != i} and len(gone) >= 40


def test_short_lines_and_scripts_without_blanks(spark):
    zh, th = "数据清洗是训练语言模型之前必须完成的一个重要步骤之一", "การทำความสะอาดข้อมูลเป็นขั้นตอนสำคัญ"
    texts = [f"Share this article now\n{zh}\n---\nOnly here", f"share this ARTICLE now!\n{zh}\n---\n{th}",
             f"{zh.replace('训', '驯')}\n{th.replace('สำ', 'ส')}\nShare that article now", "数据很好\nnow\n\nnow"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in line_dedup.deduped(rows).orderBy("doc_id").collect()]
    assert got == [texts[0], f"---\n{th}", "Share that article now", "数据很好\nnow\n"]
    assert len(line_dedup.normalised("お早う ございます, 안녕 하세요".encode())[0]) == 10


def test_edits():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
            p = q
        assert line_dedup.edits(a, b) == p[-1]


# ---- passages -------------------------------------------------------------------------------------------------------

def plain_passages(rows, window):
    seen, out = Counter(), []
    split = [data.words(t) for _, t in rows]
    for ws in split:
        seen.update(tuple(ws[i:i + window]) for i in range(len(ws) - window + 1))
    for (i, _), ws in zip(rows, split):
        hit = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if seen[tuple(ws[k:k + window])] > 1:
                hit[k:k + window] = [True] * window
        kept = b" ".join(w for w, h in zip(ws, hit) if not h)
        out.append((i, len(ws), sum(hit), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("shard", [1, 256])
@pytest.mark.parametrize("window", [14, 35])
def test_passages_equal_brute_force(docs, none, monkeypatch, shard, window):
    monkeypatch.setattr(substring_dups, "SHARD", shard)
    got = substring_dups.without_repeats(docs, window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == plain_passages(data.texts(), window)
    assert substring_dups.without_repeats(none).count() == 0


def test_passage_query(spark):
    t = table()
    assert Counter(tuple(r) for r in QUERIES["op8_substring_dedup"](spark, SF).collect()) == plain_passages([(r["doc_id"], r["text"]) for r in t], 35)


def test_automaton_shard_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        window = rng.randint(1, 4)
        classes = [([rng.randint(0, 2) for _ in range(rng.randint(window, 9))], rng.choice((1, 1, 2))) for _ in range(rng.randint(1, 5))]
        where = defaultdict(set)
        for k, (seq, n) in enumerate(classes):
            for i in range(len(seq) - window + 1):
                where[tuple(seq[i:i + window])] |= {k} if n == 1 else {k, -1}
        want = [[i for i in range(len(seq) - window + 1) if len(where[tuple(seq[i:i + window])]) > 1] for seq, _ in classes]
        assert substring_dups.repeats_in_shard(classes, window) == want
