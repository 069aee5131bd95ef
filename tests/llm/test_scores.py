import math
import re
import zlib
from collections import Counter

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import decontamination, lm_scoring, pseudonyms, quality_rules
from dialoom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---- language model -------------------------------------------------------------------------------------------------

def plain_base(rows):
    tokens = [data.words(data.lower(t)) + [b"\n"] for _, t in rows]
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
            for (i, _), ws, h in zip(rows, tokens, held)]


@pytest.mark.parametrize("fineness", [50, 1 << 22])
def test_base_scores(docs, none, fineness):
    got = lm_scoring.score(docs, fineness=fineness).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == Counter(plain_base(data.texts()))
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score(none).count() == 0


def test_model_beats_the_base_on_held_out_text(spark):
    got = QUERIES["op6_lm_scoring"](spark, SF).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0] + 1


def plain_scores(rows, base):
    """{id: log10 probability} by the plain formula: discounted shares of triple and pair, back-off masses, base probability."""
    seqs = [(i, zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1, ["\n"] + data.words(data.lower(t)) + ["\n"]) for i, t in rows]
    pair, triple, one, two = Counter(), Counter(), Counter(), Counter()
    for _, held, x in seqs:
        if not held:
            one.update(x[:-1])
            pair.update(zip(x, x[1:]))
            two.update(zip(x, x[1:-1]))
            triple.update(zip(x, x[1:], x[2:]))
    keep = lambda c: {k: n for k, n in c.items() if n >= 2}
    pair, triple = keep(pair), keep(triple)
    left1, left2 = dict.fromkeys(one, 1.0), dict.fromkeys(two, 1.0)
    for (v, _), n in pair.items():
        left1[v] -= (n - 0.75) / one[v]
    for (u, v, _), n in triple.items():
        left2[u, v] -= (n - 0.75) / two[u, v]
    out = []
    for i, _, x in seqs:
        total = 0.0
        for k in range(1, len(x)):
            v, w = x[k - 1], x[k]
            p = (pair[v, w] - 0.75) / one[v] if (v, w) in pair else 0.0
            p += max(left1.get(v, 1.0), 1e-9) * base(w)
            if k > 1:
                u = x[k - 2]
                p *= max(left2.get((u, v), 1.0), 1e-9)
                p += (triple[u, v, w] - 0.75) / two[u, v] if (u, v, w) in triple else 0.0
            total += math.log10(p)
        out.append((i, len(x), total))
    return out


def base_of(rows):
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in data.words(data.lower(t)) + ["\n"])
    return lambda w: (c[w] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))


@pytest.mark.parametrize("options", [{}, {"fineness": 50}, {"shard_tokens": 500}, {"fineness": 50, "shard_tokens": 300}])
def test_scores_equal_the_plain_formula(spark, docs, options):
    rows = data.texts()
    want = sorted(plain_scores(rows, base_of(rows)), key=lambda r: (str(r[0]), r[2]))
    got = sorted(lm_scoring.score(docs, **options).collect(), key=lambda r: (str(r.doc_id), r.score))
    assert len(got) == len(want)
    for r, (i, n, total) in zip(got, want):
        assert r.doc_id == i and r.n_tokens == n - 1 and abs(r.score - total) < 2e-3 * n


def test_a_phrase_keeps_its_context_in_a_larger_corpus(spark):
    """What a model knows about a phrase doesn't depend on how much else it has read."""
    phrase = "copper lanterns drifted beyond seven quiet harbours"
    rows = [(i, phrase) for i in (0, 1, 2)]
    more = rows + [(10 + i, " ".join(f"x{(i * 7 + k) % 900}" for k in range(300))) for i in range(300)]
    gain = []
    for part in (rows, more):
        got = lm_scoring.score(spark.createDataFrame(part, "doc_id long, text string"), fineness=100).where("doc_id < 3").collect()
        gain.append(min(r.score for r in got))
    assert gain[1] > gain[0] - 4 and gain[1] > -8


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    w = rng.zipf(1.5, 20_000).clip(max=60).astype(np.int64)
    v, u = np.append(0, w[:-1]), np.append([lm_scoring.NOTHING, 0], w[:-2])
    words = np.unique(np.concatenate((u, v, w)))
    u, v, w = (np.searchsorted(words, x) for x in (u, v, w))
    trie = lm_scoring.Trie(lm_scoring.build(words, u, v, w))
    base = np.bincount(w, minlength=len(words)) / len(w)
    every = np.arange(len(words))
    for k in (1, 50, 999, 15_000):
        own, rest = trie.shares(np.full(len(words), u[k]), np.full(len(words), v[k]), every)
        assert abs((own + rest * base).sum() - 1) < 2e-3


def test_packed_keys_find_their_places():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 10**12, 200_000))
    packed = lm_scoring.Keys(lm_scoring.map_arrays(lm_scoring.pack_keys("x", keys)), "x")
    asked = np.unique(np.concatenate((keys[::7], keys[::11] + 1, [0, 10**13])))
    want = np.where(np.isin(asked, keys), np.searchsorted(keys, asked), -1)
    assert (packed.places(asked) == want).all()
    assert packed.low.nbytes + packed.high.nbytes < 5 * len(keys)


# ---- quality rules --------------------------------------------------------------------------------------------------

def plain_quality(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    hit = set()
    for i in range(len(ws) - 2):
        if grams[tuple(ws[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 50 or 100 * len(hit) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality_counts(docs, none):
    got = quality_rules.judge(docs, keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == \
        Counter((i, *plain_quality(t)) for i, t in data.texts())
    assert not any(r.kept and r.base_failed for r in got)
    whole = quality_rules.filtered(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.kept for r in got)
    assert quality_rules.filtered(none).count() == 0 and quality_rules.judge(none, keep=["doc_id"]).count() == 0


def test_bad_hosts_lose_only_documents_that_break_a_rule(spark):
    rng = __import__("random").Random(1)
    many = [w + str(i) for w in data.WORDS for i in range(40)]
    clean = lambda: data.prose(rng, 80, many)
    symbols = lambda: clean() + " #" * 20
    rows = [(i, symbols() if i % 10 else clean(), "bad") for i in range(60)] + [(100 + i, clean(), f"h{i % 5}") for i in range(100)] + [(300, symbols(), "h0")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept == (i % 10 == 0) for i in range(60)) and all(got[100 + i].kept for i in range(100)) and got[300].kept
    assert got[1].host_rate > 0.7 and 0 < got[101].host_rate < 0.2


# ---- decontamination ------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(rows, items):
    import hashlib
    windows = {}
    for name, t in items:
        ws = WORD.findall(data.lower(t))
        for s in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[s:s + 13]), set()).update([] if name is None else [str(name)])
    out = []
    for i, t in rows:
        ws, hit, names = WORD.findall(data.lower(t)), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(ws) - n + 1):
                if tuple(ws[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names |= windows[tuple(ws[s:s + n])]
        out.append((i, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return Counter(out)


@pytest.mark.parametrize("block_words", [10, 1_000_000])
def test_hits_equal_brute_force(spark, docs, none, block_words):
    texts = [t for _, t in data.texts()]
    items = [(1, texts[3][200:500]), (2, "alpha3"), (3, None), (4, ""), (5, "beta1 gamma2"), (None, texts[7]), (6, texts[9]), (6, texts[9]), (7, "!!"),
             (10, "a a a"), (9, texts[6][:3000]), (8, "中文")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, bench, block_words=block_words).select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256), "contaminated").collect()
    want = plain_hits(data.texts(), items)
    assert Counter(tuple(r) for r in got) == want
    clean = decontamination.cleaned(docs, bench, block_words=block_words)
    assert clean.columns == docs.columns and clean.count() == sum(n for r, n in want.items() if not r[-1])
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_long_and_repeated_items_are_cut_into_pieces(spark):
    rng = __import__("random").Random(9)
    long = [f"w{rng.randrange(40_000)}" for _ in range(120_000)]
    rows = [(k, " ".join(["zz"] * 5 + long[at:at + n] + ["zz"] * 5)) for k, (at, n) in
            enumerate([(0, 13), (9_990, 30), (10_000, 13), (9_999, 13), (119_980, 20), (34_567, 12), (50_000, 40)])]
    items = [("long", " ".join(long)), ("short", "zz zz zz w1")] + [("often", " ".join(long[:300]))] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.items) for r in decontamination.decontaminate(docs, bench, block_words=50_000).collect()}
    assert got == {0: (13, ["long", "often"]), 1: (30, ["long"]), 2: (13, ["long"]), 3: (13, ["long"]), 4: (20, ["long"]), 5: (0, []), 6: (40, ["long"])}


def test_decontamination_query(spark):
    import pyarrow.dataset as ds
    read = lambda n, a: [(r[a], r["text"]) for r in ds.dataset(f"{SF}/{n}.parquet").to_table(columns=[a, "text"]).to_pylist()]
    assert Counter(tuple(r) for r in QUERIES["op10_decontamination"](spark, SF).collect()) == plain_hits(read("documents", "doc_id"), read("benchmark", "item_id"))


# ---- pseudonyms -----------------------------------------------------------------------------------------------------

def luhn(d):
    s = [int(x) for x in d[::-1]]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def new(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, [f.kind for f in r.finds]) for r in pseudonyms.pseudonymised(df, key).orderBy("doc_id").collect()]


def test_formats_are_kept(spark):
    got = new(spark, ["card 4041894974608795, 4041-8949-7460-8795", "4041894974608796", "+1 (988) 555-2485 988-555-2485", "ip 42.144.35.254 300.1.1.1 1.2.3.4.5",
                      "1980-02-29 02/29/1980 1981-02-29", "123-45-6789 000-12-3456 666-12-3456", "bosbt.42@mail8.example.com", None, "", "x" * 100_000, "1" * 50_000])
    one, two = re.findall(r"[\d-]{16,}", got[0][0])
    assert one == two.replace("-", "") != "4041894974608795" and luhn(one) and two[4] == two[9] == "-" and got[0][1] == ["card"] * 2
    assert got[1] == ("4041894974608796", [])
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} [2-9]\d\d-[2-9]\d\d-\d{4}", got[2][0]) and re.sub(r"\D", "", got[2][0])[1:11] == re.sub(r"\D", "", got[2][0])[11:]
    assert got[3][1] == ["ipv4"] and got[3][0].endswith(" 300.1.1.1 1.2.3.4.5") and all(int(x) < 256 for x in got[3][0].split()[1].split("."))
    iso, us, bad = got[4][0].split()
    assert iso == f"{us[6:]}-{us[:2]}-{us[3:5]}" != "1980-02-29" and bad == "1981-02-29" and got[4][1] == ["date"] * 2
    assert got[5][1] == ["ssn"] and got[5][0].endswith(" 000-12-3456 666-12-3456")
    assert re.fullmatch(r"[a-z]{5}\.\d\d@mail8\.example\.com", got[6][0]) and got[6][0] != "bosbt.42@mail8.example.com"
    assert got[7] == (None, []) and got[8] == ("", []) and got[9] == ("x" * 100_000, []) and got[10] == ("1" * 50_000, [])
    assert new(spark, ["4041894974608795"], "other") != new(spark, ["4041894974608795"])


def test_numbers_beside_a_card_do_not_hide_it(spark):
    plain, blanks, hyphens = "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"
    around = [f"{blanks} 12/26", f"{plain} 123", f"{hyphens} 25 items", f"order 12 {blanks}", f"123456 {blanks}", f"77 {plain} 8", f"{hyphens} {blanks}"]
    want = new(spark, [plain])[0][0]
    assert want != plain
    shapes = {plain: want, blanks: " ".join(re.findall("....", want)), hyphens: "-".join(re.findall("....", want))}
    for text, (got, kinds) in zip(around, new(spark, around)):
        assert got == re.sub("|".join(shapes), lambda m: shapes[m[0]], text) and set(kinds) == {"card"}
    other = [f"{plain} 988-555-2485", f"{blanks} 02/29/1980", "3782 822463 10005 99", "6304 0000 0000 0000 000", "4111 1111 1111 1112 5"]
    got = new(spark, other)
    assert [k for _, k in got] == [["card", "phone"], ["card", "date"], ["card"], ["card"] if luhn("6304" + "0" * 15) else [], []]
    assert luhn(re.sub(r"\D", "", got[2][0])[:15]) and got[2][0].endswith(" 99") and got[4][0] == other[4]


def test_feistel_is_a_permutation(spark):
    days = spark.range(pseudonyms.DAYS).select(F.date_format(F.date_add(F.lit(pseudonyms.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pseudonyms.pseudonymised(days.sample(0.05, 1), "k").agg(F.count_distinct("text") == F.count("text")).first()[0]
    octets = spark.range(3000).select(F.concat(F.lit("10.0."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256).alias("text"))
    assert pseudonyms.pseudonymised(octets, "k").select("text").distinct().count() == 3000


def test_pseudonyms_keep_columns_and_plan_without_python(docs, none, spark):
    out = pseudonyms.pseudonymised(docs, "k")
    assert out.columns == [*docs.columns, "finds"] and out.count() == docs.count()
    assert pseudonyms.pseudonymised(none, "k").count() == 0
    q = QUERIES["op7_pseudonyms"](spark, SF)
    assert not re.search("Python|Arrow|Pandas|Exchange", q._jdf.queryExecution().executedPlan().toString())
    mails = q.where("kinds like '%mail%'").count()
    assert mails and q.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
