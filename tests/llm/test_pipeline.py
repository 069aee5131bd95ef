from collections import Counter

import data
import numpy as np
import public_tokenizers
import test_near_copies
import test_scores
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and len(after) == docs.count() <= len(before)
        names.append(name)
        if name == "quality_rules":
            assert all(test_scores.plain_quality(before[i].text)[-1] is False for i in after)
        elif name == "line_dedup":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "simhash_near_dedup":
            ids = list(before)
            sets = test_near_copies.plain_sets([before[i].text for i in ids])
            root = data.grouped(len(ids), test_near_copies.plain_links(sets))
            low = {}
            for r, i in zip(root, ids):
                low[r] = min(low.get(r, i), i)
            assert set(after) == set(low.values())
        else:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {r[0] for r in test_scores.plain_hits([(i, r.text) for i, r in before.items()], bench) if r[-1]}
            assert set(before) - set(after) == bad
    rows = corpus_pipeline.run(spark, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in after.items()}
    assert {r.doc_id: r.doc_tokens for r in rows} == want
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert dict(got) == want
    assert len(corpus_pipeline.STAGES) == 5 and names[0] == "quality_rules"


def test_stages_on_hostile_rows(spark, docs, none):
    for table in (docs, none):
        for _, stage in corpus_pipeline.STAGES:
            wide = table.withColumn("n_chars", __import__("pyspark.sql.functions", fromlist=["length"]).length("text").cast("long"))
            stage(spark, wide, SF).count()
