"""Span embeddings: work is dealt over tasks, window vectors are added up where they are made."""
import numpy as np
from pyspark.sql import functions as F

from dialoom.operators import hooks


def spans(spark, n):
    return spark.createDataFrame([(i, 1000 * i, 1000 * i + 900 * (i % 9)) for i in range(n)], "id long, start_ms long, end_ms long").coalesce(1)


def test_windows_of_one_partition_are_embedded_by_many_tasks(spark):
    def factory():
        from pyspark import TaskContext
        return lambda pdf: [[float(TaskContext.get().partitionId()), 1.0]] * len(pdf)

    e = hooks.embed_spans(spans(spark, 200), ["id"], factory)
    assert e.select(F.round(F.get("embedding", F.lit(0)) / F.get("embedding", F.lit(1)), 3)).distinct().count() > 4


def test_mean_of_missing_null_and_short_vectors(spark):
    def vector(a):
        a = a // 100
        return None if a % 7 == 0 else [float(a % 11), None if a % 5 == 0 else 2.0] + ([1.0] if a % 3 else [])

    lists = hooks.embed_spans(spans(spark, 60), ["id"], lambda: lambda pdf: [vector(a) for a in pdf["win_start_ms"]], batch=7)
    wins = hooks.embedding_windows(spans(spark, 60)).collect()
    want = {}
    for i in {w["id"] for w in wins}:
        mine = [(vector(w["win_start_ms"]), w["win_end_ms"] - w["win_start_ms"]) for w in wins if w["id"] == i]
        mine = [m for m in mine if m[0] is not None]
        dims = [[(v[k], w) for v, w in mine if len(v) > k] for k in range(max((len(v) for v, _ in mine), default=0))]
        if dims and all(any(x is not None for x, _ in d) for d in dims):
            mean = [sum((x or 0) * w for x, w in d) / sum(w for _, w in d) for d in dims]
            want[i] = (sum(w for _, w in dims[0]), len(dims[0]), np.array(mean) / np.linalg.norm(mean))
    got = {r["id"]: r for r in lists.collect()}
    assert want and {i for i in got if None not in got[i]["embedding"]} == set(want)
    for i, (used, n, mean) in want.items():
        assert (got[i]["used_ms"], got[i]["n_sub"]) == (used, n) and np.allclose(got[i]["embedding"], mean)


def test_array_answers_equal_lists(spark):
    plain = lambda pdf: [[float(a % 13), 2.0] for a in pdf["win_start_ms"]]
    a, b = (hooks.embed_spans(spans(spark, 40), ["id"], lambda f=f: f) for f in (plain, lambda pdf: np.array(plain(pdf))))
    assert sorted(a.collect()) == sorted(b.collect())
