"""Streaming jobs give what their batch twins give on the same events."""
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from dialoom.streaming import jobs

SCHEMA = "user_id bigint, event_id bigint, status string, action string, ts timestamp"


def events(seed=1, n=60):
    r, t, out = random.Random(seed), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for i in range(n):
        t += timedelta(seconds=r.randrange(5, 400))
        out.append((r.randrange(3), i, r.choice(["PENDING", "DONE"]), r.choice(["delete", "restore"]), t))
    return out


def stream(spark, tmp_path, rows, name, build, mode, per_file=20):
    src = str(tmp_path / "in")
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i:i + per_file], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_latest_status(spark, tmp_path):
    rows = events()
    got = stream(spark, tmp_path, rows, "st", lambda s: jobs.latest_status(s.withColumnRenamed("user_id", "job_id")), "complete")
    want = jobs.latest_status(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("user_id", "job_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_flag_state(spark, tmp_path):
    rows = events(2)
    fn = lambda s: jobs.flag_state(s, "user_id")
    got = stream(spark, tmp_path, rows, "fl", fn, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fn(spark.createDataFrame(rows, SCHEMA)).collect()))


def state_rows(spark, tmp_path, rows, build):
    """Updates of a stream over one file a batch, and how many keys the state holds after each batch."""
    src, seen = str(tmp_path / "in"), []
    for some in rows:
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(s).writeStream.foreachBatch(lambda df, i: seen.extend(map(tuple, df.collect()))).outputMode("update").option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        return seen, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()


def test_state_of_silent_and_finished_keys_goes(spark, tmp_path):
    """Latest values equal the batch table; a day after its last event, or once done, a key is forgotten."""
    t, hour = datetime(2024, 1, 1, tzinfo=timezone.utc), timedelta(hours=1)
    rows = [[(1, 0, "PENDING", "delete", t), (2, 1, "DONE", "restore", t), (3, 2, "PENDING", "delete", t + hour)],
            [(1, 4, "RUNNING", "delete", t + hour), (1, 3, "PENDING", "restore", t + hour / 2), (3, 5, "DONE", "restore", t + 2 * hour)],
            [(9, 6, "DONE", "restore", t + 10 * hour)], [(9, 7, "DONE", "restore", t + 40 * hour)], [(9, 8, "DONE", "restore", t + 80 * hour)],
            [(9, 9, "DONE", "restore", t + 120 * hour)]]
    flat = spark.createDataFrame([r for some in rows for r in some], SCHEMA)
    seen, held = state_rows(spark, tmp_path, rows, lambda s: jobs.latest_status(s, "user_id", 1, ("DONE",)))
    last = {k: (v, ts) for k, v, ts in seen}
    assert last == {r["user_id"]: (r["status"], r["updated_at"]) for r in jobs.latest_status(flat, "user_id").collect()}
    assert max(held) >= 3 and held[-1] <= 1
    seen, held = state_rows(spark, tmp_path / "f", rows, lambda s: jobs.flag_state(s, "user_id", 1))
    assert {k: (v, ts) for k, v, ts in seen} == {r["user_id"]: (r["is_deleted"], r["changed_at"]) for r in jobs.flag_state(flat, "user_id").collect()}
    assert max(held) >= 3 and held[-1] <= 1


def test_lockouts(spark, tmp_path):
    rows = events(3, 80)
    closer = (9, 999, "x", "delete", rows[-1][4] + timedelta(days=2))  # moves the watermark past all sessions
    last = (9, 1000, "x", "delete", rows[-1][4] + timedelta(days=4))
    fn = lambda s: jobs.lockouts(s, minutes=15, limit=3)
    got = stream(spark, tmp_path, rows + [closer, last], "lk", fn, "append")
    want = fn(spark.createDataFrame(rows, SCHEMA)).collect()
    assert want and sorted(map(tuple, got.filter("user_id <> 9").collect())) == sorted(map(tuple, want))


def test_cooldown(spark, tmp_path):
    rows = events(4, 60)
    got = stream(spark, tmp_path, rows, "cd", lambda s: jobs.cooldown(s, seconds=600), "append")
    want, until = [], {}
    for u, _, _, _, t in rows:
        if u not in until or t >= until[u]:
            want.append((u, t.timestamp()))
            until[u] = t + timedelta(seconds=600)
    assert sorted((r["user_id"], r["ts"].astimezone().timestamp()) for r in got.collect()) == sorted(want)


def test_purge_due(spark, tmp_path):
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    day = timedelta(days=1)
    rows = [(1, 0, "", "delete", t), (2, 1, "", "delete", t), (2, 2, "", "restore", t + day), (3, 3, "", "delete", t + 6 * day), (9, 4, "", "restore", t + 7 * day), (9, 5, "", "restore", t + 8 * day)]
    got = stream(spark, tmp_path, rows, "pg", lambda s: jobs.purge_due(s, "user_id"), "append", per_file=1)
    assert [r["user_id"] for r in got.collect()] == [1]


def test_append_is_once(spark, tmp_path):
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "a", t), (1, 1, "a", t), (1, 2, "b", t)], "job_id bigint, line_id bigint, text string, ts timestamp").write.parquet(src)
    s = spark.readStream.schema("job_id bigint, line_id bigint, text string, ts timestamp").parquet(src)
    q = jobs.append_transcripts(s, out, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).count() == 2


def test_entry_contract(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["recording_id", "seg_id", "overlap_ms", "overlap_ratio"]
