"""Keyed, time-driven behaviour as Structured Streaming jobs; each takes a streaming (or batch) table of events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dialoom.operators import jumps

LOCK_AFTER, LOCK_MINUTES, COOLDOWN_SEC, RETENTION_DAYS = 5, 15, 60, 3  # fixed values


def latest_status(events: DataFrame, key: str = "job_id", ttl_days: float | None = None, final: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Latest status per job (update or complete mode); works on a batch table as well.

    With `ttl_days` a stream (update mode) forgets a job that long after its last event, and one with a `final` status as soon
    as no earlier event can arrive any more."""
    if events.isStreaming and ttl_days is not None:
        return _latest(events, key, "status", ttl_days, final, late).select(key, F.col("value").alias("status"), F.col("ts").alias("updated_at"))
    return events.groupBy(key).agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("l")).select(key, "l.status", F.col("l.ts").alias("updated_at"))


def _latest(events: DataFrame, key: str, value: str, ttl_days: float, final: Sequence[str], late: str) -> DataFrame:
    """key, value, ts whenever a key's latest event (by time, then event id) changes; keys leave the state by event time."""
    out = T.StructType([events.schema[key], T.StructField("value", T.StringType()), T.StructField("ts", T.TimestampType())])
    kept = T.StructType([T.StructField("value", T.StringType()), T.StructField("us", T.LongType()), T.StructField("event_id", T.LongType())])
    ttl, final = int(ttl_days * 86_400_000), set(final)

    def step(k, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        if st.hasTimedOut:
            st.remove()
            return
        had = st.get if st.exists else None
        best = had
        for pdf in batches:
            for v, t, i in zip(pdf[value], pdf["ts"], pdf["event_id"]):
                us = int(pd.Timestamp(t).value // 1000)
                if best is None or (us, i) > best[1:]:
                    best = (v, us, int(i))
        st.update(best)
        due = best[1] // 1000 + (1 if best[0] in final else ttl)
        st.setTimeoutTimestamp(max(due, st.getCurrentWatermarkMs() + 1))
        if best != had:
            yield pd.DataFrame({key: [k[0]], "value": [best[0]], "ts": [pd.Timestamp(best[1], unit="us", tz="UTC")]})

    return (events.withWatermark("ts", late).groupBy(key)
            .applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.EventTimeTimeout))


def lock_step(state: dict, us: int, window: int, limit: int) -> tuple[int, int] | None:
    """One failure at `us`: refused while the lock stands, else counted; (first, expiry) when it makes the lock."""
    n, last = state.get("n", 0), state.get("last", 0)
    if n >= limit and us < last + window:
        return None
    if n >= limit or us >= last + window:
        n = 0
    state["first"] = us if n == 0 else state["first"]
    state["n"], state["last"] = n + 1, us
    return (state["first"], us + window) if n + 1 == limit else None


def lockouts(failures: DataFrame, key: str = "user_id", minutes: int = LOCK_MINUTES, limit: int = LOCK_AFTER, late: str = "1 hour") -> DataFrame:
    """Locks: `limit` failures, each within `minutes` of the one before, lock a key for `minutes` from the last of them.

    Attempts during a lock are refused before they count, so they neither count nor renew it; afterwards counting starts
    anew. A batch table follows jumps slab by slab (a key may hold most rows), a stream keeps three numbers per live key.
    """
    window = minutes * 60_000_000
    if not failures.isStreaming:
        d = failures.select(key, F.unix_micros("ts").alias("us")).withColumn("tie", F.lit(0))
        locks = jumps.starts(d, [key], "us", "tie", jumps.lockout_step(window, limit), limit * window, limit * window).filter("flag")
        return locks.select(key, F.timestamp_micros("us").alias("first_at"), F.timestamp_micros("until").alias("expires_at"),
                            F.lit(limit).cast("long").alias("failures"))
    schema = T.StructType([failures.schema[key], T.StructField("first_at", T.TimestampType()), T.StructField("expires_at", T.TimestampType()),
                           T.StructField("failures", T.LongType())])
    kept = T.StructType([T.StructField(n, T.LongType()) for n in ("n", "first", "last")])

    def arrive(k, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        if st.hasTimedOut:
            st.remove()
            return
        state = dict(zip(("n", "first", "last"), st.get)) if st.exists else {}
        locks = [x for us in sorted(int(pd.Timestamp(t).value // 1000) for pdf in batches for t in pdf["ts"])
                 if (x := lock_step(state, us, window, limit))]
        st.update((state["n"], state["first"], state["last"]))
        st.setTimeoutTimestamp(max((state["last"] + window) // 1000, st.getCurrentWatermarkMs() + 1))
        at = lambda us: pd.Timestamp(us, unit="us", tz="UTC")
        yield pd.DataFrame({key: [k[0]] * len(locks), "first_at": [at(a) for a, _ in locks], "expires_at": [at(b) for _, b in locks],
                            "failures": [limit] * len(locks)})

    return (failures.withWatermark("ts", late).groupBy(key)
            .applyInPandasWithState(arrive, schema, kept, "append", GroupStateTimeout.EventTimeTimeout))


def cooldown(requests: DataFrame, key: str = "user_id", seconds: int = COOLDOWN_SEC, late: str = "1 hour") -> DataFrame:
    """Requests accepted at most once per period and key, in event order; in a stream inside each micro-batch."""
    if not requests.isStreaming:
        d = requests.select(key, F.unix_micros("ts").alias("us")).withColumn("tie", F.lit(0))
        got = jumps.starts(d, [key], "us", "tie", jumps.cooldown_step(seconds * 1_000_000), seconds * 1_000_000)
        return got.select(key, F.timestamp_micros("us").alias("ts"))
    out = T.StructType([requests.schema[key], T.StructField("ts", T.TimestampType())])
    state = T.StructType([T.StructField("until_us", T.LongType())])

    def step(k, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        if st.hasTimedOut:
            st.remove()
            return
        until = st.get[0] if st.exists else None
        seen = sorted(t for pdf in batches for t in pdf["ts"])
        kept = []
        for t in seen:
            us = int(pd.Timestamp(t).value // 1000)
            if until is None or us >= until:
                kept.append(t)
                until = us + seconds * 1_000_000
        st.update((until,))
        st.setTimeoutTimestamp(max(until // 1000, st.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(kept), "ts": kept})

    return (requests.withWatermark("ts", late).groupBy(key)
            .applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout))


def purge_due(flags: DataFrame, key: str = "job_id", days: int = RETENTION_DAYS, late: str = "1 hour") -> DataFrame:
    """Soft-deleted jobs whose retention has passed in event time; a restore before that cancels the purge.

    `flags`: key, action (delete/restore), ts. Emits key and the deletion time once the watermark passes the deadline.
    """
    out = T.StructType([flags.schema[key], T.StructField("deleted_at", T.TimestampType())])
    state = T.StructType([T.StructField("last_us", T.LongType()), T.StructField("deleted", T.BooleanType())])
    span = days * 86_400_000

    def step(k, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        if st.hasTimedOut:
            last, deleted = st.get
            st.remove()
            if deleted:
                yield pd.DataFrame({key: [k[0]], "deleted_at": [pd.Timestamp(last, unit="us", tz="UTC")]})
            return
        last, deleted = st.get if st.exists else (-1, False)
        for pdf in batches:
            for t, a in zip(pdf["ts"], pdf["action"]):
                us = int(pd.Timestamp(t).value // 1000)
                if us >= last:
                    last, deleted = us, a == "delete"
        if deleted:
            st.update((last, True))
            st.setTimeoutTimestamp(max(last // 1000 + span, st.getCurrentWatermarkMs() + 1))
        else:
            st.update((last, False))
            st.setTimeoutTimestamp(max(last // 1000 + span, st.getCurrentWatermarkMs() + 1))

    return (flags.withWatermark("ts", late).groupBy(key)
            .applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout))


def flag_state(flags: DataFrame, key: str = "job_id", ttl_days: float | None = None, late: str = "1 hour") -> DataFrame:
    """Soft delete and restore as the last event of a key (update or complete mode).

    With `ttl_days` a stream (update mode) forgets a key that long after its last event, and a restored one as soon as no earlier
    event can arrive any more."""
    if flags.isStreaming and ttl_days is not None:
        got = _latest(flags, key, "action", ttl_days, ("restore",), late)
        return got.select(key, (F.col("value") == "delete").alias("is_deleted"), F.col("ts").alias("changed_at"))
    return flags.groupBy(key).agg(F.max_by(F.struct("action", "ts"), F.struct("ts", "event_id")).alias("l")).select(
        key, (F.col("l.action") == "delete").alias("is_deleted"), F.col("l.ts").alias("changed_at"))


def append_transcripts(lines: DataFrame, path: str, checkpoint: str):
    """Append arriving transcript rows to the table, each line once within the watermark."""
    return (lines.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["job_id", "line_id"])
            .writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path))
