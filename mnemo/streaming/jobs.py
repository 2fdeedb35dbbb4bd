"""Continuous forms of the jobs, over a stream of commits or accesses.

Each has a batch twin; run with ``trigger(availableNow=True)`` both give the
same rows.  State is keyed.  Watermarks, timers or slots bound it, but for
``stream_revise`` and, without ``late``, ``stream_newest_wins``, which keep one
row for each key, and the sessions of ``stream_working_memory``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemo.operators.revise import FIELDS, decide
from mnemo.operators.upsert import commit_log, upsert
from mnemo.operators.working import as_puts, replay_rows

DAY_US = 86_400_000_000


def upsert_writer(store: str, log: str, now: float) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch into the newest version under ``store`` and appends its log rows.

    Versions are named by batch, so a batch that is run again writes the same place.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id:
            current = spark.read.parquet(f"{store}/v={batch_id - 1}")
        else:
            current = batch.limit(0)
        upsert(current, batch, now).write.mode("overwrite").parquet(f"{store}/v={batch_id}")
        commit_log(current, batch).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return write


def stream_upsert(commits: DataFrame, store: str, log: str, checkpoint: str, now: float):
    """A query that keeps ``store`` and ``log`` up to date."""
    return commits.writeStream.foreachBatch(upsert_writer(store, log, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _revise(strategy: str) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = dict(zip(BELIEF, state.get, strict=True)) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        rows = rows.astype(object).where(rows.notna(), None)
        out = []
        for x in rows.to_dict("records"):
            decision, old = decide(strategy, old, x)
            out.append((key[0], x["seq"], decision))
        state.update(tuple(old[c] for c in BELIEF))
        yield pd.DataFrame(out, columns=["key", "seq", "decision"])

    return run


BELIEF = (*FIELDS, "entrenchment", "revisions")


def stream_revise(proposals: DataFrame, strategy: str = "entrenchment") -> DataFrame:
    """(key, seq, decision) as proposals arrive; in order of ``seq`` within a batch, batches in order of arrival.

    State is one belief a key and never leaves: a belief holds until it is revised.
    Columns that the strategy does not need may be missing.
    """
    for name, kind in (("created_at", "double"), ("is_verified", "boolean")):
        proposals = proposals if name in proposals.columns else proposals.withColumn(name, F.lit(None).cast(kind))
    kinds = {f.name: f.dataType.simpleString() for f in proposals.schema}
    held = ", ".join(f"{c} {kinds[c]}" for c in FIELDS) + ", entrenchment double, revisions int"
    return proposals.select("key", *FIELDS).groupBy("key").applyInPandasWithState(_revise(strategy), "key string, seq long, decision string", held, "append", GroupStateTimeout.NoTimeout)


def stream_op_metrics(commits: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Operations per window and type; ``ts`` is the event time."""
    by = F.window("ts", window)
    return commits.withWatermark("ts", late).groupBy(by, "op_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op_type", "n")


def stream_recent(commits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Accesses of each key in the last minute, every ten seconds."""
    by = F.window("ts", "60 seconds", "10 seconds")
    return commits.withWatermark("ts", late).groupBy(by, "key").agg(F.count("*").alias("n")).select(F.col("window.end").alias("at"), "key", "n")


def stream_sessions(commits: DataFrame, gap: str = "30 minutes", late: str = "1 hour", min_entries: int = 6) -> DataFrame:
    """Sessions closed by a gap, with their entries, where there are enough."""
    by = F.session_window("ts", gap)
    out = commits.withWatermark("ts", late).groupBy(by, "session_id").agg(F.count("*").alias("entries"), F.max("importance").alias("importance"))
    return out.where(F.col("entries") >= min_entries).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "entries", "importance")


def _expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (ends,) = state.get
        state.remove()
        yield pd.DataFrame([(key[0], ends)], columns=["key", "ends_ms"])
        return
    ends = max(int(x) for b in batches for x in b["ends_ms"])
    ends = max(ends, state.get[0]) if state.exists else ends
    if ends <= state.getCurrentWatermarkMs():
        if state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], ends)], columns=["key", "ends_ms"])
        return
    state.update((ends,))
    state.setTimeoutTimestamp(ends)


def stream_expiry(entries: DataFrame, late: str = "1 hour", default_ttl: float = 14 * 86400.0) -> DataFrame:
    """(key, ends_ms) when an entry's ttl or end passes in event time; entries have ts, ttl, invalid_at."""
    ttl = F.coalesce(F.when(F.col("ttl") > 0, F.col("ttl")), F.lit(default_ttl))
    ends = F.least(F.unix_micros("ts") / 1000 + ttl * 1000, F.coalesce(F.when(F.col("invalid_at") > 0, F.col("invalid_at") * 1000), F.lit(float(1 << 53))))
    rows = entries.withWatermark("ts", late).select("key", "ts", ends.cast("long").alias("ends_ms"))
    return rows.groupBy("key").applyInPandasWithState(_expire, "key string, ends_ms long", "ends long", "append", GroupStateTimeout.EventTimeTimeout)


def _newest(timed: bool) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, seq, value, stale = state.get if state.exists else (float("-inf"), -1, None, 0)
        for b in batches:
            for r in b.itertuples():
                if (r.created_at, -r.seq) > (at, -seq):
                    at, seq, value = r.created_at, r.seq, r.value
                else:
                    stale += 1
        state.update((at, seq, value, stale))
        if timed:
            state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(key[0], at, seq, value, stale)], columns=["key", "created_at", "seq", "value", "stale"])

    return run


def stream_newest_wins(commits: DataFrame, late: str | None = None) -> DataFrame:
    """The newest commit of each key, and how many rows came that changed nothing; order of arrival does not matter.

    With ``late`` (commits need ``ts``) a key's state leaves once the watermark
    has passed its commit.  Rows behind the watermark are dropped before, so
    whatever comes for the key then is newer; Spark counts the dropped ones
    (``numRowsDroppedByWatermark``).  Without it every key is kept.
    """
    columns, timeout = ["key", "created_at", "seq", "value"], GroupStateTimeout.NoTimeout
    if late:
        commits, columns, timeout = commits.withWatermark("ts", late), [*columns, "ts"], GroupStateTimeout.EventTimeTimeout
    out, held = "key string, created_at double, seq long, value string, stale long", "created_at double, seq long, value string, stale long"
    return commits.select(*columns).groupBy("key").applyInPandasWithState(_newest(bool(late)), out, held, "update", timeout)


def _slots(slots: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
        out = replay_rows(pd.concat(list(batches)), held, key[0], slots)
        state.update((list(held), *[[e[i] for e in held.values()] for i in range(4)]))
        yield out

    return run


def stream_working_memory(events: DataFrame, slots: int = 8) -> DataFrame:
    """Put, use and eviction history of each session; its state is at most ``slots`` entries with their heat."""
    held = "keys array<string>, importance array<double>, at array<double>, heat array<double>, heat_at array<double>"
    return as_puts(events).groupBy("session_id").applyInPandasWithState(_slots(slots), "session_id string, seq long, key string, evicted string, held int", held, "append", GroupStateTimeout.NoTimeout)


def consolidate_with(callback: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: hands evicted entries of a batch to a caller's function."""
    return lambda batch, _: callback(batch.where("evicted is not null"))
