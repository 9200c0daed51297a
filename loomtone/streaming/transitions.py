"""Conversion states followed event by event: what state each file is in, and which events do not fit the order of states.

One value state per file holds its newest event; timers, in event time, report files that got stuck and let finished ones be forgotten. So the state grows with the files in
work and not with all files ever seen. Needs the RocksDB state store, which :func:`follow_status` chooses for its own query.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomtone.streaming.status import keep_changes

# The states, and what may follow each; a finished file may be queued for another run.
LEGAL = {
    None: ("pending", "queued"),
    "pending": ("queued",),
    "queued": ("converting",),
    "converting": ("completed", "failed"),
    "completed": ("queued",),
    "failed": ("queued",),
}
AT_WORK = ("queued", "converting")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def verdict(last: tuple | None, state: str | None, us: int | None, seq: int | None) -> str:
    """How an event fits what is known of its file; ``last``: ``(state, us, seq)`` of its newest event."""
    if us is None or seq is None:
        return "undated"
    if last is not None and (us, seq) <= last[1:]:
        return "repeated" if (us, seq) == last[1:] else "late"
    return "ok" if state in LEGAL.get(last[0] if last else None, ()) else "illegal"


class Follower(StatefulProcessor):
    """The newest event of a file; one row per event, and one when a file is stuck."""

    def __init__(self, stuck_ms: int, forget_ms: int, timers: bool):
        self.stuck_ms, self.forget_ms, self.timers = stuck_ms, forget_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "state string, us bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        last = before
        for r in sorted(rows, key=lambda r: (r.us is None or r.seq is None, r.us or 0, r.seq or 0)):
            told = verdict(last, r.state, r.us, r.seq)
            yield Row(file=key[0], us=r.us, seq=r.seq, state=r.state, error=r.error, previous=last[0] if last else None, verdict=told)
            if told in ("ok", "illegal"):
                last = (r.state, r.us, r.seq)
        if last != before:
            self.newest.update(last)
            if self.timers:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(last[1] // 1000 + (self.stuck_ms if last[0] in AT_WORK else self.forget_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.newest.exists():
            return
        state, us, seq = self.newest.get()
        due = us // 1000 + self.forget_ms
        if state in AT_WORK and expiredTimerInfo.getExpiryTimeInMs() < due:
            self.handle.registerTimer(due)
            yield Row(file=key[0], us=us, seq=seq, state=state, error=None, previous=state, verdict="stuck")
        else:
            self.newest.clear()


def status_transitions(events: DataFrame, key: str = "file_id", lateness: str = "1 day", stuck_after: int = 3_600, forget_after: int = 7 * 86_400) -> DataFrame:
    """``(key, ts, seq, state, error, previous, verdict)``: a row per event ``(key, ts, seq, state, error)``.

    A file's newest event, by ``ts`` and ``seq``, is its state. ``verdict``: ``ok``; ``illegal`` where the state may not follow the one before, which is taken over all the same;
    ``late`` for events older than the newest one and ``repeated`` for that one again, which change nothing; ``undated`` without time or number. Streams also get
    a ``stuck`` row for each file that is queued or converting and has had no event for ``stuck_after`` seconds of event time. After ``forget_after`` seconds, more than
    ``stuck_after``, a file's state is forgotten, and its next event counts as its first. Events further behind than ``lateness`` are dropped by the watermark.
    A batch of events gives the same rows without timers.
    """
    assert forget_after > stuck_after
    timers = events.isStreaming
    dated = events.withWatermark("ts", lateness) if timers else events
    slim = dated.select(F.col(key).alias("file"), *(["ts"] if timers else []), F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint").alias("seq"), "state", "error")
    kind = events.schema[key].dataType.simpleString()
    told = slim.groupBy("file").transformWithState(
        Follower(stuck_after * 1000, forget_after * 1000, timers),
        f"file {kind}, us bigint, seq bigint, state string, error string, previous string, verdict string", "append", "EventTime" if timers else "None")
    return told.select(F.col("file").alias(key), F.timestamp_micros("us").alias("ts"), "seq", "state", "error", "previous", "verdict")


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries that start, and batch plans that run, within it keep state in RocksDB; the session's own choice comes back after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def follow_status(events: DataFrame, out: str, checkpoint: str, key: str = "file_id", once: bool = True, **options) -> StreamingQuery:
    """Write the transitions of a stream of events, each micro-batch to its own ``batch=`` folder, which a repeated batch overwrites."""
    with rocks_state(events.sparkSession):
        return keep_changes(status_transitions(events, key, **options), out, checkpoint, "append", once)


def states_of(log: DataFrame, key: str = "file_id") -> DataFrame:
    """``(key, state, error, ts)`` as the log of transitions leaves each file."""
    newest = F.max_by(F.struct("state", "error", "ts"), F.struct("ts", "seq"))
    return log.where("verdict IN ('ok', 'illegal')").groupBy(key).agg(newest.alias("s")).select(key, "s.*")
