"""Aggregates over MIDI event rows ``(file_id, track, ord, delta, kind, channel, a, b)``.

All of them combine before the shuffle, so a file with very many events costs one partial row per task and track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.functions import numbers as N
from loomtone.functions.text import time_sig_text
from loomtone.operators.blocked import running_sum
from loomtone.operators.lookup import lookup_key_signature

#: Files whose events one task groups, about, where their number is known.
FILES_PER_TASK = 50_000

NOTE = "kind = 'note_on' AND b > 0"
KEY = "kind = 'key_signature' AND a BETWEEN -7 AND 7 AND b IN (0, 1)"


def midi_track_ticks(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Ticks per track: the sum of its deltas."""
    return events.filter("track >= 0").groupBy(key, "track").agg(F.sum("delta").alias("ticks"))


def midi_total_ticks(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Ticks of a file: its longest track."""
    return midi_track_ticks(events, key).groupBy(key).agg(F.max("ticks").alias("total_ticks"))


def midi_note_count(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Notes per file; a note-on with velocity zero ends a note and does not count."""
    return events.groupBy(key).agg(F.count_if(F.expr(NOTE)).alias("notes"))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def _mask(n: str, low: int, when: str) -> Column:
    """Bit set of the values ``low .. low + 63`` of a column, as a fixed-width aggregate."""
    inside = F.expr(when) & F.col(n).between(low, low + 63)
    return F.coalesce(F.bit_or(F.when(inside, _bit(F.col(n) - low))), F.lit(0).cast("bigint"))


def _members(mask: Column, low: int) -> Column:
    numbers = F.sequence(F.lit(low), F.lit(low + 63))
    return F.filter(numbers, lambda n: F.call_function("getbit", mask, n - low) == 1)


_LOWS = (0, 64, 128, 192)


def _program_masks() -> list[Column]:
    """Bit sets of all byte values: a damaged program byte may exceed 127 and still counts."""
    return [_mask("a", low, "kind = 'program_change'").alias(f"_p{low}") for low in _LOWS]


def _programs() -> Column:
    return F.concat(*[_members(F.col(f"_p{low}"), low) for low in _LOWS])


def midi_distinct_sets(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Sorted arrays of the channels that play notes and of the programs chosen."""
    got = events.groupBy(key).agg(
        _mask("channel", 0, NOTE).alias("_channels"), *_program_masks()
    )
    return got.select(
        key,
        _members(F.col("_channels"), 0).alias("channels"),
        _programs().alias("programs"),
    )


def _last(value: str, when: str) -> Column:
    return F.max_by(value, F.when(F.expr(when), F.col("ord")))


def _last_track(value: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("track")))


META = ["tempo_us", "ts_num", "ts_pow", "key_sf", "key_mi"]


def _per_track_meta() -> list[Column]:
    return [
        _last("a", "kind = 'set_tempo'").alias("tempo_us"),
        _last("a", "kind = 'time_signature'").alias("ts_num"),
        _last("b", "kind = 'time_signature'").alias("ts_pow"),
        _last("a", KEY).alias("key_sf"),
        _last("b", KEY).alias("key_mi"),
    ]


def midi_last_meta(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Last tempo, time signature and valid key signature of a file, in track then event order; null if it has none."""
    tracks = events.groupBy(key, "track").agg(*_per_track_meta())
    return tracks.groupBy(key).agg(*[_last_track(c).alias(c) for c in META])


def ticks_per_beat(division: Column) -> Column:
    """Division of the file header; a time-code division (high bit set) counts as the default."""
    return F.when(division < 32768, division).otherwise(F.lit(dims.DEFAULT_TICKS_PER_BEAT)).cast("int")


def midi_header(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Tracks and ticks per beat of each file."""
    return events.filter("kind = 'header'").select(
        key, F.col("a").cast("int").alias("tracks"), ticks_per_beat(F.col("b")).alias("ticks_per_beat")
    )


def midi_running_ticks(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Add the absolute tick of each event within its track."""
    return running_sum(events.filter("track >= 0"), [key, "track"], "ord", "delta", "tick")


def midi_summary(events: DataFrame, key: str = "file_id", files: int | None = None) -> DataFrame:
    """All facts of a file in one pass over its events: counts, sets, last signatures, and the figures they imply.

    ``files`` is the number of files, if it is known: events are then dealt by file to so many tasks that each groups about ``FILES_PER_TASK``, whatever
    partitions the session has or joins together. A join of the facts by file keeps this dealing. Without it, rows combine before the shuffle.
    """
    if files is not None:
        tasks = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files // FILES_PER_TASK))
        events = events.repartition(tasks, key)
    tracks = events.groupBy(key, "track").agg(
        F.sum("delta").alias("ticks"),
        F.count_if(F.expr(NOTE)).alias("notes"),
        _mask("channel", 0, NOTE).alias("_channels"),
        *_program_masks(),
        F.max(F.when(F.expr("kind = 'header'"), F.col("a"))).alias("tracks"),
        F.max(F.when(F.expr("kind = 'header'"), F.col("b"))).alias("division"),
        *_per_track_meta(),
    )
    files = tracks.groupBy(key).agg(
        F.max("ticks").alias("total_ticks"),
        F.sum("notes").alias("notes"),
        *[F.bit_or(c).alias(c) for c in ("_channels", *(f"_p{low}" for low in _LOWS))],
        F.max("tracks").cast("int").alias("tracks"),
        F.max("division").alias("division"),
        *[_last_track(c).alias(c) for c in META],
    )
    tempo_us = F.coalesce(F.col("tempo_us"), F.lit(dims.DEFAULT_TEMPO_US))
    signature = lookup_key_signature(F.col("key_sf"), F.col("key_mi"))
    files = files.select(
        key,
        "tracks",
        ticks_per_beat(F.col("division")).alias("ticks_per_beat"),
        "total_ticks",
        "notes",
        _members(F.col("_channels"), 0).alias("channels"),
        _programs().alias("programs"),
        "tempo_us",
        time_sig_text(F.col("ts_num"), F.col("ts_pow")).alias("time_signature"),
        signature["key"].alias("key_signature"),
        signature["key_type"].alias("key_type"),
        N.bpm(tempo_us).alias("tempo"),
    ).withColumn("duration", N.midi_duration(F.col("total_ticks"), tempo_us, F.col("ticks_per_beat")))
    beats = F.coalesce(N.beat_count(F.col("tempo"), F.col("duration")), F.lit(0))
    return files.withColumn("beat_count", beats)
