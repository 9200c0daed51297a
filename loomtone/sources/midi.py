"""Standard MIDI files as rows of events. Tasks only split the bytes; every figure is computed by Spark aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLUSH_ROWS = 20_000
CHANNEL_KINDS = ["note_off", "note_on", "poly_pressure", "control", "program_change", "channel_pressure", "pitch_bend"]
META_KINDS = {0x51: "set_tempo", 0x58: "time_signature", 0x59: "key_signature"}
FIELDS = [
    T.StructField("track", T.IntegerType()),
    T.StructField("ord", T.LongType()),
    T.StructField("delta", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("a", T.LongType()),
    T.StructField("b", T.LongType()),
]


def _varlen(data: bytes, pos: int, end: int) -> tuple[int, int]:
    value = 0
    while pos < end:
        byte = data[pos]
        pos += 1
        value = (value << 7) | (byte & 0x7F)
        if byte < 0x80:
            break
    return value & 0x7FFFFFFFFFFFFFFF, pos


def _meta(kind: int, body: bytes) -> tuple[str, int, int]:
    if kind == 0x51 and len(body) == 3:
        return "set_tempo", int.from_bytes(body, "big"), 0
    if kind == 0x58 and len(body) >= 2:
        return "time_signature", body[0], body[1]
    if kind == 0x59 and len(body) == 2:
        return "key_signature", int.from_bytes(body[:1], "big", signed=True), body[1]
    return "meta", kind, len(body)


def track_events(data: bytes, pos: int, end: int) -> Iterator[tuple]:
    """``(delta, kind, channel, a, b)`` of one track; a cut-off last event keeps its delta under kind ``tail``."""
    running = 0
    while pos < end:
        delta, pos = _varlen(data, pos, end)
        if pos >= end:
            yield delta, "tail", None, None, None
            return
        status = data[pos]
        if status >= 0x80:
            pos += 1
        elif running:
            status = running
        else:
            yield delta, "stray", None, status, None
            pos += 1
            continue
        if status >= 0xF0:
            kind = 0
            if status == 0xFF:
                kind, pos = (data[pos] if pos < end else 0), pos + 1
            elif status not in (0xF0, 0xF7):
                yield delta, "system", None, status, None
                continue
            size, pos = _varlen(data, pos, end)
            if pos + size > end:
                yield delta, "tail", None, None, None
                return
            if status == 0xFF:
                name, a, b = _meta(kind, data[pos : pos + size])
                yield delta, name, None, a, b
            else:
                yield delta, "sysex", None, status, size
            pos += size
            continue
        running = status
        size = 1 if 0xC0 <= status < 0xE0 else 2
        if pos + size > end:
            yield delta, "tail", None, None, None
            return
        yield delta, CHANNEL_KINDS[(status >> 4) - 8], status & 15, data[pos], data[pos + 1] if size == 2 else None
        pos += size


def file_events(data: bytes) -> Iterator[tuple]:
    """``(track, ord, delta, kind, channel, a, b)`` of a file; first its header as track -1 (a: tracks, b: division)."""
    if len(data) < 14 or data[:4] != b"MThd":
        return
    tracks, division = int.from_bytes(data[10:12], "big"), int.from_bytes(data[12:14], "big")
    yield -1, 0, 0, "header", None, tracks, division
    pos = 8 + int.from_bytes(data[4:8], "big")
    for track in range(tracks):
        if data[pos : pos + 4] != b"MTrk" or pos + 8 > len(data):
            return
        end = pos + 8 + int.from_bytes(data[pos + 4 : pos + 8], "big")
        for ordinal, event in enumerate(track_events(data, pos + 8, min(end, len(data)))):
            yield (track, ordinal, *event)
        pos = end


_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]


class MidiEvents:
    """Event rows of a table of ``(key, content)``, a bounded number at a time."""

    def eval(self, files: pa.RecordBatch) -> Iterator[pa.Table]:
        keys, rows = [], []
        for key, data in zip(files.column(0), files.column(1)):
            for event in file_events(data.as_py() or b""):
                keys.append(key.as_py())
                rows.append(event)
                if len(rows) >= FLUSH_ROWS:
                    yield self.pack(files, keys, rows)
                    keys, rows = [], []
        if rows:
            yield self.pack(files, keys, rows)

    @staticmethod
    def pack(files: pa.RecordBatch, keys: list, rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(keys, files.schema.field(0).type), *_columns(rows)], names=["file", *(f.name for f in FIELDS)])


class FileEvents:
    """Event rows of one file's bytes."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from file_events(content or b"")


def register_midi_events(spark: SparkSession, key_type: str = "string", prefix: str = "midi_events") -> None:
    """Make the event rows available to SQL, with the columns ``track, ord, delta, kind, channel, a, b``.

    ``SELECT * FROM midi_events(TABLE(SELECT path, content FROM files))`` takes whole batches and tells the first column, of ``key_type``, as ``file``;
    ``SELECT f.path, e.* FROM files f, LATERAL midi_events_of(f.content) e`` goes row by row, since Arrow table functions cannot stand in a lateral join. Bytes that
    are null or no MIDI give no row.
    """
    fields = T.StructType(FIELDS)
    with_key = T.StructType([T.StructField("file", T.DataType.fromDDL(key_type)), *FIELDS])
    spark.udtf.register(prefix, F.arrow_udtf(MidiEvents, returnType=with_key))
    spark.udtf.register(f"{prefix}_of", F.udtf(FileEvents, returnType=fields))


def midi_events(df: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """Long table ``(key, track, ord, delta, kind, channel, a, b)`` of MIDI bytes; one bounded batch at a time."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *FIELDS])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            arrow_key = batch.schema.field(0).type
            for i in range(batch.num_rows):
                file_key = batch.column(0)[i].as_py()
                for event in file_events(batch.column(1)[i].as_py() or b""):
                    ids.append(file_key)
                    rows.append(event)
                    if len(rows) >= FLUSH_ROWS:
                        yield pack(ids, rows, arrow_key)
                        ids, rows = [], []
            if rows:
                yield pack(ids, rows, arrow_key)

    def pack(ids: list, rows: list, key_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, key_type), *_columns(rows)], names=[key, *(f.name for f in FIELDS)])

    return df.select(key, content).mapInArrow(split, schema)
