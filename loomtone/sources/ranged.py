"""Loop files read by ranges: a data source that walks the chunk headers and fetches only what is decoded.

Audio data is most of a file and is never read: chunks are skipped by their sizes, whatever the file's length. The source reads a written listing, so each file
has one row: what its chunks say, or why it could not be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomtone import dims
from loomtone.sources.containers import PAYLOAD_TYPES
from loomtone.sources.listing import open_store, write_listing

SCHEMA = ("path string, length bigint, modificationTime timestamp, format string, error string, "
          "chunks array<struct<ord:int,type:string,off:bigint,size:decimal(20,0),payload:binary>>, content binary, bytes_read bigint")
_CHUNK = pa.struct([("ord", pa.int32()), ("type", pa.string()), ("off", pa.int64()), ("size", pa.decimal128(20, 0)), ("payload", pa.binary())])
_ARROW = pa.schema([
    ("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC")), ("format", pa.string()), ("error", pa.string()),
    ("chunks", pa.list_(_CHUNK)), ("content", pa.binary()), ("bytes_read", pa.int64())])

#: Bytes that are fetched with each header, so that neighbouring small chunks come with it.
READ_AHEAD = 16 << 10
#: A longer MIDI file or decoded chunk makes the file an error row.
MOST_PAYLOAD = 256 << 20
#: More chunks make the file an error row: no loop has them, damaged ones may.
MOST_CHUNKS = 1 << 20
FILES_PER_TASK = 1_000
_FLUSH = 16 << 20

_KEPT_IDS = tuple(bytes.fromhex(u) for u in (dims.TAG_UUID, dims.MARKER_UUID))
_TEXT = [chr(c) if c < 128 else "�" for c in range(256)]


class Unreadable(Exception):
    """Why a file gives no record."""


class Ranges:
    """Byte ranges of an open file; a short range fetches its surroundings ahead, which answer the next ones."""

    def __init__(self, file, ahead: int = READ_AHEAD):
        self.file, self.ahead, self.size = file, ahead, file.size()
        self.start, self.held, self.bytes_read = 0, b"", 0

    def at(self, first: int, size: int) -> bytes:
        stop = min(first + size, self.size)
        if not self.start <= first <= stop <= self.start + len(self.held):
            self.file.seek(first)
            self.start, self.held = first, self.file.read(min(max(size, self.ahead), self.size - first))
            self.bytes_read += len(self.held)
        return self.held[first - self.start:stop - self.start]


def walk(ranges: Ranges, start: int, header: int, most_payload: int, most_chunks: int) -> list[tuple]:
    """``(ord, type, off, size, payload)`` of the chunks from ``start`` on: sizes of ``header - 4`` bytes, in files with 32-bit sizes padded to even."""
    n, pos, out = ranges.size, start, []
    while pos < n - header:
        if len(out) >= most_chunks:
            raise Unreadable(f"more than {most_chunks} chunks")
        head = ranges.at(pos, header)
        kind, size = "".join(map(_TEXT.__getitem__, head[:4])), int.from_bytes(head[4:], "big")
        off = pos + header
        held, payload = min(size, n - off), None
        if kind in PAYLOAD_TYPES:
            if kind == "uuid" and held > 16 and ranges.at(off, 16) not in _KEPT_IDS:
                held = 16  # of chunks that nothing decodes only the identifier
            if held > most_payload:
                raise Unreadable(f"chunk {kind} of {held} bytes")
            payload = ranges.at(off, held)
        out.append((len(out), kind, off, size, payload))
        pos = min(off + size + (size % 2 if header == 8 else 0), n)
    return out


def read_loop(ranges: Ranges, path: str, most_payload: int = MOST_PAYLOAD, most_chunks: int = MOST_CHUNKS):
    """``(format, error, chunks, content)`` of a file; ``content`` for MIDI files only."""
    head = ranges.at(0, 12)
    try:
        if head[:4] == b"caff":
            if ranges.size < 8:
                return "CAF", "Invalid CAF file: too short", [], None
            return "CAF", None, walk(ranges, 8, 12, most_payload, most_chunks), None
        if head[:4] == b"FORM" and head[8:12] == b"AIFF":
            return "AIFF", None, walk(ranges, 12, 8, most_payload, most_chunks), None
        if head[:4] == b"MThd":
            if ranges.size > most_payload:
                raise Unreadable(f"MIDI file of {ranges.size} bytes")
            return "MIDI", None, None, ranges.at(0, ranges.size)
    except Unreadable as e:
        return None, f"{e}: {path}", None, None
    return None, f"Unknown file format: {path}", None, None


@dataclass
class FileGroup(InputPartition):
    """Some rows of one part of the listing."""

    part: str
    first: int
    rows: int


class LoopReader(DataSourceReader):
    def __init__(self, options: dict):
        self.listing = options["listing"]
        self.rows = int(options.get("files_per_task", FILES_PER_TASK))
        self.ahead = int(options.get("read_ahead", READ_AHEAD))
        self.most = int(options.get("most_payload", MOST_PAYLOAD)), int(options.get("most_chunks", MOST_CHUNKS))

    def partitions(self) -> list[FileGroup]:
        """Groups of rows of the listing's parts, from their footers: as many parts as listing tasks, whatever the number of files."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, inner, prefix = open_store(self.listing)
        parts = sorted(i.path for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.path.endswith(".parquet"))
        groups = []
        for part in parts:
            n = pq.read_metadata(part, filesystem=system).num_rows
            groups += [FileGroup(prefix + part, k, min(self.rows, n - k)) for k in range(0, n, self.rows)]
        return groups or [FileGroup("", 0, 0)]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, length, time, reason in self._listed(partition):
            rows.append(self._row(path, length, time, reason))
            held += 200 + rows[-1][-1]
            if held >= _FLUSH:
                yield self._pack(rows)
                rows, held = [], 0
        if rows:
            yield self._pack(rows)

    def _listed(self, group: FileGroup) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        if not group.rows:
            return
        system, inner, _ = open_store(group.part)
        at = 0
        with pq.ParquetFile(inner, filesystem=system) as part:
            for batch in part.iter_batches(self.rows, columns=["kind", "path", "length", "modificationTime", "reason"]):
                own = batch.slice(max(group.first - at, 0), max(min(group.first + group.rows - at, batch.num_rows) - max(group.first - at, 0), 0))
                at += batch.num_rows
                for kind, *row in zip(*(c.to_pylist() for c in own.columns)):
                    if kind == 0:
                        yield row
                if at >= group.first + group.rows:
                    return

    def _row(self, path: str, length, time, reason) -> tuple:
        if reason is not None:
            return path, length, time, None, reason, None, None, 0
        try:
            system, inner, _ = open_store(path)
            with system.open_input_file(inner) as file:
                ranges = Ranges(file, self.ahead)
                return path, ranges.size, time, *read_loop(ranges, path, *self.most), ranges.bytes_read
        except OSError as e:
            return path, length, time, None, f"cannot be read ({type(e).__name__}): {path}", None, None, 0

    @staticmethod
    def _pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        columns[5] = [None if c is None else [dict(zip(("ord", "type", "off", "size", "payload"), chunk)) for chunk in c] for c in columns[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class LoopSource(DataSource):
    """``spark.read.format("loops").option("listing", folder)``: one row per file of a listing that :func:`write_listing` wrote.

    Options: ``files_per_task``, ``read_ahead``, ``most_payload``, ``most_chunks``.
    """

    @classmethod
    def name(cls) -> str:
        return "loops"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LoopReader:
        return LoopReader(self.options)


def read_loops(spark: SparkSession, listing: str, **options) -> DataFrame:
    """The ``loops`` source over a written listing."""
    spark.dataSource.register(LoopSource)
    return spark.read.format("loops").options(listing=listing, **options).load()


def scan_loops(spark: SparkSession, root: str, recursive: bool = False, **options) -> DataFrame:
    """Finished loops and MIDI files below ``root``: format, error and chunks of each listed file, see :func:`read_loop`.

    Lists once, in tasks, when called; empty, hidden and unreadable files are rows with an error.
    """
    return read_loops(spark, write_listing(spark, root, dims.LOOP_EXTENSIONS, recursive), **options)
