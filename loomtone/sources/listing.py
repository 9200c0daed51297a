"""Listing a library in tasks: the driver sees no file names, only whether another round is needed.

A round lists folders, one row each. A folder of more than ``width`` entries is not told at once: the task counts its names, draws a sample and hands on
ranges of names, which the tasks of the next round list side by side, so a flat library of millions of files is the work of many tasks. Extensions are tested on names
before a file is looked at. Rounds are written to the shared folder; a lost task repeats its folders.
"""

from __future__ import annotations

import os
import random
import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone.workspace import forget_later, scratch_path

#: Entries of a folder that one task tells; a larger folder is divided by names.
WIDTH = 10_000
_SAMPLE = 4_096
_FILE, _FOLDER, _RANGE = 0, 1, 2
ROWS = "kind int, path string, length bigint, modificationTime timestamp, reason string, low string, high string, hidden boolean"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC")), ("reason", pa.string()),
    ("low", pa.string()), ("high", pa.string()), ("hidden", pa.bool_())])


def open_store(path: str):
    """``(filesystem, plain path, prefix)`` of a Hadoop path: names are taken as they are, with blanks, ``#`` and ``%``."""
    from pyarrow import fs

    scheme, authority, inner = re.match(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?)?(.*)$", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), inner, path[: len(path) - len(inner)]
    bucket = scheme in ("s3", "s3a", "s3n", "gs")
    system, _ = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority or ''}/")
    return system, f"{authority}{inner}" if bucket else inner, f"{scheme}://" if bucket else f"{scheme}://{authority or ''}"


class Entry(NamedTuple):
    """One name in a folder; ``look`` gives its bytes and time, and may fail."""

    name: str
    is_dir: bool
    look: object


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def entries(folder: str) -> Iterator[Entry]:
    """What a folder holds, as it comes. Local folders are streamed and files looked at one by one; links to folders are not followed.

    Stores behind ``pyarrow.fs`` answer with names, sizes and times together.
    """
    from pyarrow import fs

    system, inner, _ = open_store(folder)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(inner) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield Entry(e.name, True, None)
                elif not e.is_dir():
                    yield Entry(e.name, False, lambda e=e: (e.stat().st_size, _time(e.stat().st_mtime)))
    else:
        for i in system.get_file_info(fs.FileSelector(inner)):
            yield Entry(i.base_name, i.type == fs.FileType.Directory, lambda i=i: (i.size, i.mtime))


def suffix(name: str) -> str:
    """Lower-cased extension; empty where there is none or the name only starts with a dot."""
    head, dot, tail = name.rpartition(".")
    return tail.lower() if head and dot and tail else ""


def name_ranges(names: list[str], count: int, width: int, most: int) -> list[tuple[str | None, str | None]]:
    """Ranges ``[low, high)`` over all names, of about ``width`` each and at most ``most`` of them, from a sample of the names."""
    held = sorted(set(names))
    parts = max(1, min(most, -(-count // width), len(held)))
    cuts = sorted({held[k * len(held) // parts] for k in range(1, parts)})
    return list(zip([None, *cuts], [*cuts, None]))


class _Lister:
    """What a task does with the folders and ranges of a round."""

    def __init__(self, extensions: tuple[str, ...] | None, recursive: bool, width: int, parts: int):
        self.extensions, self.recursive, self.width, self.parts = extensions, recursive, width, parts

    def told(self, folder: str, e: Entry, hidden: bool) -> tuple | None:
        hidden = hidden or e.name.startswith((".", "_"))
        path = f"{folder.rstrip('/')}/{e.name}"
        if e.is_dir:
            return (_FOLDER, path, None, None, None, None, None, hidden) if self.recursive else None
        if self.extensions is not None and suffix(e.name) not in self.extensions:
            return None
        try:
            path.encode()
        except UnicodeEncodeError:
            return _FILE, path.encode("utf-8", "replace").decode(), None, None, "unreadable name", None, None, hidden
        try:
            length, time = e.look()
        except OSError:
            return _FILE, path, None, None, "unreadable file", None, None, hidden
        reason = "empty file" if length == 0 else "hidden file" if hidden else None
        return _FILE, path, length, time, reason, None, None, hidden

    def folder(self, folder: str, low: str | None, high: str | None, divided: bool, hidden: bool) -> Iterator[tuple]:
        try:
            wanted = (e for e in entries(folder) if (low is None or e.name >= low) and (high is None or e.name < high))
            first, sample, count, rng = [], [], 0, random.Random(folder)
            for e in wanted:
                count += 1
                if divided:
                    row = self.told(folder, e, hidden)
                    if row:
                        yield row
                elif count <= self.width:
                    first.append(e)
                else:
                    if not sample:
                        sample, first = [f.name for f in first], []
                    if len(sample) < _SAMPLE:
                        sample.append(e.name)
                    else:
                        k = rng.randrange(count)
                        if k < len(sample):
                            sample[k] = e.name
        except OSError:
            yield _FILE, folder, None, None, "unreadable folder", None, None, hidden
            return
        for e in first:
            row = self.told(folder, e, hidden)
            if row:
                yield row
        if sample:
            readable = [n for n in sample if n.isascii() or n.encode("utf-8", "ignore").decode() == n]
            for a, b in name_ranges(readable, count, self.width, self.parts):
                yield _RANGE, folder, None, None, None, a, b, hidden

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for folder, low, high, divided, hidden in zip(*(c.to_pylist() for c in batch.columns)):
                for row in self.folder(folder, low, high, divided, hidden):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield self.pack(rows)
                        rows = []
        if rows:
            yield self.pack(rows)

    @staticmethod
    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as Spark's file sources spell it, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_listing(spark: SparkSession, root: str, extensions: Iterable[str] | None = None, recursive: bool = True, width: int = WIDTH,
                  parts: int | None = None) -> str:
    """List ``root`` and give the folder of the written listing, for :func:`read_listing` and the ``loops`` source.

    ``parts``: tasks of a round and most ranges of one folder; the session's shuffle partitions if not given.
    """
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = scratch_path(spark, "listing")
    lister = _Lister(None if extensions is None else tuple(e.lower() for e in extensions), recursive, width, parts)
    start = "path string, low string, high string, divided boolean, hidden boolean"
    level, depth = spark.createDataFrame([(qualified(spark, root), None, None, False, False)], start), 0
    while True:
        target = f"{base}/round{depth}"
        # a given number, so that small rows of much work are not coalesced into few tasks
        level.repartition(parts if depth else 1, "path", "low").mapInArrow(lister, ROWS).write.parquet(target)
        told = spark.read.schema(ROWS).parquet(target).where(F.col("kind") != _FILE)
        level = told.select("path", "low", "high", (F.col("kind") == _RANGE).alias("divided"), "hidden")
        depth += 1
        if level.isEmpty():
            break
    forget_later(spark, base)
    return base


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length, modificationTime, reason)`` of a written listing, one row per file; ``reason`` tells why a file is not to be read, null for good ones."""
    rows = spark.read.option("recursiveFileLookup", "true").schema(ROWS).parquet(folder)
    return rows.where(F.col("kind") == _FILE).select("path", "length", "modificationTime", "reason")


def list_library(spark: SparkSession, root: str, extensions: Iterable[str] | None = None, recursive: bool = True, **options) -> DataFrame:
    """Every file below ``root`` with one of the extensions, in any letter case (all files without extensions).

    ``reason``: ``empty file``, ``hidden file`` (a name or a folder below the root begins with a dot or an underscore), ``unreadable file``,
    ``unreadable folder`` (a row for the folder), ``unreadable name`` (not UTF-8); null for files to read.
    """
    return read_listing(spark, write_listing(spark, root, extensions, recursive, **options))
