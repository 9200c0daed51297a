"""New files of a library as a stream: a source whose offset is one mark, the time and path of the last file taken.

Nothing is remembered per file, so neither a log nor a state grows with the library. A batch is the next ``files_per_batch`` files after the mark in the order of
(modification time, path), however long the backlog is; a batch that is repeated after a failure is found again from its two marks. The planning process holds
one batch of names at a time; tasks get groups of them.
"""

from __future__ import annotations

import heapq
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomtone.sources.listing import entries, open_store, qualified, suffix

SCHEMA = "path string, modificationTime timestamp, length bigint"
_ARROW = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
FILES_PER_BATCH = 100_000
FILES_PER_TASK = 1_000
#: Seconds between the latest time that is taken and the listing, by which a store has shown and dated all files up to then.
SETTLE = 2.0
_START = {"time": -1, "path": ""}


def files_below(root: str, extensions: tuple[str, ...] | None) -> Iterator[tuple[int, str, int]]:
    """``(time in microseconds, path, length)`` of the files that can be read: no empty ones, none behind a dot or an underscore."""
    folders = [root.rstrip("/")]
    while folders:
        folder = folders.pop()
        try:
            for e in entries(folder):
                if e.name.startswith((".", "_")):
                    continue
                path = f"{folder}/{e.name}"
                if e.is_dir:
                    folders.append(path)
                elif extensions is None or suffix(e.name) in extensions:
                    try:
                        path.encode()
                        length, at = e.look()
                    except (OSError, UnicodeEncodeError):
                        continue  # gone again, or no name that a table can hold
                    if length:
                        yield int(at.timestamp() * 1_000_000), path, length
        except OSError:
            if folder == root.rstrip("/"):
                raise


def _key(offset: dict) -> tuple[int, str]:
    return offset["time"], offset["path"]


@dataclass
class Arrivals(InputPartition):
    files: list[tuple[int, str, int]]


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.marks = options["root"], options["marks"]
        names = options.get("extensions", "")
        self.extensions = tuple(names.split(",")) if names else None
        self.per_batch = int(options.get("files_per_batch", FILES_PER_BATCH))
        self.per_task = int(options.get("files_per_task", FILES_PER_TASK))
        self.settle = float(options.get("settle", SETTLE))
        self.planned: dict | None = None
        self.found: tuple[dict, dict, list] | None = None

    def initialOffset(self) -> dict:
        return dict(_START)

    def latestOffset(self) -> dict:
        """The mark of the last of the next files. It is noted beside the checkpoint before it is told: the engine does not say where a restarted query stands."""
        start = self.planned or self._noted() or dict(_START)
        upto = int(time.time() * 1_000_000)
        time.sleep(self.settle)
        after = (f for f in files_below(self.root, self.extensions) if f[:2] > _key(start) and f[0] <= upto)
        files = heapq.nsmallest(self.per_batch, after)
        end = {"time": files[-1][0], "path": files[-1][1]} if files else start
        if files:
            self._note(end)
            self.found = start, end, files
        self.planned = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Arrivals]:
        if self.found and self.found[:2] == (start, end):
            files = self.found[2]
        else:  # a repeated batch, or one planned anew after a crash
            files = sorted(f for f in files_below(self.root, self.extensions) if _key(start) < f[:2] <= _key(end))
        return [Arrivals(files[k:k + self.per_task]) for k in range(0, len(files), self.per_task)]

    def read(self, partition: Arrivals) -> Iterator[pa.RecordBatch]:
        times, paths, lengths = zip(*partition.files)
        at = [datetime.fromtimestamp(t / 1_000_000, timezone.utc) for t in times]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((paths, at, lengths), _ARROW)], schema=_ARROW)

    def _noted(self) -> dict | None:
        from pyarrow import fs

        system, inner, _ = open_store(self.marks)
        names = [i.path for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if i.path.endswith(".json")]
        marks = []
        for name in names:
            with system.open_input_stream(name) as f:
                try:
                    marks.append(json.loads(f.read()))
                except ValueError:
                    continue  # cut off by a crash before it was told
        return max(marks, key=_key, default=None)

    def _note(self, end: dict) -> None:
        """Two notes in turn: while one is written the other stands."""
        system, inner, _ = open_store(self.marks)
        system.create_dir(inner, recursive=True)
        self.turn = 1 - getattr(self, "turn", 0)
        with system.open_output_stream(os.path.join(inner, f"mark{self.turn}.json")) as f:
            f.write(json.dumps(end).encode())


class ArrivalSource(DataSource):
    """``spark.readStream.format("loop_arrivals")`` with ``root``, ``marks`` (a folder inside the query's checkpoint), and optionally ``extensions`` (comma list),
    ``files_per_batch``, ``files_per_task``, ``settle``."""

    @classmethod
    def name(cls) -> str:
        return "loop_arrivals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(self.options)


def read_arrivals(spark: SparkSession, root: str, checkpoint: str, extensions: tuple[str, ...] | None = None, **options) -> DataFrame:
    """Path, time and length of the files below ``root`` as they appear, each version of a file once.

    ``checkpoint``: that of the query that reads the stream. Files must appear with growing modification times (a copy that keeps an old time is not seen); within
    ``settle`` seconds any order is right. Empty and hidden files are left out.
    """
    spark.dataSource.register(ArrivalSource)
    wanted = {"extensions": ",".join(extensions)} if extensions else {}
    return spark.readStream.format("loop_arrivals").options(root=qualified(spark, root), marks=f"{qualified(spark, checkpoint)}/marks", **wanted, **options).load()
