"""File scans: libraries of audio/MIDI files and of finished loops, path parts, format detection."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.sources.listing import list_library, open_store

LIBRARY_EXTENSIONS = dims.AUDIO_EXTENSIONS + dims.MIDI_EXTENSIONS
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def parse_extensions(text: str | None = None, audio_only: bool = False, midi_only: bool = False) -> list[str]:
    """Extensions chosen by a comma list (dot optional, blanks ignored), or by kind, or all."""
    if text:
        return [e.strip().lstrip(".").lower() for e in text.split(",") if e.strip()]
    if audio_only:
        return list(dims.AUDIO_EXTENSIONS)
    return list(dims.MIDI_EXTENSIONS) if midi_only else list(LIBRARY_EXTENSIONS)


def _any_case(extension: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)


def name_glob(extensions: Iterable[str]) -> str:
    """File-name glob for the extensions in any letter case."""
    return "*.{" + ",".join(_any_case(e) for e in extensions) + "}"


def scan(spark: SparkSession, root: str, extensions: Iterable[str], recursive: bool, content: bool = False) -> DataFrame:
    """Files below ``root`` by extension through Spark's own file source: path, length and time, and ``content`` only when asked for.

    That source lists on the driver and leaves out empty and hidden files; :func:`scan_library` and ``ranged.scan_loops`` do neither.
    """
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", name_glob(extensions))
        .load(root)
    )
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return df.select(*columns)


def scan_library(spark: SparkSession, root: str, extensions: Iterable[str] | None = None, recursive: bool = True) -> DataFrame:
    """The files of a library that can become loops, audio and MIDI: path, length and time.

    Tasks do the listing, once, when this is called; empty, hidden and unreadable files are left out, :func:`list_library` has them with the reason.
    """
    listed = list_library(spark, root, extensions or LIBRARY_EXTENSIONS, recursive)
    return listed.where(F.col("reason").isNull()).drop("reason")


def filter_extensions(df: DataFrame, extensions: Iterable[str], path: str = "path") -> DataFrame:
    """Rows whose path has one of the extensions, in any case."""
    return df.filter(extension_of(F.col(path)).isin([e.lower() for e in extensions]))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(path: Column) -> Column:
    """Lower-cased suffix without the dot; empty when there is none or the name only starts with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def path_parts(df: DataFrame, path: str = "path", root: str | None = None) -> DataFrame:
    """Add file_name, stem, ext, parent and rel_parent (relative to ``root``; ``.`` for files directly in it).

    Root and path may differ in scheme: a scan gives ``file:/lib/a.wav`` for the root ``/lib``.
    """
    name = file_name(F.col(path))
    stem = F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1), F.lit("")), name)
    parent = F.substring(F.col(path), F.lit(1), F.length(path) - F.length(name) - 1)
    below = F.lit(re.sub(SCHEME, "", root).rstrip("/") + "/") if root else F.lit("/")
    folder = F.concat(F.regexp_replace(parent, SCHEME, ""), F.lit("/"))
    rel = F.when(
        F.startswith(folder, below), F.rtrim(F.substring(folder, F.length(below) + 1, F.length(folder)), F.lit("/"))
    ).otherwise(parent)
    return df.withColumns(
        {
            "file_name": name,
            "stem": stem,
            "ext": extension_of(F.col(path)),
            "parent": parent,
            "rel_parent": F.coalesce(F.nullif(rel, F.lit("")), F.lit(".")),
        }
    )


def is_midi(ext: Column) -> Column:
    return F.lower(ext).isin(dims.MIDI_EXTENSIONS)


def is_audio(ext: Column) -> Column:
    return F.lower(ext).isin(dims.AUDIO_EXTENSIONS)


def is_supported(ext: Column) -> Column:
    """Audio only: what can be added by hand."""
    return is_audio(ext)


def detect_format(content: Column) -> Column:
    """CAF, AIFF or MIDI by magic bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 4))
    form_type = F.hex(F.substring(content, 9, 4))
    return (
        F.when(head == "63616666", F.lit("CAF"))
        .when((head == "464F524D") & (form_type == "41494646"), F.lit("AIFF"))
        .when(head == "4D546864", F.lit("MIDI"))
    )


def list_tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Every file below ``root`` with its length and time, also the empty and hidden ones that Spark's file source leaves out."""
    return list_library(spark, root, None, recursive).select("path", "length", "modificationTime")


#: Bytes of files that are handed on at a time, and most of one file.
_FLUSH, MOST_CONTENT = 32 << 20, 1 << 30
#: Files that one task reads.
_FILES_PER_TASK = 2_000


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, contents, held = [], [], 0

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                system, inner, _ = open_store(path)
                with system.open_input_stream(inner) as stream:
                    content = stream.read(MOST_CONTENT + 1)
            except OSError:
                content = None
            paths.append(path)
            contents.append(None if content is None or len(content) > MOST_CONTENT else content)
            held += len(content or b"")
            if held >= _FLUSH:
                yield pack()
                paths, contents, held = [], [], 0
    if paths:
        yield pack()


def read_content(paths: DataFrame, files_per_task: int = _FILES_PER_TASK) -> DataFrame:
    """``(path, content)`` of listed files, read by the tasks; null content where a file cannot be read or has more than a GB.

    Rows of a listing are small and would share few tasks: they are counted and dealt anew.
    """
    only = paths.select("path")
    tasks = -(-only.count() // files_per_task)
    return only.repartition(max(tasks, 1), "path").mapInArrow(_read_files, "path string, content binary")


def skipped_files(listing: DataFrame, scanned: DataFrame, extensions: Iterable[str], root: str | None = None) -> DataFrame:
    """Listed files of the wanted kind that a scan did not return, with the reason; hidden means below ``root``, where it is given."""
    name = file_name(F.col("path"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    wanted = filter_extensions(listing, extensions).withColumn("_plain", plain)
    seen = scanned.select(F.regexp_replace("path", "^file:/+", "/").alias("_plain"))
    top = re.sub(SCHEME, "", root).rstrip("/") if root else ""
    below = F.regexp_replace("path", SCHEME, "")
    below = F.when(F.startswith(below, F.lit(top + "/")), F.substring(below, F.lit(len(top) + 1), F.length(below))).otherwise(below)
    reason = F.when(F.col("length") == 0, F.lit("empty file")).when(
        F.regexp_like(below, F.lit("/[._]")), F.lit("hidden file")
    )
    return wanted.join(seen, "_plain", "left_anti").select(
        "path", name.alias("file_name"), F.coalesce(reason, F.lit("not listed")).alias("error")
    )
