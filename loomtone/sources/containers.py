"""Chunked containers: walking CAF and AIFF files and reading the chunks that carry loop facts.

A file's chunks stay in its own row as an array, so decoding needs no shuffle; tasks walk batches of files with numpy (``chunk_walk``); ``explode_chunks`` gives the long table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.functions import binary as B
from loomtone.functions.rows import indexed_rows, let, struct_rows
from loomtone.functions.text import pitch_class_name
from loomtone.sources import chunk_walk

PAYLOAD_TYPES = ["desc", "pakt", "info", "uuid", "midi", "COMM", "basc", "cate"]
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def caf_chunks(content: Column) -> Column:
    """``array<struct<ord, type, off, size, payload>>`` of a CAF file; the payload only of chunks that are decoded."""

    def walk(files: pa.Array) -> pa.Array:
        return chunk_walk.chunks(files, 8, True, PAYLOAD_TYPES)

    return F.arrow_udf(walk, chunk_walk.CHUNKS)(content)


def aiff_chunks(content: Column) -> Column:
    """The same for an AIFF file: 32-bit sizes, chunks padded to even length."""

    def walk(files: pa.Array) -> pa.Array:
        return chunk_walk.chunks(files, 12, False, PAYLOAD_TYPES)

    return F.arrow_udf(walk, chunk_walk.CHUNKS)(content)


def explode_chunks(df: DataFrame, key: str, chunks: str = "chunks") -> DataFrame:
    """Long table ``(key, ord, type, off, size)``."""
    return struct_rows(df, [key], F.col(chunks), "ord").drop("payload")


def payloads(chunks: Column, kind: str, at_least: int = 0) -> Column:
    """Payloads of all chunks of a type that are long enough, in file order."""
    fit = F.filter(chunks, lambda c: (c["type"] == kind) & (F.length(c["payload"]) >= at_least))
    return F.transform(fit, lambda c: c["payload"])


def last_payload(chunks: Column, kind: str, at_least: int = 0) -> Column:
    return F.try_element_at(payloads(chunks, kind, at_least), F.lit(-1))


def uuid_payloads(chunks: Column, uuid: str) -> Column:
    """Bodies of the uuid chunks with one identifier."""
    fit = F.filter(payloads(chunks, "uuid", 16), lambda p: F.hex(F.substring(p, 1, 16)) == uuid)
    return F.transform(fit, lambda p: F.substring(p, F.lit(17), F.length(p)))


def caf_desc(payload: Column) -> Column:
    """``struct<sample_rate, format_id, channels, bits_per_sample>`` of an audio description chunk."""
    return F.struct(
        B.be_double(payload, 0).alias("sample_rate"),
        F.trim(B.byte_text(F.substring(payload, 9, 4)), F.lit(BLANKS)).alias("format_id"),
        B.be_uint(payload, 24, 4).cast("int").alias("channels"),
        B.be_uint(payload, 28, 4).cast("int").alias("bits_per_sample"),
    )


def caf_pakt(payload: Column) -> Column:
    """``struct<num_packets, num_frames>`` of a packet table chunk."""
    return F.struct(B.be_i64(payload, 0).alias("num_packets"), B.be_i64(payload, 8).alias("num_frames"))


def caf_info_kv(chunks: Column) -> Column:
    """Key/value pairs of every info chunk, in order."""
    return F.flatten(F.transform(payloads(chunks, "info", 4), B.nul_pairs))


def loop_tags(chunks: Column) -> Column:
    """Key/value pairs of every loop-metadata chunk, in order."""
    bodies = F.filter(uuid_payloads(chunks, dims.TAG_UUID), lambda p: F.length(p) >= 4)
    return F.flatten(F.transform(bodies, B.nul_pairs))


def tag_value(pairs: Column, key: str) -> Column:
    """Value of the last pair with ``key``, or null."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]


def genre_pairs(chunks: Column) -> Column:
    """All genre pairs of info and loop-metadata chunks in file order: the last one is the file's genre."""

    def pairs(c: Column) -> Column:
        body = F.when(c["type"] == "info", c["payload"]).when(
            F.hex(F.substring(c["payload"], 1, 16)) == dims.TAG_UUID,
            F.substring(c["payload"], F.lit(17), F.length(c["payload"])),
        )
        empty = F.array().cast("array<struct<pos:int,key:string,value:string>>")
        return let(body, lambda b: F.when(F.length(b) >= 4, B.nul_pairs(b)).otherwise(empty))

    return F.flatten(F.transform(F.filter(chunks, lambda c: c["type"].isin("info", "uuid")), pairs))


def marker_bodies(chunks: Column) -> Column:
    """Bodies of the marker chunks: a 20-byte header, then 12-byte entries."""
    return F.filter(uuid_payloads(chunks, dims.MARKER_UUID), lambda p: F.length(p) >= 20)


def read_markers(bodies: Column) -> Column:
    """``struct<declared, positions>``: the last header's count, and the entries of all marker chunks."""

    def entries(files: pa.Array) -> pa.Array:
        return chunk_walk.marker_entries(files)

    return F.struct(
        B.be_uint(F.try_element_at(bodies, F.lit(-1)), 16, 4).alias("declared"),
        F.arrow_udf(entries, "array<bigint>")(bodies).alias("positions"),
    )


def loop_markers(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """Add ``markers``: the declared count and the positions of each file."""
    bodies = df.withColumn("_bodies", marker_bodies(F.col(chunks)))
    return bodies.withColumn("markers", read_markers(F.col("_bodies"))).drop("_bodies")


def explode_markers(df: DataFrame, key: str, markers: str = "markers") -> DataFrame:
    """Long table ``(key, idx, pos)``."""
    return indexed_rows(df, [key], F.col(markers)["positions"], "idx", "pos")


def aiff_comm(payload: Column) -> Column:
    """``struct<channels, num_frames, bits_per_sample, sample_rate>`` of a common chunk."""
    return F.struct(
        B.be_uint(payload, 0, 2).cast("int").alias("channels"),
        B.be_uint(payload, 2, 4).alias("num_frames"),
        B.be_uint(payload, 6, 2).cast("int").alias("bits_per_sample"),
        B.be_float80(payload, 8).alias("sample_rate"),
    )


def lookup_codec(format_id: Column) -> Column:
    """Codec name of a format code, else the code itself."""
    names = F.create_map(*[F.lit(v) for pair in dims.entries(dims.CODECS) for v in pair])
    return F.coalesce(F.try_element_at(names, format_id), format_id)


def lookup_scale(scale: Column) -> Column:
    """Key type of a scale code."""
    names = F.array(*[F.lit(name) for _, name in dims.entries(dims.SCALE_TYPES)])
    return F.coalesce(F.get(names, scale), F.lit("neither"))


def aiff_basc(payload: Column) -> Column:
    """Loop facts of a legacy basic-info chunk."""
    root = B.be_uint(payload, 8, 2).cast("int")
    scale = B.be_uint(payload, 10, 2).cast("int")
    num, den = B.be_uint(payload, 12, 2), B.be_uint(payload, 14, 2)
    return F.struct(
        B.be_uint(payload, 0, 4).alias("loopable"),
        B.be_uint(payload, 4, 4).alias("beat_count"),
        root.alias("root_note_midi"),
        scale.alias("scale_type"),
        F.when(root == 0, F.lit("")).otherwise(pitch_class_name(root)).alias("key_signature"),
        F.when(root == 0, F.lit("neither")).otherwise(lookup_scale(scale)).alias("key_type"),
        F.when((num > 0) & (den > 0), F.concat_ws("/", num.cast("string"), den.cast("string"))).alias("time_signature"),
    )


def aiff_cate(payload: Column) -> Column:
    """``struct<category, subcategory, genre>``: the first three non-empty terminated strings."""
    text = F.regexp_replace(F.decode(payload, "ISO-8859-1"), "[\\x80-\\xFF]", "")
    parts = F.split(text, "\\x00")
    ended = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    words = F.filter(F.transform(ended, lambda s: F.trim(s, F.lit(BLANKS))), lambda s: s != "")
    return F.struct(
        F.get(words, F.lit(0)).alias("category"),
        F.get(words, F.lit(1)).alias("subcategory"),
        F.get(words, F.lit(2)).alias("genre"),
    )
