"""Lines that several reports share: each report keeps a compressed bitmap of its lines, the texts do not move.

The hashes of all lines are dealt by ranges of (hash, report, line number) and sorted so within each range. A task streams over its range and keeps
nothing but the first report of the hash at hand: lines of the same hash in later reports go. Ranges are cut inside a hash too, so a line that a third of all
reports have is shared among tasks. What a range cannot know, whether an earlier one began its first hash, is settled by one row per range that tells
its last hash and the first report there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomtone.llm.blocks import BLANK_WORDS, LOWER, blocks
from loomtone.llm.shared import keep, named

#: Lines of fewer characters are never taken for repeated.
LEAST_CHARS = 10

_GONE, _OPEN, _LAST = 0, 1, 2


def _line_hashes(least: int, id_type: pa.DataType):
    """Rows ``(h1, h2, id, row, line)`` of the lines with at least ``least`` characters between blanks; 128-bit hashes of the lower-cased line."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts = batch.columns
            for first, stop, held, at in blocks(texts):
                low = LOWER[held]
                feeds = np.flatnonzero(low == 10)
                start = np.union1d(at[:-1], feeds + 1)
                start = start[start < len(low)]
                end = np.append(start[1:], len(low))
                owner = np.searchsorted(at, start, "right") - 1
                number = np.arange(len(start)) - np.searchsorted(start, at[owner])
                shown = np.flatnonzero(BLANK_WORDS[low])
                a, b = np.searchsorted(shown, start), np.searchsorted(shown, end)
                full = np.flatnonzero(b - a >= 1)
                start, end = shown[a[full]], shown[b[full] - 1] + 1
                chars = np.zeros(len(low) + 1, np.int64)
                np.cumsum((low & 0xC0) != 0x80, out=chars[1:])
                long = chars[end] - chars[start] >= least
                start, end, full = start[long], end[long], full[long]
                if not len(full):
                    continue
                data, digest = low.tobytes(), xxhash.xxh3_128_digest
                codes = b"".join([digest(data[s:e]) for s, e in zip(start.tolist(), end.tolist())])
                pairs = np.frombuffer(codes, ">i8").astype(np.int64).reshape(-1, 2)
                take = pa.array(first + owner[full])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), ids.take(take).cast(id_type), rows.take(take), pa.array(number[full].astype(np.int32))],
                    names=["h1", "h2", "id", "row", "line"])

    return hashes


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(both, pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: lines whose hash began in an earlier report (gone), those of its first hash and report (open), and its last hash."""
    last = None  # (h1, h2, first id as an array of one) of the hash at hand
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            new[0] = h1[0] != last[0] or h2[0] != last[1]
        group = np.cumsum(new)  # 0: the hash at hand
        heads = ids.take(pa.array(np.flatnonzero(new)))
        pool = pa.concat_arrays([last[2] if last is not None else ids.slice(0, 1), heads])
        same = _same(ids, pool.take(pa.array(group)))
        state = np.where(same, -1, _GONE)
        if not begun:
            opened = 0 if last is not None else 1
            state[same & (group == opened)] = _OPEN
            begun = bool(group[-1] > opened)
        at = np.flatnonzero(state >= 0)
        if len(at):
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(state[at].astype(np.int32)), *out.columns], names=["state", *batch.schema.names])
        last = (h1[-1], h2[-1], pool.slice(int(group[-1]), 1))
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([_LAST], pa.int32()), pa.array([last[0]]), pa.array([last[1]]), last[2], pa.array([0], pa.int64()), pa.array([0], pa.int32())],
            names=["state", "h1", "h2", "id", "row", "line"])


@F.arrow_udf(T.BinaryType())
def _bitmap(lines: pa.Array) -> pa.Array:
    """A compressed bitmap from the numbers of the lines that go; lines beyond its end stay."""
    out = []
    for gone in lines.to_pylist():
        bits = np.ones((max(gone) // 8 + 1) * 8, bool)
        bits[gone] = False
        out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _bits(bitmaps: pa.Array) -> pa.Array:
    out = []
    for packed in bitmaps:
        data = packed.as_py()
        out.append(None if data is None else np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), bitorder="little").astype(bool).tolist())
    return pa.array(out, pa.list_(pa.bool_()))


def _rows(reports: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(named(text_column).cast("string"), F.lit(""))
    rows = reports.select(named(id_column).alias("id"), text.alias("text"))
    return rows.select("id", F.xxhash64("text").alias("row"), "text")


def _marks(rows: DataFrame, least: int) -> DataFrame:
    """``(id, row, n_dropped, keep)`` of the rows that lose lines; rows of one id and one text are alike."""
    id_field = T.StructField("id", rows.schema["id"].dataType)
    line = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), id_field, T.StructField("row", T.LongType()), T.StructField("line", T.IntegerType())]
    lines = rows.mapInArrow(_line_hashes(least, to_arrow_type(id_field.dataType)), T.StructType(line))
    order = [F.col("h1"), F.col("h2"), F.asc_nulls_last("id"), F.col("line")]
    told = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _first_occurrences, T.StructType([T.StructField("state", T.IntegerType()), *line]))
    told = keep(told, "repeated-lines")
    # one row per range, so at most as many as there are partitions
    lasts = told.where(F.col("state") == _LAST).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    late = told.where(F.col("state") == _OPEN).join(F.broadcast(lasts), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    gone = told.where(F.col("state") == _GONE).select("id", "row", "line").union(late.select("id", "row", "line"))
    sets = gone.groupBy("id", "row").agg(F.collect_set("line").alias("lines"))
    return sets.select("id", "row", F.size("lines").cast("bigint").alias("n_dropped"), _bitmap("lines").alias("keep"))


def _answered(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Each row with its mark, if it has one: rows are found by id and text, null ids too."""
    held = marks.withColumnsRenamed({"id": "_id", "row": "_row"})
    return rows.join(held, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").withColumn(
        "n_dropped", F.coalesce("n_dropped", F.lit(0).cast("bigint")))


def line_count(text: Column) -> Column:
    """Lines of a text; an empty one has one line."""
    return (F.size(F.split(text, "\n"))).cast("bigint")


def kept_lines(text: Column, keep_bits: Column) -> Column:
    """The lines that an array of bits keeps, joined again; without bits the text as it is, and lines beyond them stay."""
    held = F.filter(F.split(text, "\n"), lambda _, i: F.coalesce(F.get(keep_bits, i), F.lit(True)))
    return F.when(keep_bits.isNull(), text).otherwise(F.array_join(held, "\n"))


def line_bitmaps(reports: DataFrame, id_column: str = "file_id", text_column: str = "report", least: int = LEAST_CHARS) -> DataFrame:
    """``(id, n_lines, n_dropped, keep)``, one row per report: ``keep`` is a zlib-compressed bitmap, one bit per line, least bit first.

    A line is compared without the blanks at its ends and with A-Z lower-cased. If at least two reports hold it and it has ``least`` characters or more, it stays
    only in the report of the least id, there as often as it stands. Bits beyond the bitmap's end count as set; ``keep`` is null where all lines stay.

    A null or empty report is one empty line. A null id comes after all others. Rows of the same id are one report in several rows: none of
    them is a repeat of another. Further columns are not looked at, and an id column may have any name.
    """
    rows = _rows(reports, id_column, text_column)
    slim = rows.select("id", "row", line_count(F.col("text")).alias("n_lines"))
    return _answered(slim, _marks(rows, least)).select("id", "n_lines", "n_dropped", "keep").toDF(id_column, "n_lines", "n_dropped", "keep")


def drop_repeated_lines(reports: DataFrame, id_column: str = "file_id", text_column: str = "report", least: int = LEAST_CHARS) -> DataFrame:
    """``(id, n_lines, n_dropped, kept)``: each report without the lines that :func:`line_bitmaps` marks, joined by line feeds."""
    rows = _rows(reports, id_column, text_column)
    marked = _answered(rows, _marks(rows, least).withColumn("bits", _bits("keep")).drop("keep"))
    return marked.select("id", line_count(F.col("text")).alias("n_lines"), "n_dropped", kept_lines(F.col("text"), F.col("bits")).alias("kept")).toDF(
        id_column, "n_lines", "n_dropped", "kept")
