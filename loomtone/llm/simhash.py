"""Near-duplicate files by SimHash, linked through a hierarchical index in Gray order.

Words are lower-cased (A-Z) runs without blanks; the shingles are three words, repeats included. Fingerprints that differ in at
most ``distance`` bits are linked, and groups are what links reach.

The index sorts distinct fingerprints by Gray rank, so neighbours share most bits. Runs of neighbours form cells; a cell, and
every node below it, stands for the bits that all its members share (mask and pattern). Two nodes whose shared bits already
differ more than allowed are dropped with everything below; otherwise the differences found so far go down with the pair and
only newly shared bits are counted. Cells hold bounded runs, pairs of cells are dealt to tasks, and a task reports a spanning forest
of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtone.llm.blocks import buffers
from loomtone.llm.shared import components, keep, roots

SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints in a leaf of the index, children of an upper node, and fingerprints in a cell.
LEAF, FAN_OUT, CELL_ROWS = 64, 8, 16_384
#: Most cells; beyond it cells grow, at 8 bytes a fingerprint.
MOST_CELLS = 4_096
_VOTES = 1 << 15


def _fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])[:n].tolist()
    stop = end[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, stop)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _VOTES):
        bits = np.unpackbits(hashes[i: i + _VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(column: pa.Array) -> pa.Array:
    held, at = buffers(column)
    found = [_fingerprint(held[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def fingerprint(report: Column) -> Column:
    """The 64-bit fingerprint of a text as bigint; null or wordless texts give 0."""
    return _fingerprints(report.cast("string"))


def fingerprint_hex(fingerprint: Column) -> Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def gray_rank(fingerprint: Column) -> Column:
    """The place of a fingerprint in the Gray sequence, shifted so that signed order is the order of ranks."""
    rank = fingerprint
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _ranks(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class _Index:
    """Levels of (mask, pattern) above sorted fingerprints, the root level first."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(_ranks(codes))]
        starts, self.levels = np.arange(0, len(codes), LEAF), []
        all_, any_ = np.bitwise_and.reduceat(self.codes, starts), np.bitwise_or.reduceat(self.codes, starts)
        while True:
            self.levels.insert(0, (~(all_ ^ any_), all_))
            if len(all_) == 1:
                break
            starts = np.arange(0, len(all_), FAN_OUT)
            all_, any_ = np.bitwise_and.reduceat(all_, starts), np.bitwise_or.reduceat(any_, starts)

    def leaf_rows(self, leaves: np.ndarray) -> np.ndarray:
        return np.minimum(leaves[:, None] * LEAF + np.arange(LEAF), len(self.codes) - 1)


def _leaf_pairs(a: _Index, b: _Index, distance: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that pruning leaves over; for ``own`` each pair once."""
    depth = max(len(a.levels), len(b.levels))
    level = [[x.levels[max(0, k - depth + len(x.levels))] for k in range(depth)] for x in (a, b)]
    i = j = np.zeros(1, np.int64)
    seen, apart = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    for k in range(depth):
        if k:
            grown = [depth - k < len(x.levels) for x in (a, b)]
            fan = [np.arange(FAN_OUT) if g else np.zeros(1, np.int64) for g in grown]
            shape = (len(i), len(fan[0]), len(fan[1]))
            up = np.broadcast_to(np.arange(len(i))[:, None, None], shape).ravel()
            i = np.broadcast_to((i * (FAN_OUT if grown[0] else 1))[:, None, None] + fan[0][None, :, None], shape).ravel()
            j = np.broadcast_to((j * (FAN_OUT if grown[1] else 1))[:, None, None] + fan[1][None, None, :], shape).ravel()
            there = (i < len(level[0][k][0])) & (j < len(level[1][k][0]))
            if own:
                there &= i <= j
            i, j, seen, apart = i[there], j[there], seen[up[there]], apart[up[there]]
        (mask_a, pattern_a), (mask_b, pattern_b) = level[0][k], level[1][k]
        shared = mask_a[i] & mask_b[j]
        apart = apart + np.bitwise_count((pattern_a[i] ^ pattern_b[j]) & shared & ~seen)
        near = apart <= distance
        i, j, seen, apart = i[near], j[near], shared[near], apart[near]
    return i, j


def _cell_links(cell_a: np.ndarray, cell_b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint place it reaches) for the fingerprints of two cells, or of one, that are linked."""
    a = _Index(cell_a)
    b = a if cell_b is None else _Index(cell_b)
    shift = 0 if cell_b is None else len(a.codes)
    codes = a.codes if cell_b is None else np.concatenate([a.codes, b.codes])
    parent = np.arange(len(codes))
    leaf_a, leaf_b = _leaf_pairs(a, b, distance, cell_b is None)
    for k in range(0, len(leaf_a), 256):
        rows_a, rows_b = a.leaf_rows(leaf_a[k: k + 256]), b.leaf_rows(leaf_b[k: k + 256])
        close = np.bitwise_count(a.codes[rows_a][:, :, None] ^ b.codes[rows_b][:, None, :]) <= distance
        p, x, y = np.nonzero(close)
        parent = roots(parent, rows_a[p, x], rows_b[p, y] + shift)
    moved = np.flatnonzero(parent != np.arange(len(codes)))
    return codes[moved], codes[parent[moved]]


def _pack(batches):
    """The fingerprints of one range as one row, with the bits that all and that any of them have."""
    codes = [b.column(0).to_numpy() for b in batches]
    if codes and sum(map(len, codes)):
        held = np.concatenate(codes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([held.tobytes()], pa.binary()), pa.array([np.bitwise_and.reduce(held)]), pa.array([np.bitwise_or.reduce(held)])],
            names=["codes", "every", "some"])


def _pair_task(distance: int):
    def run(batches):
        for batch in batches:
            for first, second in zip(batch.column(0), batch.column(1)):
                a = np.frombuffer(first.as_buffer(), np.uint64)
                b = np.frombuffer(second.as_buffer(), np.uint64) if second.is_valid else None
                node, to = _cell_links(a, b, distance)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(to.view(np.int64))], names=["a", "b"])

    return run


def link_fingerprints(classes: DataFrame, distance: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(node, component)`` for the distinct ``fingerprint`` values of ``classes`` that have a link.

    A cell travels as one packed row. The driver holds one mask and pattern per cell, at most ``MOST_CELLS``, never fingerprints.
    """
    spark = classes.sparkSession
    cells = min(MOST_CELLS, -(-classes.count() // cell_rows))
    ranged = classes.select("fingerprint").repartitionByRange(max(1, cells), gray_rank(F.col("fingerprint")))
    packed = ranged.mapInArrow(_pack, "codes binary, every bigint, some bigint").withColumn("cell", F.spark_partition_id().cast("bigint"))
    packed = keep(packed, "gray-cells")
    top = packed.select("cell", "every", "some").orderBy("cell").collect()
    number = np.array([r.cell for r in top], np.int64)
    every, some = (np.array([r[k] for r in top], np.int64).view(np.uint64) for k in (1, 2))
    mask = ~(every ^ some)
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(len(top)):
        near = np.flatnonzero(np.bitwise_count((every[k] ^ every[k:]) & mask[k] & mask[k:]) <= distance) + k
        first.append(np.full(len(near), number[k]))
        second.append(number[near])
    pairs = spark.createDataFrame(pa.table({"first": np.concatenate(first), "second": np.concatenate(second)}))
    one = packed.select(F.col("cell").alias("first"), F.col("codes").alias("codes_a"))
    two = packed.select(F.col("cell").alias("second"), F.col("codes").alias("codes_b"))
    dealt = pairs.join(one, "first").join(two, "second")
    links = dealt.select("codes_a", F.when(F.col("first") != F.col("second"), F.col("codes_b")).alias("codes_b")).mapInArrow(
        _pair_task(distance), "a bigint, b bigint")
    return components(links, "gray-links")


def near_duplicates(loops: DataFrame, id_column: str = "file_id", text_column: str = "report", distance: int = 2,
                    cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(id, fingerprint bigint, component_id)``, one row per row of ``loops``.

    ``component_id`` is the least id that links reach, the row's own included. Null and wordless texts share fingerprint 0 and are
    linked like any other. Repeated rows are kept; a null id gets its component's least id, null when the component has no other.
    An empty table gives no rows; further columns are not looked at.
    """
    prints = keep(loops.select(F.col(id_column).cast("bigint").alias(id_column), fingerprint(F.col(text_column)).alias("fingerprint")), "prints")
    classes = keep(prints.groupBy("fingerprint").agg(F.min(id_column).alias("least")), "print-classes")
    reached = link_fingerprints(classes, distance, cell_rows)
    grouped = classes.join(reached, classes.fingerprint == reached.node, "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    grouped = keep(grouped, "print-groups")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(grouped.join(least, "component").select("fingerprint", "component_id"), "fingerprint").select(
        id_column, "fingerprint", "component_id")


def keep_one(loops: DataFrame, id_column: str = "file_id", text_column: str = "report", distance: int = 2) -> DataFrame:
    """``loops`` with one row of each near-duplicate group: that of the least id, then of the least fingerprint; all columns stay.

    Where all ids of a group are null, one row for each fingerprint stays. Rows that repeat both id and fingerprint count as one.
    """
    columns = loops.columns
    near = near_duplicates(loops, id_column, text_column, distance)
    far = (1 << 63) - 1
    chosen = near.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("_alone")).agg(
        F.min(F.struct(F.coalesce(id_column, F.lit(far)).alias("_lt_id"), F.col("fingerprint").alias("_lt_print"))).alias("_k")).select("_k.*")
    marked = loops.withColumns({"_lt_id": F.coalesce(F.col(id_column).cast("bigint"), F.lit(far)), "_lt_print": fingerprint(F.col(text_column))})
    return marked.join(chosen, ["_lt_id", "_lt_print"], "left_semi").dropDuplicates(["_lt_id", "_lt_print"]).select(*columns)
