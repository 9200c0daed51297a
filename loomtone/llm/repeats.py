"""Repeated passages of reports, found by a sparse suffix array whose comparisons go through hashes.

A byte is repeated when a string of ``LENGTH`` bytes that covers it also starts anywhere else. Every such string has one anchor, the ``GRAM`` bytes in it
with the least hash (leftmost of equals), so equal strings have their anchors at the same place. Only suffixes at anchors are sorted, about one in
180 bytes. An anchor's context is the text of all strings that it stands for.

1. Anchor hashes are counted; those that occur once have no repeated string. The others fill a sieve of fixed size.
2. Contexts of anchors that pass the sieve are grouped by digest: in equal contexts every string is repeated.
3. Different contexts of one anchor are compared in tasks: mergesort over the suffixes to the right, and again over those to the left, of the anchor. A comparison finds
   the common extension by binary search on prefix polynomial hashes. Neighbours' extensions are then checked byte by byte; a collision sends the bucket to
   plain sorting. A string with d bytes left of the anchor is repeated when another context falls in the same run of left extensions of at least d
   and of right ones of at least ``LENGTH`` - d.
4. Anchors with very many different contexts are not gathered: their strings are compared as 128-bit digests, one row each.

The ranges go back to their report by id and hash of the text.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtone.llm.blocks import blocks, buffers, mix, powers, prefix_hash
from loomtone.llm.shared import keep

LENGTH = 400
GRAM = 32
#: Bits of the sieve of repeated anchors (16 MB). A fuller sieve lets more contexts through to be compared; nothing is lost.
SIEVE_BITS = 27
#: Contexts of one task's bucket, on average; different contexts of one anchor beyond which its strings are compared as digests.
BUCKET_ROWS, HOT_CONTEXTS = 8_192, 4_096
#: Bytes of text whose anchors are sought at once, and bytes of contexts or places that a task holds before it hands them on, about.
TEXT_BYTES, BATCH_BYTES = 1 << 18, 4 << 20
_INVERSE = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))


def anchors(text: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, place, first string and last string (starts) of every anchor, and the number of its text."""
    none = tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    n = len(text) - gram + 1
    wide = length - gram + 1
    if n < wide:
        return none
    sums = prefix_hash(text)
    code = mix((sums[gram:] - sums[:-gram]) * powers(len(text), _INVERSE)[:n])
    least = (code & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    held = 1
    while held * 2 <= wide:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    if wide > held:
        least = np.minimum(least[: n - wide + 1], least[wide - held:])
    starts = np.arange(len(least))
    owner = np.searchsorted(at, starts, "right") - 1
    inside = starts + length <= at[owner + 1]
    starts, owner = starts[inside], owner[inside]
    if not len(starts):
        return none
    place = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return code[place[new]], place[new], starts[new], starts[last], owner[new]


def _keys(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for _, _, text, at in blocks(batch.column(0), TEXT_BYTES):
                key, count = np.unique(anchors(text, at, length, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["key", "n"])

    return run


def _slots(key: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(key + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in (1, 2)]


def _sieve_parts(bits: int):
    """One kilobyte of the sieve for each group of slots."""

    def run(table: pa.Table) -> pa.Table:
        part = np.zeros(8192, np.uint8)
        part[table.column("slot").to_numpy()] = 1
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "held": pa.array([np.packbits(part).tobytes()], pa.binary())})

    return run


def _sieve(repeated: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of the two slots of every repeated key; ``2 ** bits`` bits reach the driver, whatever the number of keys."""

    def slots(batches):
        for batch in batches:
            slot = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 13), pa.array(slot & 8191)], names=["part", "slot"])

    parts = repeated.mapInArrow(slots, "part bigint, slot bigint").distinct().groupBy("part").applyInArrow(_sieve_parts(bits), "part bigint, held binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        out[row.part << 10: (row.part + 1) << 10] = np.frombuffer(row.held, np.uint8)
    return out


def _passes(sieve: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    good = np.ones(len(key), bool)
    for slot in _slots(key, bits):
        good &= (sieve[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    return good


def _candidates(sieve, bits: int, length: int, gram: int):
    """Row, key, digest, first string, number of strings, bytes left of the anchor and context of each anchor that passes the sieve."""

    def run(column):
        for row, _, text, at in blocks(column, TEXT_BYTES):
            key, place, first, last, owner = anchors(text, at, length, gram)
            good = _passes(sieve.value, key, bits)
            held = text.tobytes()
            for k, p, a, b, o in zip(*(x[good].tolist() for x in (key.view(np.int64), place, first, last, owner))):
                context = held[a: b + length]
                digest = hashlib.blake2b(context, digest_size=16, salt=(p - a).to_bytes(4, "little")).digest()
                yield row + o, k, digest, a - int(at[o]), b - a + 1, p - a, context

    return run


def _places(candidates):
    def run(batches):
        for batch in batches:
            told = (c[:5] for c in candidates(batch.column(2)))
            while found := list(zip(*islice(told, BATCH_BYTES // 256))):
                row = pa.array(found[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary()),
                     pa.array(found[3], pa.int64()), pa.array(found[4], pa.int32())],
                    names=[batch.schema.names[0], "_lt_hash", "key", "digest", "first", "strings"])

    return run


def _contexts(candidates):
    def run(batches):
        for batch in batches:
            held, size = {}, 0
            for _, key, digest, _, strings, left, context in candidates(batch.column(0)):
                if (key, digest) not in held:
                    held[key, digest] = [0, strings, left, context]
                    size += len(context) + 256
                held[key, digest][0] += 1
                if size >= BATCH_BYTES:
                    yield packed(held)
                    held, size = {}, 0
            if held:
                yield packed(held)

    def packed(held: dict[tuple, list]) -> pa.RecordBatch:
        keys, digests = zip(*held)
        copies, strings, left, context = zip(*held.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(copies, pa.int64()), pa.array(strings, pa.int32()),
             pa.array(left, pa.int32()), pa.array(context, pa.binary())],
            names=["key", "digest", "copies", "strings", "left", "context"])

    return run


class Suffixes:
    """Byte strings of bounded length as rows, with prefix polynomial hashes of each."""

    def __init__(self, strings: list[bytes], wide: int):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.byte = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(-1, wide)
        self.hash = np.zeros((len(strings), wide + 1), np.uint64)
        sums = self.hash[:, 1:]  # worked on in place: the table is the largest thing that a task holds
        sums[:] = self.byte
        sums += np.uint64(1)
        sums *= powers(wide)[:wide]
        np.cumsum(sums, axis=1, out=sums)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the common beginning of rows ``i`` and ``j``, by binary search on the hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = self.hash[i, mid] == self.hash[j, mid]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether row ``i`` sorts before row ``j`` (equal rows don't)."""
        n = self.common(i, j)
        end_i, end_j = n >= self.size[i], n >= self.size[j]
        last = self.byte.shape[1] - 1
        a, b = self.byte[i, np.minimum(n, last)], self.byte[j, np.minimum(n, last)]
        return np.where(end_i | end_j, end_i & ~end_j, a < b)


def merge_sort(rows: Suffixes, group: np.ndarray) -> np.ndarray:
    """The order of ``rows`` by group, then by bytes: bottom-up mergesort, all merges of a level at once."""
    n = len(group)
    order, run = np.arange(n), 1

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = group[i] < group[j]
        tie = np.flatnonzero(group[i] == group[j])
        out[tie] = rows.before(i[tie], j[tie])
        return out

    while run < n:
        at = np.arange(n)
        base = at // (2 * run) * (2 * run)
        first = at - base < run
        other = np.where(first, base + run, base)
        low, high = np.minimum(other, n), np.minimum(np.where(first, base + 2 * run, base + run), n)
        start = low.copy()
        while True:  # the left run goes before equals of the right one
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            mine, theirs = order[open_], order[mid]
            f = first[open_]
            ahead = np.where(f, less(theirs, mine), ~less(mine, theirs))
            low[open_] = np.where(ahead, mid + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], mid)
        to = np.where(first, at, at - run) + low - start
        merged = np.empty(n, np.int64)
        merged[to] = order
        order, run = merged, 2 * run
    return order


def _sorted_extensions(strings: list[bytes], wide: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and bytes, and the common length of each row in it with the one before (0 across groups)."""
    rows = Suffixes(strings, wide)
    order = merge_sort(rows, group)
    a, b = order[:-1], order[1:]
    common = np.where(group[a] == group[b], rows.common(a, b), 0)
    column = np.arange(wide)
    sound = ((rows.byte[a] == rows.byte[b]) | (column >= common[:, None])).all()
    here = np.minimum(common, wide - 1)
    ends = (common >= rows.size[a]) | (common >= rows.size[b])
    ordered = (group[a] < group[b]) | ends & (rows.size[a] <= rows.size[b]) | ~ends & (rows.byte[a, here] < rows.byte[b, here])
    if not (sound and ordered.all()):  # a collision of hashes
        order = np.array(sorted(range(len(strings)), key=lambda k: (group[k], strings[k])))
        a, b = order[:-1], order[1:]
        short = np.minimum(rows.size[a], rows.size[b])
        differ = (rows.byte[a] != rows.byte[b]) | (column >= short[:, None])
        common = np.where(group[a] == group[b], np.where(differ.any(1), differ.argmax(1), short), 0)
    return order, np.concatenate([[0], common])


def repeated_strings(key: np.ndarray, copies: np.ndarray, strings: np.ndarray, left: np.ndarray, context: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the strings (by number) that another context of its key holds at the same place, or all where it has copies."""
    group = np.unique(key, return_inverse=True)[1]
    order_r, common_r = _sorted_extensions([c[d:] for c, d in zip(context, left.tolist())], length, group)
    order_l, common_l = _sorted_extensions([c[:d][::-1] for c, d in zip(context, left.tolist())], length, group)
    n = len(group)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_r[order_r], rank_l[order_l] = np.arange(n), np.arange(n)
    most_r, most_l = np.empty(n, np.int64), np.empty(n, np.int64)
    most_r[order_r] = np.maximum(common_r, np.append(common_r[1:], 0))
    most_l[order_l] = np.maximum(common_l, np.append(common_l[1:], 0))
    new_group = [np.concatenate([[True], group[o[1:]] != group[o[:-1]]]) for o in (order_r, order_l)]
    low = np.maximum(left - strings + 1, length - most_r)
    high = np.minimum(left, most_l)
    met: list[list[int]] = [[] for _ in range(n)]
    for d in range(int(low.min()), int(high.max()) + 1) if (low <= high).any() else ():
        who = np.flatnonzero((low <= d) & (d <= high))
        if not len(who):
            continue
        run_r = np.cumsum(new_group[0] | (common_r < length - d))[rank_r[who]]
        run_l = np.cumsum(new_group[1] | (common_l < d))[rank_l[who]]
        _, at, count = np.unique(run_r * (n + 1) + run_l, return_inverse=True, return_counts=True)
        for k in who[count[at] > 1].tolist():
            met[k].append(int(left[k]) - d)
    return [np.arange(strings[k]) if copies[k] > 1 else np.array(sorted(met[k]), np.int64) for k in range(n)]


def _ranges(strings: np.ndarray) -> list[dict]:
    """Runs of consecutive string numbers."""
    if not len(strings):
        return []
    cut = np.flatnonzero(np.diff(strings) != 1) + 1
    return [{"first": int(r[0]), "stop": int(r[-1]) + 1} for r in np.split(strings, cut)]


_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def _bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("key", "copies", "strings", "left")}
        got = repeated_strings(column["key"], column["copies"], column["strings"].astype(np.int64), column["left"].astype(np.int64),
                               table.column("context").to_pylist(), length)
        return pa.table({"key": table.column("key"), "digest": table.column("digest"), "repeated": pa.array([_ranges(r) for r in got], _ARROW_SPANS)})

    return run


def _single_strings(length: int):
    """One row per string of a context, as its digest."""

    def run(batches):
        for batch in batches:
            for key, digest, copies, strings, left, context in zip(*(batch.column(k).to_pylist() for k in range(6))):
                one = [hashlib.blake2b(context[k: k + length], digest_size=16, salt=(left - k).to_bytes(4, "little")).digest() for k in range(strings)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * strings, pa.int64()), pa.array([digest] * strings, pa.binary()), pa.array([copies] * strings, pa.int64()),
                     pa.array(range(strings), pa.int64()), pa.array(one, pa.binary())], names=["key", "digest", "copies", "number", "string"])

    return run


@F.arrow_udf(_SPANS)
def _number_ranges(column: pa.Array) -> pa.Array:
    return pa.array([_ranges(np.array(sorted(set(v)), np.int64)) for v in column.to_pylist()], _ARROW_SPANS)


@F.arrow_udf(_SPANS)
def _union(column: pa.Array) -> pa.Array:
    out = []
    for spans in column.to_pylist():
        merged: list[list[int]] = []
        for a, b in sorted((s["first"], s["stop"]) for s in spans or ()):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out.append([{"first": a, "stop": b} for a, b in merged])
    return pa.array(out, _ARROW_SPANS)


@F.arrow_udf(T.BinaryType())
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    held, at = buffers(text)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(text)), pc.list_value_length(spans).fill_null(0).to_numpy())
    first, stop = (at[row] + flat.field(k).to_numpy() for k in (0, 1))
    size = np.diff(at) - np.bincount(row, stop - first, len(text)).astype(np.int64)
    edge = [np.concatenate([[at[0]], stop]), np.concatenate([first, [at[-1]]])]  # what stays lies between two spans
    out = np.empty(int(size.sum()), np.uint8)
    done = 0
    for a, b in zip(*(e.tolist() for e in edge)):
        out[done: done + b - a] = held[a:b]
        done += b - a
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def repeated_ranges(loops: DataFrame, id_column: str = "file_id", text_column: str = "report", length: int = LENGTH, gram: int = GRAM,
                    bucket_rows: int = BUCKET_ROWS, hot_contexts: int = HOT_CONTEXTS, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """``(id, _lt_hash, spans)`` for the reports that have a repeated byte: the byte ranges ``[first, stop)``, merged; ``_lt_hash`` is xxhash64 of the text."""
    spark = loops.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = loops.select(id_column, text.alias("_lt_text")).select(id_column, F.xxhash64("_lt_text").alias("_lt_hash"), "_lt_text")
    kind = loops.schema[id_column].dataType.simpleString()
    keys = rows.select("_lt_text").mapInArrow(_keys(length, gram), "key bigint, n bigint")
    repeated = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    candidates = _candidates(spark.sparkContext.broadcast(_sieve(repeated, sieve_bits)), sieve_bits, length, gram)
    contexts = rows.select("_lt_text").mapInArrow(
        _contexts(candidates), "key bigint, digest binary, copies bigint, strings int, left int, context binary")
    contexts = contexts.groupBy("key", "digest").agg(
        F.sum("copies").alias("copies"), F.first("strings").alias("strings"), F.first("left").alias("left"), F.first("context").alias("context"))
    contexts = keep(contexts, "repeat-contexts")
    kinds = keep(contexts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all")).where("all > 1"), "repeat-keys")
    alone = contexts.drop("context").join(kinds.where("kinds = 1"), "key").select(
        "key", "digest", F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("strings").cast("bigint").alias("stop"))).alias("repeated"))
    several = contexts.join(kinds.where(f"kinds > 1 and kinds <= {hot_contexts}").select("key"), "key")
    number = kinds.where(f"kinds > 1 and kinds <= {hot_contexts}").agg(F.sum("kinds")).first()[0] or 0
    buckets = max(1, -(-number // bucket_rows))
    compared = several.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        _bucket(length), "key bigint, digest binary, repeated array<struct<first:bigint,stop:bigint>>")
    hot = contexts.join(kinds.where(f"kinds > {hot_contexts}").select("key"), "key").select("key", "digest", "copies", "strings", "left", "context")
    single = keep(hot.mapInArrow(_single_strings(length), "key bigint, digest binary, copies bigint, number bigint, string binary"), "repeat-strings")
    often = single.groupBy("string").agg(F.sum("copies").alias("n")).where("n > 1").select("string")
    numbered = single.join(often, "string").groupBy("key", "digest").agg(F.collect_list("number").alias("numbers")).select(
        "key", "digest", _number_ranges("numbers").alias("repeated"))
    told = alone.union(compared).union(numbered).where(F.size("repeated") > 0)
    places = rows.mapInArrow(_places(candidates), f"{id_column} {kind}, _lt_hash bigint, key bigint, digest binary, first bigint, strings int")
    spans = F.transform("repeated", lambda r: F.struct((F.col("first") + r["first"]).alias("first"), (F.col("first") + r["stop"] + length - 1).alias("stop")))
    return places.join(told, ["key", "digest"]).select(id_column, "_lt_hash", spans.alias("spans")).groupBy(id_column, "_lt_hash").agg(
        _flat("spans").alias("spans")).select(id_column, "_lt_hash", _union("spans").alias("spans"))


def _flat(column: str):
    return F.flatten(F.collect_list(column))


def drop_repeats(loops: DataFrame, id_column: str = "file_id", text_column: str = "report", **settings) -> DataFrame:
    """``(id, n_bytes, spans, kept)``, one row per row of ``loops``: the ranges of repeated bytes and the bytes without them.

    Strings are judged on the input; matches never cross reports; a null text is empty. Texts shorter than ``LENGTH`` bytes keep all. Rows that repeat count as
    places of their own, so both lose what they share. Null ids are answered like any other. Further columns are not looked at.
    """
    ranges = repeated_ranges(loops, id_column, text_column, **settings).select(F.col(id_column).alias("_lt_id"), F.col("_lt_hash").alias("_lt_key"), "spans")
    rows = loops.select(id_column, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_lt_text"))
    same = F.col(id_column).eqNullSafe(F.col("_lt_id")) & (F.xxhash64("_lt_text") == F.col("_lt_key"))
    none = F.expr("cast(array() as array<struct<first:bigint,stop:bigint>>)")
    out = rows.join(ranges, same, "left").select(id_column, "_lt_text", F.coalesce("spans", none).alias("spans"))
    return out.select(id_column, F.octet_length("_lt_text").cast("bigint").alias("n_bytes"), "spans", _without("_lt_text", "spans").alias("kept"))
