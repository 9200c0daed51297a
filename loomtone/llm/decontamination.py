"""Golden reports found inside other reports, by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive words of a golden report; a shorter report is one window. The symbols are words (64-bit codes). A
block is the last two words under the cursor: the shift table says how far the cursor may jump before any pattern could end;
where it says zero, the block's bucket lists the patterns with that suffix, their prefix code selects among them, and the words
themselves, byte by byte, confirm. Many cursors, one per stretch of words, advance together.

Windows of fewer than ``window`` words have tables of their own, one per length, as the shortest pattern bounds the jump. Patterns are cut
into groups of at most ``MOST_WORDS`` words, which bounds what is broadcast; each group is one pass over the reports.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtone.llm.blocks import LOWER, PLAIN_WORDS, blocks, mix, word_hash, words
from loomtone.llm.shared import keep

WINDOW = 13
#: Words of all patterns of one group: what one broadcast holds at most (about 24 bytes a word).
MOST_WORDS = 4_000_000
#: Words that one cursor covers.
STRETCH = 256
_TABLE_BITS = 16


def _block(codes: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The code of the block of ``width`` words that ends before ``end``."""
    last = codes[end - 1]
    return mix(last if width == 1 else last * np.uint64(0x9E3779B97F4A7C15) + codes[end - 2])


@dataclass
class Patterns:
    """The tables of all patterns of one length."""

    length: int
    width: int
    codes: np.ndarray  # pattern x length
    texts: list[bytes]  # the words, joined by single blanks
    golden: list[list[str]]  # the golden reports that hold the pattern
    shift: np.ndarray
    suffix: np.ndarray  # sorted block codes of the pattern ends
    order: np.ndarray

    @classmethod
    def build(cls, length: int, codes: np.ndarray, texts: list[bytes], golden: list[list[str]]) -> Patterns:
        width = min(2, length)
        shift = np.full(1 << _TABLE_BITS, length - width + 1, np.int64)
        flat, ends = codes.ravel(), np.arange(len(codes)) * length
        for k in range(width, length + 1):
            at = _block(flat, ends + k, width) >> np.uint64(64 - _TABLE_BITS)
            np.minimum.at(shift, at.astype(np.int64), length - k)
        suffix = _block(flat, ends + length, width)
        order = np.argsort(suffix, kind="stable")
        return cls(length, width, codes, texts, golden, shift, suffix[order], order)

    def find(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends (word places) and patterns of all occurrences by code, in texts of the words ``first`` to ``last``."""
        starts = first + self.length
        room = np.maximum(0, last - starts + 1)
        stretches = -(-room // STRETCH)
        owner = np.repeat(np.arange(len(first)), stretches)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        cursor = starts[owner] + nth * STRETCH
        stop = np.minimum(cursor + STRETCH, last[owner] + 1)
        ends, found = [], []
        while len(cursor):
            block = _block(codes, cursor, self.width)
            jump = self.shift[(block >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
            here = np.flatnonzero(jump == 0)
            if len(here):
                low, high = np.searchsorted(self.suffix, block[here]), np.searchsorted(self.suffix, block[here], "right")
                width = high - low
                at = np.repeat(cursor[here], width)
                which = self.order[np.repeat(low - (np.cumsum(width) - width), width) + np.arange(len(at))]
                same = codes[at - self.length] == self.codes[which, 0]
                at, which = at[same], which[same]
                for k in range(1, self.length):
                    same = codes[at - self.length + k] == self.codes[which, k]
                    at, which = at[same], which[same]
                ends.append(at)
                found.append(which)
            cursor = cursor + np.maximum(jump, 1)
            go = cursor < stop
            cursor, stop = cursor[go], stop[go]
        if not ends:
            return (np.empty(0, np.int64),) * 2
        return np.concatenate(ends), np.concatenate(found)


def _golden_windows(window: int):
    """One row per distinct window of a golden report: the words, joined by blanks, their number and the report's id."""

    def run(batches):
        for batch in batches:
            out: dict[tuple[str, bytes], int] = {}
            ids = batch.column(0).to_pylist()
            for first, _, text, at in blocks(batch.column(1)):
                text = LOWER[text]
                start, end, owner = words(text, at, PLAIN_WORDS)
                held = text.tobytes()
                for row in np.unique(owner).tolist():
                    a, b = np.searchsorted(owner, [row, row + 1])
                    own = [held[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]
                    n = min(window, len(own))
                    for k in range(len(own) - n + 1):
                        out[ids[first + row], b" ".join(own[k: k + n])] = n
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in out]), pa.array([k[1].decode() for k in out]), pa.array(list(out.values()), pa.int32())],
                    names=["golden_id", "words", "n"])

    return run


def _tables(rows) -> list[Patterns]:
    """The search tables of one group of ``(words, n, golden ids)`` rows."""
    by: dict[int, list] = {}
    for row in rows:
        by.setdefault(row.n, []).append(row)
    made = []
    for n, group in sorted(by.items()):
        texts = [r.words.encode() for r in group]
        text = np.frombuffer(b" ".join(texts), np.uint8)
        start, end, _ = words(text, np.array([0, len(text)]), PLAIN_WORDS)
        made.append(Patterns.build(n, word_hash(text, start, end).reshape(-1, n), texts, [list(r.golden) for r in group]))
    return made


_FOUND = "n_words bigint, spans array<struct<first:bigint,stop:bigint>>, golden array<string>"


def _search(tables):
    """For each text: its words, the word spans that occurrences cover (merged) and the golden reports that occur."""

    def run(batches):
        for batch in batches:
            n_words, spans, golden = [], [], []
            for first, stop, text, at in blocks(batch.column(1)):
                text = LOWER[text]
                start, end, owner = words(text, at, PLAIN_WORDS)
                codes = word_hash(text, start, end)
                bound = np.searchsorted(owner, np.arange(stop - first + 1))
                n_words += np.diff(bound).tolist()
                hit: dict[int, tuple[list, set]] = {}
                for patterns in tables.value:
                    ends, which = patterns.find(codes, bound[:-1], bound[1:])
                    for e, w in sorted(zip(ends.tolist(), which.tolist())):
                        a = e - patterns.length
                        row = int(owner[a])
                        if b" ".join(text[start[k]: end[k]].tobytes() for k in range(a, e)) == patterns.texts[w]:
                            mine = hit.setdefault(row, ([], set()))
                            mine[0].append((a - int(bound[row]), e - int(bound[row])))
                            mine[1].update(patterns.golden[w])
                for row in range(stop - first):
                    found, ids = hit.get(row, ([], set()))
                    spans.append([{"first": a, "stop": b} for a, b in merged(found)])
                    golden.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))), pa.array(golden, pa.list_(pa.string()))],
                names=[batch.schema.names[0], "n_words", "spans", "golden"])

    return run


def merged(spans) -> list[tuple[int, int]]:
    """The union of half-open spans, as few as possible."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def golden_hits(loops: DataFrame, goldens: DataFrame, id_column: str = "file_id", text_column: str = "report",
                golden_id: str = "golden_id", golden_text: str = "report", window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """``(id, n_words, spans, n_hit, golden)``, one row per row of ``loops``.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII. ``spans`` are the word
    ranges ``[first, stop)`` inside an occurrence of any golden window, ``n_hit`` their words and ``golden`` the ids (as text, sorted) of the
    golden reports with an occurring window. A null or empty text has no words. A golden report without words or without an id has no window; repeated
    ones count once. Without windows nothing is hit. Rows that repeat an id are answered each for itself. Other columns are not looked at.
    """
    spark = loops.sparkSession
    kind = loops.schema[id_column].dataType
    windows = (
        goldens.where(F.col(golden_id).isNotNull()).select(F.col(golden_id).cast("string"), F.col(golden_text).cast("string"))
        .mapInArrow(_golden_windows(window), "golden_id string, words string, n int")
        .groupBy("words", "n").agg(F.sort_array(F.collect_set("golden_id")).alias("golden"))
    )
    windows = keep(windows, "golden-windows")
    groups = max(1, -(-(windows.agg(F.sum("n")).first()[0] or 0) // most_words))
    texts = loops.select(id_column, F.col(text_column).cast("string").alias("_lt_text"))
    schema = f"{id_column} {kind.simpleString()}, {_FOUND}"
    if groups == 1:
        found = texts.mapInArrow(_search(spark.sparkContext.broadcast(_tables(windows.toLocalIterator()))), schema)
    else:
        # one pass per group; the rows of a text meet again by the place that its row got in a kept copy
        placed = keep(texts.select(F.monotonically_increasing_id().alias("_lt_row"), *texts.columns), "golden-rows")
        passes = None
        for k in range(groups):
            part = windows.where(F.pmod(F.xxhash64("words"), F.lit(groups)) == k)
            tables = spark.sparkContext.broadcast(_tables(part.toLocalIterator()))
            one = placed.select("_lt_row", "_lt_text").mapInArrow(_search(tables), f"_lt_row bigint, {_FOUND}")
            passes = one if passes is None else passes.union(one)
        union = F.aggregate(
            F.array_sort(F.flatten(F.collect_list("spans"))), F.expr("cast(array() as array<struct<first:bigint,stop:bigint>>)"),
            lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["stop"] >= s["first"]), F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["stop"], s["stop"]).alias("stop"))),
            )).otherwise(F.concat(out, F.array(s))))
        found = passes.groupBy("_lt_row").agg(
            F.max("n_words").alias("n_words"), union.alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("golden")))).alias("golden"))
        found = placed.select("_lt_row", id_column).join(found, "_lt_row").drop("_lt_row")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(id_column, "n_words", "spans", hit.alias("n_hit"), "golden")


def contaminated(n_hit, n_words):
    """The contamination rule: hit at all, and at least one word in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(loops: DataFrame, goldens: DataFrame, id_column: str = "file_id", text_column: str = "report",
                      golden_id: str = "golden_id", golden_text: str = "report") -> DataFrame:
    """``loops`` without the rows that golden reports contaminate; all columns stay. Repeated rows share their verdict."""
    key = F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"))
    hits = golden_hits(loops.select(key.alias("_lt_key"), F.col(text_column).alias("_lt_report")), goldens, "_lt_key", "_lt_report", golden_id, golden_text)
    bad = hits.where(contaminated(F.col("n_hit"), F.col("n_words"))).select("_lt_key").distinct()
    same = F.col(id_column).eqNullSafe(F.col("_lt_key.id")) & (F.xxhash64(text_column) == F.col("_lt_key.hash"))
    return loops.join(bad, same, "left_anti")
