"""Fill-in-the-middle forms of reports, made by rotating blocks of a byte buffer in place.

A report is scanned once for its units (a run of ASCII letters, or any other single character); two hashed cuts part it into prefix, middle and suffix. The
sentinels are inserted into the buffer in the order of the text, then neighbouring blocks change places by three reversals, which need no
second buffer. The way back finds the sentinels, undoes the rotation by the same reversals with the lengths exchanged, and deletes the sentinels.
Texts that hold a sentinel themselves stay plain, so each sentinel of a rotated text stands once and the way back is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtone.llm.blocks import blocks
from loomtone.llm.shared import named

# The sentinels and the forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, SUFFIX_LAST, SUFFIX_FIRST = "plain", "psm", "spm"

#: Bytes at either end that one step of a reversal exchanges.
STRIDE = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def reverse(buffer: bytearray, first: int, stop: int) -> None:
    """Reverse ``buffer[first:stop]`` in place; beside the buffer at most two strides are held."""
    while stop - first > 1:
        k = min(STRIDE, (stop - first) // 2)
        left = buffer[first:first + k]
        buffer[first:first + k] = buffer[stop - k:stop][::-1]
        buffer[stop - k:stop] = left[::-1]
        first, stop = first + k, stop - k


def rotate(buffer: bytearray, first: int, middle: int, stop: int) -> None:
    """Exchange the neighbours ``buffer[first:middle]`` and ``buffer[middle:stop]`` by three reversals."""
    reverse(buffer, first, middle)
    reverse(buffer, middle, stop)
    reverse(buffer, first, stop)


def arrange(text: bytes, cuts: tuple[int, int], form: str) -> bytes:
    """``text`` with its blocks in the order of ``form``; ``cuts`` are the bytes where prefix and middle end."""
    if form == PLAIN:
        return text
    buffer = bytearray(text)
    buffer[cuts[1]:cuts[1]] = SUFFIX
    buffer[cuts[0]:cuts[0]] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = cuts[0] + len(PREFIX), cuts[1] + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == SUFFIX_LAST else 0, suffix, len(buffer))
    return bytes(buffer)


def rearrange(made: bytes, form: str) -> bytes | None:
    """The text that :func:`arrange` was given; None for bytes that are not of this form."""
    if form == PLAIN:
        return made
    if form not in (SUFFIX_LAST, SUFFIX_FIRST):
        return None
    at = {mark: made.find(mark) for mark in (PREFIX, SUFFIX, MIDDLE)}
    order = (PREFIX, SUFFIX, MIDDLE) if form == SUFFIX_LAST else (SUFFIX, PREFIX, MIDDLE)
    if not 0 == at[order[0]] < at[order[1]] < at[order[2]]:
        return None
    buffer, end = bytearray(made), len(made)
    if form == SUFFIX_LAST:
        middle, suffix = at[SUFFIX], at[SUFFIX] + end - at[MIDDLE]
        rotate(buffer, at[SUFFIX], at[MIDDLE], end)
    else:
        middle, suffix = at[MIDDLE] - at[PREFIX], end - at[PREFIX]
        rotate(buffer, 0, at[PREFIX], end)
    del buffer[suffix:suffix + len(SUFFIX)]
    del buffer[middle:middle + len(MIDDLE)]
    del buffer[:len(PREFIX)]
    return bytes(buffer)


_MADE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
_MADE_ARROW = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _maker(plain_from: int, first_below: int):
    @F.arrow_udf(_MADE)
    def make(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        rows = []
        draws = [h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)]
        for first, stop, held, at in blocks(texts):
            letter = _LETTER[held]
            starts = (held & 0xC0) != 0x80  # first bytes of characters
            chars = np.zeros(len(held) + 1, np.int64)
            np.cumsum(starts, out=chars[1:])
            starts[1:] &= ~(letter[1:] & letter[:-1])
            starts[at[:-1][at[:-1] < len(held)]] = True
            unit = np.flatnonzero(starts)
            upto = np.searchsorted(unit, at)
            for k in range(stop - first):
                a, b = int(at[k]), int(at[k + 1])
                text, n = held[a:b].tobytes(), int(upto[k + 1] - upto[k])
                d = [int(h[first + k]) for h in draws]
                if not n or d[2] % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((n, PLAIN, None, None, text.decode("utf-8", "replace")))
                    continue
                form = SUFFIX_FIRST if d[3] % 100 < first_below else SUFFIX_LAST
                low, high = sorted((d[0] % (n + 1), d[1] % (n + 1)))
                c, e = (int(unit[upto[k] + u]) if u < n else b for u in (low, high))
                made = arrange(text, (c - a, e - a), form)
                rows.append((n, form, int(chars[c] - chars[a]), int(chars[e] - chars[c]), made.decode("utf-8", "replace")))
        columns = list(zip(*rows)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MADE_ARROW)], fields=list(_MADE_ARROW))

    return make


@F.arrow_udf(T.StringType())
def _undo(made: pa.Array, form: pa.Array) -> pa.Array:
    out = []
    for m, f in zip(made, form):
        back = None if m.as_py() is None else rearrange(m.as_py().encode(), f.as_py())
        out.append(None if back is None else back.decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def fill_in_middle(reports: DataFrame, id_column: str = "file_id", text_column: str = "report", seed: int = 1, plain_from: int = 90,
                   first_below: int = 20) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)``, one row per report.

    ``n`` counts units. The first four 8-digit groups of the hex SHA-256 of ``seed:id`` decide: two cuts modulo ``n + 1``, plain where the third modulo
    100 is at least ``plain_from``, else the suffix first (``spm``) where the fourth modulo 100 is below ``first_below``, else last (``psm``).
    ``prefix_chars`` and ``middle_chars`` count characters and are null for plain rows.

    A null report counts as empty; empty reports and those that hold a sentinel stay plain. A null id is hashed as the empty text. Repeated rows get the same
    answer each; further columns are not looked at, and an id column may have any name.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_column).cast("string"), F.lit(""))), 256)
    hashed = reports.select(named(id_column).alias("_lt_id"), F.coalesce(named(text_column).cast("string"), F.lit("")).alias("_lt_text"), digest.alias("_lt_h"))
    draws = [F.conv(F.substring("_lt_h", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    made = hashed.select("_lt_id", _maker(plain_from, first_below)("_lt_text", *draws).alias("_lt_made"))
    fields = [F.col("_lt_made")[f.name] for f in _MADE]
    return made.select("_lt_id", *fields).toDF(id_column, *(f.name for f in _MADE))


def restore(output: Column, form: Column) -> Column:
    """The exact report behind an ``output`` of :func:`fill_in_middle`; null where the text is not of that form."""
    return _undo(output, form)
