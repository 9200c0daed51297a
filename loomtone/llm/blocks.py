"""Whole texts as byte arrays: words of many texts at a time, cut and hashed with array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is one block of its own.
BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that blanks part: all but the blank and 0x09-0x0D.
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of ASCII digits, lower-case letters and anything beyond ASCII.
PLAIN_WORDS = np.zeros(256, bool)
PLAIN_WORDS[0x30:0x3A] = PLAIN_WORDS[0x61:0x7B] = PLAIN_WORDS[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) <= n:
        full = np.full(max(n + 1, BLOCK_BYTES + 1), base, np.uint64)
        full[0] = 1
        got = _powers[base] = np.multiply.accumulate(full)
        if n > 4 * BLOCK_BYTES:
            _powers.pop(base)
    return got


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null has length 0."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held, at


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of runs of whole texts of about ``most`` bytes."""
    held, at = buffers(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        stop = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, stop, held[at[first]: at[stop]], at[first: stop + 1] - at[first]
        first = stop


def words(text: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of word bytes; runs end with their text."""
    n = len(text)
    if not n:
        return (np.empty(0, np.int64),) * 3
    inside = word[text]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[cut[:n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[1:]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def prefix_hash(text: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers of a base, modulo 2 ** 64, before each position and at the end."""
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * powers(len(text))[: len(text)], out=out[1:])
    return out


def word_hash(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``text[start:end]``, the same wherever it stands."""
    sums = prefix_hash(text)
    return mix((sums[end] - sums[start]) * powers(len(text), _INVERSE)[start])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)
