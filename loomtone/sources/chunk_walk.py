"""Chunk headers and marker entries of many files at a time: one step of numpy goes over the current chunk of every file of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNKS = "array<struct<ord:int,type:string,off:bigint,size:decimal(20,0),payload:binary>>"
_FIELDS = {"ord": pa.int32(), "type": pa.string(), "off": pa.int64(), "size": pa.decimal128(20, 0), "payload": pa.binary()}


def _spans(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Buffer]:
    """First byte and length of each value, null ones empty, and the bytes they lie in."""
    wide = pa.types.is_large_binary(values.type)
    _, ends, data = values.buffers()
    data = data if data is not None else pa.py_buffer(b"")
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[values.offset: values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    held = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0) if len(values) else np.zeros(0, np.int64)
    return at[:-1], held, np.frombuffer(data, np.uint8), data


def _u32(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    return raw[at[:, None] + np.arange(4)].view(">u4")[:, 0].astype(np.uint64)


def _texts(kinds: np.ndarray) -> pa.Array:
    """The four bytes of each kind as text, those above 127 as U+FFFD."""
    found, which = np.unique(kinds, return_inverse=True)
    texts = ["".join(chr(b) if b < 0x80 else "�" for b in int(k).to_bytes(4, "big")) for k in found]
    return pa.array(texts, pa.string()).take(pa.array(which))


def chunks(content: pa.Array, start: int, wide: bool, decoded: list[str]) -> pa.Array:
    """Chunks of each file from byte ``start`` on, with 64-bit sizes (``wide``) or 32-bit ones padded to even; payloads of ``decoded`` types only.

    A walk goes on while more than a header is left and ends at a chunk that passes the end; its payload is what the file holds.
    """
    base, held, raw, data = _spans(content)
    header = 12 if wide else 8
    rows = np.flatnonzero(start < held - header)
    pos = np.full(len(rows), start, np.int64)
    seen: list[tuple[np.ndarray, ...]] = []
    while len(rows):
        at, n = base[rows] + pos, held[rows]
        low = _u32(raw, at + (8 if wide else 4))
        high = _u32(raw, at + 4) if wide else np.zeros(len(rows), np.uint64)
        seen.append((rows, pos, _u32(raw, at), (high << np.uint64(32)) | low))
        low = low.astype(np.int64)
        pos = np.where(high > 0, n, np.minimum(pos + header + low + (0 if wide else low % 2), n))
        on = pos < n - header
        rows, pos = rows[on], pos[on]
    if not seen:
        return _listed(np.zeros(len(content) + 1, np.int32), [pa.array([], t) for t in _FIELDS.values()])
    rows, pos, kinds, sizes = (np.concatenate(c) for c in zip(*seen))
    order = np.argsort(rows, kind="stable")
    rows, pos, kinds, sizes = rows[order], pos[order], kinds[order], sizes[order]
    ends = np.zeros(len(content) + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=len(content)), out=ends[1:])
    left = (held[rows] - pos - header).astype(np.uint64)
    first = base[rows] + pos + header
    # payloads and the bytes between them are the values of one array over the same bytes
    cuts = np.empty(2 * len(rows) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = first, first + np.minimum(sizes, left).astype(np.int64), len(raw)
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(rows), [None, pa.py_buffer(cuts), data])
    wanted = np.isin(kinds, [int.from_bytes(t.encode(), "big") for t in decoded])
    payload = pieces.take(pa.array(2 * np.arange(len(rows)), mask=~wanted)).cast(pa.binary())
    digits = np.zeros((len(rows), 2), np.uint64)
    digits[:, 0] = sizes
    size = pa.Array.from_buffers(pa.decimal128(20, 0), len(rows), [None, pa.py_buffer(digits)])
    ordinal = np.arange(len(rows)) - ends[rows]
    return _listed(ends.astype(np.int32), [pa.array(ordinal.astype(np.int32)), _texts(kinds), pa.array(pos + header), size, payload])


def _listed(ends: np.ndarray, fields: list[pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, list(_FIELDS)))


def marker_entries(bodies: pa.Array) -> pa.Array:
    """Positions in all marker bodies of each file, in order: as many as a body declares and holds; null where there is no list of bodies."""
    starts, counts = _lists(bodies)
    base, held, raw, _ = _spans(bodies.values)
    n = np.zeros(len(base), np.int64)
    told = np.flatnonzero(held >= 20)
    n[told] = np.minimum(_u32(raw, base[told] + 16).astype(np.int64), (held[told] - 20) // 12)
    up_to = np.concatenate([[0], np.cumsum(n)])
    # bodies of a null or sliced-off list belong to no file
    per_file = up_to[starts + counts] - up_to[starts]
    body = np.repeat(np.arange(len(base)), n)
    at = base[body] + 28 + 12 * (np.arange(len(body)) - up_to[body])
    values = _u32(raw, at).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(per_file)])
    first = np.repeat(up_to[starts] - ends[:-1], per_file)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[np.arange(ends[-1]) + first]), mask=bodies.is_null())


def _lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First value and number of values of each list, none for null."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return ends[:-1], np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
