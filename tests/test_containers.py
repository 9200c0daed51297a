"""Chunk walks and fields on odd and damaged bytes."""

import struct

from pyspark.sql import functions as F

from loomtone import dims
from loomtone.functions import binary as B
from loomtone.operators.sinks import split_errors
from loomtone.plans.decode import decode_files
from loomtone.sources import containers as C


def caf(*chunks, sizes=None):
    out = b"caff\x00\x01\x00\x00"
    for i, (kind, body) in enumerate(chunks):
        size = (sizes or {}).get(i, len(body))
        out += kind + struct.pack(">Q", size) + body
    return out


def walked(spark, data, fn):
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    rows = C.explode_chunks(df.withColumn("chunks", fn(F.col("content"))).withColumn("id", F.lit(1)), "id").orderBy("ord")
    return [(r["type"], r["off"], int(r["size"])) for r in rows.collect()]


def plain_walk(data):
    pos, out = 8, []
    while pos < len(data) - 12:
        size = struct.unpack(">Q", data[pos + 4 : pos + 12])[0]
        out.append((data[pos : pos + 4].decode("latin-1"), pos + 12, size))
        pos += 12 + size
    return out


def test_long_chains_are_walked_to_the_end(spark):
    data = caf(*[(b"c%03d" % (i % 1000), b"x" * (i % 5)) for i in range(700)])
    assert walked(spark, data, C.caf_chunks) == plain_walk(data)


def test_size_to_the_end_empty_tail_and_tiny_files(spark):
    data = caf((b"desc", b"abc"), (b"data", b"z" * 30), sizes={1: 2**64 - 1})
    assert walked(spark, data, C.caf_chunks) == plain_walk(data) == [("desc", 20, 3), ("data", 35, 2**64 - 1)]
    tail = caf((b"free", b"1234"), (b"last", b""))
    assert walked(spark, tail, C.caf_chunks) == [("free", 20, 4)]
    assert walked(spark, b"caff", C.caf_chunks) == []
    assert walked(spark, b"", C.caf_chunks) == []


def test_a_batch_of_files_is_walked_together(spark):
    whole = caf((b"desc", b"abc"), (b"d\xe4ta", b""), (b"uuid", b"0123456789" * 9))
    rows = [(k, None if k % 7 == 0 else bytearray(whole[: k % len(whole)])) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, content binary").repartition(3)
    walk = df.select("id", C.caf_chunks(F.col("content")).alias("c"))
    assert "lambdafunction" not in walk._jdf.queryExecution().optimizedPlan().toString()  # no fold over texts of bytes
    for r in walk.collect():
        data = bytes(rows[r["id"]][1] or b"")
        want = [(i, t.replace("\xe4", "\ufffd"), off, n, data[off:off + n] if t in C.PAYLOAD_TYPES else None) for i, (t, off, n) in enumerate(plain_walk(data))]
        assert [(c["ord"], c["type"], c["off"], int(c["size"]), c["payload"] and bytes(c["payload"])) for c in r["c"]] == want


def test_marker_entries_of_several_bodies_and_none(spark):
    one, two, bare = markers(5, 0, 48000, 2**32 - 1)[16:], markers(1, 7, 8)[16:], b"short"
    rows = [(0, [one, two]), (1, None), (2, []), (3, [bare, two]), (4, [one[:-1]])]
    df = spark.createDataFrame([(k, None if b is None else [bytearray(x) for x in b]) for k, b in rows], "id int, b array<binary>").coalesce(1)
    got = {r["id"]: r["m"] for r in df.select("id", C.read_markers(F.col("b")).alias("m")).collect()}
    assert {k: m["positions"] for k, m in got.items()} == {0: [0, 48000, 2**32 - 1, 7], 1: None, 2: [], 3: [7], 4: [0, 48000]}
    assert [got[k]["declared"] for k in range(5)] == [1, None, None, 1, 5]


def test_odd_aiff_chunks_are_padded(spark):
    body = b"NAME" + struct.pack(">I", 3) + b"abc\x00" + b"COMM" + struct.pack(">I", 18) + b"\x00" * 18 + b"ENDS" + struct.pack(">I", 1) + b"x"
    data = b"FORM" + struct.pack(">I", len(body) + 4) + b"AIFF" + body
    assert [t for t, _, _ in walked(spark, data, C.aiff_chunks)] == ["NAME", "COMM", "ENDS"]


def test_numbers_in_bytes(spark):
    values = [44100.0, 0.0, -1.5, 5e-324, 1.7976931348623157e308, 96000.123]
    df = spark.createDataFrame([(bytearray(struct.pack(">d", v)), v) for v in values], "d binary, v double")
    assert all(r[0] == r[1] for r in df.select(B.be_double(F.col("d"), 0), "v").collect())
    ints = spark.createDataFrame([(bytearray(struct.pack(">q", v)), v) for v in (-1, 0, 2**62, -(2**63))], "d binary, v bigint")
    assert all(r[0] == r[1] for r in ints.select(B.be_i64(F.col("d"), 0), "v").collect())
    short = spark.createDataFrame([(bytearray(b"\x01"),)], "d binary")
    assert short.select(B.be_uint(F.col("d"), 0, 4)).first()[0] is None


def test_pairs_stop_at_a_missing_nul_and_keep_bad_bytes_visible(spark):
    data = struct.pack(">I", 9) + b"genre\x00Funk\x00ke\xffy\x00val\x00open\x00cut"
    df = spark.createDataFrame([(bytearray(data),)], "d binary")
    got = [(p["key"], p["value"]) for p in df.select(B.nul_pairs(F.col("d"))).first()[0]]
    assert got == [("genre", "Funk"), ("ke�y", "val")]
    one = spark.createDataFrame([(bytearray(bytes.fromhex("00000001" "67656e726500" "46756e6b00")),)], "d binary")
    assert [(p["key"], p["value"]) for p in one.select(B.nul_pairs(F.col("d"))).first()[0]] == [("genre", "Funk")]


def tags(*pairs):
    return bytes.fromhex(dims.TAG_UUID) + struct.pack(">I", len(pairs)) + b"".join(k + b"\x00" + v + b"\x00" for k, v in pairs)


def markers(count, *positions):
    head = struct.pack(">IIHHII", 0, 0x10000, 0x32, 0x10, 0, count)
    return bytes.fromhex(dims.MARKER_UUID) + head + b"".join(struct.pack(">HHII", 1, 0, 0, p) for p in positions)


def test_records(spark):
    desc = struct.pack(">d4sIIIII", 48000.0, b"aac ", 0, 0, 0, 2, 16)
    pakt = struct.pack(">qqii", 1, 96000, 0, 0)
    full = caf(
        (b"desc", desc), (b"pakt", pakt), (b"data", b"desc pakt uuid"), (b"uuid", tags((b"genre", b"Jazz"), (b"beat count", b"4"))),
        (b"uuid", tags((b"beat count", b"x4"), (b"category", b"Bass"))), (b"info", struct.pack(">I", 1) + b"genre\x00Funk\x00"),
        (b"uuid", markers(5, 0, 48000, 96000)),
    )
    late = caf((b"pakt", pakt), (b"desc", desc), (b"uuid", tags((b"beat count", b"8"))), (b"free", b"."))
    rows = [("/a.caf", full), ("/late.caf", late), ("/bad.caf", b"RIFFxxxx"), ("/none.caf", b""), ("/tiny.caf", b"caff")]
    files = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length bigint, content binary")
    done = decode_files(files)
    good, bad = split_errors(done)
    got = {r["file_path"]: r for r in good.collect()}
    assert set(got) == {"/a.caf", "/late.caf"}
    a = got["/a.caf"]
    assert (a["audio"]["duration"], a["audio"]["codec"], a["audio"]["channels"]) == (2.0, "AAC", 2)
    assert a["metadata"]["genre"] == "Funk"  # the later chunk wins
    assert a["metadata"]["beat_count"] == 0 and a["metadata"]["tempo"] is None  # last pair wins, not a number
    assert a["metadata"]["category"] == "Bass"
    assert a["beat_markers"]["marker_count"] == 5 and a["beat_markers"]["positions"] == [0, 48000, 96000]
    assert a["beat_markers"]["positions_seconds"] == [0.0, 1.0, 2.0]
    assert a["spotlight"] == {"genre": "Funk"} and len(a["raw_chunks"]) == 5
    assert got["/late.caf"]["audio"]["duration"] is None  # no rate was known at the packet table
    errors = {r["file"]: r["error"] for r in bad.collect()}
    assert errors == {
        "/bad.caf": "Unknown file format: /bad.caf",
        "/none.caf": "Unknown file format: /none.caf",
        "/tiny.caf": "Invalid CAF file: too short",
    }
    assert done.count() == len(rows)
