"""MIDI bytes to events to figures."""

import random
import struct

from loomtone.operators import midi_stats as M
from loomtone.operators.blocked import running_sum
from loomtone.plans import convert
from loomtone.sources import midi
from loomtone.sources.files import path_parts


def varlen(n):
    out = [n & 0x7F]
    while n := n >> 7:
        out.append((n & 0x7F) | 0x80)
    return bytes(reversed(out))


def smf(*tracks, division=480):
    out = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), division)
    for t in tracks:
        out += b"MTrk" + struct.pack(">I", len(t)) + t
    return out


def summary(spark, **files):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file_id string, content binary")
    return {r["file_id"]: r for r in M.midi_summary(midi.midi_events(df)).collect()}


def test_running_status_zero_velocity_and_long_lengths(spark):
    text = b"\x00\xff\x01" + varlen(300) + b"t" * 300
    a = text + b"\x00\x90\x3c\x40" + varlen(200) + b"\x3c\x00" + b"\x00\x40\x40" + varlen(70000) + b"\x40\x00\x00\xff\x2f\x00"
    sysex = b"\x00\xf0" + varlen(3) + b"\x01\x02\xf7" + b"\x05\x91\x3c\x01" + b"\x00\xc1\x21"
    got = summary(spark, a=smf(a), b=smf(sysex, a, division=0xE728))
    assert (got["a"]["notes"], got["a"]["total_ticks"], got["a"]["channels"]) == (2, 70200, [0])
    assert (got["b"]["notes"], got["b"]["channels"], got["b"]["programs"]) == (3, [0, 1], [33])
    assert got["b"]["ticks_per_beat"] == 480 and got["a"]["tempo_us"] is None and got["a"]["tempo"] == 120


def test_last_meta_wins_across_tracks_and_unknown_keys_do_not_count(spark):
    one = b"\x00\xff\x51\x03\x07\xa1\x20\x00\xff\x59\x02\xff\x01\x00\xff\x59\x02\x09\x00"
    two = b"\x00\xff\x51\x03\x03\xd0\x90\x00\xff\x58\x04\x07\x03\x18\x08\x83\x60\xff\x2f\x00"
    got = summary(spark, a=smf(one, two))["a"]
    assert (got["tempo"], got["time_signature"], got["key_signature"], got["key_type"]) == (240, "7/8", "D", "minor")
    assert got["total_ticks"] == 480 and got["duration"] == 480 * (250000 / 1e6) / 480 and got["beat_count"] == 1


def test_damaged_files_give_what_can_be_read(spark):
    whole = smf(b"\x00\x90\x3c\x40\x81\x00\x80\x3c\x00")
    for cut in range(len(whole)):
        list(midi.file_events(whole[:cut]))
    assert list(midi.file_events(b"RIFF" + whole)) == []
    kinds = [e[3] for e in midi.file_events(whole[:-1])]
    assert kinds == ["header", "note_on", "tail"]


def test_large_files_come_in_batches(spark, monkeypatch):
    monkeypatch.setattr(midi, "FLUSH_ROWS", 7)
    track = b"".join(b"\x01\x90\x3c\x40" for _ in range(100))
    df = spark.createDataFrame([(i, bytearray(smf(track))) for i in range(5)], "file_id int, content binary")
    assert midi.midi_events(df).filter("kind = 'note_on'").count() == 500


def test_running_ticks_do_not_depend_on_block_size(spark):
    rng = random.Random(1)
    rows = [(f, t, o, rng.randrange(50)) for f in range(3) for t in range(2) for o in rng.sample(range(400), 90)]
    df = spark.createDataFrame(rows, "file_id int, track int, ord bigint, delta bigint")
    want, acc = {}, {}
    for f, t, o, d in sorted(rows):
        acc[f, t] = acc.get((f, t), 0) + d
        want[f, t, o] = acc[f, t]
    for size in (1, 7, 64, 10_000):
        got = running_sum(df, ["file_id", "track"], "ord", "delta", "tick", size)
        assert {(r[0], r[1], r[2]): r["tick"] for r in got.collect()} == want


def test_events_from_sql(spark):
    midi.register_midi_events(spark, prefix="events")
    track = b"MTrk" + (8).to_bytes(4, "big") + bytes.fromhex("00903C40 00FF2F00")
    whole = b"MThd" + bytes.fromhex("00000006 0000 0001 0060") + track
    long = b"MThd" + bytes.fromhex("00000006 0000 0001 0060") + b"MTrk" + (4 * 50_000).to_bytes(4, "big") + bytes.fromhex("00903C40") * 50_000
    spark.createDataFrame([("a", whole), ("b", None), ("c", b"no MIDI"), ("d", long)], "path string, content binary").createOrReplaceTempView("midi_texts")
    got = spark.sql("SELECT path, e.* FROM midi_texts f, LATERAL events_of(f.content) e")
    counts = {r.path: (r.n, r.k) for r in got.groupBy("path").agg({"ord": "count", "kind": "max"}).toDF("path", "n", "k").collect()}
    assert counts == {"a": (3, "note_on"), "d": (50_001, "note_on")}
    same = midi.midi_events(spark.table("midi_texts"), "path")
    assert sorted(map(str, got.collect())) == sorted(map(str, same.collect()))
    table = spark.sql("SELECT file AS path, * EXCEPT (file) FROM events(TABLE(SELECT path, content FROM midi_texts))")
    assert table.columns == same.columns and sorted(map(str, table.collect())) == sorted(map(str, same.collect()))


def test_a_task_groups_a_bounded_number_of_files(spark, monkeypatch):
    monkeypatch.setattr(M, "FILES_PER_TASK", 5)
    track = b"\x00\x93\x3c\x40\x64\x3c\x00\x00\xff\x2f\x00"
    rows = [(k, bytearray(smf(b"\x00\xc1\x21", track * (k % 4 + 1)))) for k in range(400)] + [(None, bytearray(smf(track))), (7, bytearray(smf(track, track)))]
    files = spark.createDataFrame(rows, "id bigint, content binary").repartition(3)
    plain = M.midi_summary(midi.midi_events(files, "id"), "id")
    dealt = M.midi_summary(midi.midi_events(files, "id"), "id", len(rows))
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect())) and len(plain.collect()) == 401
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == 81 and max(sizes) <= 20


def test_a_join_of_facts_keeps_their_dealing(spark, monkeypatch):
    monkeypatch.setattr(M, "FILES_PER_TASK", 5)
    files = spark.createDataFrame([(k, bytearray(smf(b"\x00\xc1\x21"))) for k in range(400)], "id bigint, content binary").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listed = path_parts(files.selectExpr("id", "'/lib/take.mid' path"), "path", "/lib")
        sizes = [len(p) for p in convert.convert_catalog(listed, convert.midi_facts(files, "id", 400), key="id").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(sizes) == 80 and sum(sizes) == 400 and max(sizes) <= 20
