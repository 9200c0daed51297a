"""Precedence, overrides, edits, targets and streams."""

import os

from loomtone.operators import resolve as V
from loomtone.operators import sinks
from loomtone.operators.stats import batch_stats, progress
from loomtone.plans.convert import convert_catalog, convert_library, convert_run
from loomtone.sources.files import list_tree, scan_library, skipped_files
from loomtone.streaming import arrivals, ingest, status

MIDI = "midi struct<tempo:int,key_signature:string,key_type:string,time_signature:string,duration:double,beat_count:int,programs:array<int>>"


def test_precedence(spark):
    files = spark.createDataFrame([("/l/Kick_100bpm_Am.mid",), ("/l/take_x.mid",), ("/l/pad_Cm.wav",)], "path string")
    midi = spark.createDataFrame(
        [("/l/Kick_100bpm_Am.mid", (90, "D", "major", "3/4", 6.0, 9, [0])), ("/l/take_x.mid", (90, "D", "major", "3/4", 6.0, 9, [33]))],
        f"path string, {MIDI}",
    )
    got = {r["stem"]: r for r in convert_catalog(files, midi, root="/l").collect()}
    kick, take, pad = got["Kick_100bpm_Am"], got["take_x"], got["pad_Cm"]
    assert (kick["tempo"], kick["key_signature"], kick["key_type"], kick["beat_count"]) == (100, "", "neither", 10)
    assert (take["tempo"], take["key_signature"], take["category"], take["time_signature"]) == (90, "D", "Bass", "3/4")
    assert (pad["loop_type"], pad["key_signature"], pad["duration"], pad["beat_count"]) == ("audio", "C", 4.0, 0)


def test_explicit_values_win_last(spark):
    files = spark.createDataFrame([("/l/Loop_120bpm.wav",), ("/l/Pad_90bpm.wav",)], "path string")
    mine = spark.createDataFrame([("/l/Pad_90bpm.wav", None, 7)], "path string, tempo int, beat_count int")
    got = {r["stem"]: r["beat_count"] for r in convert_catalog(files, overrides=mine).collect()}
    assert got == {"Loop_120bpm": 8, "Pad_90bpm": 7}
    run = V.RunOverrides(tempo=60, key="Gm", beat_count=3)
    for r in convert_catalog(files, run=run).collect():
        assert (r["tempo"], r["key_signature"], r["key_type"], r["beat_count"]) == (60, "G", "minor", 3)


def test_batch_edit_touches_only_the_selection(spark):
    df = spark.createDataFrame([(1, 100, "4/4", True), (2, 110, "4/4", True)], "id int, tempo int, time_signature string, auto_tempo boolean")
    chosen = spark.createDataFrame([(2,), (2,), (9,)], "id int")
    got = {r["id"]: tuple(r)[1:] for r in V.apply_batch(df, chosen, "id", V.BatchEdit(tempo=77, time_signature="7/8")).collect()}
    assert got == {1: (100, "4/4", True), 2: (77, "7/8", False)}


def test_targets_that_collide(spark):
    rows = [(f"/l/{d}/a.wav", "a", d) for d in ("x", "y", ".")] + [("/l/x/b.wav", "b", "x")]
    df = spark.createDataFrame(rows, "path string, stem string, rel_parent string")
    flat = {r["path"]: (r["target"], r["collides"]) for r in sinks.plan_output(df, "/o").collect()}
    assert flat["/l/x/a.wav"] == ("/o/a.caf", True) and flat["/l/x/b.wav"] == ("/o/b.caf", False)
    tree = {r["path"]: (r["target"], r["collides"]) for r in sinks.plan_output(df, "/o", True).collect()}
    assert tree["/l/./a.wav"] == ("/o/a.caf", False) and tree["/l/y/a.wav"] == ("/o/y/a.caf", False)


def test_empty_batches(spark):
    none = spark.createDataFrame([], "loop_type string, status string, done boolean")
    assert batch_stats(none).first()["total"] == 0
    assert progress(none).first()["percentage"] == 0.0


def _write(root, name, data):
    os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
    with open(os.path.join(root, name), "wb") as f:
        f.write(data)


def test_library_on_disk(spark, tmp_path):
    root = str(tmp_path)
    _write(root, "Jazz/bass_100bpm.Wav", b"RIFF")
    _write(root, "_x/lead.caf", b"caff\x00\x01\x00\x00")
    _write(root, "empty.caf", b"")
    _write(root, "notes.txt", b"no")
    got = convert_library(spark, root).collect()
    assert [(r["stem"], r["genre"], r["rel_parent"]) for r in got] == [("bass_100bpm", "Jazz", "Jazz")]
    missed = skipped_files(list_tree(spark, root), scan_library(spark, root), ["caf"])
    assert {(r["file_name"], r["error"]) for r in missed.collect()} == {("empty.caf", "empty file"), ("lead.caf", "hidden file")}


def test_damaged_midi_is_midi_and_fails(spark, tmp_path):
    root = str(tmp_path)
    _write(root, "Hip Hop #1/pad_F#m_90bpm.mid", b"not MIDI at all")
    _write(root, "Hip Hop #1/pad 100%_60bpm.wav", b"RIFF")
    _write(root, "gone_90bpm.mid", b"")
    rows = {r["stem"]: r for r in convert_run(spark, root).collect()}
    bad = rows["pad_F#m_90bpm"]
    assert (bad["loop_type"], bad["duration"], bad["beat_count"], bad["markers"], bad["status"]) == ("midi", None, 0, 0, "FAILED")
    assert bad["error"] == "no MIDI header" and rows["gone_90bpm"]["error"] == "empty file"
    good = rows["pad 100%_60bpm"]
    assert (good["loop_type"], good["beat_count"], good["markers"], good["status"]) == ("audio", 4, 17, "OK")
    stats = batch_stats(convert_run(spark, root)).first()
    assert (stats["total"], stats["converted"], stats["errors"], stats["audio"], stats["midi"]) == (3, 1, 2, 1, 0)


def test_stream_takes_new_files_once(spark, tmp_path):
    root, out, state = (str(tmp_path / d) for d in ("lib", "out", "state"))
    _write(root, "a_100bpm.wav", b"RIFF")
    ingest.stream_catalog(spark, root, out, state, source={"settle": 0.05}).awaitTermination()
    _write(root, "b_90bpm.wav", b"RIFF")
    ingest.stream_catalog(spark, root, out, state, source={"settle": 0.05}).awaitTermination()
    ingest.stream_catalog(spark, root, out, state, source={"settle": 0.05}).awaitTermination()
    assert sorted(r["tempo"] for r in spark.read.parquet(out).collect()) == [90, 100]
    assert "content" not in arrivals.read_arrivals(spark, root, state).columns


def test_status_changes_over_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "log", "state"))
    schema = "file_id int, ts timestamp, seq bigint, state string, error string"

    def arrive(rows):
        spark.sql("SELECT * FROM VALUES " + ", ".join(
            f"({f}, timestamp'2024-01-01 00:00:{s:02d}', {s}L, '{st}', CAST({e} AS string))" for f, s, st, e in rows) + " AS t(file_id, ts, seq, state, error)"
        ).write.mode("append").parquet(src)
        events = spark.readStream.schema(schema).parquet(src)
        status.keep_changes(status.latest_status(events), out, state).awaitTermination()

    arrive([(1, 1, "queued", "NULL"), (2, 1, "queued", "NULL"), (1, 5, "completed", "NULL")])
    arrive([(1, 3, "converting", "NULL"), (2, 9, "failed", "'no space'")])
    snapshot = str(tmp_path / "snapshot")

    def held(**where):
        return {r["file_id"]: (r["state"], r["error"]) for r in status.current(spark, out, **where).collect()}

    assert held() == {1: ("completed", None), 2: ("failed", "no space")}
    status.compact(spark, out, snapshot)
    assert held(snapshot=snapshot) == held()
    arrive([(3, 2, "queued", "NULL"), (2, 12, "queued", "NULL")])
    assert held(snapshot=snapshot) == held() == {1: ("completed", None), 2: ("queued", None), 3: ("queued", None)}
    for _ in range(2):
        status.compact(spark, out, snapshot, last=snapshot)
        assert held(snapshot=snapshot) == held()
