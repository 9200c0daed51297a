"""Files with ordinary but awkward names, and rows that used to be lost."""

from loomtone.operators import lookup, midi_stats, resolve
from loomtone.sources import files


def test_names_with_blanks_and_signs(spark, tmp_path):
    root = tmp_path / ".cache lib"
    (root / "Hip Hop").mkdir(parents=True)
    for name, data in {"Hip Hop/pad_F#m_90bpm.caf": b"caff", "100%.caf": b"x", "empty.caf": b"", "_kept.caf": b"y", "é ü.caf": b"z"}.items():
        (root / name).write_bytes(data)
    for top in (str(root), f"file://{root}", f"file:{root}"):
        listed = files.list_tree(spark, top)
        got = {r.path.rsplit("lib/", 1)[1]: bytes(r.content) for r in files.read_content(listed).collect()}
        assert got == {"Hip Hop/pad_F#m_90bpm.caf": b"caff", "100%.caf": b"x", "empty.caf": b"", "_kept.caf": b"y", "é ü.caf": b"z"}
        scanned = files.scan_library(spark, str(root))
        assert scanned.count() == files.read_content(scanned).count() == 3
        skipped = {r.file_name: r.error for r in files.skipped_files(listed, scanned, ["caf"], top).collect()}
        assert skipped == {"empty.caf": "empty file", "_kept.caf": "hidden file"}


def test_stores_keep_their_scheme():
    import pyarrow.fs as fs

    system, inner, prefix = files.open_store("/lib/a#b c%.caf")
    assert isinstance(system, fs.LocalFileSystem) and (inner, prefix) == ("/lib/a#b c%.caf", "")
    assert files.open_store("file:///lib/a")[1:] == ("/lib/a", "file://")


def test_wide_ranges(spark):
    ranges = spark.createDataFrame([(0, 8, "a"), (5, 10**12, "b"), (-(2**40), 0, "c"), (7, 8, "d"), (9, 9, "none")], "lo bigint, hi bigint, name string")
    rows = spark.createDataFrame([(v,) for v in (-(2**40), -1, 0, 5, 7, 8, 10**12 - 1, 10**12)], "v bigint")
    got = sorted((r.v, r.name) for r in lookup.range_lookup(rows, "v", ranges).collect())
    held = [tuple(r) for r in ranges.collect()]
    assert got == sorted((r.v, n) for r in rows.collect() for lo, hi, n in held if lo <= r.v < hi)
    assert lookup.range_lookup(rows, "v", ranges.limit(0)).count() == 0


def test_one_row_per_file_with_repeated_overrides(spark):
    df = spark.createDataFrame([(1, 90), (2, 80)], "id bigint, tempo int")
    over = spark.createDataFrame([(1, 100, 1), (1, 95, 2), (1, None, 0)], "id bigint, tempo int, n int")
    assert sorted(map(tuple, resolve.merge_overrides(df, over, "id").collect())) == [(1, 100), (2, 80)]
    assert sorted(map(tuple, resolve.merge_overrides(df, over, "id", order="n").collect())) == [(1, 95), (2, 80)]


def test_damaged_program_bytes_count(spark):
    events = spark.createDataFrame([(1, 0, k, 0, "program_change", 0, p, 0) for k, p in enumerate((0, 127, 128, 200, 255))],
                                   "file_id bigint, track int, ord bigint, delta bigint, kind string, channel int, a int, b int")
    assert midi_stats.midi_distinct_sets(events).first().programs == [0, 127, 128, 200, 255]
    assert midi_stats.midi_summary(events).first().programs == [0, 127, 128, 200, 255]
