"""Rounding and derived figures."""

from pyspark.sql import functions as F

from loomtone.functions import display as D
from loomtone.functions import numbers as N
from loomtone.operators.markers import fallback_markers, grid_markers


def test_tempo_table(spark):
    df = spark.createDataFrame([(8, 4.0), (16, 8.0), (8, 3.2), (4, 2.0), (8, 5.0)], "b int, d double")
    got = [r[0] for r in df.select(N.tempo_from_beats(F.col("b"), F.col("d"), F.lit(None).cast("int"))).collect()]
    assert got == [120.0, 120.0, 150.0, 120.0, 96.0]


def test_rounding_follows_the_binary_value(spark):
    values = [2.675, 0.125, 2.5, 1e-9, 1234567.891, 0.005, 59.9996, 12.345, 0.615, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(N.round_to(F.col("x"), 2)).collect()] == [round(v, 2) for v in values]
    assert [r[0] for r in df.select(N.fixed_text(F.col("x"), 0)).collect()] == [f"{v:.0f}" for v in values]
    assert [r[0] for r in df.select(N.fixed_text(F.col("x"), 3)).collect()] == [f"{v:.3f}" for v in values]


def test_beats_round_half_even_and_zero_is_unknown(spark):
    df = spark.createDataFrame([(60, 2.5), (60, 3.5), (0, 4.0), (120, 0.0), (None, 1.0)], "t int, d double")
    assert [r[0] for r in df.select(N.beat_count(F.col("t"), F.col("d"))).collect()] == [2, 4, None, None, None]


def test_duration_texts(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (5.1234,), (59.9996,), (61.0,), (3600.5,)], "s double")
    assert [r[0] for r in df.select(D.fmt_duration(F.col("s"))).collect()] == [
        "0:00.000", "0:00.000", "0:05.123", "0:60.000", "1:01.000", "60:00.500",
    ]
    sizes = spark.createDataFrame([(1023,), (1024,), (1048575,), (1048576,)], "n bigint")
    assert [r[0] for r in sizes.select(D.fmt_size(F.col("n"))).collect()] == ["1023 B", "1.0 KB", "1024.0 KB", "1.00 MB"]


def test_grid_of_eight_beats(spark):
    df = spark.createDataFrame([(1, 176400, 8), (2, 100, 0), (3, 3, 2)], "id int, num_frames bigint, beat_count int")
    rows = {}
    for r in grid_markers(df, "id").orderBy("id", "idx").collect():
        rows.setdefault(r["id"], []).append(r["pos"])
    assert len(rows[1]) == 33 and rows[1][:5] == [0, 5512, 11025, 16538, 22050] and rows[1][-1] == 176400
    assert rows[2] == [0, 100]
    assert rows[3] == [0, 0, 1, 1, 2, 2, 2, 3, 3]


def test_fallback_fills_only_short_lists(spark):
    files = spark.createDataFrame([(1, 100, 5), (2, 100, 1), (3, 100, 3)], "id int, num_frames bigint, min_markers int")
    have = spark.createDataFrame([(1, 0), (1, 100), (2, 0), (3, 0), (3, 10), (3, 100)], "id int, pos bigint")
    got = {}
    for r in fallback_markers(have, files, "id").collect():
        got.setdefault(r["id"], set()).add(r["pos"])
    assert got == {1: {0, 25, 50, 75, 100}, 2: {0}, 3: {0, 10, 100}}
