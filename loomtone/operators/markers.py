"""Beat markers: even grids, onset-based lists, fill-ins, and the choice between them. Markers are long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.operators.blocked import explode_count, join_unique

SUBDIVISIONS = 4


def grid_size(beats: Column, subdivisions: int = SUBDIVISIONS) -> Column:
    """Markers of an even grid: one per subdivision and the end, or start and end when there are no beats."""
    return F.when(beats > 0, beats.cast("bigint") * subdivisions + 1).otherwise(F.lit(2).cast("bigint"))


def grid_markers(
    df: DataFrame,
    key: str,
    frames: str = "num_frames",
    beats: str = "beat_count",
    subdivisions: int = SUBDIVISIONS,
) -> DataFrame:
    """``(key, idx, pos)``: evenly spaced positions, rounded half-even, the last one forced to the frame count.

    Positions are made row by row from the index; equal neighbours are kept.
    """
    slim = df.select(key, F.col(frames).cast("bigint").alias("_frames"), F.col(beats).alias("_beats"))
    size = grid_size(F.col("_beats"), subdivisions)
    rows = explode_count(slim.withColumn("_size", size), F.col("_size"), "idx")
    step = F.col("_frames") / F.nullif(F.col("_beats"), F.lit(0)) / F.lit(subdivisions)
    even = F.least(F.rint(F.col("idx") * step).cast("bigint"), F.col("_frames"))
    pos = (
        F.when(F.col("idx") == F.col("_size") - 1, F.col("_frames"))
        .when(F.col("_beats") > 0, even)
        .otherwise(F.lit(0).cast("bigint"))
    )
    return rows.select(key, F.col("idx").cast("int").alias("idx"), pos.alias("pos"))


def midi_grid_markers(df: DataFrame, key: str, duration: str = "duration", beats: str = "beat_count") -> DataFrame:
    """The even grid of MIDI loops on a virtual 44.1 kHz clock; only loops with beats and a length have one."""
    frames = (F.col(duration) * F.lit(dims.DEFAULT_SAMPLE_RATE)).cast("bigint")
    timed = df.filter((F.col(duration) > 0) & (F.col(beats) > 0)).withColumn("_clock", frames)
    return grid_markers(timed, key, "_clock", beats)


def build_markers(onsets: DataFrame, files: DataFrame, key: str, frames: str = "num_frames") -> DataFrame:
    """``(key, pos)``: start, every onset strictly inside the file, and end, without repeats."""
    length = files.select(key, F.col(frames).cast("bigint").alias("_frames"))
    inside = join_unique(onsets.select(key, "pos"), length, key, "pos").filter("pos > 0 AND pos < _frames").select(key, F.col("pos").cast("bigint"))
    ends = length.select(key, F.explode(F.array(F.lit(0).cast("bigint"), F.col("_frames"))).alias("pos"))
    return inside.unionByName(ends).distinct()


def fallback_markers(
    markers: DataFrame, files: DataFrame, key: str, frames: str = "num_frames", minimum: str = "min_markers"
) -> DataFrame:
    """Add evenly spaced markers to files that have fewer than their minimum; other files stay as they are."""
    have = markers.distinct().groupBy(key).agg(F.count("*").alias("_have"))
    short = files.select(
        key, F.col(frames).cast("bigint").alias("_frames"), F.col(minimum).cast("bigint").alias("_min")
    ).join(have, key)
    short = short.filter((F.col("_have") < F.col("_min")) & (F.col("_min") > 1))
    rows = explode_count(short, F.col("_min"), "_i")
    interval = F.col("_frames") / F.nullif(F.col("_min") - 1, F.lit(0))
    even = F.least(F.rint(F.col("_i") * interval).cast("bigint"), F.col("_frames"))
    return markers.select(key, "pos").unionByName(rows.select(key, even.alias("pos"))).distinct()


def choose_markers(
    files: DataFrame, onset: DataFrame, key: str, enabled: bool = True, loop_type: str = "loop_type"
) -> DataFrame:
    """``(key, pos, source)``: onset markers of audio files that have them, else the even grid.

    The files are split before the grid is laid out, so no grid is made and dropped again.
    """
    files = files.select(key, "num_frames", "beat_count", F.col(loop_type).alias("_type"))
    if not enabled:
        return grid_markers(files, key).select(key, "pos", F.lit("grid").alias("source"))
    audio = files.filter(F.col("_type") == "audio").select(key)
    chosen = join_unique(onset.select(key, "pos"), audio, key, "pos", "left_semi")
    ready = chosen.select(key).distinct().withColumn("_ready", F.lit(True))
    rest = files.join(ready, key, "left").filter("_ready IS NULL")
    grid = grid_markers(rest, key).select(key, "pos", F.lit("grid").alias("source"))
    return chosen.select(key, "pos", F.lit("onset").alias("source")).unionByName(grid)


def sort_markers(markers: DataFrame, key: str) -> DataFrame:
    """Distinct positions of each file in ascending order, as rows; a range-partitioned sort, so no file is gathered."""
    return markers.select(key, "pos").distinct().orderBy(key, "pos")


def marker_summary(markers: DataFrame, key: str) -> DataFrame:
    """Count, first and last position per file."""
    return markers.groupBy(key).agg(
        F.count("*").alias("marker_count"),
        F.min_by("pos", "idx").alias("first_pos"),
        F.max_by("pos", "idx").alias("last_pos"),
    )
