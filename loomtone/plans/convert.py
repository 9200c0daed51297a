"""The convert job: scan, classify, settle, lay out markers, report. One lazy plan over a whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.operators import markers as M
from loomtone.operators import resolve as R
from loomtone.operators.midi_stats import midi_summary
from loomtone.sources.files import LIBRARY_EXTENSIONS, is_midi, path_parts, read_content
from loomtone.sources.listing import list_library
from loomtone.sources.midi import midi_events
from loomtone.workspace import keep


def midi_facts(files: DataFrame, key: str = "path", number: int | None = None) -> DataFrame:
    """``(key, midi)``: the facts of MIDI files with their bytes in ``content``; ``number`` of them, if known, see :func:`midi_summary`."""
    summary = midi_summary(midi_events(files, key), key, number)
    default = F.coalesce("time_signature", F.lit("4/4"))
    return summary.select(
        key,
        F.struct(
            F.col("tempo"),
            F.coalesce("key_signature", F.lit("")).alias("key_signature"),
            F.coalesce("key_type", F.lit("")).alias("key_type"),
            default.alias("time_signature"),
            F.col("duration"),
            F.col("beat_count"),
            F.col("programs"),
            F.col("tracks"),
            F.col("notes"),
        ).alias("midi"),
    )


def convert_catalog(
    files: DataFrame,
    midi: DataFrame | None = None,
    durations: DataFrame | None = None,
    overrides: DataFrame | None = None,
    run: R.RunOverrides | None = None,
    key: str = "path",
    root: str | None = None,
    dictionaries: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Metadata of each listed file.

    ``files`` needs ``path`` (parts are added when missing). ``midi``: ``(key, midi)`` from :func:`midi_facts`.
    ``durations``: ``(key, audio_duration)`` from probe logs. Overrides are applied last, so they always hold.
    A file with a MIDI suffix and no facts is MIDI, has no length and says so in ``error``. ``dictionaries`` take the place of the built-in ones, see :func:`loomtone.operators.resolve.detect`.
    """
    if "stem" not in files.columns:
        files = path_parts(files, "path", root)
    found = R.detect(files, dictionaries=dictionaries)
    if midi is not None:
        found = found.join(midi, key, "left")
    by_suffix = is_midi(F.col("ext")) if midi is not None and "ext" in found.columns else None
    settled = R.resolve_metadata(found, "midi" if midi is not None else None, by_suffix)
    unread = (F.col("loop_type") == "midi") & F.col("midi").isNull() if midi is not None else F.lit(False)
    settled = settled.withColumn("error", F.when(unread, F.lit("no MIDI header")))
    if durations is not None:
        settled = settled.join(durations, key, "left")
    elif "audio_duration" not in settled.columns:
        settled = settled.withColumn("audio_duration", F.lit(None).cast("double"))
    if overrides is not None:
        settled = R.merge_overrides(settled, overrides, key)
    if run is not None:
        settled = R.merge_literal_overrides(settled, run)
    settled = R.settle_beats(settled, "audio_duration").drop("audio_duration")
    fixed = [c for c in ("beat_count",) if overrides is not None and c in overrides.columns]
    if fixed:
        settled = R.merge_overrides(settled, overrides, key, fixed)
    if run is not None and run.beat_count:
        settled = R.merge_literal_overrides(settled, R.RunOverrides(beat_count=run.beat_count))
    return settled


def convert_listed(listed: DataFrame, root: str, **options) -> DataFrame:
    """Catalog of the good files of a listing; bytes are read for MIDI files only."""
    files = path_parts(listed.where(F.col("reason").isNull()).drop("reason"), "path", root)
    midi = files.where(is_midi(F.col("ext")))
    return convert_catalog(files, midi_facts(read_content(midi), number=midi.count()), root=root, **options)


def convert_library(spark: SparkSession, root: str, recursive: bool = True, **options) -> DataFrame:
    """Catalog of a library on disk, listed once by tasks when this is called."""
    return convert_listed(list_library(spark, root, LIBRARY_EXTENSIONS, recursive), root, **options)


def run_markers(catalog: DataFrame, onsets: DataFrame | None = None, key: str = "path") -> DataFrame:
    """``(key, pos, source)``: beat markers of the files that were read.

    Audio files with ``onsets(key, pos)`` take start, onsets and end, filled up evenly to one marker more than they have beats; others
    take the even grid, MIDI files only with beats and a length. Positions count samples of 44.1 kHz, or of ``num_frames`` if there.
    """
    frames = F.rint(F.col("duration") * F.lit(dims.DEFAULT_SAMPLE_RATE)).cast("bigint")
    frames = F.coalesce("num_frames", frames) if "num_frames" in catalog.columns else frames
    files = catalog.where("error IS NULL").select(
        key, "loop_type", "duration", "beat_count", frames.alias("num_frames"), (F.col("beat_count") + 1).alias("min_markers"))
    files = files.where("loop_type = 'audio' OR (duration > 0 AND beat_count > 0)")
    if onsets is None:
        return M.choose_markers(files, None, key, enabled=False)
    heard = files.where("loop_type = 'audio'").join(onsets.select(key).distinct(), key, "left_semi")
    built = M.build_markers(onsets.join(heard.select(key), key, "left_semi"), heard, key)
    return M.choose_markers(files, M.fallback_markers(built, heard, key), key)


def convert_run(
    spark: SparkSession, root: str, recursive: bool = True, onsets: DataFrame | None = None, **options
) -> DataFrame:
    """One row per convertible file below ``root``, also those that could not be read, with its marker count.

    The library is listed once. ``status``: ``OK``; ``FAILED`` for damaged MIDI, empty and unreadable files; ``SKIPPED`` for hidden ones. ``error`` tells why.
    :func:`loomtone.operators.stats.batch_stats` of the rows gives the counts of the run.
    """
    listed = list_library(spark, root, LIBRARY_EXTENSIONS, recursive)
    catalog = keep(convert_listed(listed, root, **options), "catalog")
    missed = listed.where(F.col("reason").isNotNull()).select("path", F.col("reason").alias("error"))
    missed = path_parts(missed, "path", root).withColumns({
        "loop_type": F.when(is_midi(F.col("ext")), F.lit("midi")).otherwise(F.lit("audio")), "markers": F.lit(0).cast("bigint")})
    rows = report_rows(catalog, markers=run_markers(catalog, onsets)).unionByName(missed, allowMissingColumns=True)
    status = F.when(F.col("error").isNull(), F.lit("OK")).when(F.col("error") == "hidden file", F.lit("SKIPPED"))
    return rows.withColumn("status", status.otherwise(F.lit("FAILED")))


def report_rows(catalog: DataFrame, status: str = "OK", markers: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Catalog rows with a marker count and a status, ready for the report; without ``markers`` the count of the even grid."""
    if markers is None:
        count = F.when(F.col("beat_count") > 0, M.grid_size(F.col("beat_count"))).otherwise(F.lit(0))
        return catalog.withColumns({"markers": count, "status": F.lit(status)})
    counted = markers.groupBy(key).agg(F.count("*").alias("markers"))
    joined = catalog.join(counted, key, "left").withColumn("markers", F.coalesce("markers", F.lit(0).cast("bigint")))
    return joined.withColumn("status", F.lit(status))
