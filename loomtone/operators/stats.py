"""Counts over batches of files, events and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def batch_figures() -> list[Column]:
    """The totals of a batch as aggregates over ``(loop_type, status)`` rows.

    Status ``OK`` is converted, ``SKIPPED`` skipped, anything else an error; audio and midi count converted files.
    """
    ok = F.col("status") == "OK"
    skipped = F.col("status") == "SKIPPED"
    return [
        F.count("*").alias("total"),
        F.count_if(ok).alias("converted"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(~ok & ~skipped).alias("errors"),
        F.count_if(ok & (F.col("loop_type") == "audio")).alias("audio"),
        F.count_if(ok & (F.col("loop_type") == "midi")).alias("midi"),
    ]


def decode_figures() -> list[Column]:
    """Files read, decoded and failed, as aggregates over the ``error`` column."""
    return [
        F.count("*").alias("total_files"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    ]


def observed(df: DataFrame, figures: list[Column]) -> tuple[DataFrame, Observation]:
    """``df``, and the figures that come about while it is written: no second pass, no second plan.

    Observe the last stage of a plan, after its last shuffle: tasks of that stage count once however often they are repeated, those of earlier
    ones may count twice when an executor is lost.
    """
    seen = Observation()
    return df.observe(seen, *figures), seen


def batch_stats(results: DataFrame, by_type: bool = False) -> DataFrame:
    """Totals of a batch, see :func:`batch_figures`; ``by_type`` adds one row per loop type to the grand total."""
    return results.rollup("loop_type").agg(*batch_figures()) if by_type else results.agg(*batch_figures())


def scan_counts(files: DataFrame) -> DataFrame:
    """Files found by kind, from a boolean ``is_midi``."""
    return files.groupBy("is_midi").agg(F.count("*").alias("files"))


def decode_summary(decoded: DataFrame) -> DataFrame:
    """Files read, decoded and failed, from the ``error`` column."""
    return decoded.agg(*decode_figures())


def run_result(events: DataFrame) -> DataFrame:
    """Outcome of a run from status events ``(state, ts)``: counts and wall time in seconds."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return events.agg(
        F.count_if(F.col("state") == "completed").alias("success_count"),
        F.count_if(F.col("state") == "failed").alias("failure_count"),
        F.count_if(F.col("state") == "skipped").alias("skipped_count"),
        (span / F.lit(1e6)).alias("total_duration"),
    )


def progress(files: DataFrame, done: str = "done") -> DataFrame:
    """Finished files, all files, and their ratio (zero when there are none)."""
    counts = files.agg(F.count_if(F.col(done)).alias("current_index"), F.count("*").alias("total_files"))
    share = F.col("current_index") / F.nullif(F.col("total_files"), F.lit(0))
    return counts.withColumn("percentage", F.coalesce(share, F.lit(0.0)))


def chunk_inventory(chunks: DataFrame, key: str) -> DataFrame:
    """Per file and chunk type: how many, their bytes together, and the size of the last one."""
    return chunks.groupBy(key, "type").agg(
        F.count("*").alias("chunks"),
        F.sum("size").alias("total_size"),
        F.max_by("size", "ord").alias("last_size"),
    )


def genre_index(df: DataFrame, key: str) -> DataFrame:
    """Search index rows ``(key, tag, value)``; kept long, so a genre held by most files stays spread over tasks."""
    return df.select(key, F.lit("genre").alias("tag"), F.col("genre").alias("value"))
