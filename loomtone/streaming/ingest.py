"""Cataloguing files as they arrive in a library."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtone.plans.convert import convert_catalog, midi_facts
from loomtone.sources.files import LIBRARY_EXTENSIONS, is_midi, path_parts, read_content
from loomtone.streaming.arrivals import read_arrivals


def stream_catalog(
    spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = True, extensions: Iterable[str] = LIBRARY_EXTENSIONS,
    source: dict | None = None, **options
) -> StreamingQuery:
    """Classify arriving files into a Parquet catalog.

    Each micro-batch runs the batch plan and overwrites its own ``batch=`` folder, so a repeated batch after a failure
    leaves no duplicates. The stream carries names only; the tasks of a batch read the bytes of its MIDI files. ``source``: options of
    :func:`loomtone.streaming.arrivals.read_arrivals`. With ``once`` all files that are there are worked off, in batches, before the call returns.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        files = path_parts(batch.persist(), "path", root)
        facts = midi_facts(read_content(files.filter(is_midi(F.col("ext")))))
        rows = convert_catalog(files, facts, root=root, **options).drop("midi")
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    arriving = read_arrivals(spark, root, checkpoint, tuple(extensions), **(source or {}))
    query = arriving.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()
    if once:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query
