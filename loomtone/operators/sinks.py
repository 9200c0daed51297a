"""Where results go: catalog tables, JSON datasets, output paths."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtone.operators.blocked import join_unique
from loomtone.operators.stats import batch_figures, decode_figures, observed
from loomtone.sources.listing import open_store, qualified
from loomtone.workspace import keep


def write_catalog(
    df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000, figures: list[Column] | None = None
) -> dict | None:
    """Resolved metadata as Parquet partitioned by loop type and category.

    Rows are first rebalanced by those two columns: a small category becomes one file instead of one per task, and a large
    one is split at runtime and written by many tasks. ``figures``: aggregates that are taken on the way and given back by name.
    """
    placed, seen = df.hint("rebalance", F.col("loop_type"), F.col("category")), None
    if figures:
        placed, seen = observed(placed, figures)
    placed.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("loop_type", "category").parquet(path)
    return seen.get if seen else None


def write_run(rows: DataFrame, path: str, **options) -> dict:
    """Write the rows of a convert run as a catalog; the run's totals, counted while it was written."""
    return write_catalog(rows, path, figures=batch_figures(), **options)


def split_errors(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded rows, and ``(file, error)`` rows; together they are the whole batch."""
    good = decoded.filter(F.col("error").isNull()).drop("error")
    bad = decoded.filter(F.col("error").isNotNull()).select(F.col("file_path").alias("file"), "error")
    return good, bad


def _kept(decoded: DataFrame) -> tuple[DataFrame, dict]:
    """The decoded rows, computed and counted once."""
    # rows of the record job come out of a join; the counts belong to the stage that writes
    counted, seen = observed(decoded.hint("rebalance"), decode_figures())
    return keep(counted, "decoded"), seen.get


def export_json(decoded: DataFrame, path: str) -> dict:
    """The batch as three JSON datasets: ``files``, ``errors`` and ``summary``; the decoded rows are computed once, and counted as they are."""
    kept, summary = _kept(decoded)
    good, bad = split_errors(kept)
    good.write.mode("overwrite").json(f"{path}/files")
    bad.write.mode("overwrite").json(f"{path}/errors")
    decoded.sparkSession.createDataFrame([summary], "total_files bigint, successful bigint, failed bigint").coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return summary


def _fragments(rows: DataFrame, order: str, path: str) -> list[str]:
    """Write each row as JSON text in order, and give the parts in order: every part is a list of objects between commas."""
    text = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    text.select(F.when(first, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value")).write.mode("overwrite").text(path)
    system, inner, _ = open_store(path)
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(i.base_name for i in found if i.base_name.startswith("part-") and i.size > 0)


def export_document(decoded: DataFrame, path: str) -> dict:
    """The batch as one JSON document in ordered parts: ``{"files": [...], "errors": [...], "summary": {...}}``.

    ``files`` and ``errors`` are written as fragments by path order, each by its own task; ``parts.json``, written last, lists the pieces of the document in
    order. :func:`document` reads them one after the other. A run that fails leaves no list, a repeated one overwrites. Fields without a value are null.
    """
    path = qualified(decoded.sparkSession, path)
    kept, summary = _kept(decoded)
    system, inner, _ = open_store(path)
    system.create_dir(inner, recursive=True)
    if system.get_file_info(f"{inner}/parts.json").size is not None:
        system.delete_file(f"{inner}/parts.json")
    good, bad = split_errors(kept)
    pieces: list[dict] = []
    for name, rows, order in (("files", good, "file_path"), ("errors", bad, "file")):
        pieces.append({"text": ("{" if name == "files" else "],") + f'"{name}":['})
        for k, part in enumerate(_fragments(rows, order, f"{path}/{name}")):
            pieces += [{"text": ","}] * (k > 0) + [{"part": f"{name}/{part}"}]
    pieces.append({"text": '],"summary":' + json.dumps(summary) + "}"})
    with system.open_output_stream(f"{inner}/parts.json") as out:
        out.write(json.dumps(pieces).encode())
    return summary


def document(path: str, block: int = 8 << 20) -> Iterator[bytes]:
    """The bytes of the document that :func:`export_document` wrote, a block at a time, for a file, an upload or a response."""
    system, inner, _ = open_store(path)
    with system.open_input_stream(f"{inner}/parts.json") as f:
        pieces = json.loads(f.read())
    for piece in pieces:
        if "text" in piece:
            yield piece["text"].encode()
            continue
        with system.open_input_stream(f"{inner}/{piece['part']}") as f:
            while data := f.read(block):
                yield data


def plan_output(df: DataFrame, out_dir: str, preserve_structure: bool = False) -> DataFrame:
    """Add ``target`` and ``collides``: whether several files would be written to the same target.

    Only targets with more than one file are joined back, and they are salted, so one target shared by very many
    files does not gather them in one task.
    """
    base = out_dir.rstrip("/")
    inside = F.when(F.col("rel_parent") == ".", F.lit(None)).otherwise(F.col("rel_parent"))
    folder = F.concat_ws("/", F.lit(base), inside) if preserve_structure else F.lit(base)
    planned = df.withColumn("target", F.concat(folder, F.lit("/"), F.col("stem"), F.lit(".caf")))
    shared = planned.groupBy("target").agg(F.count("*").alias("_n")).filter("_n > 1")
    flagged = shared.select("target", F.lit(True).alias("collides"))
    joined = join_unique(planned, flagged, "target", "path", "left")
    return joined.withColumn("collides", F.coalesce("collides", F.lit(False)))
