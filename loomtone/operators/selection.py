"""Working sets of files: adding, choosing and removing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtone.operators.blocked import numbered
from loomtone.sources.files import extension_of, is_supported


def add_files(existing: DataFrame, incoming: DataFrame, path: str = "path") -> DataFrame:
    """Incoming files that are new, visible and of a supported audio kind, each once."""
    visible = ~F.regexp_like(F.col(path), F.lit(r"/\."))
    fit = incoming.filter(visible & is_supported(extension_of(F.col(path))))
    return fit.dropDuplicates([path]).join(existing.select(path), path, "left_anti")


def select_files(files: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The files whose key is chosen."""
    return files.join(chosen.select(key), key, "left_semi")


def remove_files(files: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The files whose key is not chosen."""
    return files.join(chosen.select(key), key, "left_anti")


def union_listing(*listings: DataFrame) -> DataFrame:
    """Union of listings, each path once."""
    out = listings[0].select("path")
    for other in listings[1:]:
        out = out.unionByName(other.select("path"))
    return out.distinct()


def sort_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Paths once each, in ascending order (a range-partitioned sort)."""
    return files.select(path).distinct().orderBy(path)


def row_progress(files: DataFrame, path: str = "path") -> DataFrame:
    """Position of every file in path order, the total, and the share reached."""
    listed = files.select(path).distinct()
    ranked = numbered(listed, path, "position", "total")
    return ranked.withColumn("share", F.col("position") / F.col("total"))
