"""A catalog that is kept up to date: changed files replace their rows, and readers see a whole old or a whole new catalog.

Below the catalog's folder lie ``parts/run=<run>/loop_type=<...>/category=<...>`` with Parquet files that are never touched again, and ``versions/<number>.json``, each
listing the partition folders that make up one version. An update rewrites only the partitions that changed files are in or come into; its version file is
renamed into place last. A run that breaks off before leaves folders that no version lists.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone.workspace import keep

PARTITION = ("loop_type", "category")
_NULL = "__HIVE_DEFAULT_PARTITION__"  # Spark's name for a missing value


class _Store:
    """The few calls on the catalog's file system that the driver makes."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.base = self.fs.makeQualified(self.root).toString()

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, value: dict) -> None:
        """Write beside and rename into place; an existing name is another writer's and is not replaced."""
        draft = self.at(f"{name}.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft)
        out.write(json.dumps(value).encode())
        out.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(draft, self.at(name)):
            self.fs.delete(draft, False)
            raise FileExistsError(f"{self.base}/{name} was written by another update")


def catalog_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that can be read, oldest first."""
    return [int(n[:-5]) for n in _Store(spark, path).names("versions") if n.endswith(".json")]


def _folders(store: _Store, version: int | None) -> list[str]:
    return store.read(f"versions/{version:08d}.json")["folders"] if version is not None else []


def _values(folder: str) -> tuple:
    """The partition values of ``run=../loop_type=../category=..``."""
    held = [unquote(p.split("=", 1)[1]) for p in folder.split("/")[1:]]
    return tuple(None if v == _NULL else v for v in held)


def _read(spark: SparkSession, store: _Store, folders: list[str], schema: str) -> DataFrame:
    reader = spark.read.option("basePath", f"{store.base}/parts").schema(schema + ", run string")
    return reader.parquet(*(f"{store.base}/parts/{f}" for f in folders)).drop("run")


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The catalog as of a version, the newest if none is named; filters on loop type and category leave out whole folders."""
    store = _Store(spark, path)
    versions = catalog_versions(spark, path)
    if not versions or version is not None and version not in versions:
        raise FileNotFoundError(f"no version {'' if version is None else version} of a catalog in {path}")
    held = store.read(f"versions/{versions[-1] if version is None else version:08d}.json")
    if not held["folders"]:
        return spark.createDataFrame([], held["schema"])
    return _read(spark, store, held["folders"], held["schema"])


def upsert_catalog(changes: DataFrame, path: str, key: str = "path", removed: Column | None = None, rows_per_file: int = 5_000_000) -> int:
    """Put the rows of ``changes`` in the place of those of the same ``key``, and give the number of the new version.

    ``changes`` needs the columns ``loop_type`` and ``category``; a file whose category changed leaves its old partition. ``removed``: where true, the key's row goes. Of
    several rows of one key one stays, the same on every run. Rows without a key are left out. New columns are null in older rows. Two updates at once: the
    later one fails and can be repeated.
    """
    spark = changes.sparkSession
    store, versions = _Store(spark, path), catalog_versions(spark, path)
    last = versions[-1] if versions else None
    before = _folders(store, last)
    gone = F.coalesce(removed, F.lit(False)) if removed is not None else F.lit(False)
    columns = changes.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in columns), gone.alias("_gone"))
    one = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, F.xxhash64(F.to_json(whole))).alias("_row"))
    news = keep(one.select("_row.*"), "changes")  # read twice, for the touched partitions and for the rows
    fresh = news.where(~F.col("_gone")).drop("_gone")
    touched = {tuple(r) for r in fresh.select(*PARTITION).distinct().collect()}  # as many as there are categories
    rows = fresh
    if before:
        old = read_catalog(spark, path, last)
        hit = old.select(key, *PARTITION).join(news.select(key), key, "left_semi")
        touched |= {tuple(r) for r in hit.select(*PARTITION).distinct().collect()}
        stale = [f for f in before if _values(f) in touched]
        if stale:
            stays = _read(spark, store, stale, store.read(f"versions/{last:08d}.json")["schema"]).join(news.select(key), key, "left_anti")
            rows = stays.unionByName(fresh, allowMissingColumns=True)
        known = {f.name for f in fresh.schema}
        kinds = [*fresh.schema, *(f for f in old.schema if f.name not in known)]
    else:
        kinds = list(fresh.schema)
    run = uuid.uuid4().hex[:12]
    target = f"{store.base}/parts/run={run}"
    rows.hint("rebalance", *(F.col(c) for c in PARTITION)).write.option("maxRecordsPerFile", rows_per_file).partitionBy(*PARTITION).parquet(target)
    made = [f"run={run}/{a}/{b}" for a in store.names(f"parts/run={run}") if "=" in a for b in store.names(f"parts/run={run}/{a}") if "=" in b]
    folders = [f for f in before if _values(f) not in touched] + made
    version = (last or 0) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    store.publish(f"versions/{version:08d}.json", {"folders": folders, "schema": schema})
    return version


def expire_versions(spark: SparkSession, path: str, keep_last: int = 2) -> list[str]:
    """Remove all versions but the last ones, and the runs that none of these lists; gives the runs that went. Not while an update is under way."""
    store, versions = _Store(spark, path), catalog_versions(spark, path)
    kept = versions[-keep_last:]
    needed = {f.split("/")[0] for v in kept for f in _folders(store, v)}
    for v in versions[:-keep_last]:
        store.fs.delete(store.at(f"versions/{v:08d}.json"), False)
    lost = [r for r in store.names("parts") if r not in needed]
    for r in lost:
        store.fs.delete(store.at(f"parts/{r}"), True)
    return lost
