"""Helpers of the training-data operators: kept intermediate tables, folds by checksum, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone.workspace import scratch_path


def keep(df: DataFrame, name: str, *by: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder (in a folder for each value of ``by``) and read it back, so later uses neither recompute nor lose it.

    ``options`` are those of the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).partitionBy(*by).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame, *parts: str) -> None:
    """Remove a table that ``keep`` wrote and that nothing reads any more, or its ``parts`` (``column=value``)."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if parts and path.rsplit("/", 1)[1] not in parts:
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark removes them when the driver's JVM collects their plans."""
    spark._jvm.java.lang.System.gc()


def named(column: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    ident = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % folds


def judged_sample(loops: DataFrame, judged: DataFrame, id_column: str, text_column: str, label_column: str, rows: int,
                  each_label: bool = False) -> DataFrame:
    """``(text, label int, place bigint)``: at most ``rows`` different judged texts (per label 0 and 1 with ``each_label``), least hash first.

    Learns only from ids whose fold of 5 is not 0. The choice is made on hashes, so texts are read for the chosen rows alone.
    """
    known = judged.where(F.col(label_column).isNotNull() & (fold(id_column, 5) != 0)).select(
        id_column, (F.col(label_column) != 0).cast("int").alias("label"))
    texts = loops.where(fold(id_column, 5) != 0).select(
        id_column, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).withColumn("place", F.xxhash64("text"))
    marks = texts.select(id_column, "place").join(known, id_column).select("place", "label").distinct()
    if each_label:
        chosen = marks.where("label = 0").orderBy("place").limit(rows).union(marks.where("label = 1").orderBy("place").limit(rows))
    else:
        chosen = marks.orderBy("place", "label").limit(rows)
    return texts.join(F.broadcast(chosen), "place").groupBy("place", "label").agg(F.min("text").alias("text")).select("text", "label", "place")


def roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of the positions ``a`` and ``b`` pair by pair; ``parent`` holds each position's root before and after."""
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        if not open_.any():
            return parent
        a, b = low[open_], high[open_]
        np.minimum.at(parent, b, a)


def _forest(batches):
    """The links of one task as stars: each node with the least node it reaches within the task."""
    left, right = [], []
    for batch in batches:
        left.append(batch.column(0).to_numpy(zero_copy_only=False))
        right.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not left:
        return
    a, b = np.concatenate(left), np.concatenate(right)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(np.arange(len(nodes)), at[: len(a)], at[len(a):])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    if len(moved):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``links(a bigint, b bigint)``; ``component`` is the least node reachable.

    Alternates the large-star and small-star steps on stars that each task has already folded. Each step is one aggregation and
    one join on the node, so that AQE can split a hub. Every round is written to the shared folder. Ends when a round changes nothing.
    """
    spark = links.sparkSession
    links = links.where("a <> b").mapInArrow(_forest, "a bigint, b bigint")
    stars = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        stars = keep(small, name)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
    tops = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
    return spark.createDataFrame([], "node bigint, component bigint") if now[0] == 0 else out
