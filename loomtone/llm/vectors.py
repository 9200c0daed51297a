"""Near-duplicate feature vectors: spherical k-means cells, blocked cosine products within them, one representative per group.

Vectors are compared only within a category. Equal vectors of a category are one class with a count. Centroids are fitted on a bounded sample; every
class lives in its nearest cell and also visits its ``PROBES`` nearest ones, so links across a border are met. A cell is cut into blocks of bounded
size, and pairs of blocks are dealt to tasks: no cell, however full, is gathered in one task. All links of a cell count; a pair that meets in two cells counts in
the first. Tasks report link counts and a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtone.llm.shared import components, keep, roots

LEAST_COSINE = 0.93
#: Vectors that the centroids are fitted on at most, in the order of a hash; centroids at most; vectors of a category per cell aimed at.
SAMPLE_ROWS, MOST_CELLS, CELL_ROWS = 20_000, 1_024, 2_048
PROBES = 4
#: Vectors of a block.
BLOCK_ROWS = 2_048
_ROUNDS = 12


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """``k`` unit centroids of the unit rows ``x``."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(_ROUNDS):
        near = np.concatenate([(x[a: a + 4096] @ centre.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 0, total / np.maximum(size, 1e-300), centre)
    return centre


def _units(column: pa.Array) -> np.ndarray:
    """Packed doubles as unit rows."""
    if not len(column):
        return np.empty((0, 0))
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(batches):
    """Vectors as packed doubles, scaled against overflow; null where a vector is null, empty, zero or not finite throughout."""
    for batch in batches:
        packed = []
        for v in batch.column(2).to_pylist():
            good = None
            if v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    good = (x / 2.0 ** np.floor(np.log2(top))).tobytes()
            packed.append(good)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "category", "packed"])


def _assign(centroids):
    """One row per class and cell: its home first, then the other cells that it visits."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            width = np.array([len(v) for v in batch.column(2).to_pylist()])
            probes = np.zeros((n, 1), np.int32)
            centre = centroids.value
            if len(centre):
                fits = np.flatnonzero(width == centre.shape[1] * 8)
                take = min(PROBES, len(centre))
                probes = np.full((n, take), -1, np.int32)
                if len(fits):
                    cosine = _units(batch.column(2).take(pa.array(fits))) @ centre.T
                    probes[fits] = np.argsort(-cosine, axis=1, kind="stable")[:, :take]
            row, nth = np.nonzero((probes >= 0) | (np.arange(probes.shape[1]) == 0))
            order = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(order), batch.column(1).take(order), batch.column(2).take(order), batch.column(3).take(order),
                 pa.array(probes[row, nth], pa.int32()), pa.array(nth == 0), pa.array(probes.tolist(), pa.list_(pa.int32())).take(order)],
                names=["least", "category", "packed", "copies", "cell", "home", "probes"])

    return run


def _block_links(least_cosine: float):
    """Links between two blocks of a cell (or within one): counts by class, and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        cell = table.column("cell")[0].as_py()
        wide = np.array([len(v.as_py()) for v in table.column("packed")])
        node = table.column("least").to_numpy()
        copies = table.column("copies").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        probes = table.column("probes").to_pylist()
        met = np.zeros(len(node), np.int64)
        parent = np.arange(len(node))
        same_block = not (side == 1).any()
        for width in np.unique(wide):
            own = np.flatnonzero(wide == width)
            a = own[side[own] == 0]
            b = a if same_block else own[side[own] == 1]
            if not len(a) or not len(b):
                continue
            x = _units(table.column("packed").take(pa.array(a)).combine_chunks())
            y = x if same_block else _units(table.column("packed").take(pa.array(b)).combine_chunks())
            for k in range(0, len(a), 512):
                i, j = np.nonzero(x[k: k + 512] @ y.T >= least_cosine)
                i, j = a[i + k], b[j]
                good = (home[i] | home[j]) & ((i < j) if same_block else True)
                i, j = i[good], j[good]
                mixed = np.flatnonzero(home[i] != home[j])
                drop = np.zeros(len(i), bool)
                for m in mixed:  # seen from both homes: the lesser cell counts the pair
                    stay, guest = (i[m], j[m]) if home[i[m]] else (j[m], i[m])
                    drop[m] = probes[guest][0] in probes[stay] and probes[guest][0] < cell
                i, j = i[~drop], j[~drop]
                np.add.at(met, i, copies[j])
                np.add.at(met, j, copies[i])
                parent = roots(parent, i, j)
        got = np.flatnonzero((met > 0) | (parent != np.arange(len(node))))
        return pa.table({"a": node[got], "b": node[parent[got]], "met": met[got]})

    return run


def link_vectors(vectors: DataFrame, id_column: str = "file_id", vector_column: str = "features", category_column: str = "category",
                 least_cosine: float = LEAST_COSINE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Two vectors link when their categories are equal and not null and their cosine in double precision is at least ``least_cosine``. A vector that is
    null, empty, zero or holds null or non-finite parts, one without category, and vectors of different length link with nothing. ``n_links``
    counts other rows linked directly, ``component_id`` is the least id that links reach, ``kept`` marks the row that has it. Repeated rows count
    each for itself. A null id links like any other and its row is never kept. Cells are an index: recall is measured in the tests.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(category_column).cast("string").alias("category"),
        F.col(vector_column).cast("array<double>").alias("v")).mapInArrow(_pack, "id bigint, category string, packed binary")
    rows = keep(rows, "vectors")
    good = F.col("packed").isNotNull() & F.col("category").isNotNull()
    far = F.lit((1 << 63) - 1)
    classes = rows.where(good).groupBy("category", "packed").agg(F.min(F.coalesce("id", far)).alias("least"), F.count("*").alias("copies"))
    # a class is named by its place, as ids may be null or repeated
    classes = keep(classes, "vector-classes").select("*", F.monotonically_increasing_id().alias("place"))
    classes = keep(classes, "vector-places")
    n, kinds = classes.agg(F.count("*"), F.approx_count_distinct("category")).first()
    k = min(MOST_CELLS, max(1, round(n / max(1, kinds) / cell_rows)))
    centre = np.empty((0, 0))
    if k > 1:
        sample = classes.orderBy(F.xxhash64("packed"), "place").limit(SAMPLE_ROWS).select("packed").toPandas()["packed"]
        width = max(set(map(len, sample)), key=[len(v) for v in sample].count)
        x = np.frombuffer(b"".join(v for v in sample if len(v) == width), np.float64).reshape(-1, width // 8)
        centre = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), min(k, len(x)))
    dealt = classes.select("place", "category", "packed", "copies").mapInArrow(
        _assign(spark.sparkContext.broadcast(centre)),
        "least bigint, category string, packed binary, copies bigint, cell int, home boolean, probes array<int>")
    dealt = keep(dealt, "vector-cells")
    size = dealt.groupBy("category", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = dealt.join(size, ["category", "cell"]).withColumn("block", F.pmod(F.xxhash64("least"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = placed.select("*", other).select(
        "least", "category", "packed", "copies", "cell", "home", "probes", F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    links = keep(pairs.groupBy("category", "cell", "first", "second").applyInArrow(
        _block_links(least_cosine), "a bigint, b bigint, met bigint"), "vector-links")
    reached = components(links.select("a", "b"), "vector-groups")
    met = links.groupBy(F.col("a").alias("place")).agg(F.sum("met").alias("met"))
    told = classes.join(met, "place", "left").join(reached, classes.place == reached.node, "left").select(
        "category", "packed", "least", F.col("copies") - 1 + F.coalesce("met", F.lit(0)), F.coalesce("component", "place")).toDF(
        "category", "packed", "least", "n_links", "component")
    told = keep(told, "vector-told")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(least, "component").select("category", "packed", "n_links", F.nullif("component_id", far).alias("component_id"))
    linked = rows.where(good).join(told, ["category", "packed"]).select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
