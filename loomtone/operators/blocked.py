"""Ordered computations over series of any length.

A window over a whole series would put that series into one task. These helpers cut a series into blocks of its order
column, keep one summary row per block, carry the summaries forward in two levels (within spans of ``size`` blocks, then
over spans), and run the row-level window inside blocks only. The order column must be unique within a series, so neither a
block nor a span hands more than ``size`` rows to a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtone.functions.rows import value_rows

BLOCK = 65_536
SALTS = 16
#: Rows of one key beyond which a join deals them to several tasks.
HOT_ROWS = 2_000_000


def with_block(df: DataFrame, order: str, size: int = BLOCK) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(size)).cast("bigint"))


def _earlier(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _with_span(summaries: DataFrame, size: int) -> DataFrame:
    """Spans of ``size`` blocks: blocks are cut by value, so a sparse order column makes about one block per row."""
    return summaries.withColumn("_span", F.floor(F.col("_block") / F.lit(size)).cast("bigint"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, size: int = BLOCK) -> DataFrame:
    """Add the running total of ``value`` within ``keys``, in ``order``."""
    blocks = with_block(df, order, size)
    sums = _with_span(blocks.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum")), size)
    spans = sums.groupBy(*keys, "_span").agg(F.sum("_sum").alias("_sum"))
    spans = spans.select(*keys, "_span", F.sum("_sum").over(_earlier(keys, "_span")).alias("_start"))
    inside_span = F.sum("_sum").over(_earlier([*keys, "_span"], "_block"))
    offsets = sums.withColumn("_in_span", inside_span).join(spans, [*keys, "_span"])
    zero = F.lit(0)
    offsets = offsets.select(*keys, "_block", (F.coalesce("_start", zero) + F.coalesce("_in_span", zero)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_block", "_before")
    )


def last_seen(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, current: bool, size: int = BLOCK
) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row (``current``), or strictly before it."""
    blocks = with_block(df, order, size).withColumn("_value", value)
    latest = lambda column, at: F.max_by(column, F.when(F.col(column).isNotNull(), F.col(at)))
    tails = _with_span(blocks.groupBy(*keys, "_block").agg(latest("_value", order).alias("_tail")), size)
    spans = tails.groupBy(*keys, "_span").agg(latest("_tail", "_block").alias("_tail"))
    spans = spans.select(*keys, "_span", F.last("_tail", ignorenulls=True).over(_earlier(keys, "_span")).alias("_start"))
    inside_span = F.last("_tail", ignorenulls=True).over(_earlier([*keys, "_span"], "_block"))
    carried = tails.withColumn("_in_span", inside_span).join(spans, [*keys, "_span"])
    carried = carried.select(*keys, "_block", F.coalesce("_in_span", "_start").alias("_carry"))
    end = 0 if current else -1
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    return (
        blocks.join(carried, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_block", "_value", "_carry")
    )


def with_halo(df: DataFrame, order: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Copy rows near a block edge into the neighbour block, flagged ``_halo``, for windows of bounded reach.

    ``before`` / ``after``: how far a row's window looks back and ahead in units of ``order``.
    """
    assert max(before, after) < size
    own = F.floor(F.col(order) / F.lit(size)).cast("bigint")
    left = F.floor((F.col(order) - after) / F.lit(size)).cast("bigint")
    right = F.floor((F.col(order) + before) / F.lit(size)).cast("bigint")
    wanted = F.array_distinct(F.array(own, left, right))
    spread = value_rows(df.withColumn("_own", own), ["*"], wanted, "_block")
    return spread.withColumn("_halo", F.col("_block") != F.col("_own")).drop("_own")


def join_unique(rows: DataFrame, unique: DataFrame, key: str, spread: str, how: str = "inner", hot: int = HOT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Join rows of any number per ``key`` to a side with one row per key.

    Rows are counted by key first. Only keys of more than ``hot`` rows are salted, by the ``spread`` column, and only their rows of the unique side are
    repeated per salt; all others meet in a plain join. There is at most one such key per ``hot`` rows, so the list of them is broadcast.
    ``counted``: rows to count in place of ``rows``, cheaper ones with at least as many per key.
    """
    busy = F.broadcast((rows if counted is None else counted).groupBy(key).count().where(F.col("count") > hot).select(F.col(key).alias("_hot")))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.sequence(F.lit(0), F.when(F.col("_hot").isNotNull(), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    placed = rows.join(busy, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    repeated = unique.join(busy, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return placed.join(repeated, [key, "_salt"], how).drop("_salt")


def explode_count(df: DataFrame, count: Column, out: str, size: int = BLOCK) -> DataFrame:
    """Rows 0 .. count-1 per input row, in two steps so that no array is longer than ``size``."""
    n = F.col("_n")
    outer = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(size)).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    start = F.col("_outer") * size
    inner = F.sequence(start, F.least(start + size, n) - 1)
    blocks = value_rows(df.withColumn("_n", count.cast("bigint")), ["*"], outer, "_outer")
    return value_rows(blocks, ["*"], inner, out).drop("_n", "_outer")


def numbered(df: DataFrame, order: str, out: str, total: str) -> DataFrame:
    """Global 1-based row number by ``order``, and the number of rows, without gathering the rows in one task.

    Rows are range-partitioned and sorted, kept by a reliable checkpoint so both passes see the same partitions, and
    each partition's offset comes from the partition counts.
    """
    from loomtone.workspace import cut

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(parts, order)
        .sortWithinPartitions(order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_within", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    counts = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"),
        F.sum("count").over(Window.partitionBy()).alias(total),
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_within") + 1)
        .drop("_part", "_within", "_before")
    )
