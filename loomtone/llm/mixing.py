"""Mixing folders of a library to target weights by Pfair scheduling.

Each folder's files are cut into blocks. With weights that sum to W, the i-th block of a folder of weight w may take a slot from its release
floor((i - 1) W / w) on and must have one before its deadline ceil(i W / w). Slots go, one after the other, to the released block with the earliest
deadline. So after any number of slots a folder has had its weight's share of them with a deviation of less than one block. When
a folder has no block left, the others go on by their weights from there: no file is dropped or repeated.

Rows are numbered within their folder by one range sort of hashes, so a folder of any size is spread over tasks. The plan is made of block numbers
only, ``MOST_BLOCKS`` at most and one per folder: blocks grow with the library. Every folder keeps its weight, whatever their number.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtone.llm.shared import keep
from loomtone.workspace import broadcast_if_small

BLOCK_ROWS = 64
#: Blocks of full size at most; each folder may add one that is not full.
MOST_BLOCKS = 200_000
_LOW = (1 << 33) - 1


def pfair(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int]]:
    """The folder and block of each slot, by earliest deadline among released blocks; phases end as a folder runs out.

    Folders without a slot in the phase wait by weight, so that a phase costs its slots and not all folders.
    """
    left, done, plan = {k: n for k, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), []
    total = sum(weights[k] for k in left)
    fresh: dict[int, list[str]] = {}
    for k in sorted(left):
        fresh.setdefault(weights[k], []).append(k)
    alive = {w: len(held) for w, held in fresh.items()}
    classes = sorted(fresh, reverse=True)  # first deadlines ascend
    while left:
        front: list[tuple[int, str, int]] = []  # the next folder of a weight without a slot yet
        waiting: list[tuple[int, int, str, int]] = []
        ready: list[tuple[int, str, int]] = []
        had, at, slot = [], 0, 0
        while True:
            while waiting and waiting[0][0] <= slot:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            while at < len(classes) and (not front or -(-total // classes[at]) <= front[0][0]):
                w = classes[at]
                if fresh[w]:
                    heapq.heappush(front, (-(-total // w), fresh[w][0], w))
                at += 1
            if front and (not ready or front[0][:2] < ready[0][:2]):
                deadline, k, w = heapq.heappop(front)
                heapq.heappop(fresh[w])
                if fresh[w]:
                    heapq.heappush(front, (deadline, fresh[w][0], w))
                had.append(k)
                i = 1
            else:
                _, k, i = heapq.heappop(ready)
                w = weights[k]
            plan.append((k, done[k]))
            done[k] += 1
            left[k] -= 1
            if not left[k]:
                break
            heapq.heappush(waiting, (i * total // w, -(-(i + 1) * total // w), k, i + 1))
            slot += 1
        del left[k]
        total -= w
        alive[w] -= 1
        if not alive[w]:
            classes.remove(w)
        for k in had:
            if k in left:
                heapq.heappush(fresh[weights[k]], k)
    return plan


def damped_weights(loops: DataFrame, folder_column: str = "folder") -> DataFrame:
    """``(folder, weight bigint, unnamed)``: target weights that grow with the square root of a folder's rows; rows of no folder are one of their own, ``unnamed``."""
    sized = loops.groupBy(F.col(folder_column).cast("string").alias("folder")).agg(F.count("*").alias("n"))
    return sized.select("folder", F.greatest(F.lit(1), F.round(F.sqrt("n"))).cast("bigint").alias("weight"), F.col("folder").isNull().alias("unnamed"))


def mix(loops: DataFrame, weights: DataFrame, id_column: str = "file_id", folder_column: str = "folder", rest_weight: int = 1,
        block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``loops`` with three more columns: ``block`` (of the folder), ``slot`` (of the block in the mix) and ``place`` (in the block), from 0 on.

    ``weights(folder, weight)`` holds positive whole numbers, one row per folder, as many as there are; a repeated folder counts with its
    greatest weight, weights that are null or not positive are left out. Where it has a third column ``unnamed``, the row of null folder that is true there holds
    for rows of no folder. Rows of other folders, and of none without such a row, are mixed as one folder of ``rest_weight``. Rows
    of a folder are ordered by a hash of the id, then by the id; equal rows keep places of their own. Columns of ``loops`` that are
    named like the new ones are replaced. An empty table gives no rows.
    """
    unnamed = F.coalesce("unnamed", F.lit(False)) if "unnamed" in weights.columns else F.lit(False)
    given = weights.select("folder", "weight", unnamed.alias("unnamed")).where("weight > 0 and (folder is null) = unnamed")
    given = given.groupBy("folder").agg(F.max("weight").alias("weight")).collect()
    spark = loops.sparkSession
    names = {r.folder: k for k, r in enumerate(sorted(given, key=lambda r: (r.folder is None, r.folder or "")))}
    known = spark.createDataFrame([(f, k) for f, k in names.items() if f is not None], "_lt_folder string, _lt_mix int")
    columns = [c for c in loops.columns if c not in ("block", "slot", "place")]
    rows = loops.select(*columns, F.col(folder_column).cast("string").alias("_lt_folder"))
    rows = rows.join(broadcast_if_small(known), "_lt_folder", "left").withColumn(
        "_lt_mix", F.when(F.col("_lt_folder").isNull(), names.get(None, -1)).otherwise(F.coalesce("_lt_mix", F.lit(-1)))).drop("_lt_folder")
    keys = ["_lt_mix", "_lt_hash", id_column]
    ranged = rows.withColumn("_lt_hash", F.xxhash64(id_column)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("_lt_row", F.monotonically_increasing_id())
    ranged = keep(ranged.withColumns({"_lt_part": F.shiftright("_lt_row", 33).cast("int"), "_lt_at": F.col("_lt_row").bitwiseAND(_LOW)}).drop("_lt_row", "_lt_hash"), "mix-rows")
    # one row per task and folder in it: where the folder starts in the task, and how many of its rows stand in tasks before
    runs = ranged.groupBy("_lt_part", "_lt_mix").agg(F.min("_lt_at").alias("_lt_first"), F.count("*").alias("n")).orderBy("_lt_mix", "_lt_part").collect()
    total: dict[int, int] = {}
    starts = []
    for r in runs:
        starts.append((r._lt_part, r._lt_mix, total.get(r._lt_mix, 0) - r._lt_first))
        total[r._lt_mix] = total.get(r._lt_mix, 0) + r.n
    size = max(block_rows, -(-sum(total.values()) // most_blocks))
    plan = pfair({k: -(-n // size) for k, n in total.items()}, {k: rest_weight for k in total} | {names[r.folder]: int(r.weight) for r in given})
    offsets = spark.createDataFrame(starts, "_lt_part int, _lt_mix int, _lt_shift bigint")
    slots = spark.createDataFrame([(k, b, t) for t, (k, b) in enumerate(plan)], "_lt_mix int, block bigint, slot bigint")
    nth = F.col("_lt_at") + F.col("_lt_shift")
    placed = ranged.join(broadcast_if_small(offsets), ["_lt_part", "_lt_mix"]).withColumns(
        {"block": F.floor(nth / size), "place": nth % size})
    return placed.join(broadcast_if_small(slots), ["_lt_mix", "block"]).select(*columns, "block", "slot", "place")
