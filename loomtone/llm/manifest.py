"""A Merkle manifest of a catalog: one root for all files, and per file the siblings that lead from its leaf to the root.

Each category is a tree of eight children per node over its files in id order; the categories' roots, in order of the category, are the leaves of one more tree.
Trees are stored in blocks, aligned subtrees of ``HEIGHT`` levels. Inside a block the nodes lie in van Emde Boas order: the block is split at half its height
into an upper subtree and the lower ones under its leaves, the upper one stored first, each stored the same way, so that a walk from leaf to root
touches few cache lines whatever their length. Building follows the same recursion; siblings are found by address arithmetic. The roots of blocks are the
leaves of the next level of blocks, ``8 ** (HEIGHT - 1)`` times fewer each time.

In Spark a block is one group of bounded size: files are numbered within their category by one range sort, so a category of any size is many groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtone.llm.shared import keep, named

FIELDS = ("file_id", "folder", "category", "length", "report")
#: Children per node.
WIDE = 8
#: Levels of a block: 512 leaves, 585 nodes.
HEIGHT = 4
DIGEST = 32
_LOW = (1 << 33) - 1


def field(value: Column) -> Column:
    """A field as the digest takes it: ``-`` for null, else its length in UTF-8 bytes, a colon and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*(field(f) for f in fields)), 256)


# ---- one block ------------------------------------------------------------------------------------------------------


def nodes_in(height: int) -> int:
    return (WIDE**height - 1) // (WIDE - 1)


@cache
def addresses(height: int, depth: int) -> np.ndarray:
    """Where the nodes of one depth lie in a block of ``height`` levels; depth 0 is the block's root."""
    if height == 1:
        return np.zeros(1, np.int64)
    upper = height // 2
    if depth < upper:
        return addresses(upper, depth)
    lower = height - upper
    index = np.arange(WIDE**depth)
    subtree, inside = np.divmod(index, WIDE ** (depth - upper))
    return nodes_in(upper) + subtree * nodes_in(lower) + addresses(lower, depth - upper)[inside]


def join_digests(digests: bytes) -> bytes:
    """The node above a run of digests: the hash of their hex texts."""
    return sha256(digests.hex().encode()).digest()


def _fill(nodes: bytearray, base: int, height: int, leaves: list[bytes]) -> bytes:
    """Lay out the subtree over ``leaves`` from node ``base`` on; its root."""
    if height == 1:
        nodes[base * DIGEST:(base + 1) * DIGEST] = leaves[0]
        return leaves[0]
    upper = height // 2
    lower, each = height - upper, WIDE ** (height - upper - 1)
    first, step = base + nodes_in(upper), nodes_in(lower)
    roots = [_fill(nodes, first + k * step, lower, leaves[k * each:(k + 1) * each]) for k in range(-(-len(leaves) // each))]
    return _fill(nodes, base, upper, [join_digests(b"".join(roots[k:k + WIDE])) for k in range(0, len(roots), WIDE)])


def height_of(leaves: int, most: int = HEIGHT) -> int:
    """Levels that a tree of so many leaves has, ``most`` at most."""
    height = 1
    while leaves > 1 and height < most:
        leaves, height = -(-leaves // WIDE), height + 1
    return height


def build_block(leaves: list[bytes], height: int) -> bytes:
    """The nodes of a block in van Emde Boas order; places without a node hold zeros. The root is the first digest."""
    nodes = bytearray(nodes_in(height) * DIGEST)
    _fill(nodes, 0, height, leaves)
    return bytes(nodes)


class Block:
    """A stored block: runs of siblings by address arithmetic."""

    def __init__(self, nodes: bytes, height: int, leaves: int):
        self.height, held = height, np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
        self.runs: list[list[bytes]] = []  # per level from the leaves up, the digests of each run in one piece
        for depth in range(height - 1, 0, -1):
            level = held[addresses(height, depth)[:leaves]].tobytes()
            self.runs.append([level[k:k + WIDE * DIGEST] for k in range(0, len(level), WIDE * DIGEST)])
            leaves = -(-leaves // WIDE)

    def path(self, index: int) -> list[tuple[int, bytes]]:
        """Per level from the leaf up: its place in its run, and the run."""
        out = []
        for runs in self.runs:
            run, own = divmod(index, WIDE)
            out.append((own, runs[run]))
            index = run
        return out


def pack(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes((own, len(run) // DIGEST)) + run for own, run in path)


def unpack(packed: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(packed):
        own, size = packed[at], packed[at + 1] * DIGEST
        out.append((own, packed[at + 2:at + 2 + size]))
        at += 2 + size
    return out


def siblings(path: list[tuple[int, bytes]]) -> bytes:
    """The other digests of each run, level by level."""
    return b"".join(run[:own * DIGEST] + run[(own + 1) * DIGEST:] for own, run in path)


def fold(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf leads to with these siblings."""
    for own, run in path:
        digest = join_digests(run[:own * DIGEST] + digest + run[(own + 1) * DIGEST:])
    return digest


# ---- blocks in Spark ------------------------------------------------------------------------------------------------


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``place`` (0-based, by ``order`` within ``tree``) and ``leaves`` (how many the tree has)."""
    keys = [F.asc_nulls_first(c) for c in ("tree", *order)]
    dealt = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = keep(dealt.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_LOW))}), "manifest-sorted")
    counts = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_n").over(Window.partitionBy("tree")).alias("leaves"))
    placed = dealt.join(starts, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_shift"))
    return keep(placed.drop("_at", "_part", "_shift"), "manifest-leaves")


def _block_of(place: Column, height: int) -> Column:
    return F.floor(place / F.lit(WIDE ** (height - 1))).cast("bigint")


_BLOCKS = "tree string, block bigint, leaves bigint, held int, height int, nodes binary"
_BLOCKS_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("leaves", pa.int64()), ("held", pa.int32()), ("height", pa.int32()), ("nodes", pa.binary())])


def _blocks(placed: DataFrame, height: int) -> DataFrame:
    """Blocks of ``(tree, place, leaves, digest)``; only a tree of one block is lower than ``height``."""
    most = WIDE ** (height - 1)

    def build(table: pa.Table) -> pa.Table:
        tree, leaves = table.column("tree")[0].as_py(), table.column("leaves")[0].as_py()
        place = table.column("place").to_numpy()
        digests = table.column("digest").to_pylist()
        own = [digests[k] for k in np.argsort(place)]
        high = height if leaves > most else height_of(leaves, height)
        row = [tree, int(place[0]) // most, leaves, len(own), high, build_block(own, high)]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS_ARROW)], schema=_BLOCKS_ARROW)

    cut = placed.select("tree", _block_of(F.col("place"), height).alias("block"), "place", "leaves", "digest")
    return cut.groupBy("tree", "block").applyInArrow(build, _BLOCKS)


def _root(nodes: Column) -> Column:
    return F.substring(nodes, 1, DIGEST)


def _forest(placed: DataFrame, height: int, name: str) -> list[DataFrame]:
    """The blocks over ``placed`` leaves, then those over the roots of these blocks, until every tree has one."""
    most, made = WIDE ** (height - 1), []
    largest = placed.agg(F.max("leaves")).first()[0] or 0
    while True:
        made.append(keep(_blocks(placed, height), f"manifest-{name}"))
        if largest <= most:
            return made
        placed = made[-1].where(F.col("leaves") > most).select(
            "tree", F.col("block").alias("place"), F.ceil(F.col("leaves") / F.lit(most)).cast("bigint").alias("leaves"), _root(F.col("nodes")).alias("digest"))
        largest = -(-largest // most)


def _tops(forest: list[DataFrame], height: int) -> DataFrame:
    """``(tree, digest)`` of each tree of a forest."""
    most, tops = WIDE ** (height - 1), None
    for blocks in forest:
        part = blocks.where(F.col("leaves") <= most).select("tree", _root(F.col("nodes")).alias("digest"))
        tops = part if tops is None else tops.union(part)
    return tops


def _paths(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(tree, place, above)``: for each leaf of each block the packed path up to the root of all."""
    for batch in blocks:
        for tree, block, held, height, nodes, above, most in zip(*(c.to_pylist() for c in batch.columns)):
            stored = Block(nodes, height, held)
            above = above or b""
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * held), pa.array(range(block * most, block * most + held), pa.int64()),
                 pa.array([pack(stored.path(k)) + above for k in range(held)], pa.binary())], names=["tree", "place", "above"])


def _with_above(forest: list[DataFrame], above: DataFrame | None, height: int) -> DataFrame:
    """The lowest blocks of a forest, each with the packed path from its root to the root of all.

    ``above``: ``(tree, above)`` of the trees' roots, or None where these are the root of all.
    """
    most = WIDE ** (height - 1)
    down = None
    for blocks in reversed(forest):
        if above is None:
            top = blocks.withColumn("above", F.lit(None).cast("binary"))
        else:
            top = blocks.join(above, "tree")
        if down is not None:  # trees of more than one block: the path of the block as a leaf of the one above
            paths = down.select("tree", "block", "held", "height", "nodes", "above", F.lit(most).alias("most")).mapInArrow(
                _paths, "tree string, place bigint, above binary")
            inner = blocks.join(paths.withColumnRenamed("place", "block"), ["tree", "block"])
            top = top.where(F.col("leaves") <= most).unionByName(inner)
        else:
            top = top.where(F.col("leaves") <= most)
        down = top
    return down


class Manifest:
    """The stored trees of a catalog.

    ``leaves``: one row per file, with ``tree`` (its category), ``place``, ``digest`` and what was asked for beside. ``blocks``: ``(tree, block, leaves, held, height,
    nodes, above)``, every lowest block with its nodes in van Emde Boas order and the path from its root to the root of all. ``roots``: ``(tree, digest)`` per
    category. ``root``: the root of all, None for an empty catalog.
    """

    def __init__(self, leaves: DataFrame, height: int):
        self.height = height
        self.leaves = leaves
        forest = _forest(leaves, height, "blocks")
        self.roots = keep(_tops(forest, height), "manifest-roots")
        tops = _numbered(self.roots.select(F.lit("").alias("tree"), F.col("tree").alias("category"), "digest"), ["category"])
        over = _forest(tops, height, "top")
        found = _tops(over, height).first()
        self.root: bytes | None = bytes(found["digest"]) if found else None
        # the path of each category's root, a leaf of the tree over categories
        paths = _with_above(over, None, height).select("tree", "block", "held", "height", "nodes", "above", F.lit(WIDE ** (height - 1)).alias("most")).mapInArrow(
            _paths, "tree string, place bigint, above binary")
        above = tops.join(paths.select("place", "above"), "place").select(F.col("category").alias("tree"), "above")
        self.blocks = keep(_with_above(forest, above, height), "manifest-stored")


def _tree_key(category: Column) -> Column:
    """The category as text that sorts null first, then by bytes."""
    return F.when(category.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), category.cast("string")))


def catalog_manifest(files: DataFrame, id_column: str = "file_id", group_column: str = "category", fields: tuple[str, ...] = FIELDS,
                     seen: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """Digest ``fields`` of every file and build the trees; each row is a leaf, equal rows too.

    Leaves ascend by id within their category, null ids first, equal ids by digest. ``seen``: columns in place of recorded ones, as they are
    found now; the digest of such a copy is kept beside the leaf for :func:`check_files`. A null category is one of its own. Columns outside ``fields`` are not
    looked at, names may be any.
    """
    recorded = {c: named(c) for c in fields}
    copy = leaf([(seen or {}).get(c, recorded[c]) for c in fields]) if seen else F.lit(None).cast("string")
    hashed = files.select(named(id_column).alias("id"), _tree_key(named(group_column)).alias("tree"), leaf(list(recorded.values())).alias("d"), copy.alias("c"))
    leaves = hashed.select("tree", "id", F.unhex("d").alias("digest"), F.unhex(F.when(F.col("c") != F.col("d"), F.col("c"))).alias("copy"))
    return Manifest(_numbered(keep(leaves, "manifest-digests"), ["id", "digest", "copy"]), height)


def check_files(manifest: Manifest, id_column: str = "file_id") -> DataFrame:
    """``(id, leaf, subroot, root, proof, folded_root, verified)`` per file, digests as binary.

    ``proof``: the siblings on the way from the leaf to the root of all, level by level. ``folded_root``: the root that the copy's digest (the leaf's where there is no
    other) leads to with them; ``verified`` tells whether it is the root. A tree of one leaf has no siblings. An empty catalog has no rows.
    """
    height, root = manifest.height, manifest.root
    id_type = manifest.leaves.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.BinaryType()) for c in ("leaf", "subroot", "proof", "folded_root"))])

    def check(files: pa.Table, blocks: pa.Table) -> pa.Table:
        leaves, held, high, nodes, above = (blocks.column(c)[0].as_py() for c in ("leaves", "held", "height", "nodes", "above"))
        stored, upper = Block(nodes, high, held), unpack(above or b"")
        rest, tops = siblings(upper), {}
        subroot = fold(nodes[:DIGEST], upper[:height_of(leaves, 99) - high])
        digests, copies = files.column("digest").to_pylist(), files.column("copy").to_pylist()
        proofs, folded = [], []
        for place, digest, copy in zip(files.column("place").to_pylist(), digests, copies):
            path = stored.path(place % WIDE ** (height - 1))
            proofs.append(siblings(path) + rest)
            top = fold(copy or digest, path)
            if top not in tops:
                tops[top] = fold(top, upper)
            folded.append(tops[top])
        made = [pa.array(digests, pa.binary()), pa.array([subroot] * len(digests), pa.binary()), pa.array(proofs, pa.binary()), pa.array(folded, pa.binary())]
        return pa.Table.from_arrays([files.column("id").combine_chunks(), *made], names=["id", "leaf", "subroot", "proof", "folded_root"])

    files = manifest.leaves.withColumn("block", _block_of(F.col("place"), height))
    told = files.groupBy("tree", "block").cogroup(manifest.blocks.groupBy("tree", "block")).applyInArrow(check, out)
    top = F.lit(root).cast("binary")
    rows = told.select("id", "leaf", "subroot", top.alias("root"), "proof", "folded_root", (F.col("folded_root") == top).alias("verified"))
    return rows.toDF(id_column, *rows.columns[1:])
