"""The manifest against a tree built level by level."""

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtone.llm import manifest as M

SCHEMA = "file_id bigint, folder string, category string, length bigint, report string, digest string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(leaves):
    """All levels of a tree, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[k:k + 8])) for k in range(0, len(low), 8)])
    return levels


def plain(rows, changed):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), row[0], leaf(changed(row))))
    names = sorted(trees, key=lambda c: (c is not None, (c or "").encode()))
    grown = {c: grow([x[2] for x in sorted(trees[c])]) for c in names}
    over = grow([grown[c][-1][0] for c in names])
    out = []
    for at, c in enumerate(names):
        for pos, (_, _, own, ident, copy) in enumerate(sorted(trees[c])):
            proof, folded = "", copy
            for levels, k in ((grown[c], pos), (over, at)):
                for level in levels[:-1]:
                    run = level[k // 8 * 8:k // 8 * 8 + 8]
                    proof += "".join(run[:k % 8] + run[k % 8 + 1:])
                    folded = digest("".join(run[:k % 8]) + folded + "".join(run[k % 8 + 1:]))
                    k //= 8
            out.append((ident, own, grown[c][-1][0], over[-1][0], digest(proof), folded, folded == over[-1][0]))
    return sorted(out, key=str)


def answer(df):
    text = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    rows = df.select(df.columns[0], *text, F.sha2(F.lower(F.hex("proof")), 256), F.lower(F.hex("folded_root")), "verified")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def lowered(row):
    return (*row[:4], row[4].lower() if row[4] and row[0] is not None and row[0] % 3 == 0 else row[4])


def seen():
    return {"report": F.when(F.col("file_id") % 3 == 0, F.lower("report")).otherwise(F.col("report"))}


def some_files():
    rng = random.Random(5)
    sizes = {"Bass": 700, "Drums": 65, "Keys": 64, "Guitars": 9, "Mixed": 8, "Other": 1, None: 3, "": 2, "-": 1, "Äther": 2}
    rows, ident = [], 0
    for category, n in sizes.items():
        for _ in range(n):
            ident += rng.randrange(1, 4)
            rows.append((ident, rng.choice(["a", None, "é"]), category, rng.choice([None, 7, -3]), rng.choice([None, "", "Tempo: 120", "ÄB x" * 9])))
    rows += [rows[0], rows[0], rows[3], (None, None, None, None, None), (None, None, None, None, None), (rows[1][0], "x", "Bass", 0, "y"), (10**12, "long", "Bass", 1, "A" * 500_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 4])
def test_roots_proofs_and_changed_files(spark, height):
    rows = some_files()
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).repartition(6)
    made = M.catalog_manifest(df, seen=seen(), height=height)
    got = answer(M.check_files(made))
    assert got == plain(rows, lowered)
    assert made.root.hex() == got[0][3] and {r[-1] for r in got} == {True, False}
    assert made.roots.count() == 10


def test_one_file_and_none(spark):
    row = (1, "f", "c", 2, "t")
    one = M.catalog_manifest(spark.createDataFrame([(*row, "x")], SCHEMA))
    assert answer(M.check_files(one)) == [(1, leaf(row), leaf(row), leaf(row), digest(""), leaf(row), True)]
    none = M.catalog_manifest(spark.createDataFrame([], SCHEMA))
    assert none.root is None and M.check_files(none).collect() == []


def test_addresses_split_at_half_height():
    assert M.addresses(2, 1).tolist() == list(range(1, 9))
    for height in range(1, 6):
        places = np.concatenate([M.addresses(height, d) for d in range(height)])
        assert sorted(places) == list(range(M.nodes_in(height)))
    # a block of four levels: the upper two lie first, then each lower subtree in one piece
    assert sorted(np.concatenate([M.addresses(4, 0), M.addresses(4, 1)])) == list(range(9))
    lower = np.concatenate([M.addresses(4, 2)[:1], M.addresses(4, 3)[:8]])
    assert sorted(lower) == list(range(9, 18))


def test_names(spark):
    df = spark.createDataFrame([("a", None, "r"), ("b", "c", "r")], "`the id` string, tree string, verified string")
    told = M.check_files(M.catalog_manifest(df, "the id", "tree", ("the id", "tree", "verified")), "the id")
    assert {r[0] for r in told.collect()} == {"a", "b"} and told.columns[0] == "the id"
