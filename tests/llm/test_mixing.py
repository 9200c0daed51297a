"""Pfair mixing: windows, deviation and whole results."""

import math
from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtone.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.tuples(st.integers(0, 40), st.integers(1, 50)), max_size=8))
def test_less_than_one_block_off(given_):
    blocks, weights = {k: n for k, (n, _) in given_.items()}, {k: w for k, (_, w) in given_.items()}
    plan = mixing.pfair(blocks, weights)
    assert Counter(k for k, _ in plan) == Counter({k: n for k, n in blocks.items() if n})
    assert all([b for q, b in plan if q == k] == list(range(n)) for k, n in blocks.items())
    left, at = dict(blocks), 0
    while at < len(plan):
        active = [k for k, n in left.items() if n]
        total, had, slot = sum(weights[k] for k in active), Counter(), 0
        while at < len(plan) and all(left[k] for k in active):
            k = plan[at][0]
            i = had[k] + 1
            assert i > 0 and math.floor(Fraction((i - 1) * total, weights[k])) <= slot < math.ceil(Fraction(i * total, weights[k]))
            had[k] += 1
            left[k] -= 1
            at, slot = at + 1, slot + 1
            assert all(abs(had[q] - Fraction(slot * weights[q], total)) < 1 for q in active)


def test_mix_is_whole_and_by_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id file_id", "source folder", "text slot")
    weights = mixing.damped_weights(docs)
    got = mixing.mix(docs, weights, block_rows=7).collect()
    assert sorted(r.file_id for r in got) == sorted(r.file_id for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault((r.folder, r.block), []).append(r)
    assert all(len({r.slot for r in v}) == 1 and sorted(r.place for r in v) == list(range(len(v))) for v in by.values())
    names = sorted({r.folder for r in got})
    w = {r.folder: r.weight for r in weights.collect()}
    sizes = Counter(r.folder for r in got)
    plan = mixing.pfair({k: -(-sizes[n] // 7) for k, n in enumerate(names)}, {k: w[n] for k, n in enumerate(names)})
    assert {(r.slot, r.folder, r.block) for r in got} == {(t, names[k], b) for t, (k, b) in enumerate(plan)}


def test_edge_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, "z"), (4, ""), (None, None)]
    loops = spark.createDataFrame(rows, "file_id bigint, folder string").selectExpr("*", "9 place", "1 weight", "'t' report")
    weights = spark.createDataFrame([("a", 3), ("a", 1), ("", None), ("b", 5), (None, 2), ("z", 0)], "folder string, weight bigint")
    got = mixing.mix(loops, weights, block_rows=1).collect()
    assert sorted((str(r.file_id), str(r.folder)) for r in got) == sorted((str(a), str(b)) for a, b in rows)
    assert sorted(r.slot for r in got) == list(range(len(rows)))
    assert len({r.block for r in got if r.folder != "a"}) == 4
    assert mixing.mix(loops.limit(0), weights).count() == 0
    fewer = mixing.mix(loops, weights, block_rows=1, most_blocks=2).collect()
    assert len(fewer) == len(rows) and max(r.place for r in fewer) == 3


def test_every_source_has_its_weight(spark):
    # more sources than any list held before, and a third of the rows without one
    named = [(k, f"s{k:05d}") for k in range(10_200)] + [(20_000 + k, "big") for k in range(900)]
    loops = spark.createDataFrame(named + [(40_000 + k, None) for k in range(5_000)], "file_id bigint, folder string")
    weights = mixing.damped_weights(loops)
    held = {r.folder: r.weight for r in weights.collect()}
    assert len(held) == 10_202 and held[None] == 71 and held["big"] == 30 and held["s10199"] == 1
    got = mixing.mix(loops, weights, block_rows=10).collect()
    assert Counter(r.file_id for r in got) == Counter(r.file_id for r in loops.collect())
    sizes = Counter(r.folder for r in got)
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    plan = mixing.pfair({k: -(-sizes[n] // 10) for k, n in enumerate(names)}, {k: held[n] for k, n in enumerate(names)})
    assert {(r.slot, r.folder, r.block) for r in got} == {(t, names[k], b) for t, (k, b) in enumerate(plan)}
