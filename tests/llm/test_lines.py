"""Repeated lines against a table of all lines."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zlib

from loomtone.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least=10):
    held = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(BLANKS).translate(LOW)
    order = lambda i: (i is None, i or 0)
    for i, parts in split:
        for line in parts:
            held[key(line)].add(i)
    first = {k: min(ids, key=order) for k, ids in held.items() if len(ids) > 1 and len(k) >= least}
    out = []
    for i, parts in split:
        kept = [p for p in parts if key(p) not in first or first[key(p)] == i]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some_reports(seed=0, n=150):
    rng = random.Random(seed)
    pool = ["Format: CAF audio", "Tempo: 120 beats", "  Tempo: 120 BEATS\t", "Genre: Jazz", "Key: äöü ÄÖÜ xy", "日本語日本語日本語日", "ninechars", "tenletters", "\r Tempo: 120 beats", ""]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {rng.random()}" for _ in range(rng.randrange(9)))) for k in range(n)]
    return rows + [(None, "Format: CAF audio\nonly without id 1"), (None, "only without id 2\nonly without id 2"), (3, rows[3][1]), (3, "Genre: Jazz\nown line of three"),
                   (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "Tempo: 120 beats\n" * 3000), (n + 4, "x" * 300_000 + "\n" + " " * 50_000 + "x" * 300_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra") for i, t in rows], "file_id bigint, report string, keep string")


def test_kept_lines(spark):
    rows = some_reports()
    got = sorted((tuple(r) for r in lines.drop_repeated_lines(frame(spark, rows).repartition(7)).collect()), key=str)
    assert got == plain(rows)


def test_bitmaps_say_the_same(spark):
    rows = some_reports(4)
    for r in lines.line_bitmaps(frame(spark, rows)).collect():
        if r.keep is not None:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(bytes(r.keep)), np.uint8), bitorder="little")
            assert r.n_dropped == (bits == 0).sum() > 0
        else:
            assert r.n_dropped == 0
    got = sorted(((r.file_id, r.n_lines, r.n_dropped) for r in lines.line_bitmaps(frame(spark, rows)).collect()), key=str)
    assert got == sorted([r[:3] for r in plain(rows)], key=str)


def test_one_line_in_all_reports_is_shared_among_ranges(spark):
    rows = [(k, f"a line that all reports have\nown {k}") for k in range(3000)]
    told = lines.drop_repeated_lines(frame(spark, rows).repartition(5)).where("n_dropped = 0").collect()
    assert [r.file_id for r in told] == [0]
    ranges = frame(spark, rows).selectExpr("1 AS h", "file_id").repartitionByRange(8, "h", "file_id")
    assert ranges.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).filter(lambda n: n > 0).count() > 1


def test_streaming_over_cut_ranges():
    rng = random.Random(2)
    table = sorted({(rng.randrange(4), 0, rng.randrange(5), rng.randrange(3)) for _ in range(60)})
    first = {}
    for h, _, i, _ in table:
        first.setdefault(h, i)
    for cuts in range(20):
        at = sorted(rng.randrange(len(table) + 1) for _ in range(3))
        states, lasts = defaultdict(list), []
        for a, b in zip([0, *at], [*at, len(table)]):
            step = rng.randrange(1, 9)
            batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(h, g, i, 0, n) for h, g, i, n in table[k:min(k + step, b)]]),
                                                   (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["h1", "h2", "id", "row", "line"])
                       for k in range(a, b, step)]
            for out in lines._first_occurrences(iter(batches)):
                for r in out.to_pylist():
                    (lasts if r["state"] == 2 else states[r["state"]]).append((r["h1"], r["id"], r["line"]))
        least = {h: min(i for g, i, _ in lasts if g == h) for h, _, _ in lasts}
        gone = set(states[0]) | {r for r in states[1] if least.get(r[0], r[1]) != r[1]}
        assert gone == {(h, i, n) for h, _, i, n in table if first[h] != i}


def test_names_and_empty_table(spark):
    df = spark.createDataFrame([("b", "the same line"), ("a", "the same line")], "`doc id` string, n_lines string")
    out = lines.drop_repeated_lines(df, "doc id", "n_lines")
    assert sorted(map(tuple, out.collect())) == [("a", 1, 0, "the same line"), ("b", 1, 1, "")]
    assert lines.drop_repeated_lines(df.limit(0), "doc id", "n_lines").collect() == []
    assert lines.line_bitmaps(df.toDF("keep", "row"), "keep", "row").columns == ["keep", "n_lines", "n_dropped", "keep"]
