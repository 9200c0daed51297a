"""Golden windows in reports against a plain search."""

import re

import pytest

from loomtone.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(reports, goldens, window=13):
    windows = {}
    for golden, text in goldens:
        w = WORD.findall((text or "").translate(UPPER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and golden is not None else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(golden))
    lengths = {len(w) for w in windows}
    out = []
    for file_id, text in reports:
        w = WORD.findall((text or "").translate(UPPER))
        hit, ids = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    ids |= got
        out.append((file_id, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_words", [4_000_000, 300])
def test_equals_plain_search(spark, most_words):
    base = "/root/testdata/sf0.001"
    loops = spark.read.parquet(f"{base}/documents.parquet").selectExpr("doc_id file_id", "text report", "lang golden")
    goldens = spark.read.parquet(f"{base}/benchmark.parquet").selectExpr("item_id golden_id", "text report")
    goldens = goldens.union(spark.createDataFrame([(900, "Of the, and!"), (901, "the"), (902, ""), (903, None), (None, "of"), (904, "the")], goldens.schema))
    got = decontamination.golden_hits(loops, goldens, most_words=most_words)
    rows = sorted(((r.file_id, r.n_words, r.n_hit, list(r.golden)) for r in got.collect()), key=str)
    assert rows == plain([(r.file_id, r.report) for r in loops.collect()], [tuple(r) for r in goldens.collect()])


def test_edge_rows(spark):
    line = "a b c d e f g h i j k l m n o p"
    rows = [(1, None), (2, ""), (3, "--- !!"), (4, line.upper()), (4, "x " * 50_000 + line), (None, "b c d"), (5, "É" + line), (6, "l m n o p a b c d e f g h i j k l m")]
    loops = spark.createDataFrame(rows, "file_id bigint, report string")
    goldens = spark.createDataFrame([(1, line), (1, line), (2, "c"), (3, "É")], "golden_id int, report string")
    got = sorted(((r.file_id, r.n_words, r.n_hit, list(r.golden)) for r in decontamination.golden_hits(loops, goldens).collect()), key=str)
    assert got == plain(rows, [(1, line), (2, "c"), (3, "É")])
    assert decontamination.golden_hits(loops.limit(0), goldens).count() == 0
    none = decontamination.golden_hits(loops, goldens.limit(0)).collect()
    assert {r.n_hit for r in none} == {0} and len(none) == len(rows)
    kept = decontamination.drop_contaminated(loops.selectExpr("*", "1 n_hit"), goldens).collect()
    assert sorted(str(r.file_id) for r in kept) == ["1", "2", "3"] + (["4"]) and kept[0].n_hit == 1
