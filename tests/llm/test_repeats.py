"""Repeated strings against a table of all strings."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtone.llm import repeats


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        spans, k = [], 0
        while k < len(t):
            if gone[k]:
                a = k
                while k < len(t) and gone[k]:
                    k += 1
                spans.append((a, k))
            else:
                k += 1
        out.append((i, len(t), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def answer(df):
    return sorted(((r[0], r.n_bytes, [(s.first, s.stop) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def some_rows(seed, n=120):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(10, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 7)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("xyz") + p[k + 1:]
            parts.append(p if rng.random() < 0.8 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))))
        rows.append((i, "".join(parts)))
    return rows + [(500, None), (501, ""), (502, "short"), (None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (503, "aaaa" * 60), (504, "ab" * 90)]


@pytest.mark.parametrize("settings", [{}, {"hot_contexts": 1}, {"hot_contexts": 3, "bucket_rows": 50}, {"sieve_bits": 14}])
def test_equals_table_of_strings(spark, settings):
    rows = some_rows(len(settings) + 1)
    loops = spark.createDataFrame(rows, "file_id bigint, report string").selectExpr("*", "1 spans", "'x' key", "2 kept").repartition(5)
    assert answer(repeats.drop_repeats(loops, length=24, gram=6, **settings)) == plain(rows, 24)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert answer(repeats.drop_repeats(docs, "doc_id", "text")) == plain([tuple(r) for r in docs.collect()], 400)


def test_empty_table_and_long_text(spark):
    rows = [(1, "pad loop " * 40_000), (2, "one of a kind " + "".join(chr(97 + k * k % 23) for k in range(3000)))]
    loops = spark.createDataFrame(rows, "file_id bigint, report string")
    assert repeats.drop_repeats(loops.limit(0)).count() == 0
    got = answer(repeats.drop_repeats(loops))
    assert got[0] == (1, 360_000, [(0, 360_000)], b"")


def test_merge_sort():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    group = np.array([rng.randrange(5) for _ in strings])
    order, common = repeats._sorted_extensions(strings, 12, group)
    got = [(group[k], strings[k]) for k in order]
    assert got == sorted(got)
    for k in range(1, len(order)):
        (g, a), (h, b) = got[k - 1], got[k]
        n = 0
        while g == h and n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert common[k] == n


def test_collisions_are_noticed(monkeypatch):
    monkeypatch.setattr(repeats, "powers", lambda n, base=0: np.zeros(n + 1, np.uint64))
    strings = [b"abc", b"abd", b"a", b"zz", b"ab"]
    order, common = repeats._sorted_extensions(strings, 5, np.zeros(5, np.int64))
    assert [strings[k] for k in order] == sorted(strings) and common.tolist() == [0, 1, 2, 2, 0]


def test_contexts_are_handed_on_in_small_batches():
    rng = np.random.default_rng(5)
    text = pa.array(["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(3000)])
    every = type("Held", (), {"value": np.full(1 << 11, 255, np.uint8)})  # a sieve that lets all anchors through
    candidates = repeats._candidates(every, 14, 400, 32)
    sizes = [b.nbytes for b in repeats._contexts(candidates)([pa.RecordBatch.from_arrays([text], names=["t"])])]
    assert sum(sizes) > 16 << 20 and max(sizes) < 8 << 20


def test_bytes_without_spans():
    spans = pa.array([[{"first": 1, "stop": 3}, {"first": 4, "stop": 6}], [], None, [{"first": 0, "stop": 4}], []], repeats._ARROW_SPANS)
    text = pa.array(["abcdéf", "x", "yé", "four", ""])
    assert repeats._without.func(text, spans).to_pylist() == [b"adf", b"x", "yé".encode(), b"", b""]
    assert repeats._without.func(text[1:], spans[1:]).to_pylist() == [b"x", "yé".encode(), b"", b""]
    assert repeats._without.func(text[:0], spans[:0]).to_pylist() == []
