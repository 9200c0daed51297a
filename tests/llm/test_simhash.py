"""SimHash groups against a comparison of all pairs."""

import pytest
import xxhash

from loomtone.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle, seed=42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def plain_groups(prints, distance=2):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(prints))]


def signed(code):
    return code - (1 << 64) if code >> 63 else code


def test_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id file_id", "text report", "'x' fingerprint")
    rows = sorted(docs.collect())
    prints = [plain_fingerprint(r.report) for r in rows]
    group = plain_groups(prints)
    got = {r.file_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, cell_rows=100).collect()}
    assert got == {r.file_id: (signed(p), rows[g].file_id) for r, p, g in zip(rows, prints, group)}


@pytest.mark.parametrize("cell_rows", [50, 100_000])
def test_links_of_close_codes(spark, cell_rows):
    import random
    rng = random.Random(5)
    codes = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(60):
        base = rng.getrandbits(64)
        codes.append(base)
        for _ in range(6):
            base ^= 1 << rng.randrange(64)
            base ^= 1 << rng.randrange(64) if rng.random() < 0.6 else 0
            base ^= 1 << rng.randrange(64) if rng.random() < 0.3 else 0
            codes.append(base)
    codes = sorted(set(codes))
    classes = spark.createDataFrame([(signed(c),) for c in codes], "fingerprint bigint")
    got = {r.node: r.component for r in simhash.link_fingerprints(classes, cell_rows=cell_rows).collect()}
    group = plain_groups(codes)
    by = {}
    for code, g in zip(codes, group):
        by.setdefault(g, []).append(signed(code))
    expected = {c: min(members) for members in by.values() if len(members) > 1 for c in members}
    assert got == expected


def test_edge_rows(spark):
    long = " ".join(f"pad{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (4, "a B"), (None, "one two three four"), (7, long), (8, long + " end"), (9, "é x")]
    loops = spark.createDataFrame(rows, "file_id bigint, report string")
    got = [(r.file_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(loops).collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(prints)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    assert sorted(got, key=str) == sorted(((i, signed(p), least[g]) for (i, _), p, g in zip(rows, prints, group)), key=str)
    kept = simhash.keep_one(loops).collect()
    assert len(kept) == len(set(group))
    assert simhash.near_duplicates(loops.limit(0)).count() == 0
    assert simhash.keep_one(loops.limit(0)).columns == loops.columns


def test_gray_rank_and_hex(spark):
    row = spark.sql("select cast(-1 as bigint) x").select(simhash.fingerprint_hex(simhash.F.col("x")).alias("h")).first()
    assert row.h == "f" * 16
    codes = [i ^ (i >> 1) for i in range(256)]
    got = spark.createDataFrame([(c,) for c in codes], "x bigint").select("x", simhash.gray_rank(simhash.F.col("x")).alias("r")).orderBy("r").collect()
    assert [r.x for r in got] == codes
