"""Posting lists against sets of numbers."""

import random

from loomtone.operators import postings as P


def table(spark, seed=3, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([k + 1, 32_768 * rng.randrange(1, 5) + rng.randrange(-1, 3), 10**12 + k]), rng.choice(["Jazz", "Funk", None, ""]), rng.choice([["Dry"], ["Dry", "Dark"], [], None, [None, "Dark"]]), k) for k in range(n)]
    rows += [rows[0], (0, "Jazz", ["Dry"], 1), (-5, "Jazz", ["Dry"], 1), (None, "Jazz", None, 2)]
    return rows, spark.createDataFrame(rows, "`file number` bigint, genre string, words array<string>, value int").repartition(6)


def test_members_counts_and_intersections(spark):
    rows, df = table(spark)
    good = [r for r in rows if r[0] is not None and r[0] >= 1]
    having = {}
    for number, genre, words, _ in good:
        for tag, values in (("genre", [genre]), ("words", words or [])):
            for v in values:
                if v is not None:
                    having.setdefault((tag, v), set()).add(number)
    lists = P.tag_postings(df, "`file number`", ["genre", "words"])
    got = {}
    for r in P.members(lists, "tag", "value").collect():
        got.setdefault((r.tag, r.value), []).append(r.number)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in having.items()}
    assert {(r.tag, r.value): r.files for r in P.file_count(lists, "tag", "value").collect()} == {k: len(v) for k, v in having.items()}
    both = P.matching(lists, ("genre", ["Jazz", "", "Jazz"]), ("words", ["Dark"]))
    want = (having["genre", "Jazz"] | having["genre", ""]) & having["words", "Dark"]
    assert {r.number for r in P.members(both).collect()} == want and P.file_count(both).first().files == len(want) > 0
    facets = {r.value: r.files for r in P.facet_counts(lists, "words", P.matching(lists, ("genre", ["Funk"]))).collect()}
    assert facets == {v: len(having["words", v] & having["genre", "Funk"]) for v in ("Dry", "Dark")}
    none = P.matching(lists, ("genre", ["Polka"]), ("words", ["Dark"]))
    assert none.count() == 0 and P.file_count(none).first().files == 0


def test_a_value_of_most_files_is_many_rows(spark):
    df = spark.range(1, 200_001).selectExpr("id AS number", "'Jazz' AS genre")
    lists = P.tag_postings(df, "number", ["genre"])
    assert lists.count() == -(-200_000 // P.BUCKET) and P.file_count(lists).first().files == 200_000
    assert max(len(r.bits) for r in lists.collect()) == P.BUCKET // 8
