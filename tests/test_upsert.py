"""A catalog through several updates, broken ones between."""

import random

import pytest
from pyspark.sql import functions as F

from loomtone.operators import upsert as U

SCHEMA = "path string, loop_type string, category string, tempo int, words array<string>"


def rows(spark, held):
    return spark.createDataFrame([(p, *v) for p, v in held.items()], SCHEMA)


def told(df):
    return {r.path: (r.loop_type, r.category, r.tempo, r.words) for r in df.collect()}


def test_updates_equal_a_merged_table(spark, tmp_path):
    rng, path, held = random.Random(2), str(tmp_path / "cat #1"), {}
    some = lambda: (rng.choice(["audio", "midi"]), rng.choice(["Horn/Wind", "Bass = low", None, "Drums 100%"]), rng.randrange(60, 200), ["a", None])
    for step in range(4):
        changed = {f"/lib/{rng.randrange(40)}.wav": some() for _ in range(15)}
        lost = set(rng.sample(sorted(changed), 4)) if step else set()
        df = rows(spark, changed).withColumn("lost", F.col("path").isin(*lost, ""))
        assert U.upsert_catalog(df.drop("lost") if not step else df, path, removed=None if not step else F.col("lost")) == step + 1
        held = {p: v for p, v in {**held, **changed}.items() if p not in lost}
        assert told(U.read_catalog(spark, path)) == held
    first = told(U.read_catalog(spark, path, 1))
    assert len(first) and first != held and U.catalog_versions(spark, path) == [1, 2, 3, 4]
    assert U.expire_versions(spark, path, 1) and told(U.read_catalog(spark, path)) == held
    with pytest.raises(FileNotFoundError):
        U.read_catalog(spark, path, 1)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "cat")
    U.upsert_catalog(rows(spark, {str(k): ("audio", f"c{k % 5}", k, None) for k in range(50)}), path)
    U.upsert_catalog(rows(spark, {"7": ("audio", "c4", 1, None), "new": ("midi", "c0", 2, None)}), path)  # 7 moves from c2 to c4
    store = U._Store(spark, path)
    one, two = (U._folders(store, v) for v in (1, 2))
    assert {U._values(f) for f in set(one) & set(two)} == {("audio", "c0"), ("audio", "c1"), ("audio", "c3")}
    assert {U._values(f) for f in set(two) - set(one)} == {("audio", "c2"), ("audio", "c4"), ("midi", "c0")}
    plan = U.read_catalog(spark, path).where("category = 'c1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan


def test_a_broken_update_leaves_the_old_catalog(spark, tmp_path):
    path = str(tmp_path / "cat")
    held = {str(k): ("audio", f"c{k % 3}", k, None) for k in range(9)}
    U.upsert_catalog(rows(spark, held), path)
    broken = rows(spark, {"1": ("audio", "c1", 99, None), "2": ("audio", "c2", 98, None)})
    with pytest.raises(Exception, match="lost in the middle"):
        U.upsert_catalog(broken.withColumn("tempo", F.when(F.col("path") == "2", F.raise_error(F.lit("lost in the middle")).cast("int")).otherwise(F.col("tempo"))), path)
    assert told(U.read_catalog(spark, path)) == held
    publish, U._Store.publish = U._Store.publish, lambda *a: (_ for _ in ()).throw(OSError("no connection"))
    try:
        with pytest.raises(OSError, match="no connection"):
            U.upsert_catalog(broken, path)
    finally:
        U._Store.publish = publish
    assert told(U.read_catalog(spark, path)) == held and U.catalog_versions(spark, path) == [1]
    assert U.upsert_catalog(broken, path) == 2
    assert told(U.read_catalog(spark, path)) == {**held, "1": ("audio", "c1", 99, None), "2": ("audio", "c2", 98, None)}
    with pytest.raises(FileExistsError):
        U._Store(spark, path).publish("versions/00000002.json", {})


def test_new_columns_repeated_and_missing_keys_and_all_removed(spark, tmp_path):
    path = str(tmp_path / "cat")
    U.upsert_catalog(rows(spark, {"a": ("audio", "x", 1, None), "b": ("audio", "y", 2, None)}), path)
    more = spark.createDataFrame([("a", "audio", "y", 5, None, "A"), ("a", "audio", "x", 6, None, "B"), (None, "audio", "x", 7, None, "A")], SCHEMA + ", key string")
    U.upsert_catalog(more, path)
    got = {r.path: r.key for r in U.read_catalog(spark, path).collect()}
    assert set(got) == {"a", "b"} and got["a"] in "AB" and got["b"] is None
    U.upsert_catalog(U.read_catalog(spark, path), path, removed=F.lit(True))
    assert U.read_catalog(spark, path).collect() == [] and "key" in U.read_catalog(spark, path).columns
