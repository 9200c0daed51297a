"""Toxicity and quality models: held-out accuracy, and rows at the edges."""

import numpy as np
import pytest

from loomtone.llm import quality, toxicity
from loomtone.llm.shared import fold

BASE = "/root/testdata/sf0.1"


def ranked(y, s):
    """The share of (1, 0) pairs that the score puts in order."""
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    ones = y.sum()
    return (order[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.fixture(scope="module")
def loops(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet").selectExpr("doc_id file_id", "text report", "source score", "lang place")


@pytest.fixture(scope="module")
def judged(spark):
    return spark.read.parquet(f"{BASE}/labels.parquet").withColumnRenamed("doc_id", "file_id")


@pytest.mark.parametrize("module, score, label, least", [
    (toxicity, "score_toxicity", "toxic", 0.7), (quality, "score_quality", "quality", 0.95)])
def test_held_out_reports_are_ranked(loops, judged, module, score, label, least):
    got = getattr(module, score)(loops, judged).join(judged, "file_id").where("held_out").toPandas()
    assert ranked(got[label].to_numpy(), got["score"].to_numpy()) > least


def test_fold_is_crc32(spark):
    import zlib
    got = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_edge_rows(spark, score):
    texts = ["clown idiot " * 5, "a calm and warm pad loop " * 9] * 30
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \n"), (None, "warm pad"), (103, "pad " * 300_000), (103, "pad"), (103, "pad")]
    loops = spark.createDataFrame(rows, "file_id bigint, report string").selectExpr("*", "1 score", "'x' label", "2 place")
    judged = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)] + [(None, 1, 1), (101, None, None)], "file_id bigint, quality int, toxic int")
    got = score(loops, judged).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.file_id is not None and r.file_id < 60}) == 2
    by = {r.file_id: r.score for r in got}
    assert (by[0] > by[1]) == (score is toxicity.score_toxicity)
    assert score(loops.limit(0), judged).count() == 0
    unlearnt = score(loops, judged.limit(0)).collect()
    assert len(unlearnt) == len(rows) and len({r.score for r in unlearnt}) == 1


def test_ratio_table_is_a_ratio_of_distributions():
    rng = np.random.default_rng(3)
    codes = [rng.integers(0, 1 << 25, 4000).astype(np.int32) for _ in range(2)]
    counts = toxicity._Counts(codes[0])
    flat = np.full(32, 1 / 32, np.float32)
    one = counts.up_to(3, 1, flat).reshape(-1, 32).sum(1)
    assert np.allclose(one, 1, atol=1e-3)


def test_model_of_one_class_calls_nothing_toxic(spark):
    loops = spark.createDataFrame([(i, f"pad {i}") for i in range(20)], "file_id bigint, report string")
    judged = spark.createDataFrame([(i, 0) for i in range(20)], "file_id bigint, toxic int")
    assert not any(r.predicted for r in toxicity.score_toxicity(loops, judged).collect())


def test_keep_good_keeps_columns(spark, loops, judged):
    kept = quality.keep_good(loops, judged, 0.3)
    assert kept.columns == loops.columns and 0 < kept.count() <= loops.count()


def test_late_passages_of_long_texts_are_learnt(spark):
    calm, rude = "a calm and warm pad loop ", "clown idiot "
    rows = [(i, calm * 900 + (rude * 300 if i % 2 else "")) for i in range(60)] + [(100, rude * 9), (101, calm * 9)]
    loops = spark.createDataFrame(rows, "file_id bigint, report string")
    judged = spark.createDataFrame([(i, i % 2) for i in range(60)], "file_id bigint, toxic int")
    by = {r.file_id: r.score for r in toxicity.score_toxicity(loops, judged).collect()}
    assert by[100] > 0.5 > by[101]


def test_counts_of_a_part_are_expectations():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 40, 300).astype(np.int32)
    code, n = np.unique(codes, return_counts=True)
    part = toxicity._Counts(code, n, 0.4)
    drawn = [toxicity._Counts(codes[rng.random(300) < 0.4]) for _ in range(2000)]
    assert np.isclose(part.count.sum(), 120)
    for k in (1, 3):
        assert np.allclose(part.lower[k], np.mean([d.lower[k] for d in drawn], 0), atol=0.1)
    flat = np.full(32, 1 / 32, np.float32)
    assert np.allclose(part.up_to(3, 1, flat).reshape(-1, 32).sum(1), 1, atol=1e-3)
