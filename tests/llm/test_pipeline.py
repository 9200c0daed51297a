"""The pipeline stage by stage against plain versions, on all documents of the smallest table."""

import re

import corpus_pipeline as pipeline
from loomtone.llm import privacy, quality
from tests.llm.test_decontamination import plain as plain_hits
from tests.llm.test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    (_, good), (_, near), (_, clean), (_, private), (_, mixed) = pipeline.STAGES

    judged = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, judged, "doc_id", "text").collect()}
    first = good(spark, docs, SF)
    assert rows(first) == [r for r in rows(docs) if scores[r[0]] >= 0.3] and first.columns == columns
    held = rows(first)
    assert len(held) > 100

    second = near(spark, first, SF)
    by_id = sorted(held)
    group = plain_groups([plain_fingerprint(r[1]) for r in by_id])
    assert rows(second) == sorted((by_id[g] for g in sorted(set(group))), key=str) and second.columns == columns

    third = clean(spark, second, SF)
    goldens = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, n, hit, _ in plain_hits([(r[0], r[1]) for r in rows(second)], goldens) if hit and 20 * hit >= n}
    assert rows(third) == [r for r in rows(second) if r[0] not in bad] and third.columns == columns

    fourth = private(spark, third, SF)
    assert fourth.columns == columns and fourth.schema == docs.schema
    for before, after in zip(sorted(rows(third)), sorted(rows(fourth))):
        assert not privacy.identifiers(after[1]) and after[4] == len(after[1])
        kept = re.sub(r"<(EMAIL|IP|CARD|PHONE)>", "", after[1])
        assert (before[1] == after[1]) == (not privacy.all_spans(before[1])) and len(kept) <= len(before[1])

    fifth = mixed(spark, fourth, SF)
    assert rows(fifth.select(columns)) == rows(fourth)
    assert fifth.columns == [*columns, "block", "slot", "place"]


def test_run_and_edge_rows(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "pad loop of the a.b@c.de", "en", "a", 9), (3, "x " * 100_000, None, "b", None),
         (3, "x " * 100_000, None, "b", None), (4, "one warm pad loop with bass", "en", "a", None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing")], "item_id bigint, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "None"]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_names_and_registration():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in (1, 2, 3, 4, 5, 6, 8, 9, 10)) and "pipeline" in names
