"""Counts on the way to the disk, and one document in parts."""

import json
import os

from pyspark.sql import functions as F

from loomtone.operators import sinks
from loomtone.operators.stats import batch_figures, batch_stats, observed
from loomtone.streaming import status


def decoded(spark, n, bad=lambda k: k % 4 == 3):
    rows = [(f"/lib/{(7 * k) % n:04d} é\".caf", f"Unknown {k}" if bad(k) else None, {"category": None if k % 3 else "Bass"}) for k in range(n)]
    return spark.createDataFrame(rows, "file_path string, error string, metadata struct<category:string>").repartition(5)


def test_document_is_one_json_text_in_order(spark, tmp_path):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")  # several parts also of few rows
    for n, bad in ((40, lambda k: k % 4 == 3), (3, lambda k: False), (2, lambda k: True), (0, None)):
        out = str(tmp_path / f"doc{n}")
        for _ in range(2):  # the second run overwrites
            told = sinks.export_document(decoded(spark, n, bad), out)
        text = b"".join(sinks.document(out, block=64))
        whole = json.loads(text)
        assert list(whole) == ["files", "errors", "summary"] and whole["summary"] == told
        rows = sorted(decoded(spark, n, bad).collect(), key=lambda r: r.file_path)
        assert whole["files"] == [{"file_path": r.file_path, "metadata": {"category": r.metadata.category}} for r in rows if r.error is None]
        assert whole["errors"] == [{"file": r.file_path, "error": r.error} for r in rows if r.error is not None]
        assert told == {"total_files": n, "successful": len(whole["files"]), "failed": len(whole["errors"])}
    spark.conf.set(coalesce, before)
    parts = json.loads((tmp_path / "doc40" / "parts.json").read_text())
    assert len([p for p in parts if "part" in p]) > 4


def test_a_failed_run_leaves_no_list(spark, tmp_path):
    out = str(tmp_path / "doc")
    sinks.export_document(decoded(spark, 4), out)
    try:
        sinks.export_document(decoded(spark, 4).withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.lit("lost")))), out)
    except Exception:
        pass
    else:
        raise AssertionError("the run should have failed")
    assert json.loads(b"".join(sinks.document(out)))["summary"]["total_files"] == 4  # nothing was touched before the rows were there
    os.remove(f"{out}/parts.json")
    assert {r.error for r in spark.read.schema("file string, error string").json(f"{out}/errors").collect()} == {"Unknown 3"}


def test_input_is_read_once_and_counted(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(1000).selectExpr(
        "if(id % 3 = 0, 'midi', 'audio') AS loop_type", "concat('c', id % 5) AS category", "if(id % 10 = 0, 'FAILED', if(id % 10 = 1, 'SKIPPED', 'OK')) AS status")
    through = rows.mapInArrow(count, rows.schema)
    told = sinks.write_run(through, str(tmp_path / "run"))
    assert read.value == 1000
    assert told == batch_stats(rows).first().asDict() and spark.read.parquet(str(tmp_path / "run")).count() == 1000
    assert sinks.write_run(rows.limit(0), str(tmp_path / "none")) == dict.fromkeys(told, 0)
    plan = observed(rows, batch_figures())[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 1


def test_listener_counts_repeated_batches_once(spark, tmp_path):
    class Told:
        def __init__(self, batch, total, rows=1):
            self.id, self.batchId, self.numInputRows = "q", batch, rows
            self.observedMetrics = {"p": type("R", (), {"asDict": lambda s: {"total": total, "success_count": 1, "failure_count": 0}})()}

    heard = status.ProgressListener("p")
    assert heard.totals() == {"total": 0, "success_count": 0, "failure_count": 0, "percentage": 0.0}
    for batch, total, rows in ((0, 4, 1), (1, 2, 1), (1, 2, 1), (2, 0, 0)):
        heard.onQueryProgress(type("E", (), {"progress": Told(batch, total, rows)})())
    assert heard.totals() == {"total": 6, "success_count": 2, "failure_count": 0, "percentage": 2 / 6}
