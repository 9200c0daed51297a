"""Files arriving in batches of bounded size, failures between, and the marks."""

import json
import os

import pytest

from loomtone.plans.convert import convert_library
from loomtone.streaming import arrivals, ingest


def write(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


QUICK = {"settle": 0.01, "files_per_batch": 4, "files_per_task": 3}


def taken(spark, out):
    return sorted(r.path.rsplit("/lib/", 1)[1] for r in spark.read.option("recursiveFileLookup", "true").parquet(out).select("path").collect())


def test_backlog_in_bounded_batches_equals_the_batch_catalog(spark, tmp_path):
    root, out, state = (str(tmp_path / d) for d in ("lib", "out", "state"))
    for k in range(10):
        write(f"{root}/{'Jazz' if k % 2 else 'Hip Hop/é #1'}/bass_{90 + k}bpm_{k}.{'mid' if k % 3 else 'wav'}", b"RIFF")
        os.utime(f"{root}/{'Jazz' if k % 2 else 'Hip Hop/é #1'}/bass_{90 + k}bpm_{k}.{'mid' if k % 3 else 'wav'}", (1000 + k // 4, 1000 + k // 4))  # many of one time
    for name in ("_x/a.wav", ".b.wav", "notes.txt"):
        write(f"{root}/{name}")
    write(f"{root}/empty.wav", b"")
    ingest.stream_catalog(spark, root, out, state, source=QUICK)
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [4, 4, 2]
    columns = ["path", "stem", "tempo", "genre", "category", "loop_type", "error"]
    got, whole = (sorted(map(tuple, df.select(columns).collect()), key=str) for df in (spark.read.parquet(out), convert_library(spark, root)))
    assert got == whole
    write(f"{root}/Jazz/late_70bpm.wav")
    for _ in range(2):
        ingest.stream_catalog(spark, root, out, state, source=QUICK)
    assert taken(spark, out).count("Jazz/late_70bpm.wav") == 1 and len(taken(spark, out)) == 11


def test_failed_batches_are_repeated_and_nothing_is_taken_twice(spark, tmp_path):
    root, out, state = (str(tmp_path / d) for d in ("lib", "out", "state"))
    names = [f"n{k}.wav" for k in range(11)]
    for name in names:
        write(f"{root}/{name}")
    broken = {1}

    def run():
        def save(batch, batch_id):
            if batch_id in broken:
                raise ValueError("no room left")
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        stream = arrivals.read_arrivals(spark, root, state, ("wav",), **QUICK)
        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", state).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="no room left"):
        run()
    assert len(taken(spark, out)) == 4
    for name in ("n98.wav", "n99.wav"):
        write(f"{root}/{name}")
    with pytest.raises(Exception, match="no room left"):
        run()
    broken.clear()
    run()
    run()
    assert taken(spark, out) == sorted([*names, "n98.wav", "n99.wav"])


def test_marks(tmp_path):
    root = str(tmp_path / "lib")
    for k, name in enumerate(("c.wav", "a.wav", "b.WAV", "d.mid")):
        write(f"{root}/{name}")
        os.utime(f"{root}/{name}", (50 + k // 2, 50 + k // 2))
    options = {"root": root, "marks": str(tmp_path / "marks"), "extensions": "wav", "files_per_batch": "2", "files_per_task": "1", "settle": "0"}
    first = arrivals.ArrivalReader(options)
    start = first.initialOffset()
    one = first.latestOffset()
    assert one == {"time": 50_000_000, "path": f"{root}/c.wav"}
    groups = first.partitions(start, one)
    assert [[f[1][-5:] for f in g.files] for g in groups] == [["a.wav"], ["c.wav"]]
    again = arrivals.ArrivalReader(options)  # a new process: the files of the noted batch are found by the marks, the next one lies beyond
    assert [g.files for g in again.partitions(start, one)] == [g.files for g in groups]
    two = again.latestOffset()
    assert two["path"].endswith("b.WAV") and again.latestOffset() == two and again.partitions(two, two) == []
    with open(tmp_path / "marks" / "mark0.json", "w") as f:
        f.write('{"time"')
    assert arrivals.ArrivalReader(options).latestOffset() in (one, two)
    assert json.loads((tmp_path / "marks" / "mark1.json").read_text())["time"] >= 50_000_000
    with pytest.raises(OSError):
        arrivals.ArrivalReader({**options, "root": f"{root}/none", "marks": str(tmp_path / "m2")}).latestOffset()
