"""States followed over micro-batches: order, late and repeated events, stuck files, forgotten state."""

import random

from loomtone.streaming import status, transitions

SCHEMA = "file_id string, ts timestamp, seq bigint, state string, error string"


def rows_of(spark, events):
    return spark.createDataFrame([(f, s, n, st, e) for f, s, n, st, e in events], "file_id string, s bigint, seq bigint, state string, error string").selectExpr(
        "file_id", "timestamp_seconds(s) AS ts", "seq", "state", "error")


class Stream:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.options = spark, options
        self.src, self.out, self.state = (str(tmp_path / d) for d in ("in", "log", "state"))

    def arrive(self, *events):
        rows_of(self.spark, events).coalesce(1).write.mode("append").parquet(self.src)
        stream = self.spark.readStream.schema(SCHEMA).parquet(self.src)
        query = transitions.follow_status(stream, self.out, self.state, **self.options)
        query.awaitTermination()
        return query

    def log(self):
        return self.spark.read.parquet(self.out)

    def told(self):
        return sorted(((r.file_id, int(r.ts.timestamp()) if r.ts else None, r.seq, r.state, r.previous, r.verdict) for r in self.log().collect()), key=repr)


def test_order_of_states_over_batches(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    s = Stream(spark, tmp_path)
    s.arrive(("a", 3, 3, "converting", None), ("a", 1, 1, "pending", None), ("a", 2, 2, "queued", None), ("b", 1, 1, "converting", None))
    s.arrive(("a", 9, 9, "failed", "no space"), ("a", 2, 2, "queued", None), ("a", 5, 4, "completed", None), ("b", 1, 0, "queued", None), ("b", 1, 1, "converting", None))
    s.arrive(("a", 10, 10, "queued", None), ("b", 4, 4, None, None))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    assert s.told() == sorted([
        ("a", 1, 1, "pending", None, "ok"), ("a", 2, 2, "queued", "converting", "late"), ("a", 2, 2, "queued", "pending", "ok"), ("a", 3, 3, "converting", "queued", "ok"),
        ("a", 5, 4, "completed", "converting", "ok"), ("a", 9, 9, "failed", "completed", "illegal"), ("a", 10, 10, "queued", "failed", "ok"),
        ("b", 1, 0, "queued", "converting", "late"), ("b", 1, 1, "converting", None, "illegal"), ("b", 1, 1, "converting", "converting", "repeated"),
        ("b", 4, 4, None, "converting", "illegal")], key=repr)
    assert {r.file_id: r.state for r in transitions.states_of(s.log()).collect()} == {"a": "queued", "b": None}


def test_stuck_files_and_forgotten_state(spark, tmp_path):
    s = Stream(spark, tmp_path, lateness="10 seconds", stuck_after=60, forget_after=600)
    s.arrive(("slow", 1, 1, "queued", None), ("slow", 5, 2, "converting", None), ("done", 1, 1, "queued", None), ("done", 2, 2, "converting", None), ("done", 3, 3, "completed", None))
    s.arrive(("clock", 100, 1, "pending", None))
    assert [r for r in s.told() if r[-1] == "stuck"] == [("slow", 5, 2, "converting", "converting", "stuck")]
    s.arrive(("clock", 130, 2, "queued", None), ("slow", 131, 3, "completed", None))  # it was slow, not lost
    assert ("slow", 131, 3, "completed", "converting", "ok") in s.told()
    query = s.arrive(("clock", 2000, 3, "converting", None))
    assert [r[0] for r in s.told() if r[-1] == "stuck"] == ["slow"]
    s.arrive(("done", 2001, 9, "completed", None), ("slow", 2001, 9, "queued", None))  # both are forgotten
    assert [r for r in s.told() if r[2] == 9] == [("done", 2001, 9, "completed", None, "illegal"), ("slow", 2001, 9, "queued", None, "ok")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_batch_of_events_gives_the_same_rows(spark, tmp_path):
    rng = random.Random(8)
    events = [(f"f{rng.randrange(5)}", rng.randrange(1, 40), k, rng.choice(list(transitions.LEGAL)[1:]), None) for k in range(120)]
    s = Stream(spark, tmp_path)
    s.arrive(*events)
    with transitions.rocks_state(spark):
        batch = transitions.status_transitions(rows_of(spark, [*events, ("f0", None, 500, "queued", None)])).collect()
    got = sorted((r.file_id, int(r.ts.timestamp()), r.seq, r.state, r.previous or "", r.verdict) for r in batch if r.ts)
    assert got == sorted((*r[:4], r[4] or "", r[5]) for r in s.told()) and [r.verdict for r in batch if r.ts is None] == ["undated"]
    latest = {r.file_id: r.state for r in status.latest_status(rows_of(spark, events)).collect()}
    assert {r.file_id: r.state for r in transitions.states_of(s.log()).collect()} == latest
