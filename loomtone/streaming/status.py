"""Conversion status and progress kept up to date from status events ``(file_id, ts, seq, state, error)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def latest_status(events: DataFrame, key: str = "file_id") -> DataFrame:
    """Current state of each file: that of its latest event; works on batches and streams, in any arrival order."""
    newest = F.max_by(F.struct("state", "error", "ts"), F.struct("ts", "seq"))
    return events.groupBy(key).agg(newest.alias("s")).select(key, "s.state", "s.error", "s.ts")


def progress_figures() -> list[Column]:
    """Starts, finished and failed files as aggregates over status events."""
    started = F.count_if(F.col("state") == "queued")
    done, failed = F.count_if(F.col("state") == "completed"), F.count_if(F.col("state") == "failed")
    return [started.alias("total"), done.alias("success_count"), failed.alias("failure_count")]


def running_progress(events: DataFrame) -> DataFrame:
    """Files finished and failed so far, and the share of starts that have finished."""
    counts = events.agg(*progress_figures())
    share = (F.col("success_count") + F.col("failure_count")) / F.nullif("total", F.lit(0))
    return counts.withColumn("percentage", F.coalesce(share, F.lit(0.0)))


class ProgressListener(StreamingQueryListener):
    """Adds up what the micro-batches of observed streams have counted, without a query or state of its own.

    Use with ``events.observe(name, *progress_figures())`` in any stream over status events, and ``spark.streams.addListener``. A batch that is told
    again, or repeated after a restart with the same checkpoint, counts once.
    """

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        row = told.observedMetrics.get(self.name)
        if row is not None and told.numInputRows:
            self.batches[str(told.id), told.batchId] = row.asDict()

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict:
        """The sums so far, and the share of starts that have finished."""
        names = ("total", "success_count", "failure_count")
        sums = {n: sum(b[n] for b in self.batches.values()) for n in names}
        return sums | {"percentage": (sums["success_count"] + sums["failure_count"]) / sums["total"] if sums["total"] else 0.0}


def keep_changes(df: DataFrame, out: str, checkpoint: str, mode: str = "update", once: bool = True) -> StreamingQuery:
    """Write each batch's changed rows to its own ``batch=`` folder; only what changed is written, and a repeated batch
    overwrites itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _newest(log: DataFrame, key: str | None) -> DataFrame:
    """Per key the row of its latest batch, with that batch (without a key, the latest row)."""
    columns = [c for c in log.columns if c not in (key, "batch")]
    newest = F.max_by(F.struct(*columns, "batch"), F.col("batch")).alias("s")
    rows = log.groupBy(key).agg(newest) if key else log.agg(newest)
    return rows.select(*([key] if key else []), "s.*")


def current(spark: SparkSession, out: str, key: str | None = "file_id", snapshot: str | None = None) -> DataFrame:
    """The state a change log stands for: per key the row of its latest batch (without a key, the latest row).

    With a ``snapshot`` folder written by :func:`compact`, only the batches after its newest snapshot are read.
    """
    log = spark.read.parquet(out)
    if snapshot is None:
        return _newest(log, key).drop("batch")
    taken = spark.read.parquet(snapshot)
    upto = taken.agg(F.max("upto")).first()[0]
    rows = taken.filter(F.col("upto") == upto).drop("upto").unionByName(log.filter(F.col("batch") > upto))
    return _newest(rows, key).drop("batch")


def compact(
    spark: SparkSession, out: str, snapshot: str, key: str | None = "file_id", last: str | None = None
) -> None:
    """Merge the change log into a new snapshot ``snapshot/upto=<newest batch>``; run it from time to time.

    ``last``: the snapshot folder to start from, left out for the first one. A run that fails leaves the log and earlier
    snapshots as they are, and a repeated one overwrites itself. Batches up to the snapshot may then be archived.
    """
    log = spark.read.parquet(out)
    upto = log.agg(F.max("batch")).first()[0]
    rows = log
    if last is not None:
        taken = spark.read.parquet(last)
        before = taken.filter(F.col("upto") < upto).agg(F.max("upto")).first()[0]
        if before is not None:
            rows = taken.filter(F.col("upto") == before).drop("upto").unionByName(log.filter(F.col("batch") > before))
    _newest(rows, key).write.mode("overwrite").parquet(f"{snapshot}/upto={upto}")
