"""Files on disk, written results and streams."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.names import META, WITH_CATALOG, catalog
from checks.loops import AIFF_CHUNKS, CAF_CHUNKS, MIDI_FILES, RECORDS, TEMPO, mixed_files
from checks.views import KNOWN_LOOPS, TREE, TREE_PATH, library_tree, table
from loomtone.operators import sinks, upsert
from loomtone.operators.stats import batch_stats
from loomtone.plans.convert import convert_library, convert_run
from loomtone.plans.decode import decode_files, decode_library
from loomtone.sources import containers as C
from loomtone.sources import files as Fs
from loomtone.sources.listing import list_library
from loomtone.sources.ranged import scan_loops
from loomtone.streaming import ingest, status, transitions
from loomtone.workspace import scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}
WITH_TREE = S.with_(TREE)


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _rel(root: str, path: str = "path"):
    return F.regexp_extract(path, ".*/" + root.rsplit("/", 1)[1] + "/(.*)$", 1)


@query("scan_library", WITH_TREE + "SELECT rel FROM tree WHERE kind < 4 AND NOT hidden")
def _(spark, sf):
    root = library_tree(spark, sf)
    return Fs.scan_library(spark, root).select(_rel(root).alias("rel"))


@query("scan_library_flat", WITH_TREE + "SELECT id, 'Jazz/' || split_part(rel, '/', 2) AS rel FROM tree WHERE kind = 2 AND NOT hidden AND id % 3 = 0 "
       "UNION ALL SELECT id, rel FROM tree WHERE kind IN (0, 3) AND NOT hidden AND id % 3 = 0")
def _(spark, sf):
    root = library_tree(spark, sf)
    found = Fs.scan_library(spark, root + "/Jazz", recursive=False).select(_rel(root).alias("rel"))
    return found.select(F.regexp_extract("rel", r"no(\d+)\.", 1).cast("bigint").alias("id"), "rel")


LISTED = """listed AS (SELECT *, CASE WHEN kind = 5 THEN 'empty file' WHEN hidden THEN 'hidden file' END AS error,
  CASE WHEN kind < 3 AND NOT hidden THEN list_extract(['CAF', 'AIFF', 'MIDI'], kind + 1) END AS format FROM tree)"""


@query("scan_loops", S.with_(TREE, LISTED) + "SELECT rel, format, error FROM listed WHERE kind IN (0, 1, 2, 5)")
def _(spark, sf):
    root = library_tree(spark, sf)
    return scan_loops(spark, root, recursive=True).select(_rel(root).alias("rel"), "format", "error")


@query("scan_loops_chunks", S.with_(TREE, LISTED, KNOWN_LOOPS, CAF_CHUNKS, AIFF_CHUNKS) + """SELECT rel, CAST(ord AS INTEGER) AS ord, type, off, CAST(size AS BIGINT) AS size
      FROM listed JOIN (SELECT *, 0 AS kind FROM caf_chunks UNION ALL SELECT *, 1 FROM aiff_chunks) USING (id, kind) WHERE error IS NULL""")
def _(spark, sf):
    root = library_tree(spark, sf)
    found = scan_loops(spark, root, recursive=True).where("format <> 'MIDI'").select(_rel(root).alias("rel"), "chunks")
    return C.explode_chunks(found, "rel").withColumn("size", F.col("size").cast("bigint"))


@query("list_library", S.with_(TREE, LISTED) + "SELECT rel, error AS reason FROM listed WHERE kind <> 4")
def _(spark, sf):
    root = library_tree(spark, sf)
    return list_library(spark, root, Fs.LIBRARY_EXTENSIONS, width=7).select(_rel(root).alias("rel"), "reason")


@query("list_tree", WITH_TREE + "SELECT rel, kind = 5 AS empty FROM tree")
def _(spark, sf):
    root = library_tree(spark, sf)
    return Fs.list_tree(spark, root).select(_rel(root).alias("rel"), (F.col("length") == 0).alias("empty"))


@query("skipped_files", WITH_TREE + "SELECT rel, CASE WHEN kind = 5 THEN 'empty file' ELSE 'hidden file' END AS error FROM tree "
       "WHERE kind IN (0, 1, 2, 5) AND (hidden OR kind = 5)")
def _(spark, sf):
    root = library_tree(spark, sf)
    scanned = Fs.scan_library(spark, root, ["caf", "aif", "mid"]).select("path")
    listing = Fs.list_tree(spark, root)
    return Fs.skipped_files(listing, scanned, ["caf", "aif", "mid"]).select(_rel(root).alias("rel"), "error")


@query("read_content", WITH_TREE + "SELECT rel, CASE kind WHEN 0 THEN 'CAF' WHEN 1 THEN 'AIFF' WHEN 2 THEN 'MIDI' END AS format "
       "FROM tree WHERE hidden")
def _(spark, sf):
    root = library_tree(spark, sf)
    hidden = Fs.list_tree(spark, root).filter(F.contains("path", F.lit("/.trash/")))
    return Fs.read_content(hidden).select(_rel(root).alias("rel"), Fs.detect_format(F.col("content")).alias("format"))


DECODED = f"""decoded AS (SELECT rel, l.format, CASE WHEN error IS NULL THEN CASE WHEN r = 2 THEN 'midi' ELSE 'audio' END END AS loop_type, error, sample_rate,
    num_frames, codec, category, subcategory, genre, CAST(beats AS BIGINT) AS beat_count, key_signature, key_type, {TEMPO} AS tempo, marker_count,
    CASE WHEN r = 2 THEN midi_key END AS midi_key, CASE WHEN r = 2 THEN CAST(notes AS BIGINT) END AS notes, CASE WHEN r = 2 THEN length END AS midi_duration
    FROM listed l JOIN records USING (id) WHERE kind < 3 AND error IS NULL
  UNION ALL SELECT rel, NULL, NULL, error, NULL, NULL, NULL, '', '', '', 0, '', '', NULL, NULL, NULL, NULL, NULL
    FROM listed WHERE kind IN (0, 1, 2, 5) AND error IS NOT NULL)"""
WITH_DECODED = S.with_(TREE, LISTED, KNOWN_LOOPS, S.KEYS, MIDI_FILES, RECORDS, DECODED)


def _record(root: str, *more):
    return [
        _rel(root, "file_path").alias("rel"), "format", "loop_type", "audio.sample_rate", "audio.num_frames", "audio.codec", "metadata.category",
        "metadata.subcategory", "metadata.genre", "metadata.beat_count", "metadata.key_signature", "metadata.key_type", "metadata.tempo",
        "beat_markers.marker_count", F.col("midi.key_signature").alias("midi_key"), "midi.notes", F.col("midi.duration").alias("midi_duration"), *more]


@query("decode_library", WITH_DECODED + "SELECT * FROM decoded")
def _(spark, sf):
    root = library_tree(spark, sf)
    return decode_library(spark, root, recursive=True).select(*_record(root, "error"))


@query("split_errors", S.with_(TREE, LISTED, KNOWN_LOOPS, S.KEYS, MIDI_FILES, RECORDS) + """SELECT rel AS file, error FROM listed
      WHERE kind IN (0, 1, 2, 5) AND error IS NOT NULL
    UNION ALL SELECT file_path, 'Unknown file format: ' || file_path FROM records WHERE broken""")
def _(spark, sf):
    root = library_tree(spark, sf)
    on_disk = sinks.split_errors(decode_library(spark, root, recursive=True))[1]
    given = sinks.split_errors(decode_files(mixed_files(spark, sf)))[1]
    return on_disk.select(_rel(root, "file").alias("file"), "error").unionByName(given)


@query("export_json", WITH_DECODED + """SELECT * EXCLUDE error, (SELECT count(*) FROM decoded) AS total_files, (SELECT count(error) FROM decoded) AS failed
      FROM decoded WHERE error IS NULL""")
def _(spark, sf):
    root, out = library_tree(spark, sf), scratch_path(spark, "json")
    decoded = decode_library(spark, root, recursive=True)
    sinks.export_json(decoded, out)
    files = spark.read.schema(decoded.drop("error").schema).json(f"{out}/files")
    sums = spark.read.schema("total_files bigint, failed bigint").json(f"{out}/summary").first()
    return files.select(*_record(root, *(F.lit(sums[c]).cast("bigint").alias(c) for c in ("total_files", "failed"))))


@query("export_document", WITH_DECODED + """SELECT rel, error, category, tempo, (SELECT count(*) FROM decoded) AS total_files, (SELECT count(error) FROM decoded) AS failed
      FROM decoded WHERE error IS NULL UNION ALL SELECT rel, error, NULL, NULL, (SELECT count(*) FROM decoded), (SELECT count(error) FROM decoded) FROM decoded WHERE error IS NOT NULL""")
def _(spark, sf):
    """The fragments of the document, line by line; joined bytes are parsed as one document in the tests."""
    root, out = library_tree(spark, sf), scratch_path(spark, "document")
    sums = sinks.export_document(decode_library(spark, root, recursive=True), out)
    line = F.ltrim("value", F.lit(","))
    good = spark.read.text(f"{out}/files").select(F.from_json(line, "file_path string, metadata struct<category:string,tempo:double>").alias("r"))
    bad = spark.read.text(f"{out}/errors").select(F.from_json(line, "file string, error string").alias("r"))
    told = good.select(_rel(root, "r.file_path").alias("rel"), F.lit(None).cast("string").alias("error"), "r.metadata.category", "r.metadata.tempo").unionByName(
        bad.select(_rel(root, "r.file").alias("rel"), "r.error"), allowMissingColumns=True)
    return told.select("*", *(F.lit(sums[c]).cast("bigint").alias(c) for c in ("total_files", "failed")))


TAKEN = """SELECT rel, 'Keyboards' AS category, 'Synthesizer' AS subcategory, CASE WHEN starts_with(rel, 'Jazz') THEN 'Jazz'
    WHEN starts_with(rel, 'Hip') THEN 'Hip Hop' ELSE 'Rock/Blues' END AS genre, CAST(90 + id % 50 AS INTEGER) AS tempo,
    CASE WHEN kind = 2 THEN 'midi' ELSE 'audio' END AS loop_type FROM tree WHERE kind < 4 AND NOT hidden"""


@query("convert_library", WITH_TREE + TAKEN)
def _(spark, sf):
    root = library_tree(spark, sf)
    done = convert_library(spark, root)
    return done.select(_rel(root).alias("rel"), "category", "subcategory", "genre", "tempo", "loop_type")


RUN = f"""run AS (SELECT t.*, CASE WHEN kind = 5 THEN 'FAILED' WHEN hidden THEN 'SKIPPED' ELSE 'OK' END AS status,
    CASE WHEN kind = 5 THEN 'empty file' WHEN hidden THEN 'hidden file' END AS error, CASE WHEN kind = 2 THEN 'midi' ELSE 'audio' END AS loop_type,
    CASE WHEN kind = 2 THEN m.duration ELSE 4.0 END AS length,
    CASE WHEN kind < 4 AND NOT hidden THEN CAST(round_even((90 + t.id % 50) * CASE WHEN kind = 2 THEN m.duration ELSE 4.0 END / 60.0, 0) AS INTEGER) END
      AS beat_count FROM tree t LEFT JOIN midi_files m USING (id) WHERE kind <> 4),
  heard AS (SELECT id, beat_count, l_orderkey % 200000 AS pos FROM run JOIN lineitem ON l_suppkey = id AND l_linenumber = 7 AND l_quantity < 15
    WHERE status = 'OK' AND loop_type = 'audio'),
  found AS (SELECT id, pos FROM heard WHERE pos > 0 AND pos < 176400 UNION SELECT id, unnest([0, 176400]) FROM heard),
  short AS (SELECT id, beat_count FROM found JOIN (SELECT DISTINCT id, beat_count FROM heard) USING (id) GROUP BY ALL HAVING count(*) < beat_count + 1),
  filled AS (SELECT * FROM found UNION SELECT id, CAST(round_even(i * (176400 / beat_count), 0) AS BIGINT) FROM short, unnest(range(beat_count + 1)) t(i)),
  counted AS (SELECT id, count(*) AS n FROM filled GROUP BY id),
  ran AS (SELECT rel, status, error, loop_type, beat_count, CAST(CASE WHEN status <> 'OK' THEN 0 ELSE coalesce(n,
    CASE WHEN beat_count > 0 THEN 4 * beat_count + 1 WHEN loop_type = 'audio' THEN 2 ELSE 0 END) END AS BIGINT) AS markers
    FROM run LEFT JOIN counted USING (id))"""
WITH_RUN = S.with_(TREE, S.KEYS, MIDI_FILES, RUN)


def run(spark, sf):
    root = library_tree(spark, sf)
    near = table(spark, sf, "lineitem").where("l_linenumber = 7 AND l_quantity < 15")
    files = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit(f"file:{root}/" if root.startswith("/") else root + "/"), TREE_PATH(F.col("s_suppkey"))).alias("path"))
    onsets = near.join(files, "l_suppkey").select("path", (F.col("l_orderkey") % 200000).alias("pos"))
    return root, convert_run(spark, root, onsets=onsets)


@query("convert_run", WITH_RUN + "SELECT * FROM ran")
def _(spark, sf):
    root, rows = run(spark, sf)
    return rows.select(_rel(root).alias("rel"), "status", "error", "loop_type", "beat_count", "markers")


@query("convert_run_stats", WITH_RUN + """SELECT count(*) AS total, count(*) FILTER (status = 'OK') AS converted, count(*) FILTER (status = 'SKIPPED')
    AS skipped, count(*) FILTER (status = 'FAILED') AS errors, count(*) FILTER (status = 'OK' AND loop_type = 'audio') AS audio,
    count(*) FILTER (status = 'OK' AND loop_type = 'midi') AS midi FROM ran""")
def _(spark, sf):
    return batch_stats(run(spark, sf)[1])


@query("write_run", SQL["convert_run_stats"])
def _(spark, sf):
    """The totals that are counted while the run is written."""
    told = sinks.write_run(run(spark, sf)[1], scratch_path(spark, "run"))
    return spark.createDataFrame([told], ", ".join(f"{name} bigint" for name in ("total", "converted", "skipped", "errors", "audio", "midi")))


@query("stream_ingest", WITH_TREE + TAKEN)
def _(spark, sf):
    root, out = library_tree(spark, sf), scratch_path(spark, "ingest")
    ingest.stream_catalog(spark, root, f"{out}/catalog", f"{out}/state").awaitTermination()
    done = spark.read.parquet(f"{out}/catalog")
    return done.select(_rel(root).alias("rel"), "category", "subcategory", "genre", "tempo", "loop_type")


@query("write_catalog", WITH_CATALOG + f"SELECT {META} FROM catalog")
def _(spark, sf):
    out = scratch_path(spark, "catalog")
    sinks.write_catalog(catalog(spark, sf), out)
    return spark.read.parquet(out).select(*META.split(", "))


@query("write_catalog_pruned", WITH_CATALOG + f"SELECT {META} FROM catalog WHERE loop_type = 'audio' AND category <> 'Drums'")
def _(spark, sf):
    out = scratch_path(spark, "catalog")
    sinks.write_catalog(catalog(spark, sf), out)
    return spark.read.parquet(out).filter("loop_type = 'audio' AND category <> 'Drums'").select(*META.split(", "))


MERGED = """changed AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN 'Moved' ELSE category END AS category, tempo + 1 AS tempo) FROM catalog WHERE id % 3 = 0),
  merged AS (SELECT * FROM changed WHERE id % 5 <> 0 UNION ALL SELECT * FROM catalog WHERE id % 4 <> 0 AND id % 3 <> 0)"""


@query("upsert_catalog", WITH_CATALOG.rstrip() + ", " + MERGED + f" SELECT {META} FROM merged")
def _(spark, sf):
    """Two runs: the second has new, changed, moved and removed files."""
    out, rows = scratch_path(spark, "upsert"), catalog(spark, sf).select(*META.split(", "))
    upsert.upsert_catalog(rows.where("id % 4 <> 0"), out, "id")
    moved = rows.where("id % 3 = 0").withColumns({"category": F.when(F.col("id") % 2 == 0, "Moved").otherwise(F.col("category")), "tempo": F.col("tempo") + 1})
    upsert.upsert_catalog(moved, out, "id", removed=F.col("id") % 5 == 0)
    return upsert.read_catalog(spark, out).select(*META.split(", "))


# ---- streams over the event table -----------------------------------------------------------------------------------

STATES = """states AS (SELECT user_id AS file_id, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN
  'queued' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'converting' ELSE 'failed' END AS state,
  CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN props END AS error FROM events)"""


def states(spark, sf, streaming=True):
    schema = table(spark, sf, "events").schema
    if streaming:
        raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        raw = table(spark, sf, "events")
    t = F.col("event_type")
    state = F.when(t == "click", "pending").when(t == "view", "queued").when(t == "purchase", "completed").when(
        t == "signup", "converting").otherwise("failed")
    error = F.when(~t.isin("click", "view", "purchase", "signup"), F.col("props"))
    return raw.select(F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("ts"),
                      F.col("event_id").alias("seq"), state.alias("state"), error.alias("error"))


@query(
    "stream_status",
    S.with_(STATES) + """SELECT file_id, s.state AS state, s.error AS error FROM (SELECT file_id,
      arg_max({'state': state, 'error': error}, seq) AS s FROM states GROUP BY file_id)""",
)
def _(spark, sf):
    out = scratch_path(spark, "status")
    status.keep_changes(status.latest_status(states(spark, sf)), f"{out}/log", f"{out}/state").awaitTermination()
    return status.current(spark, f"{out}/log").select("file_id", "state", "error")


FOLLOWED = """late AS (SELECT *, seq % 7 = 3 AS second FROM states),
  placed AS (SELECT *, second AND seq < max(seq) FILTER (NOT second) OVER (PARTITION BY file_id) AS overtaken FROM late),
  accepted AS (SELECT *, lag(state) OVER (PARTITION BY file_id ORDER BY seq) AS previous FROM placed WHERE NOT coalesce(overtaken, false)),
  overtook AS (SELECT p.*, arg_max(b.state, b.seq) AS previous FROM placed p JOIN late b ON b.file_id = p.file_id AND NOT b.second WHERE p.overtaken GROUP BY ALL),
  followed AS (SELECT file_id, ts, seq, state, error, previous, CASE WHEN previous IS NULL AND state IN ('pending', 'queued') OR
      previous || '>' || state IN ('pending>queued', 'queued>converting', 'converting>completed', 'converting>failed', 'completed>queued', 'failed>queued')
      THEN 'ok' ELSE 'illegal' END AS verdict FROM accepted
    UNION ALL SELECT file_id, ts, seq, state, error, previous, 'late' FROM overtook)"""


def followed(spark, sf):
    """The log of transitions of a stream of two batches; one event in seven comes with the second, most of them late."""
    out, rows = scratch_path(spark, "followed"), states(spark, sf, streaming=False)
    for part, here in enumerate((F.col("seq") % 7 != 3, F.col("seq") % 7 == 3)):
        rows.where(here).write.parquet(f"{out}/in/part={part}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{out}/in")
        transitions.follow_status(stream, f"{out}/log", f"{out}/state", lateness="60 days").awaitTermination()
    return spark.read.parquet(f"{out}/log").drop("batch")


@query("status_transitions", S.with_(STATES, FOLLOWED) + "SELECT * FROM followed")
def _(spark, sf):
    return followed(spark, sf)


@query("status_violations", S.with_(STATES, FOLLOWED) + "SELECT verdict, previous, state, count(*) AS events FROM followed WHERE verdict <> 'ok' GROUP BY ALL")
def _(spark, sf):
    return followed(spark, sf).where("verdict <> 'ok'").groupBy("verdict", "previous", "state").agg(F.count("*").alias("events"))


@query("states_of", S.with_(STATES) + "SELECT file_id, arg_max(state, seq) AS state, arg_max({'e': error}, seq).e AS error, max(ts) AS ts FROM states GROUP BY file_id")
def _(spark, sf):
    return transitions.states_of(followed(spark, sf))


PROGRESS = """SELECT total, success_count, failure_count, (success_count + failure_count) / total AS percentage FROM (SELECT
  count(*) FILTER (state = 'queued') AS total, count(*) FILTER (state = 'completed') AS success_count,
  count(*) FILTER (state = 'failed') AS failure_count FROM states)"""


@query("stream_progress", S.with_(STATES) + PROGRESS)
def _(spark, sf):
    out = scratch_path(spark, "progress")
    running = status.running_progress(states(spark, sf))
    status.keep_changes(running, f"{out}/log", f"{out}/state", mode="complete").awaitTermination()
    return status.current(spark, f"{out}/log", None)


@query("observed_progress", S.with_(STATES) + PROGRESS)
def _(spark, sf):
    """What a listener adds up while another query, the current states, runs over the same stream."""
    out, heard = scratch_path(spark, "observed"), status.ProgressListener("progress")
    spark.streams.addListener(heard)
    try:
        seen = states(spark, sf).observe("progress", *status.progress_figures())
        query = status.keep_changes(status.latest_status(seen), f"{out}/log", f"{out}/state")
        query.awaitTermination()
        until = time.time() + 60
        while not heard.batches and time.time() < until:
            time.sleep(0.05)  # listeners are told after the batch
    finally:
        spark.streams.removeListener(heard)
    return spark.createDataFrame([heard.totals()], "total bigint, success_count bigint, failure_count bigint, percentage double")


@query("latest_status", S.with_(STATES) + "SELECT file_id, arg_max(state, seq) AS state, max(ts) AS ts FROM states GROUP BY file_id")
def _(spark, sf):
    return status.latest_status(states(spark, sf, streaming=False)).select("file_id", "state", "ts")
