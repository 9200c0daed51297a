"""Loop-library inputs derived from the given tables, once in Spark and once as SQL common table expressions.

The Spark side stands for real inputs (listings, MIDI events, file bytes, logs); the SQL side states the same facts
directly, so decoding and deriving can be compared.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.functions.binary import uint_hex
from loomtone.workspace import scratch_path

INSTRUMENT_TOKENS = "SynthBass Drum slide_guitar hi-hat Piano Choir FX Tom Loop Violin Trumpet 808".split()
KEY_TOKENS = ["Am", "F#m", "C_major", "Bb", "F#", "G minor", "A", "Ebm", "D", "none"]
DIR_TOKENS = ["Hip_Hop", "deep-house", "Jazz Club", "lo-fi", "Misc", "World/Latin", "Cinematic Epic", "Indie Rock"]
DESCRIPTOR_TOKENS = ["Clean", "dark_wet", "Chords", "", "Funky Dry"]
EXT_TOKENS = ["wav", "aif", "caf", "mp3", "mid", "MID", "txt"]
CATEGORIES = dims.values(dims.CATEGORIES)
GENRES = dims.values(dims.GENRES)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(make):
    """Keep a derived input as a Parquet table in the shared folder, once per session: inputs are files, not plans.

    It is written as it is made, so no file's bytes are shuffled.
    """

    @functools.wraps(make)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _STORED:
            path = scratch_path(spark, make.__name__)
            make(spark, sf_dir).write.parquet(path)
            _STORED[key] = path
        return spark.read.parquet(_STORED[key])

    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders that one task makes files of.
ORDERS_PER_TASK = 250_000


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and prices of the orders, dealt to tasks of at most about ``ORDERS_PER_TASK``: what is dealt are these two numbers, not the files made of them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // ORDERS_PER_TASK)))


def _pick(tokens: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in tokens]), (index + 1).cast("int"))


def loop_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One library file per order."""
    k = F.col("o_orderkey")
    bpm = (F.lit(60) + (k * 7) % 130).cast("int")
    base = table(spark, sf_dir, "orders").select(
        k.alias("id"),
        _pick(INSTRUMENT_TOKENS, k % 12).alias("instrument_token"),
        _pick(KEY_TOKENS, k % 10).alias("key_token"),
        bpm.alias("bpm"),
        _pick(DIR_TOKENS, F.floor(k / 12) % len(DIR_TOKENS)).alias("dir"),
        _pick(DESCRIPTOR_TOKENS, F.floor(k / 5) % len(DESCRIPTOR_TOKENS)).alias("desc_token"),
        _pick(EXT_TOKENS, F.floor(k / 3) % 7).alias("ext_token"),
        (F.lit(44100) + F.floor("o_totalprice")).cast("bigint").alias("num_frames"),
        F.when(k % 2 == 0, F.lit(44100.0)).otherwise(F.lit(48000.0)).alias("sample_rate"),
    )
    k = F.col("id")
    bpm_text = F.col("bpm").cast("string")
    tempo = (
        F.when(k % 7 == 0, F.concat(bpm_text, F.lit("bpm")))
        .when(k % 7 == 1, F.concat(F.lit("BPM_"), bpm_text))
        .when(k % 7 == 2, F.concat(F.lit("["), bpm_text, F.lit("]")))
        .when(k % 7 == 3, F.concat(F.lit("("), bpm_text, F.lit(")")))
        .when(k % 7 == 4, F.concat(bpm_text, F.lit("_"), F.col("key_token"), F.lit("_x")))
        .when(k % 7 == 5, F.concat(F.lit("x_"), bpm_text))
        .otherwise(F.lit("loop"))
    )
    stem = F.concat_ws("_", "instrument_token", F.nullif("desc_token", F.lit("")), tempo, "key_token")
    return base.withColumn("stem", stem).withColumn(
        "path", F.concat(F.lit("/lib/"), F.col("dir"), F.lit("/"), F.col("stem"), F.lit("."), F.col("ext_token"))
    ).drop("desc_token")


def _list(tokens: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in tokens) + "]"


LOOP_FILES = f"""
loop_files AS (
  SELECT *, '/lib/' || dir || '/' || stem || '.' || ext_token AS path FROM (
    SELECT *, concat_ws('_', instrument_token, nullif(desc_token, ''),
      CASE id % 7 WHEN 0 THEN bpm || 'bpm' WHEN 1 THEN 'BPM_' || bpm WHEN 2 THEN '[' || bpm || ']'
        WHEN 3 THEN '(' || bpm || ')' WHEN 4 THEN bpm || '_' || key_token || '_x' WHEN 5 THEN 'x_' || bpm
        ELSE 'loop' END, key_token) AS stem
    FROM (
      SELECT o_orderkey AS id,
        list_extract({_list(INSTRUMENT_TOKENS)}, o_orderkey % 12 + 1) AS instrument_token,
        list_extract({_list(KEY_TOKENS)}, o_orderkey % 10 + 1) AS key_token,
        CAST(60 + (o_orderkey * 7) % 130 AS INTEGER) AS bpm,
        list_extract({_list(DIR_TOKENS)}, (o_orderkey // 12) % {len(DIR_TOKENS)} + 1) AS dir,
        list_extract({_list(DESCRIPTOR_TOKENS)}, (o_orderkey // 5) % {len(DESCRIPTOR_TOKENS)} + 1) AS desc_token,
        list_extract({_list(EXT_TOKENS)}, (o_orderkey // 3) % 7 + 1) AS ext_token,
        CAST(44100 + floor(o_totalprice) AS BIGINT) AS num_frames,
        CASE WHEN o_orderkey % 2 = 0 THEN 44100.0::DOUBLE ELSE 48000.0::DOUBLE END AS sample_rate
      FROM orders)))
"""


def known_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished loops with known facts, one per order: what the container fixtures are built from."""
    return _known(table(spark, sf_dir, "orders"))


def _known(orders: DataFrame, *more: str) -> DataFrame:
    """The known facts of orders, beside the columns ``more``."""
    return orders.selectExpr(*more, *_expressions(KNOWN_COLUMNS.format(
        cat=_spark_list(CATEGORIES), genre=_spark_list(GENRES), key=_spark_list(dims.MAJOR_KEYS.split()),
        ft="floor(o_totalprice)", div="div",
    )))


def _expressions(columns: str) -> list[str]:
    return [line.strip().rstrip(",") for line in columns.strip().splitlines()]


def _spark_list(tokens: list[str]) -> str:
    return "array(" + ", ".join("'" + t + "'" for t in tokens) + ")"


KNOWN_COLUMNS = """
  o_orderkey AS id,
  CAST(44100 + {ft} AS BIGINT) AS num_frames,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 44100 ELSE 48000 END AS DOUBLE) AS sample_rate,
  CAST(1 + o_orderkey % 2 AS INTEGER) AS channels,
  CAST(o_orderkey % 3 * 8 + 8 AS INTEGER) AS bits,
  CAST(o_orderkey % 17 AS INTEGER) AS beats,
  element_at({cat}, CAST(o_orderkey % 13 + 1 AS INTEGER)) AS category,
  'Sub ' || CAST(o_orderkey % 29 AS STRING) AS subcategory,
  element_at({genre}, CAST(o_orderkey {div} 13 % 13 + 1 AS INTEGER)) AS genre,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE element_at({key}, CAST(o_orderkey % 15 + 1 AS INTEGER)) END AS key_signature,
  CASE WHEN o_orderkey % 4 = 0 THEN 'neither' WHEN o_orderkey % 4 = 1 THEN 'major' ELSE 'minor' END AS key_type,
  CASE WHEN o_orderkey % 6 = 0 THEN '3/4' ELSE '4/4' END AS time_signature,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Clean,Dry' END AS descriptors
"""

KNOWN_LOOPS = "known_loops AS (SELECT " + KNOWN_COLUMNS.replace("element_at(", "list_extract(").replace(
    "AS STRING", "AS VARCHAR"
).format(
    cat=_list(CATEGORIES), genre=_list(GENRES), key=_list(dims.MAJOR_KEYS.split()), ft="floor(o_totalprice)", div="//",
) + " FROM orders)"


def _text(value: Column | str) -> Column:
    return F.hex(F.encode(F.lit(value) if isinstance(value, str) else value, "UTF-8"))


def _pairs(pairs: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Hex of the non-empty pairs, and their number."""
    made = [F.when(v != "", F.concat(_text(k), F.lit("00"), _text(v), F.lit("00"))) for k, v in pairs]
    count = sum((F.when(v != "", 1).otherwise(0) for _, v in pairs), F.lit(0))
    return F.concat_ws("", *made), count


def _caf_chunk(kind: str, body: Column) -> Column:
    return F.concat(_text(kind), uint_hex(F.length(body) / 2, 8), body)


def _marker_entries(frames: Column, beats: Column) -> Column:
    """Bytes of the marker entries used by the fixtures: four positions per beat by whole-number division, then the end."""

    def entries(frames: pa.Array, beats: pa.Array) -> pa.Array:
        known = pc.and_(pc.is_valid(frames), pc.is_valid(beats))
        steps = 4 * np.maximum(beats.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 1)
        ends = np.concatenate([[0], np.cumsum(steps + 1)])
        file = np.repeat(np.arange(len(steps)), steps + 1)
        i = np.arange(ends[-1]) - ends[file]
        made = np.zeros(ends[-1], dtype=[("kind", ">u2"), ("rest", ">u2"), ("more", ">u4"), ("pos", ">u4")])
        made["kind"] = 1
        made["pos"] = np.floor((frames.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[file] * i).astype(float) / steps[file])
        whole = pa.Array.from_buffers(pa.binary(), len(steps), [None, pa.py_buffer((12 * ends).astype(np.int32)), pa.py_buffer(made)])
        return pc.if_else(known, whole, None)

    return F.arrow_udf(entries, "binary")(frames, beats)


def _double_hex(value: Column) -> Column:
    """IEEE-754 hex of the two sample rates in use."""
    return F.when(value == 44100.0, F.lit("40E5888000000000")).otherwise(F.lit("40E7700000000000"))


def _float80_hex(value: Column) -> Column:
    return F.when(value == 44100.0, F.lit("400EAC44000000000000")).otherwise(F.lit("400EBB80000000000000"))


@stored
def caf_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, content)``: CAF bytes of the known loops, with an unknown chunk and a repeated one in between."""
    return _known(_orders(spark, sf_dir)).select("id", _caf_bytes().alias("content"))


def _caf_bytes() -> Column:
    desc = F.concat(
        _double_hex(F.col("sample_rate")), _text("aac "), F.lit("00" * 12), uint_hex(F.col("channels"), 4),
        uint_hex(F.col("bits"), 4),
    )
    pakt = F.concat(uint_hex(F.lit(7), 8), uint_hex(F.col("num_frames"), 8), F.lit("0000000000000000"))
    info = F.concat(uint_hex(F.lit(1), 4), _text("genre"), F.lit("00"), _text(F.lit("Other Genre")), F.lit("00"))
    body, count = _pairs(
        [("subcategory", F.col("subcategory")), ("category", F.col("category")), ("key signature", F.col("key_signature")),
         ("time signature", F.col("time_signature")),
         ("beat count", F.when(F.col("beats") > 0, F.col("beats").cast("string")).otherwise("")),
         ("descriptors", F.col("descriptors")), ("genre", F.col("genre")), ("key type", F.col("key_type"))]
    )
    tags = F.concat(F.lit(dims.TAG_UUID), uint_hex(count, 4), body)
    declared = F.greatest(F.col("beats"), F.lit(1)) * 4 + 1 + F.when(F.col("id") % 11 == 0, 2).otherwise(0)
    marks = F.concat(
        F.lit(dims.MARKER_UUID + "00000000" + "00010000" + "0032" + "0010" + "00000000"), uint_hex(declared, 4),
        F.hex(_marker_entries(F.col("num_frames"), F.col("beats"))),
    )
    free = F.repeat(F.lit("00"), (F.col("id") % 9 + 1).cast("int"))
    sample = F.repeat(F.lit("64657363"), (F.col("id") % 5 + 1).cast("int"))
    whole = F.concat(
        F.lit("6361666600010000"), _caf_chunk("desc", desc), _caf_chunk("free", free), _caf_chunk("pakt", pakt),
        _caf_chunk("data", sample), _caf_chunk("info", info), _caf_chunk("uuid", tags), _caf_chunk("free", free),
        _caf_chunk("uuid", marks),
    )
    return F.unhex(whole)


@stored
def aiff_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, content)``: AIFF bytes of the known loops, with an odd-sized chunk before the decoded ones."""
    return _known(_orders(spark, sf_dir)).select("id", _aiff_bytes().alias("content"))


def _aiff_bytes() -> Column:
    chunk = lambda kind, body: F.concat(_text(kind), uint_hex(F.length(body) / 2, 4), body, F.when(F.length(body) / 2 % 2 == 1, "00").otherwise(""))  # noqa: E731,E501
    comm = F.concat(
        uint_hex(F.col("channels"), 2), uint_hex(F.col("num_frames"), 4), uint_hex(F.col("bits"), 2),
        _float80_hex(F.col("sample_rate")),
    )
    root = F.when(F.col("id") % 4 == 0, 0).otherwise(36 + F.col("id") % 40)
    basc = F.concat(
        uint_hex(F.lit(1), 4), uint_hex(F.col("beats"), 4), uint_hex(root, 2), uint_hex(F.col("id") % 6, 2),
        uint_hex(F.when(F.col("id") % 6 == 0, 3).otherwise(4), 2), uint_hex(F.lit(4), 2), F.lit("00" * 68),
    )
    cate = F.concat(_text(F.col("category")), F.lit("0000"), _text(F.concat(F.lit(" "), F.col("subcategory"))),
                    F.lit("00"), _text(F.col("genre")), F.lit("00"), _text("tail"))
    odd = F.repeat(F.lit("AB"), (F.col("id") % 4 * 2 + 1).cast("int"))
    body = F.concat(chunk("NAME", odd), chunk("COMM", comm), chunk("basc", basc), chunk("cate", cate), chunk("SSND", F.lit("00" * 16)))
    whole = F.concat(_text("FORM"), uint_hex(F.length(body) / 2 + 4, 4), _text("AIFF"), body)
    return F.unhex(whole)


def midi_files(spark: SparkSession, sf_dir: str) -> int:
    """Files of :func:`midi_blob`."""
    return table(spark, sf_dir, "orders").count()


def midi_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, content)``: two-track MIDI bytes per order with running status, zero velocities and long deltas.

    Track 0: tempo, time and key signature. Track 1: a program, then ``id % 5 + 1`` pairs of note-on and zero-velocity
    note-on, the second of each pair after ``100 + id % 400`` ticks. Made as they are read: Parquet packs these bytes so well that a task would be given
    millions of files.
    """
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), _midi_bytes(F.col("o_orderkey")).alias("content"))


def _midi_bytes(k: Column) -> Column:
    gap = F.lit(100) + k % 400
    var = F.when(gap < 128, uint_hex(gap, 1)).otherwise(
        F.concat(uint_hex(F.floor(gap / 128) + 128, 1), uint_hex(gap % 128, 1))
    )
    meta = F.concat(
        F.lit("00FF5103"), uint_hex(F.lit(300000) + k % 700000, 3), F.lit("00FF5804"), uint_hex(F.lit(2) + k % 5, 1),
        F.lit("02"), F.lit("1808"), F.lit("00FF5902"), uint_hex(F.pmod(k % 17 - 8, F.lit(256)), 1), uint_hex(k % 2, 1),
        F.lit("00FF2F00"),
    )
    pair = F.concat(F.lit("00"), F.lit("3C40"), var, F.lit("3C00"))
    notes = F.concat(
        F.lit("00C3"), uint_hex(k % 128, 1), F.lit("0093"), F.lit("3C40"), var, F.lit("3C00"),
        F.repeat(pair, (k % 5).cast("int")), F.lit("00FF2F00"),
    )
    track = lambda body: F.concat(_text("MTrk"), uint_hex(F.length(body) / 2, 4), body)
    division = F.when(k % 10 == 0, F.lit("E728")).otherwise(_pick(["0060", "0180", "01E0", "03C0"], k % 4))
    whole = F.concat(_text("MThd"), F.lit("0000000600010002"), division, track(meta), track(notes))
    return F.unhex(whole)


@stored
def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, length, content)``: a CAF, AIFF or MIDI file per order, one in twenty with bytes of no known kind.

    Kinds lie side by side in each part, so a task has as many small files as large ones.
    """
    k, first = F.col("id"), F.col("id") % 3
    content = F.when(first == 0, _caf_bytes()).when(first == 1, _aiff_bytes()).otherwise(_midi_bytes(k))
    files = _known(_orders(spark, sf_dir)).where(first >= 0).select(
        F.concat(F.lit("/loops/"), k.cast("string"), _pick([".caf", ".aif", ".mid"], first)).alias("path"), k.alias("id"), content.alias("content"))
    files = files.select("path", F.when(k % 20 == 7, F.concat(F.unhex(F.lit("52494646")), F.col("content"))).otherwise(F.col("content")).alias("content"))
    return files.withColumn("length", F.length("content").cast("bigint"))


@functools.cache
def _tree(app: str, sf_dir: str) -> str:
    spark = SparkSession.getActiveSession()
    root = scratch_path(spark, "library")
    k = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select(k.alias("s_id"), TREE_PATH(k).alias("rel"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    orders = orders.join(suppliers, F.col("o_orderkey") == F.col("s_id"), "left_semi")  # bytes are made only of orders that a file shows
    files = suppliers.join(orders, F.col("s_id") == F.col("o_orderkey"), "left")
    files = _known(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "s_id", "rel")
    kind = F.col("s_id") % 6
    content = (
        F.when(kind == 0, _caf_bytes()).when(kind == 1, _aiff_bytes()).when(kind == 2, _midi_bytes(F.col("id")))
        .when(kind == 3, F.encode(F.lit("RIFF"), "UTF-8")).when(kind == 4, F.encode(F.lit("text"), "UTF-8"))
        .otherwise(F.lit(b""))
    )
    rows = files.select(F.concat(F.lit(root + "/"), F.col("rel")).alias("path"), content.alias("content"))
    rows.mapInPandas(_write_files, "written bigint").agg(F.sum("written")).collect()
    return root


def TREE_PATH(k: Column) -> Column:
    """Where a supplier's file lies: six kinds, some folders hidden, mixed-case extensions."""
    folder = F.when(k % 10 == 9, F.lit(".trash")).otherwise(_pick(["Jazz", "Hip Hop/Loops #1", "Rock 100%"], k % 3))
    ext = _pick(["CAF", "aif", "mid", "Wav", "txt", "caf"], k % 6)
    return F.concat(folder, F.lit("/synth_pad_"), (F.lit(90) + k % 50).cast("string"), F.lit("bpm_no"), k.cast("string"),
                    F.lit("."), ext)


TREE = """tree AS (SELECT s_suppkey AS id, s_suppkey % 6 AS kind, s_suppkey % 10 = 9 AS hidden,
  CASE WHEN s_suppkey % 10 = 9 THEN '.trash' ELSE list_extract(['Jazz', 'Hip Hop/Loops #1', 'Rock 100%'], s_suppkey % 3 + 1) END
  || '/synth_pad_' || (90 + s_suppkey % 50) || 'bpm_no' || s_suppkey || '.' ||
  list_extract(['CAF', 'aif', 'mid', 'Wav', 'txt', 'caf'], s_suppkey % 6 + 1) AS rel FROM supplier)"""


def _write_files(batches):
    import os

    import pandas as pd

    from loomtone.sources.files import open_store

    made: set[str] = set()
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            system, inner, _ = open_store(path)
            folder = os.path.dirname(inner)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(inner) as out:
                out.write(content)
        yield pd.DataFrame({"written": [len(pdf)]})


def library_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder tree with one file per supplier, written by tasks once per session; returns its root."""
    return _tree(spark.sparkContext.applicationId, sf_dir)


def midi_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIDI events, one per row of ``events``; a file per user."""
    e, t = F.col("event_id"), F.col("event_type")
    kind = (
        F.when(t == "click", "note_on").when(t == "view", "note_off").when(t == "purchase", "set_tempo")
        .when(t == "signup", "program_change").otherwise("key_signature")
    )
    a = (
        F.when(t == "purchase", F.lit(300000) + e % 700000).when(t == "signup", e % 128)
        .when(t == "error", e % 17 - 8).otherwise(e % 127)
    )
    b = F.when(t == "error", e % 2).when(t == "click", e % 3).otherwise(F.lit(0))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), (e % 4).cast("int").alias("track"), e.alias("ord"),
        F.floor("value").cast("bigint").alias("delta"), kind.alias("kind"), (e % 16).cast("int").alias("channel"),
        a.cast("bigint").alias("a"), b.cast("bigint").alias("b"),
    )


MIDI_LIKE = """
midi_like AS (
  SELECT user_id AS file_id, CAST(event_id % 4 AS INTEGER) AS track, event_id AS ord,
    CAST(floor(value) AS BIGINT) AS delta,
    CASE event_type WHEN 'click' THEN 'note_on' WHEN 'view' THEN 'note_off' WHEN 'purchase' THEN 'set_tempo'
      WHEN 'signup' THEN 'program_change' ELSE 'key_signature' END AS kind,
    CAST(event_id % 16 AS INTEGER) AS channel,
    CAST(CASE event_type WHEN 'purchase' THEN 300000 + event_id % 700000 WHEN 'signup' THEN event_id % 128
      WHEN 'error' THEN event_id % 17 - 8 ELSE event_id % 127 END AS BIGINT) AS a,
    CAST(CASE event_type WHEN 'error' THEN event_id % 2 WHEN 'click' THEN event_id % 3 ELSE 0 END AS BIGINT) AS b
  FROM events)
"""


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series_id, hop, v)``: events per user and eight hours."""
    hop = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(28_800_000_000)).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("series_id"), hop.alias("hop"))
        .agg(F.count("*").alias("v"))
    )


ENERGY = """
energy AS (
  SELECT user_id AS series_id, CAST(floor(epoch_us(ts) / 28800000000) AS BIGINT) AS hop, count(*) AS v
  FROM events GROUP BY ALL)
"""
