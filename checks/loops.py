"""Loop bytes and MIDI events: decoding, event aggregates, logs and reports read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.names import QUERIES as _NAMES
from checks.views import KNOWN_LOOPS, MIDI_LIKE, aiff_blob, caf_blob, known_loops, midi_blob, midi_files, midi_like, mixed_files, table
from loomtone import dims
from loomtone.functions import binary as B
from loomtone.functions import text as X
from loomtone.functions.rows import struct_rows
from loomtone.operators import lookup as L
from loomtone.operators import midi_stats as M
from loomtone.operators import quality as Q
from loomtone.operators import reports as R
from loomtone.operators import sinks
from loomtone.operators import stats as T
from loomtone.plans import convert, decode
from loomtone.sources import containers as C
from loomtone.sources import files as Fs
from loomtone.sources import midi, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}
WITH_LOOPS = S.with_(KNOWN_LOOPS)
WITH_MIDI = S.with_(MIDI_LIKE)


def query(name: str, sql: str | None = None):
    assert name not in _NAMES

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# ---- binary fields --------------------------------------------------------------------------------------------------


@query("be_int", "SELECT event_id, event_id * 7919 AS unsigned, event_id * 7919 - 40000000 AS signed, event_id % 65536 AS short "
       "FROM events")
def _(spark, sf):
    e = F.col("event_id")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    signed = e * 7919 - 40000000
    wrapped = F.when(signed < 0, signed.cast("decimal(20,0)") + two64).otherwise(signed.cast("decimal(20,0)"))
    high, low = F.floor(wrapped / F.lit("4294967296").cast("decimal(20,0)")), wrapped % F.lit("4294967296").cast("decimal(20,0)")
    data = F.unhex(F.concat(B.uint_hex(e * 7919, 8), B.uint_hex(high, 4), B.uint_hex(low, 4), B.uint_hex(e % 65536, 2)))
    return table(spark, sf, "events").select("event_id", data.alias("d")).select(
        "event_id", B.be_u64(F.col("d"), 0).cast("bigint").alias("unsigned"), B.be_i64(F.col("d"), 8).alias("signed"),
        B.be_uint(F.col("d"), 16, 2).alias("short"),
    )


@query("be_double", "SELECT event_id, CAST((event_id + 1) * pow(2, event_id % 40 - 20) AS DOUBLE) AS number FROM events")
def _(spark, sf):
    # (event_id + 1) * 2^p written out as sign, exponent and fraction
    n, p = F.col("event_id") + 1, F.col("event_id") % 40 - 20
    top = F.floor(F.log2(n.cast("double")) + F.lit(1e-12)).cast("bigint")
    fraction = (n - F.expr("shiftleft(1L, cast(floor(log2(cast(event_id + 1 as double)) + 1e-12) as int))")) * F.pow(
        F.lit(2.0), (F.lit(52) - top).cast("double"))
    bits = (top + p + 1023) * F.lit(4503599627370496) + fraction.cast("bigint")
    return table(spark, sf, "events").select(
        "event_id", B.be_double(F.unhex(B.uint_hex(bits, 8)), 0).alias("number")
    )


@query("be_float80", "SELECT event_id, CAST(8000 + event_id % 184000 AS DOUBLE) AS rate FROM events")
def _(spark, sf):
    n = F.lit(8000) + F.col("event_id") % 184000
    top = F.floor(F.log2(n.cast("double")) + F.lit(1e-12)).cast("bigint")
    mantissa = (n * F.pow(F.lit(2.0), (F.lit(31) - top).cast("double"))).cast("bigint")
    data = F.unhex(F.concat(B.uint_hex(top + 16383, 2), B.uint_hex(mantissa, 4), F.lit("00000000")))
    return table(spark, sf, "events").select("event_id", B.be_float80(data, 0).alias("rate"))


# ---- containers -----------------------------------------------------------------------------------------------------


def caf(spark, sf):
    return caf_blob(spark, sf).withColumn("chunks", C.caf_chunks(F.col("content")))


def aiff(spark, sf):
    return aiff_blob(spark, sf).withColumn("chunks", C.aiff_chunks(F.col("content")))


@query("detect_format", """SELECT o_orderkey AS id, 'CAF' AS format, 'AIFF' AS format2, 'MIDI' AS format3,
  CAST(NULL AS VARCHAR) AS format4 FROM orders""")
def _(spark, sf):
    """Formats are told before the files meet, so the joins move no bytes."""
    fmt, content = Fs.detect_format, F.col("content")
    a = caf_blob(spark, sf).select("id", fmt(content).alias("format"), fmt(F.substring(content, F.lit(2), F.length(content))).alias("format4"))
    b = aiff_blob(spark, sf).select("id", fmt(content).alias("format2"))
    c = midi_blob(spark, sf).select("id", fmt(content).alias("format3"))
    return a.join(b, "id").join(c, "id").select("id", "format", "format2", "format3", "format4")


TAG_BYTES = """(SELECT id, 4 + 16 + length('subcategory') + length(subcategory) + 2 + length('category') + length(category) + 2
  + CASE WHEN key_signature <> '' THEN length('key signature') + length(key_signature) + 2 ELSE 0 END
  + length('time signature') + length(time_signature) + 2
  + CASE WHEN beats > 0 THEN length('beat count') + length(CAST(beats AS VARCHAR)) + 2 ELSE 0 END
  + CASE WHEN descriptors <> '' THEN length('descriptors') + length(descriptors) + 2 ELSE 0 END
  + length('genre') + length(genre) + 2 + length('key type') + length(key_type) + 2 AS n FROM known_loops)"""
CAF_CHUNKS = f"""caf_chunks AS (
  SELECT id, ord, type, CAST(8 + 12 * (ord + 1) + sum(size) OVER (PARTITION BY id ORDER BY ord) - size AS BIGINT) AS off, size
  FROM (SELECT id, unnest([
      {{'ord': 0, 'type': 'desc', 'size': 32}}, {{'ord': 1, 'type': 'free', 'size': id % 9 + 1}},
      {{'ord': 2, 'type': 'pakt', 'size': 24}}, {{'ord': 3, 'type': 'data', 'size': 4 * (id % 5 + 1)}},
      {{'ord': 4, 'type': 'info', 'size': 22}}, {{'ord': 5, 'type': 'uuid', 'size': n}},
      {{'ord': 6, 'type': 'free', 'size': id % 9 + 1}},
      {{'ord': 7, 'type': 'uuid', 'size': 36 + 12 * (greatest(beats, 1) * 4 + 1)}}], recursive := true)
    FROM known_loops JOIN {TAG_BYTES} USING (id)))"""
WITH_CHUNKS = S.with_(KNOWN_LOOPS, CAF_CHUNKS)


@query("caf_chunks", WITH_CHUNKS + "SELECT id, CAST(ord AS INTEGER) AS ord, type, off, CAST(size AS BIGINT) AS size FROM caf_chunks")
def _(spark, sf):
    return C.explode_chunks(caf(spark, sf), "id").withColumn("size", F.col("size").cast("bigint"))


@query(
    "chunk_inventory",
    WITH_CHUNKS + """SELECT id, type, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS total_size,
      CAST(arg_max(size, ord) AS BIGINT) AS last_size FROM caf_chunks GROUP BY id, type""",
)
def _(spark, sf):
    counted = T.chunk_inventory(C.explode_chunks(caf(spark, sf), "id"), "id")
    return counted.withColumns({c: F.col(c).cast("bigint") for c in ("total_size", "last_size")})


@query("check_required_chunks", WITH_CHUNKS + """, wanted AS (SELECT unnest(['desc', 'data', 'info', 'uuid', 'pakt', 'kuki']) AS type)
  SELECT id, 'missing ' || w.type AS rule FROM known_loops, wanted w WHERE w.type = 'kuki' OR w.type = 'pakt' AND id % 4 IN (0, 1)
    OR w.type IN ('info', 'uuid') AND id % 8 = 2 OR w.type IN ('desc', 'data', 'info', 'uuid') AND id % 4 = 0""")
def _(spark, sf):
    """Files 0 of 4 have no chunk at all, 1 of 4 lose ``pakt``, 2 of 8 their tags and markers."""
    i, kind, files = F.col("id"), F.col("type"), caf(spark, sf)
    desc = C.caf_desc(C.last_payload(F.col("chunks"), "desc", 32))
    codec = files.select("id", desc["format_id"].alias("format_id"))
    gone = (i % 4 == 0) | ((i % 4 == 1) & (kind == "pakt")) | ((i % 8 == 2) & kind.isin("info", "uuid"))
    return Q.check_required_chunks(C.explode_chunks(files, "id").filter(~gone), "id", codec, files.select("id"))


@query("caf_desc", WITH_LOOPS + "SELECT id, sample_rate, 'aac' AS format_id, channels, bits AS bits_per_sample FROM known_loops")
def _(spark, sf):
    return caf(spark, sf).select("id", C.caf_desc(C.last_payload(F.col("chunks"), "desc", 32)).alias("d")).select("id", "d.*")


@query("caf_pakt", WITH_LOOPS + "SELECT id, CAST(7 AS BIGINT) AS num_packets, num_frames FROM known_loops")
def _(spark, sf):
    return caf(spark, sf).select("id", C.caf_pakt(C.last_payload(F.col("chunks"), "pakt", 24)).alias("p")).select("id", "p.*")


@query("caf_info_kv", WITH_LOOPS + """SELECT id, pos, key, value FROM (SELECT id, unnest([
      {'pos': 0, 'key': 'genre', 'value': genre, 'declared': 1}, {'pos': 1, 'key': 'comments', 'value': 'take ' || id, 'declared': 2},
      {'pos': 0, 'key': 'artist', 'value': category, 'declared': 0}], recursive := true) FROM known_loops) WHERE declared <= id % 4""")
def _(spark, sf):
    """Two info chunks per file: one declares none to three pairs and holds two, the other, after a chunk of another kind, holds one and a cut-off one."""
    def info(count, *texts, cut=""):
        body = F.concat(B.uint_hex(count, 4), *(F.concat(F.hex(F.encode(t, "UTF-8")), F.lit("00")) for t in texts), F.lit(cut))
        return F.concat(F.lit("696E666F"), B.uint_hex(F.length(body) / 2, 8), body)

    take = F.concat(F.lit("take "), F.col("id").cast("string"))
    first = info(F.col("id") % 4, F.lit("genre"), F.col("genre"), F.lit("comments"), take)
    second = info(F.lit(2), F.lit("artist"), F.col("category"), cut="6B6579")
    content = F.unhex(F.concat(F.lit("6361666600010000"), first, F.lit("66726565000000000000000100"), second))
    files = known_loops(spark, sf).select("id", content.alias("content"))
    return struct_rows(files, ["id"], C.caf_info_kv(C.caf_chunks(F.col("content"))), "pos")


@query(
    "loop_tags",
    WITH_LOOPS + """SELECT id, category, subcategory, genre, CASE WHEN beats > 0 THEN CAST(beats AS VARCHAR) END AS beat_count,
      time_signature, nullif(key_signature, '') AS key_signature, key_type, nullif(descriptors, '') AS descriptors
      FROM known_loops""",
)
def _(spark, sf):
    names = ["category", "subcategory", "beat count", "time signature", "key signature", "key type", "descriptors"]
    tags = caf(spark, sf).withColumn("tags", C.loop_tags(F.col("chunks")))
    return tags.select(
        "id", C.tag_value(C.genre_pairs(F.col("chunks")), "genre").alias("genre"),
        *[C.tag_value(F.col("tags"), n).alias(n.replace(" ", "_")) for n in names],
    )


TAGS = """tags AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS INTEGER) AS pos, key, value FROM (
  SELECT id, unnest([{'o': 1, 'key': 'subcategory', 'value': subcategory}, {'o': 2, 'key': 'category', 'value': category},
    {'o': 3, 'key': 'key signature', 'value': key_signature}, {'o': 4, 'key': 'time signature', 'value': time_signature},
    {'o': 5, 'key': 'beat count', 'value': CASE WHEN beats > 0 THEN CAST(beats AS VARCHAR) END},
    {'o': 6, 'key': 'descriptors', 'value': descriptors}, {'o': 7, 'key': 'genre', 'value': genre},
    {'o': 8, 'key': 'key type', 'value': key_type}], recursive := true) FROM known_loops) WHERE value <> '')"""


@query("explode_tags", S.with_(KNOWN_LOOPS, TAGS) + "SELECT id, pos, key, value FROM tags")
def _(spark, sf):
    return struct_rows(caf(spark, sf), ["id"], C.loop_tags(F.col("chunks")), "pos")


EVEN = """even AS (SELECT id, CAST(i AS INTEGER) AS idx, num_frames * i // (greatest(beats, 1) * 4) AS pos
  FROM known_loops, unnest(range(0, greatest(beats, 1) * 4 + 1)) t(i))"""


@query("loop_markers", S.with_(KNOWN_LOOPS, EVEN) + "SELECT id, idx, pos FROM even")
def _(spark, sf):
    return C.explode_markers(C.loop_markers(caf(spark, sf)), "id")


@query(
    "check_markers",
    WITH_LOOPS + """SELECT id, unnest([x FOR x IN [
        CASE WHEN id % 13 = 0 THEN 'first marker not at zero' END, CASE WHEN id % 13 IN (0, 1) THEN 'last marker not at end' END,
        CASE WHEN id % 13 = 2 AND num_frames > 0 THEN 'markers go back' END, CASE WHEN id % 11 = 0 THEN 'marker count differs' END] IF x IS NOT NULL]) AS rule FROM known_loops""",
)
def _(spark, sf):
    """Markers of files 0 of 13 are moved by one, the last of files 1 of 13 lies beyond the end, the second of files 2 of 13 before the first."""
    marked = C.loop_markers(caf(spark, sf))
    frames = C.caf_pakt(C.last_payload(F.col("chunks"), "pakt", 24))["num_frames"]
    files = marked.select("id", frames.alias("num_frames"), F.col("markers.declared").alias("declared"))
    i, idx, pos = F.col("id"), F.col("idx"), F.col("pos")
    long = C.explode_markers(marked, "id").join(files.select("id", "num_frames"), "id")
    moved = F.when(i % 13 == 0, pos + 1).when((i % 13 == 1) & (pos == F.col("num_frames")), pos + 5).when(
        (i % 13 == 2) & (idx == 1), F.lit(-1).cast("bigint")).otherwise(pos)
    return Q.check_markers(long.select("id", "idx", moved.alias("pos")), files, "id")


AIFF_CHUNKS = """aiff_chunks AS (SELECT id, ord, type, CAST(20 + 8 * ord + sum(size + size % 2) OVER (PARTITION BY id ORDER BY ord) - size - size % 2
    AS BIGINT) AS off, size FROM (SELECT id, CAST(c.ord AS INTEGER) AS ord, c.type AS type, CAST(c.size AS BIGINT) AS size FROM known_loops, unnest([
      {'ord': 0, 'type': 'NAME', 'size': id % 4 * 2 + 1}, {'ord': 1, 'type': 'COMM', 'size': 18}, {'ord': 2, 'type': 'basc', 'size': 84},
      {'ord': 3, 'type': 'cate', 'size': length(category) + length(subcategory) + length(genre) + 9}, {'ord': 4, 'type': 'SSND', 'size': 16}]) t(c)))"""


@query("aiff_chunks", S.with_(KNOWN_LOOPS, AIFF_CHUNKS) + "SELECT * FROM aiff_chunks")
def _(spark, sf):
    long = C.explode_chunks(aiff(spark, sf), "id")
    return long.withColumns({c: F.col(c).cast("bigint") for c in ("off", "size")})


@query("aiff_comm", WITH_LOOPS + "SELECT id, channels, num_frames, bits AS bits_per_sample, sample_rate FROM known_loops")
def _(spark, sf):
    return aiff(spark, sf).select("id", C.aiff_comm(C.last_payload(F.col("chunks"), "COMM", 18)).alias("c")).select("id", "c.*")


NOTES = "[" + ", ".join(S.quote(n) for n in dims.NOTE_NAMES.split()) + "]"


@query(
    "aiff_basc",
    WITH_LOOPS + f"""SELECT id, CAST(1 AS BIGINT) AS loopable, CAST(beats AS BIGINT) AS beat_count,
      CAST(root AS INTEGER) AS root_note_midi, CAST(id % 6 AS INTEGER) AS scale_type,
      CASE WHEN root = 0 THEN '' ELSE list_extract({NOTES}, ((root - 48) % 12 + 12) % 12 + 1) END AS key_signature,
      CASE WHEN root = 0 THEN 'neither' ELSE coalesce(list_extract(['neither', 'minor', 'major', 'neither', 'both'],
        id % 6 + 1), 'neither') END AS key_type, time_signature
      FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 0 ELSE 36 + id % 40 END AS root FROM known_loops)""",
)
def _(spark, sf):
    return aiff(spark, sf).select("id", C.aiff_basc(C.last_payload(F.col("chunks"), "basc", 16)).alias("b")).select("id", "b.*")


@query("aiff_cate", WITH_LOOPS + "SELECT id, category, subcategory, genre FROM known_loops")
def _(spark, sf):
    return aiff(spark, sf).select("id", C.aiff_cate(C.last_payload(F.col("chunks"), "cate", 4)).alias("c")).select("id", "c.*")


@query("lookup_codec", """SELECT o_orderkey AS id, list_extract(['Linear PCM', 'IMA 4:1 ADPCM', 'AAC', 'Apple Lossless', 'MP3',
  'uLaw 2:1', 'aLaw 2:1', 'opus'], o_orderkey % 8 + 1) AS codec FROM orders""")
def _(spark, sf):
    codes = F.array(*[F.lit(c) for c in ("lpcm", "ima4", "aac", "alac", ".mp3", "ulaw", "alaw", "opus")])
    code = F.element_at(codes, (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), C.lookup_codec(code).alias("codec"))


@query("lookup_scale", """SELECT o_orderkey AS id, coalesce(list_extract(['neither', 'minor', 'major', 'neither', 'both'],
  o_orderkey % 7 + 1), 'neither') AS key_type FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), C.lookup_scale((F.col("o_orderkey") % 7).cast("int")).alias("key_type")
    )


# ---- whole records --------------------------------------------------------------------------------------------------


MIDI_FILES = """
midi_files AS (SELECT id, tpb, notes, tempo_us, sf, mi, ts_num, round_even(60000000.0::DOUBLE / tempo_us, 0)::INTEGER AS tempo,
    notes * gap AS ticks, program, notes * gap * (tempo_us / 1e6) / tpb AS duration,
    CASE WHEN sf BETWEEN -7 AND 7 THEN k.key END AS key_signature, CASE WHEN sf BETWEEN -7 AND 7 THEN k.key_type END AS key_type
  FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 480 ELSE list_extract([96, 384, 480, 960], o_orderkey % 4 + 1) END AS tpb, o_orderkey % 5 + 1 AS notes,
    100 + o_orderkey % 400 AS gap, 300000 + o_orderkey % 700000 AS tempo_us, o_orderkey % 17 - 8 AS sf, o_orderkey % 2 AS mi,
    2 + o_orderkey % 5 AS ts_num, o_orderkey % 128 AS program FROM orders) LEFT JOIN d_key k USING (sf, mi))
"""
RECORDS = """
records AS (
  SELECT l.id, '/loops/' || l.id || CASE l.id % 3 WHEN 0 THEN '.caf' WHEN 1 THEN '.aif' ELSE '.mid' END AS file_path,
    l.id % 3 AS r, l.id % 20 = 7 AS broken,
    CASE WHEN l.id % 3 < 2 THEN l.sample_rate END AS sample_rate, CASE WHEN l.id % 3 < 2 THEN l.num_frames END AS num_frames,
    CASE l.id % 3 WHEN 0 THEN 'AAC' WHEN 1 THEN 'Linear PCM' END AS codec,
    CASE WHEN l.id % 3 < 2 THEN l.num_frames / l.sample_rate ELSE m.duration END AS length,
    CASE WHEN l.id % 3 < 2 THEN l.category ELSE '' END AS category,
    CASE WHEN l.id % 3 < 2 THEN l.subcategory ELSE '' END AS subcategory,
    CASE WHEN l.id % 3 < 2 THEN l.genre ELSE '' END AS genre,
    CASE WHEN l.id % 3 < 2 THEN l.beats ELSE 0 END AS beats,
    CASE WHEN l.id % 3 = 0 THEN l.key_signature WHEN l.id % 3 = 1 AND l.id % 4 > 0
      THEN list_extract(""" + NOTES + """, ((36 + l.id % 40 - 48) % 12 + 12) % 12 + 1) ELSE '' END AS key_signature,
    CASE WHEN l.id % 3 = 0 THEN l.key_type WHEN l.id % 3 = 1 THEN CASE WHEN l.id % 4 = 0 THEN 'neither' ELSE
      coalesce(list_extract(['neither', 'minor', 'major', 'neither', 'both'], l.id % 6 + 1), 'neither') END ELSE '' END AS key_type,
    CASE WHEN l.id % 3 = 0 THEN CAST(greatest(l.beats, 1) * 4 + 1 + CASE WHEN l.id % 11 = 0 THEN 2 ELSE 0 END AS BIGINT) END
      AS marker_count,
    m.key_signature || CASE WHEN m.key_type = 'minor' THEN 'm' ELSE '' END AS midi_key, m.tempo AS midi_tempo, m.notes
  FROM known_loops l JOIN midi_files m USING (id))
"""
WITH_RECORDS = S.with_(KNOWN_LOOPS, S.KEYS, MIDI_FILES, RECORDS)
TEMPO = "CASE WHEN beats > 0 AND length > 0 THEN CAST(printf('%.2f', CAST(beats * 60 AS DOUBLE) / length) AS DOUBLE) " \
        "WHEN r = 2 THEN CAST(midi_tempo AS DOUBLE) END"


@query(
    "decode_files",
    WITH_RECORDS + f"""SELECT file_path, CASE r WHEN 0 THEN 'CAF' WHEN 1 THEN 'AIFF' ELSE 'MIDI' END AS format,
      CASE WHEN r = 2 THEN 'midi' ELSE 'audio' END AS loop_type, sample_rate, num_frames, codec, category, subcategory, genre,
      CAST(beats AS BIGINT) AS beat_count, key_signature, key_type, {TEMPO} AS tempo, marker_count,
      CASE WHEN r = 2 THEN midi_key END AS midi_key, CASE WHEN r = 2 THEN CAST(notes AS BIGINT) END AS notes,
      CASE WHEN r = 2 THEN length END AS midi_duration FROM records WHERE NOT broken""",
)
def _(spark, sf):
    good, _ = sinks.split_errors(decode.decode_files(mixed_files(spark, sf)))
    return good.select(
        "file_path", "format", "loop_type", "audio.sample_rate", "audio.num_frames", "audio.codec", "metadata.category",
        "metadata.subcategory", "metadata.genre", "metadata.beat_count", "metadata.key_signature", "metadata.key_type",
        "metadata.tempo", "beat_markers.marker_count", F.col("midi.key_signature").alias("midi_key"), "midi.notes",
        F.col("midi.duration").alias("midi_duration"),
    )


@query("decode_summary", WITH_RECORDS + "SELECT count(*) AS total_files, count(*) FILTER (NOT broken) AS successful, "
       "count(*) FILTER (broken) AS failed FROM records")
def _(spark, sf):
    return T.decode_summary(decode.decode_chunks(mixed_files(spark, sf)))


@query("partition_results", WITH_RECORDS + "SELECT file_path, broken AS failed FROM records")
def _(spark, sf):
    good, bad = sinks.split_errors(decode.decode_files(mixed_files(spark, sf)))
    return good.select("file_path", F.lit(False).alias("failed")).unionByName(
        bad.select(F.col("file").alias("file_path"), F.lit(True).alias("failed"))
    )


@query(
    "report_decode",
    WITH_RECORDS + f"""SELECT file_path, regexp_extract(file_path, '[^/]*$') AS filename, CASE WHEN r = 2 THEN 'MIDI' ELSE 'Audio' END
      AS type, coalesce(printf('%.0f', {TEMPO}), '-') AS tempo,
      coalesce(nullif(key_signature, ''), CASE WHEN r = 2 THEN midi_key END, '-') AS key,
      coalesce(nullif(key_type, ''), '-') AS scale, CASE WHEN beats > 0 THEN CAST(beats AS VARCHAR) ELSE '-' END AS beats,
      printf('%.2f', length) || 's' AS duration, coalesce(nullif(subcategory, ''), '-') AS category,
      coalesce(nullif(genre, ''), '-') AS genre, coalesce(CAST(marker_count AS VARCHAR), '-') AS markers
      FROM records WHERE NOT broken""",
)
def _(spark, sf):
    return R.report_decode(sinks.split_errors(decode.decode_files(mixed_files(spark, sf)))[0])


@query(
    "report_detail",
    WITH_RECORDS + f"""SELECT file_path, section, label, value FROM (
      SELECT file_path, unnest([
        {{'section': 'LOOP METADATA', 'label': 'Tempo', 'value': printf('%.1f', {TEMPO}) || ' BPM'}},
        {{'section': 'LOOP METADATA', 'label': 'Beat count', 'value': CASE WHEN beats > 0 THEN CAST(beats AS VARCHAR) END}},
        {{'section': 'LOOP METADATA', 'label': 'Key', 'value': CASE WHEN key_signature <> '' THEN key_signature || ' ' || key_type END}},
        {{'section': 'LOOP METADATA', 'label': 'Key type', 'value': CASE WHEN key_signature = '' THEN nullif(key_type, '') END}},
        {{'section': 'LOOP METADATA', 'label': 'Category', 'value': nullif(category, '')}},
        {{'section': 'LOOP METADATA', 'label': 'Subcategory', 'value': nullif(subcategory, '')}},
        {{'section': 'LOOP METADATA', 'label': 'Genre', 'value': nullif(genre, '')}},
        {{'section': 'MIDI INFORMATION', 'label': 'Notes', 'value': CASE WHEN r = 2 THEN CAST(notes AS VARCHAR) END}},
        {{'section': 'MIDI INFORMATION', 'label': 'Key signature', 'value': CASE WHEN r = 2 THEN midi_key END}},
        {{'section': 'MIDI INFORMATION', 'label': 'Duration', 'value': CASE WHEN r = 2 THEN printf('%.3f', length) || 's' END}},
        {{'section': 'BEAT MARKERS', 'label': 'First marker', 'value': CASE WHEN r = 0 THEN '0 samples' END}},
        {{'section': 'BEAT MARKERS', 'label': 'Last marker', 'value': CASE WHEN r = 0 THEN format('{{:,}}', num_frames) || ' samples' END}},
        {{'section': 'SPOTLIGHT METADATA', 'label': 'genre', 'value': CASE WHEN r = 0 THEN 'Other Genre' END}},
        {{'section': 'RAW CHUNKS', 'label': 'desc', 'value': CASE WHEN r = 0 THEN '32 bytes' END}}
        ], recursive := true) FROM records WHERE NOT broken) WHERE value IS NOT NULL""",
)
def _(spark, sf):
    detail = R.report_detail(sinks.split_errors(decode.decode_files(mixed_files(spark, sf)))[0])
    shown = ["Tempo", "Beat count", "Key", "Key type", "Category", "Subcategory", "Genre"]
    wanted = (
        ((F.col("section") == "LOOP METADATA") & F.col("label").isin(shown))
        | ((F.col("section") == "MIDI INFORMATION") & F.col("label").isin("Notes", "Key signature", "Duration"))
        | F.col("label").isin("First marker", "Last marker", "genre", "desc")
    )
    return detail.filter(wanted).select("file_path", "section", "label", "value")


# ---- MIDI -----------------------------------------------------------------------------------------------------------


ALL_EVENTS = """all_events AS (
  SELECT id, -1 AS track, 0 AS ord, 0 AS delta, 'header' AS kind, NULL AS channel, 2 AS a, CASE WHEN id % 10 = 0 THEN 59176 ELSE tpb END AS b FROM midi_files
  UNION ALL SELECT id, 0, 0, 0, 'set_tempo', NULL, tempo_us, 0 FROM midi_files
  UNION ALL SELECT id, 0, 1, 0, 'time_signature', NULL, ts_num, 2 FROM midi_files
  UNION ALL SELECT id, 0, 2, 0, 'key_signature', NULL, sf, mi FROM midi_files
  UNION ALL SELECT id, 0, 3, 0, 'meta', NULL, 47, 0 FROM midi_files
  UNION ALL SELECT id, 1, 0, 0, 'program_change', 3, program, NULL FROM midi_files
  UNION ALL SELECT id, 1, 2 * i + 1, 0, 'note_on', 3, 60, 64 FROM midi_files, unnest(range(notes)) t(i)
  UNION ALL SELECT id, 1, 2 * i + 2, ticks // notes, 'note_on', 3, 60, 0 FROM midi_files, unnest(range(notes)) t(i)
  UNION ALL SELECT id, 1, 2 * notes + 1, 0, 'meta', NULL, 47, 0 FROM midi_files)"""
EVENT_COLUMNS = """SELECT id, CAST(track AS INTEGER) AS track, CAST(ord AS BIGINT) AS ord, CAST(delta AS BIGINT) AS delta, kind, CAST(channel AS INTEGER) AS channel,
  CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM all_events"""


@query("midi_events", S.with_(S.KEYS, MIDI_FILES, ALL_EVENTS) + EVENT_COLUMNS)
def _(spark, sf):
    return midi.midi_events(midi_blob(spark, sf), "id")


@query("midi_events_table", S.with_(S.KEYS, MIDI_FILES, ALL_EVENTS) + EVENT_COLUMNS)
def _(spark, sf):
    """The same rows from SQL, batch by batch."""
    midi.register_midi_events(spark, "bigint")
    return spark.sql("SELECT file AS id, * EXCEPT (file) FROM midi_events(TABLE(SELECT id, content FROM {files}))", files=midi_blob(spark, sf))


@query("midi_events_lateral", S.with_(S.KEYS, MIDI_FILES, ALL_EVENTS) + EVENT_COLUMNS)
def _(spark, sf):
    """The same rows from SQL, file by file."""
    midi.register_midi_events(spark, "bigint")
    return spark.sql("SELECT f.id, e.* FROM {files} f, LATERAL midi_events_of(f.content) e", files=midi_blob(spark, sf))


@query(
    "midi_summary",
    S.with_(S.KEYS, MIDI_FILES) + """SELECT id, CAST(2 AS INTEGER) AS tracks, tpb AS ticks_per_beat, ticks AS total_ticks,
      CAST(notes AS BIGINT) AS notes, '3' AS channels, CAST(program AS VARCHAR) AS programs, tempo_us, ts_num || '/4' AS
      time_signature, key_signature, key_type, tempo, duration,
      CAST(CASE WHEN duration <> 0 THEN round_even(tempo * duration / 60.0, 0) ELSE 0 END AS INTEGER) AS beat_count
      FROM midi_files""",
)
def _(spark, sf):
    got = M.midi_summary(midi.midi_events(midi_blob(spark, sf), "id"), "id", midi_files(spark, sf))
    return got.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("channels", "programs")})


@query(
    "convert_midi_files",
    S.with_(S.KEYS, S.PROGRAMS, MIDI_FILES) + """SELECT id, 'take' AS stem, category, subcategory, tempo,
      CASE WHEN category IN ('Drums', 'Percussion') THEN '' ELSE coalesce(key_signature, '') END AS key_signature,
      CASE WHEN category IN ('Drums', 'Percussion') THEN 'neither' ELSE coalesce(key_type, '') END AS key_type,
      ts_num || '/4' AS time_signature,
      CAST(CASE WHEN duration <> 0 THEN round_even(tempo * duration / 60.0, 0) ELSE 0 END AS INTEGER) AS beat_count,
      'midi' AS loop_type FROM midi_files JOIN d_program p ON program >= p.lo AND program < p.hi""",
)
def _(spark, sf):
    blobs = midi_blob(spark, sf)
    files = Fs.path_parts(blobs.select("id", F.lit("/lib/take.mid").alias("path")), "path", "/lib")
    done = convert.convert_catalog(files, convert.midi_facts(blobs, "id", midi_files(spark, sf)), key="id")
    return done.select(
        "id", "stem", "category", "subcategory", "tempo", "key_signature", "key_type", "time_signature", "beat_count",
        "loop_type",
    )


@query("midi_track_ticks", WITH_MIDI + "SELECT file_id, track, CAST(sum(delta) AS BIGINT) AS ticks FROM midi_like GROUP BY ALL")
def _(spark, sf):
    return M.midi_track_ticks(midi_like(spark, sf))


@query("midi_total_ticks", WITH_MIDI + "SELECT file_id, CAST(max(t) AS BIGINT) AS total_ticks FROM (SELECT file_id, track, "
       "sum(delta) AS t FROM midi_like GROUP BY ALL) GROUP BY file_id")
def _(spark, sf):
    return M.midi_total_ticks(midi_like(spark, sf))


@query("midi_note_count", WITH_MIDI + "SELECT file_id, count(*) FILTER (kind = 'note_on' AND b > 0) AS notes FROM midi_like "
       "GROUP BY file_id")
def _(spark, sf):
    return M.midi_note_count(midi_like(spark, sf))


@query(
    "midi_distinct_sets",
    WITH_MIDI + """SELECT file_id, coalesce(array_to_string(list_sort(list(DISTINCT channel) FILTER (kind = 'note_on' AND b > 0)),
      ','), '') AS channels, coalesce(array_to_string(list_sort(list(DISTINCT a) FILTER (kind = 'program_change')), ','), '')
      AS programs FROM midi_like GROUP BY file_id""",
)
def _(spark, sf):
    got = M.midi_distinct_sets(midi_like(spark, sf))
    return got.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("channels", "programs")})


@query(
    "midi_last_meta",
    WITH_MIDI + """SELECT file_id, arg_max(a, track * 1000000000000 + ord) FILTER (kind = 'set_tempo') AS tempo_us,
      arg_max(a, track * 1000000000000 + ord) FILTER (kind = 'key_signature' AND a BETWEEN -7 AND 7) AS key_sf,
      arg_max(b, track * 1000000000000 + ord) FILTER (kind = 'key_signature' AND a BETWEEN -7 AND 7) AS key_mi
      FROM midi_like GROUP BY file_id""",
)
def _(spark, sf):
    return M.midi_last_meta(midi_like(spark, sf)).select("file_id", "tempo_us", "key_sf", "key_mi")


@query("midi_header", S.with_(S.KEYS, MIDI_FILES) + "SELECT id, CAST(2 AS INTEGER) AS tracks, CAST(tpb AS INTEGER) AS ticks_per_beat FROM midi_files")
def _(spark, sf):
    return M.midi_header(midi.midi_events(midi_blob(spark, sf), "id"), "id")


@query(
    "midi_running_ticks",
    WITH_MIDI + """SELECT file_id, track, ord, delta, CAST(sum(delta) OVER (PARTITION BY file_id, track ORDER BY ord) AS BIGINT)
      AS tick FROM midi_like""",
)
def _(spark, sf):
    return M.midi_running_ticks(midi_like(spark, sf)).select("file_id", "track", "ord", "delta", "tick")


@query(
    "lookup_program",
    S.with_(MIDI_LIKE, S.PROGRAMS) + """SELECT f.file_id, p.category, p.subcategory FROM (
      SELECT file_id, min(a) FILTER (kind = 'program_change') AS lowest FROM midi_like GROUP BY file_id) f
      LEFT JOIN d_program p ON lowest >= p.lo AND lowest < p.hi""",
)
def _(spark, sf):
    found = L.lookup_program(F.col("programs"))
    sets = M.midi_distinct_sets(midi_like(spark, sf)).withColumn("p", found)
    return sets.select("file_id", F.col("p.v1").alias("category"), F.col("p.v2").alias("subcategory"))


@query(
    "lookup_program_table",
    S.with_(MIDI_LIKE, S.PROGRAMS) + """SELECT file_id, arg_min(category, lo) AS category, arg_min(subcategory, lo) AS subcategory
      FROM midi_like JOIN d_program ON a >= lo AND a < hi WHERE kind = 'program_change' GROUP BY file_id""",
)
def _(spark, sf):
    programs = midi_like(spark, sf).filter("kind = 'program_change'").select("file_id", F.col("a").alias("program"))
    return L.lookup_program_table(programs, "file_id", dims.dim_program(spark))


# ---- texts ----------------------------------------------------------------------------------------------------------


@query(
    "afinfo_fields",
    WITH_LOOPS + """SELECT id, sample_rate, channels, CAST(printf('%.3f', num_frames / sample_rate) AS DOUBLE) AS duration,
      'aac , ' || channels || ' ch' AS codec FROM known_loops""",
)
def _(spark, sf):
    from loomtone.functions.numbers import fixed_text

    seconds = fixed_text(F.col("num_frames") / F.col("sample_rate"), 3)
    text = F.concat(
        F.lit("File:           loop.caf\nNum Tracks:     1\nData format:     aac , "), F.col("channels").cast("string"),
        F.lit(" ch\n  Sample rate:  "), fixed_text(F.col("sample_rate"), 1), F.lit(" Hz\n  Channels: "),
        F.col("channels").cast("string"), F.lit("\nestimated duration: "), seconds, F.lit(" sec\naudio bytes: 42\n"),
    )
    return texts.afinfo_fields(known_loops(spark, sf).select("id", text.alias("text")), "id")


@query(
    "report_parse",
    WITH_LOOPS + """SELECT id, CASE WHEN id % 3 > 0 THEN CAST(beats + 60 AS DOUBLE) END AS tempo,
      nullif(key_signature, '') AS key_signature, key_type, category, subcategory, genre FROM known_loops""",
)
def _(spark, sf):
    tempo = F.when(F.col("id") % 3 > 0, (F.col("beats") + 60).cast("string")).otherwise(F.lit("Unknown"))
    key = F.when(F.col("key_signature") == "", F.lit("None")).otherwise(F.col("key_signature"))
    text = F.concat(
        F.lit("File: x.wav\n  Type: Audio\n  Duration: 4.00s\n  Tempo: "), tempo, F.lit(" BPM\n  Key: "), key, F.lit(" "),
        F.col("key_type"), F.lit("\n  Category: "), F.col("category"), F.lit("\n  Subcategory: "), F.col("subcategory"),
        F.lit("\n  Genre: "), F.col("genre"), F.lit("\n  Descriptors: None\n"),
    )
    return texts.report_parse(known_loops(spark, sf).select("id", text.alias("text")), "id")


@query("lookup_key_table", S.with_(MIDI_LIKE, S.KEYS) + """SELECT ord, k.key AS key_signature, k.key_type FROM midi_like
  LEFT JOIN d_key k ON k.sf = a AND k.mi = b WHERE kind = 'key_signature'""")
def _(spark, sf):
    events = midi_like(spark, sf).filter("kind = 'key_signature'")
    keys = F.broadcast(dims.dim_key_signature(spark))
    joined = events.join(keys, (F.col("a") == F.col("sf")) & (F.col("b") == F.col("mi")), "left")
    return joined.select("ord", F.col("key").alias("key_signature"), "key_type")


@query("key_pitch_class", WITH_LOOPS + """SELECT id, CASE WHEN key_signature <> '' THEN CAST((list_extract(
  [9, 11, 0, 2, 4, 5, 7], ascii(key_signature) - 64) + CASE substr(key_signature, 2) WHEN '#' THEN 1 WHEN 'b' THEN 11 ELSE 0 END)
  % 12 AS INTEGER) END AS pitch_class FROM known_loops""")
def _(spark, sf):
    key = F.nullif(F.col("key_signature"), F.lit(""))
    return known_loops(spark, sf).select("id", X.pitch_class(key).alias("pitch_class"))
