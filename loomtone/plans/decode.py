"""The decode job: read loop files back into one nested record each.

Files are listed and read by ranges in tasks; everything but MIDI comes from the file's own row without a shuffle. MIDI bytes become event rows, are aggregated, and
only the small summary is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone.functions import binary as B
from loomtone.functions import numbers as N
from loomtone.functions.rows import let
from loomtone.operators.midi_stats import midi_summary
from loomtone.sources import containers as C
from loomtone.sources.files import detect_format
from loomtone.sources.midi import midi_events
from loomtone.sources.ranged import scan_loops
from loomtone.workspace import keep


def _last_wins(pairs: Column, key: str, value: str) -> Column:
    """Map of an array of structs; a repeated key keeps its first place and its last value."""
    held = F.struct(F.reverse(pairs[key]).alias("keys"), F.reverse(pairs[value]).alias("values"), F.array_distinct(pairs[key]).alias("found"))

    def made(h: Column) -> Column:
        last = F.transform(h["found"], lambda k: F.get(h["values"], (F.array_position(h["keys"], k) - 1).cast("int")))
        return F.map_from_arrays(h["found"], last)

    return F.when(pairs.isNotNull(), let(held, made))


def decode_chunks(files: DataFrame) -> DataFrame:
    """Add format, error and the chunk array to ``(path, length, content)`` rows."""
    fmt = files.withColumn("format", detect_format(F.col("content")))
    short = (F.col("format") == "CAF") & (F.length("content") < 8)
    error = F.when(F.col("format").isNull(), F.concat(F.lit("Unknown file format: "), F.col("path"))).when(
        short, F.lit("Invalid CAF file: too short")
    )
    of = lambda kind: F.when(F.col("format") == kind, F.col("content"))
    chunks = F.when(F.col("format") == "CAF", C.caf_chunks(of("CAF"))).when(F.col("format") == "AIFF", C.aiff_chunks(of("AIFF")))
    return fmt.withColumns({"error": error, "chunks": chunks})


def midi_bytes() -> Column:
    """The MIDI data of a file: all of it, or the last midi chunk of a CAF file; null if it has none."""
    return F.when(F.col("format") == "MIDI", F.col("content")).when(
        F.col("format") == "CAF", C.last_payload(F.col("chunks"), "midi", 14)
    )


def _facts(chunked: DataFrame) -> DataFrame:
    """What the chunks of each file say, without the file contents.

    Payloads are cut out in one projection and read in the next, so each is cut out once.
    """
    chunks = F.col("chunks")
    pakt_at = F.try_element_at(
        F.filter(chunks, lambda c: (c["type"] == "pakt") & (F.length(c["payload"]) >= 24)), F.lit(-1)
    )["ord"]
    cut_out = chunked.withColumns(
        {
            "_p_desc": C.last_payload(chunks, "desc", 32),
            "_p_desc_then": C.last_payload(F.filter(chunks, lambda c: c["ord"] < pakt_at), "desc", 32),
            "_p_pakt": C.last_payload(chunks, "pakt", 24),
            "_p_comm": C.last_payload(chunks, "COMM", 18),
            "_p_basc": C.last_payload(chunks, "basc", 16),
            "_p_cate": C.last_payload(chunks, "cate", 4),
            "_tags": C.loop_tags(chunks),
            "_genres": C.genre_pairs(chunks),
            "_spots": C.caf_info_kv(chunks),
            "_bodies": C.marker_bodies(chunks),
            "_sizes": F.transform(chunks, lambda c: F.struct(c["type"].alias("type"), c["size"].alias("size"))),
            "_midi_bytes": midi_bytes(),
        }
    ).drop("content", "chunks")
    return cut_out.select(
        "path",
        "length",
        "format",
        "error",
        "_tags",
        "_midi_bytes",
        F.length("_midi_bytes").alias("_midi_size"),
        C.caf_desc(F.col("_p_desc")).alias("_desc"),
        B.be_double(F.col("_p_desc_then"), 0).alias("_rate_then"),
        C.caf_pakt(F.col("_p_pakt"))["num_frames"].alias("_pakt_frames"),
        C.aiff_comm(F.col("_p_comm")).alias("_comm"),
        C.aiff_basc(F.col("_p_basc")).alias("_basc"),
        C.aiff_cate(F.col("_p_cate")).alias("_cate"),
        C.tag_value(F.col("_genres"), "genre").alias("_genre"),
        C.read_markers(F.col("_bodies")).alias("_marks"),
        F.coalesce(_last_wins(F.col("_spots"), "key", "value"), F.create_map().cast("map<string,string>")).alias(
            "spotlight"
        ),
        F.coalesce(_last_wins(F.col("_sizes"), "type", "size"), F.create_map().cast("map<string,decimal(20,0)>")).alias(
            "raw_chunks"
        ),
    )


def _audio() -> dict[str, Column]:
    caf, comm = F.col("format") == "CAF", F.col("_comm")
    codec = F.when(caf, C.lookup_codec(F.col("_desc")["format_id"])).when(
        comm["num_frames"].isNotNull(), F.lit("Linear PCM")
    )
    return {
        "_rate": F.when(caf, F.col("_desc")["sample_rate"]).otherwise(comm["sample_rate"]),
        "_channels": F.when(caf, F.col("_desc")["channels"]).otherwise(comm["channels"]),
        "_bits": F.when(caf, F.col("_desc")["bits_per_sample"]).otherwise(comm["bits_per_sample"]),
        "_codec": codec,
        "_frames": F.when(caf, F.col("_pakt_frames")).otherwise(comm["num_frames"]),
        "_duration": F.when(caf, N.frames_duration(F.col("_pakt_frames"), F.col("_rate_then"))).otherwise(
            N.frames_duration(comm["num_frames"], comm["sample_rate"])
        ),
    }


def decode_files(files: DataFrame) -> DataFrame:
    """Records of ``(path, length, content)`` rows, see :func:`decode_chunked`; for bytes that are in a table already."""
    return _records(_facts(decode_chunks(files)))


def decode_chunked(chunked: DataFrame) -> DataFrame:
    """One record per file: ``file_path, format, loop_type, error, audio, midi, metadata, beat_markers, spotlight,
    raw_chunks``, from ``(path, length, format, error, chunks, content)`` rows as :func:`scan_loops` gives them.

    A file that cannot be read gives a row with ``error`` set; it never stops the batch. The small facts of the files are kept in the shared
    folder, since the record and its MIDI bytes are needed apart.
    """
    return _records(keep(_facts(chunked), "loop-facts"))


def _records(slim: DataFrame) -> DataFrame:
    with_midi = slim.filter(F.col("_midi_bytes").isNotNull())
    midi = midi_summary(midi_events(with_midi, "path", "_midi_bytes"), "path").withColumnsRenamed(
        {c: f"_m_{c}" for c in ("tracks", "ticks_per_beat", "notes", "tempo_us", "tempo", "duration", "programs",
                                "key_signature", "key_type", "time_signature")}
    )
    joined = slim.drop("_midi_bytes").withColumns(_audio()).join(midi, "path", "left")
    tag = lambda name: C.tag_value(F.col("_tags"), name)
    whole = lambda text: F.when(F.regexp_like(text, F.lit("\\A[0-9]+\\z")), text.try_cast("bigint")).otherwise(
        F.lit(0)
    )
    aiff = F.col("format") == "AIFF"
    either = lambda a, b: F.coalesce(F.when(aiff, a).otherwise(b), F.lit(""))
    beats = F.coalesce(F.when(aiff, F.col("_basc")["beat_count"]).otherwise(whole(tag("beat count"))), F.lit(0))
    spelled = F.concat(F.col("_m_key_signature"), F.when(F.col("_m_key_type") == "minor", "m").otherwise(""))
    present = F.col("_midi_size").isNotNull()
    midi_tempo = F.when(F.col("_m_tempo_us").isNotNull(), F.col("_m_tempo"))
    length = F.when(F.col("_duration") != 0, F.col("_duration")).otherwise(F.col("_m_duration"))
    return joined.select(
        F.col("path").alias("file_path"),
        "format",
        F.when(F.col("error").isNull(), F.when(present, "midi").otherwise("audio")).alias("loop_type"),
        "error",
        F.struct(
            F.col("_rate").alias("sample_rate"),
            F.col("_channels").alias("channels"),
            F.col("_bits").alias("bits_per_sample"),
            F.col("_codec").alias("codec"),
            F.col("_duration").alias("duration"),
            F.col("_frames").alias("num_frames"),
            F.col("length").alias("file_size"),
        ).alias("audio"),
        F.struct(
            present.alias("present"),
            F.col("_midi_size").alias("data_size"),
            F.col("_m_tracks").alias("tracks"),
            F.col("_m_ticks_per_beat").alias("ticks_per_beat"),
            F.col("_m_notes").alias("notes"),
            midi_tempo.alias("tempo"),
            F.col("_m_duration").alias("duration"),
            spelled.alias("key_signature"),
            F.col("_m_time_signature").alias("time_signature"),
            F.col("_m_programs").alias("programs"),
        ).alias("midi"),
        F.struct(
            either(F.col("_cate")["category"], tag("category")).alias("category"),
            either(F.col("_cate")["subcategory"], tag("subcategory")).alias("subcategory"),
            either(F.col("_cate")["genre"], F.col("_genre")).alias("genre"),
            beats.alias("beat_count"),
            either(F.col("_basc")["time_signature"], tag("time signature")).alias("time_signature"),
            either(F.col("_basc")["key_signature"], tag("key signature")).alias("key_signature"),
            either(F.col("_basc")["key_type"], tag("key type")).alias("key_type"),
            F.coalesce(tag("descriptors"), F.lit("")).alias("descriptors"),
            N.tempo_from_beats(beats, length, midi_tempo).alias("tempo"),
            F.col("_basc")["loopable"].alias("loopable"),
            F.col("_basc")["root_note_midi"].alias("root_note_midi"),
            F.col("_basc")["scale_type"].alias("scale_type"),
        ).alias("metadata"),
        F.struct(
            F.col("_marks")["declared"].alias("marker_count"),
            F.col("_marks")["positions"].alias("positions"),
            F.transform(F.col("_marks")["positions"], lambda p: N.marker_seconds(p, F.col("_rate"))).alias(
                "positions_seconds"
            ),
        ).alias("beat_markers"),
        "spotlight",
        "raw_chunks",
    )


def decode_library(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """Decode every loop file below ``root``: headers and decoded chunks are read, audio data is not.

    Every listed file has a record, also empty, hidden and unreadable ones, with the reason in ``error``.
    """
    return decode_chunked(scan_loops(spark, root, recursive))
