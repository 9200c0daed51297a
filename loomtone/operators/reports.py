"""Report rows: what the converter and the decoder show, as columns. Sentinels appear here and nowhere earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtone.functions import display as D
from loomtone.functions.binary import ascii_only
from loomtone.functions.numbers import fixed_text
from loomtone.functions.rows import indexed_rows, struct_rows


def report_convert(df: DataFrame, key: str, markers: str = "markers", status: str = "status") -> DataFrame:
    """Eleven display columns per converted file."""
    return _convert_rows(
        df, key, {"markers": D.positive_text(F.col(markers)), "status": F.coalesce(F.col(status), F.lit(""))}
    )


def report_dry_run(df: DataFrame, key: str) -> DataFrame:
    """The preview: the same without markers and status."""
    return _convert_rows(df, key, {})


def _convert_rows(df: DataFrame, key: str, more: dict[str, Column]) -> DataFrame:
    tempo = F.when(F.col("tempo") != 0, F.col("tempo").cast("string")).otherwise(F.lit(D.MISSING))
    return df.select(
        key,
        F.col("file_name").alias("filename"),
        F.when(F.col("loop_type") == "midi", F.lit("MIDI")).otherwise(F.lit("Audio")).alias("type"),
        tempo.alias("tempo"),
        D.dash(F.col("key_signature")).alias("key"),
        D.dash(F.col("key_type")).alias("scale"),
        D.positive_text(F.col("beat_count")).alias("beats"),
        D.seconds_text(F.col("duration")).alias("duration"),
        F.coalesce(F.nullif("subcategory", F.lit("")), D.dash(F.col("category"))).alias("category"),
        D.dash(F.col("genre")).alias("genre"),
        *[c.alias(n) for n, c in more.items()],
    )


def report_decode(df: DataFrame) -> DataFrame:
    """Ten display columns per decoded file; the key falls back to the MIDI key, the duration to the MIDI duration."""
    m, audio, midi = F.col("metadata"), F.col("audio"), F.col("midi")
    length = F.when(audio["duration"] > 0, audio["duration"]).otherwise(midi["duration"])
    return df.select(
        "file_path",
        F.substring_index("file_path", "/", -1).alias("filename"),
        F.when(F.col("loop_type") == "midi", F.lit("MIDI")).otherwise(F.lit("Audio")).alias("type"),
        F.when(m["tempo"] > 0, fixed_text(m["tempo"], 0)).otherwise(F.lit(D.MISSING)).alias("tempo"),
        F.coalesce(F.nullif(m["key_signature"], F.lit("")), D.dash(midi["key_signature"])).alias("key"),
        D.dash(m["key_type"]).alias("scale"),
        D.positive_text(m["beat_count"]).alias("beats"),
        F.when(length > 0, F.concat(fixed_text(length, 2), F.lit("s"))).otherwise(F.lit(D.MISSING)).alias("duration"),
        F.coalesce(F.nullif(m["subcategory"], F.lit("")), D.dash(m["category"])).alias("category"),
        D.dash(m["genre"]).alias("genre"),
        D.positive_text(F.col("beat_markers")["marker_count"]).alias("markers"),
    )


def _grouped(n: Column) -> Column:
    return F.call_function("format_number", n, F.lit(0))


def report_detail(df: DataFrame, show_markers: bool = False) -> DataFrame:
    """One row per line of a detailed report: ``(file_path, section, ord, label, value)``; absent facts give no row."""
    m, audio, midi, marks = F.col("metadata"), F.col("audio"), F.col("midi"), F.col("beat_markers")
    aiff = F.col("format") == "AIFF"
    present = midi["present"]
    text = lambda c: F.nullif(c, F.lit(""))
    over_zero = lambda c, shown: F.when(c > 0, shown)
    kind = F.concat(F.col("format"), F.lit(" ("), F.upper("loop_type"), F.lit(" Loop)"))
    key_line = F.concat_ws(" ", text(m["key_signature"]), m["key_type"])
    lines: list[tuple[str, str, Column]] = [
        ("FORMAT", "Format", kind),
        ("FORMAT", "File size", D.fmt_size(audio["file_size"])),
        ("FORMAT", "Codec", F.coalesce(audio["codec"], F.lit(""))),
        ("FORMAT", "Sample rate", F.concat(fixed_text(F.coalesce(audio["sample_rate"], F.lit(0.0)), 0), F.lit(" Hz"))),
        ("FORMAT", "Channels", F.coalesce(audio["channels"], F.lit(0)).cast("string")),
        ("FORMAT", "Bit depth", over_zero(audio["bits_per_sample"], F.concat(audio["bits_per_sample"].cast("string"), F.lit("-bit")))),
        ("FORMAT", "Duration", D.fmt_duration(F.coalesce(audio["duration"], F.lit(0.0)))),
        ("FORMAT", "Total frames", over_zero(audio["num_frames"], _grouped(audio["num_frames"]))),
        ("LOOP METADATA", "Tempo", over_zero(m["tempo"], F.concat(fixed_text(m["tempo"], 1), F.lit(" BPM")))),
        ("LOOP METADATA", "Beat count", over_zero(m["beat_count"], m["beat_count"].cast("string"))),
        ("LOOP METADATA", "Time signature", text(m["time_signature"])),
        ("LOOP METADATA", "Key", F.when(text(m["key_signature"]).isNotNull(), key_line)),
        ("LOOP METADATA", "Key type", F.when(text(m["key_signature"]).isNull(), text(m["key_type"]))),
        ("LOOP METADATA", "Category", text(m["category"])),
        ("LOOP METADATA", "Subcategory", text(m["subcategory"])),
        ("LOOP METADATA", "Genre", text(m["genre"])),
        ("LOOP METADATA", "Descriptors", text(m["descriptors"])),
        ("MIDI INFORMATION", "Data size", F.when(present, F.concat(_grouped(midi["data_size"]), F.lit(" bytes")))),
        ("MIDI INFORMATION", "Tracks", F.when(present, F.coalesce(midi["tracks"], F.lit(0)).cast("string"))),
        ("MIDI INFORMATION", "Ticks/beat", F.when(present, F.coalesce(midi["ticks_per_beat"], F.lit(0)).cast("string"))),
        ("MIDI INFORMATION", "Notes", F.when(present, F.coalesce(midi["notes"], F.lit(0)).cast("string"))),
        ("MIDI INFORMATION", "Tempo", over_zero(midi["tempo"], F.concat(midi["tempo"].cast("string"), F.lit(" BPM")))),
        ("MIDI INFORMATION", "Duration", over_zero(midi["duration"], F.concat(fixed_text(midi["duration"], 3), F.lit("s")))),
        ("MIDI INFORMATION", "Time signature", text(midi["time_signature"])),
        ("MIDI INFORMATION", "Key signature", text(midi["key_signature"])),
        ("MIDI INFORMATION", "Programs", F.when(F.size(midi["programs"]) > 0, F.array_join(midi["programs"], ", "))),
        ("AIFF LEGACY FIELDS", "Loopable", F.when(aiff, F.coalesce(m["loopable"], F.lit(0)).cast("string"))),
        ("AIFF LEGACY FIELDS", "Root note MIDI", F.when(aiff & (m["root_note_midi"] > 0), m["root_note_midi"].cast("string"))),
        ("AIFF LEGACY FIELDS", "Scale type", F.when(aiff, F.coalesce(m["scale_type"], F.lit(0)).cast("string"))),
        ("BEAT MARKERS", "Markers", over_zero(marks["marker_count"], marks["marker_count"].cast("string"))),
    ]
    first = F.coalesce(F.get(marks["positions"], F.lit(0)), F.lit(0))
    last = F.coalesce(F.try_element_at(marks["positions"], F.lit(-1)), F.lit(0))
    if not show_markers:
        lines += [
            ("BEAT MARKERS", "First marker", over_zero(marks["marker_count"], F.concat(_grouped(first), F.lit(" samples")))),
            ("BEAT MARKERS", "Last marker", over_zero(marks["marker_count"], F.concat(_grouped(last), F.lit(" samples")))),
        ]
    row = lambda section, order, label, value: F.struct(
        section.alias("section"), order.cast("int").alias("ord"), label.alias("label"), value.alias("value")
    )
    fixed = F.filter(
        F.array(*[row(F.lit(s), F.lit(i), F.lit(label), v) for i, (s, label, v) in enumerate(lines)]),
        lambda r: r["value"].isNotNull(),
    )
    spots = F.transform(
        F.map_entries("spotlight"), lambda e, i: row(F.lit("SPOTLIGHT METADATA"), i, e["key"], e["value"])
    )
    chunks = F.transform(
        F.map_entries("raw_chunks"),
        lambda e, i: row(F.lit("RAW CHUNKS"), i, e["key"], F.concat(_grouped(e["value"]), F.lit(" bytes"))),
    )
    parts = [fixed, spots, chunks]
    if show_markers:
        parts.append(
            F.transform(
                F.arrays_zip(marks["positions"].alias("p"), marks["positions_seconds"].alias("s")),
                lambda e, i: row(
                    F.lit("BEAT MARKERS"), i + 1000, F.concat(F.lit("["), i.cast("string"), F.lit("]")),
                    F.concat(F.lit("Sample "), _grouped(e["p"]), F.lit(" ("), fixed_text(e["s"], 6), F.lit("s)")),
                ),
            )
        )
    return struct_rows(df, ["file_path"], F.concat(*parts), "section")


def tag_rows(df: DataFrame, key: str) -> DataFrame:
    """Ordered tag list of each file as long ``(key, pos, tag, value)`` rows; empty values give no row."""
    pairs = [
        ("subcategory", F.col("subcategory")),
        ("category", F.col("category")),
        ("key signature", F.col("key_signature")),
        ("time signature", F.col("time_signature")),
        ("beat count", F.when(F.col("beat_count") > 0, F.col("beat_count").cast("string"))),
        ("descriptors", F.col("descriptors")),
        ("genre", F.col("genre")),
        ("key type", F.col("key_type")),
        ("loop type", F.when(F.col("loop_type") == "midi", F.lit("midi"))),
    ]
    made = F.array(*[F.struct(F.lit(t).alias("tag"), ascii_only(v).alias("value")) for t, v in pairs])
    kept = F.filter(made, lambda p: p["value"] != "")
    return indexed_rows(df, [key], kept, "pos", "pair").select(key, "pos", "pair.tag", "pair.value")
