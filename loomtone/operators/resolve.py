"""Which value wins: names, MIDI content, per-file overrides, batch edits and run-wide settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.functions import numbers as N
from loomtone.functions import text as X
from loomtone.operators.lookup import folder_and_name, lookup_program, own_descriptors, own_genre, own_instrument, with_key, with_tempo

OVERRIDABLE = [
    "tempo",
    "key_signature",
    "key_type",
    "category",
    "subcategory",
    "genre",
    "descriptors",
    "time_signature",
    "beat_count",
]
AUTO_FLAGS = {"tempo": "auto_tempo", "key_signature": "auto_key", "category": "auto_category", "genre": "auto_genre"}
MIDI_FACTS = (
    "struct<tempo:int,key_signature:string,key_type:string,time_signature:string,duration:double,beat_count:int,"
    "programs:array<int>>"
)


def detect(
    df: DataFrame, stem: str = "stem", path: str = "rel_parent", dictionaries: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Add everything a name can tell: name_tempo, name_key, named (instrument), genre and descriptors.

    Shared texts are made once in an earlier projection, so no keyword test or pattern repeats them. ``dictionaries``: tables
    ``(keyword, position, value1, value2)`` under ``instrument``, ``genre`` or ``descriptor`` in place of the built-in ones.
    """
    own = dictionaries or {}
    shared = df.withColumns(
        {"_name": X.normalize_text(F.col(stem)), "_where": X.normalize_text(folder_and_name(stem, path))}
    )
    keyed = with_key(with_tempo(shared, stem, "name_tempo"), stem, "name_key")
    built_in = {
        "named": ("instrument", X.instrument_of(F.col("_name"))),
        "genre": ("genre", X.genre_of(F.col("_where"))),
        "descriptors": ("descriptor", X.descriptors_of(F.col("_name"))),
    }
    found = keyed.withColumns({out: value for out, (kind, value) in built_in.items() if kind not in own})
    if "instrument" in own:
        found = own_instrument(found, "_name", "named", own["instrument"])
    if "genre" in own:
        found = own_genre(found, "_where", "genre", own["genre"])
    if "descriptor" in own:
        found = own_descriptors(found, "_name", "descriptors", own["descriptor"])
    return found.withColumn("descriptors", F.array_join("descriptors", ",")).drop("_name", "_where")


def resolve_metadata(df: DataFrame, midi: str | None = None, is_midi: Column | None = None) -> DataFrame:
    """Settle the metadata of detected files (see :func:`detect`).

    The tempo in the name beats the MIDI tempo; the MIDI key beats the key in the name; time signature, duration and
    beats come from MIDI. Drums and percussion have no key. ``midi`` names a struct column, null for audio files. ``is_midi``
    tells the type of a file, as its suffix does; without it a file with MIDI facts is MIDI.
    """
    m = F.col(midi) if midi else F.lit(None).cast(MIDI_FACTS)
    by_program = lookup_program(m["programs"])
    category = F.coalesce(F.col("named")["v1"], by_program["v1"], F.lit(dims.DEFAULT_CATEGORY))
    subcategory = F.coalesce(F.col("named")["v2"], by_program["v2"], F.lit(dims.DEFAULT_SUBCATEGORY))
    midi_key = F.nullif(m["key_signature"], F.lit(""))
    unpitched = F.col("category").isin(dims.UNPITCHED_CATEGORIES)
    settled = df.withColumns(
        {
            "category": category,
            "subcategory": subcategory,
            "tempo": F.coalesce(F.col("name_tempo"), m["tempo"]),
            "_key": F.when(
                midi_key.isNotNull(), F.struct(midi_key.alias("key"), m["key_type"].alias("key_type"))
            ).otherwise(F.col("name_key")),
            "time_signature": F.coalesce(m["time_signature"], F.lit(dims.DEFAULT_TIME_SIGNATURE)),
            "duration": m["duration"],
            "beat_count": F.coalesce(m["beat_count"], F.lit(0)),
            "loop_type": F.when(m.isNotNull() if is_midi is None else is_midi, F.lit("midi")).otherwise(F.lit("audio")),
        }
    )
    return settled.withColumns(
        {
            "key_signature": F.when(unpitched, F.lit("")).otherwise(F.col("_key")["key"]),
            "key_type": F.when(unpitched, F.lit("neither")).otherwise(F.col("_key")["key_type"]),
        }
    ).drop("_key", "named", "name_tempo", "name_key")


def settle_beats(df: DataFrame, audio_duration: str | None = None, default: float | None = dims.DEFAULT_DURATION):
    """Set duration (audio length, or the assumed one when unknown) and the beats it implies at the tempo."""
    if audio_duration:
        length = F.coalesce(F.col(audio_duration), F.lit(default)) if default else F.col(audio_duration)
        df = df.withColumn("duration", F.when(F.col("loop_type") == "midi", F.col("duration")).otherwise(length))
    return df.withColumn(
        "beat_count", F.coalesce(N.beat_count(F.col("tempo"), F.col("duration")), F.col("beat_count"), F.lit(0))
    )


def merge_overrides(
    df: DataFrame, overrides: DataFrame, key: str, columns: list[str] | None = None, flags: bool = False, order: str | None = None
) -> DataFrame:
    """Per-file override row, column by column; a null or absent override keeps the detected value.

    A file with several rows takes the last by ``order``, or by the values themselves without it: never more than one row per file.
    With ``flags``, add the booleans telling which values were detected rather than set.
    """
    columns = columns or [c for c in OVERRIDABLE if c in overrides.columns]
    row = F.struct(*[F.col(c).alias(f"_o_{c}") for c in columns])
    renamed = overrides.groupBy(key).agg((F.max_by(row, order) if order else F.max(row)).alias("_o")).select(key, "_o.*")
    joined = df.join(renamed, key, "left")
    if flags:
        auto = {AUTO_FLAGS[c]: F.col(f"_o_{c}").isNull() for c in columns if c in AUTO_FLAGS}
        joined = joined.withColumns(auto)
    return joined.withColumns({c: F.coalesce(F.col(f"_o_{c}"), F.col(c)) for c in columns}).drop(
        *[f"_o_{c}" for c in columns]
    )


@dataclass(frozen=True)
class BatchEdit:
    """One edit for many files. Empty fields change nothing, except the time signature, which is always set."""

    tempo: float | None = None
    key_signature: str | None = None
    key_type: str = "major"
    category: str | None = None
    genre: str | None = None
    subcategory: str = ""
    descriptors: str = ""
    time_signature: str = dims.DEFAULT_TIME_SIGNATURE

    def changes(self) -> dict[str, object]:
        set_if = {c: getattr(self, c) for c in ("tempo", "category", "genre") if getattr(self, c) is not None}
        if self.key_signature is not None:
            set_if |= {"key_signature": self.key_signature, "key_type": self.key_type}
        filled = {c: getattr(self, c) for c in ("subcategory", "descriptors") if getattr(self, c)}
        return {**set_if, **filled, "time_signature": self.time_signature}


def apply_batch(df: DataFrame, selection: DataFrame, key: str, edit: BatchEdit) -> DataFrame:
    """Apply one edit to the selected files and clear the matching auto-detected flags where they exist."""
    marked = df.join(selection.select(key).distinct().withColumn("_selected", F.lit(True)), key, "left")
    chosen = F.coalesce(F.col("_selected"), F.lit(False))
    types = {f.name: f.dataType for f in df.schema}
    out: dict[str, Column] = {}
    for column, value in edit.changes().items():
        out[column] = F.when(chosen, F.lit(value).cast(types[column])).otherwise(F.col(column))
        flag = AUTO_FLAGS.get(column)
        if flag in df.columns:
            out[flag] = F.when(chosen, F.lit(False)).otherwise(F.col(flag))
    return marked.withColumns(out).drop("_selected")


@dataclass(frozen=True)
class RunOverrides:
    """Values set for a whole run; empty ones are ignored. ``key`` is a text such as ``Am`` or ``F# minor``."""

    tempo: int | None = None
    key: str | None = None
    category: str | None = None
    subcategory: str | None = None
    genre: str | None = None
    descriptors: str | None = None
    time_signature: str | None = None
    beat_count: int | None = None


def merge_literal_overrides(df: DataFrame, run: RunOverrides) -> DataFrame:
    """Replace columns by the values of the run; explicit values win over everything detected."""
    names = ("tempo", "category", "subcategory", "genre", "descriptors", "time_signature", "beat_count")
    types = {f.name: f.dataType for f in df.schema}
    out = {c: F.lit(getattr(run, c)).cast(types[c]) for c in names if getattr(run, c)}
    if run.key:
        out["key_signature"], out["key_type"] = X.parse_key_argument(run.key)
    return df.withColumns(out) if out else df
