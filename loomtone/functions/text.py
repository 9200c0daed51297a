"""Column functions that read musical facts out of names: tempo, key, keywords, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtone import dims

# ---- FIXED VALUES: patterns and accepted ranges ---------------------------------------------------------------------
TEMPO_MARKED = [
    r"(\d{2,3})\s*_?bpm",
    r"bpm\s*_?(\d{2,3})",
    r"\[(\d{2,3})\]",
    r"\((\d{2,3})\)",
]
TEMPO_SIGNS = ["bpm", "bpm", "[", "("]
TEMPO_MARKED_RANGE = (40, 300)
TEMPO_BEFORE_KEY = r"_(\d{2,3})_[A-Ga-g][#b]?(?:[_.\s]|m|$)"
TEMPO_BETWEEN = r"_(\d{2,3})_"
TEMPO_AT_END = r"_(\d{2,3})(?:\.[^.]+)?$"
TEMPO_BARE_RANGE = (60, 200)
TEMPO_PREFERRED_RANGE = (90, 150)
KEY_WITH_SCALE = r"\b([A-Ga-g][#b]?)\s*(maj(?:or)?|min(?:or)?)\b"
KEY_WITH_M = r"\b([A-Ga-g][#b]?)m\b"
KEY_ACCIDENTAL = r"\b([A-Ga-g][#b])\b"
KEY_LETTER = r"(?:^|[_\s\-])([A-Ga-g])(?:[_\s\-]|$)"
# ---- END OF FIXED VALUES --------------------------------------------------------------------------------------------


def normalize_text(text: Column) -> Column:
    """Lower case, with underscores and dashes turned into blanks."""
    return F.translate(F.lower(text), "_-", "  ")


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first hit, or null without one (a plain extract gives an empty text, which casts badly)."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def _number(text: Column, pattern: str) -> Column:
    return first_group(text, pattern).cast("int")


def _first(numbers: Column, bounds: tuple[int, int]) -> Column:
    return F.get(F.filter(numbers, lambda n: n.between(*bounds)), F.lit(0))


def _numbers(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: s.cast("int"))


def extract_tempo(text: Column, lowered: Column | None = None) -> Column:
    """Beats per minute stated in a name, or null.

    A marked number (``120bpm``, ``[120]`` ...) counts if the first hit of its pattern is in range; then numbers between
    underscores, one directly before a key first, then one in the usual range, then any; then a number at the end.
    Patterns are tried in turn, each is matched once, and only if the text holds the sign it needs.
    """
    lowered = F.lower(text) if lowered is None else lowered
    marked = [
        F.when(F.contains(lowered, F.lit(sign)), _first(F.array(_number(lowered, p)), TEMPO_MARKED_RANGE))
        for p, sign in zip(TEMPO_MARKED, TEMPO_SIGNS)
    ]
    bare = F.coalesce(
        _first(_numbers(text, TEMPO_BEFORE_KEY), TEMPO_BARE_RANGE),
        _first(_numbers(text, TEMPO_BETWEEN), TEMPO_PREFERRED_RANGE),
        _first(_numbers(text, TEMPO_BETWEEN), TEMPO_BARE_RANGE),
        _first(F.array(_number(text, TEMPO_AT_END)), TEMPO_BARE_RANGE),
    )
    return F.coalesce(*marked, F.when(F.contains(text, F.lit("_")), bare))


def key_clean(text: Column) -> Column:
    """The text keys are looked for in: underscores and dashes as blanks, case kept."""
    return F.translate(text, "_-", "  ")


def _hit(clean: Column, pattern: str, group: int = 1) -> Column:
    return first_group(clean, "(?i)" + pattern, group)


def key_found(clean: Column) -> Column:
    """``struct<key, scale>`` of the first key pattern that hits; the scale only from the pattern that has one."""
    scaled = _hit(clean, KEY_WITH_SCALE)
    other = F.coalesce(*[_hit(clean, p) for p in (KEY_WITH_M, KEY_ACCIDENTAL, KEY_LETTER)])
    return F.struct(
        F.coalesce(scaled, other).alias("key"),
        F.lower(F.substring(_hit(clean, KEY_WITH_SCALE, 2), 1, 3)).alias("scale"),
    )


def key_settled(clean: Column, found: Column) -> Column:
    """``struct<key, key_type>``; both empty when there is none.

    A scale word decides the type; without one the key is minor if ``<key>m`` stands anywhere as a word, else major.
    """
    raw = found["key"]
    key = F.coalesce(F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substring(raw, 2, 1))), F.lit(""))
    key_type = (
        F.when(raw.isNull(), F.lit(""))
        .when(found["scale"] == "min", F.lit("minor"))
        .when(found["scale"] == "maj", F.lit("major"))
        .when(F.regexp_like(clean, F.concat(F.lit("(?i)\\b"), key, F.lit("m\\b"))), F.lit("minor"))
        .otherwise(F.lit("major"))
    )
    return F.struct(key.alias("key"), key_type.alias("key_type"))


def parse_key_argument(text: str) -> tuple[Column, Column]:
    """A key given by hand (``Am``, ``F# minor``): read like a name, else upper-cased with ``m`` meaning minor."""
    clean = key_clean(F.lit(text))
    found = key_settled(clean, key_found(clean))
    by_hand = F.when(F.lit("m" in text.lower()), F.lit("minor")).otherwise(F.lit("major"))
    named = found["key"] != ""
    return (
        F.when(named, found["key"]).otherwise(F.lit(text.upper())),
        F.when(named, found["key_type"]).otherwise(by_hand),
    )


def longest_keyword(text: Column, dictionary: list[tuple[str, ...]]) -> Column:
    """Values of the longest dictionary keyword contained in ``text`` as a struct ``v1, v2 ...``; null if none is.

    One conditional chain in matching order: it stops at the first hit, needs no shuffle and compiles to plain code.
    """
    chain: Column | None = None
    for keyword, *vals in dims.keyword_rank(dictionary):
        value = F.struct(*[F.lit(v).alias(f"v{i + 1}") for i, v in enumerate(vals)])
        test = F.contains(text, F.lit(keyword))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    assert chain is not None, "empty dictionary"
    return chain


def all_keywords(text: Column, dictionary: list[tuple[str, ...]]) -> Column:
    """Sorted distinct first values of every dictionary keyword contained in ``text``.

    Keywords that share a value are tested together, so each value is decided once.
    """
    by_value: dict[str, list[str]] = {}
    for keyword, value, *_ in dictionary:
        by_value.setdefault(value, []).append(keyword)
    hits = []
    for value in sorted(by_value):
        test = F.contains(text, F.lit(by_value[value][0]))
        for keyword in by_value[value][1:]:
            test = test | F.contains(text, F.lit(keyword))
        hits.append(F.when(test, F.lit(value)))
    return F.array_compact(F.array(*hits))


def instrument_of(normal: Column) -> Column:
    """``struct<v1: category, v2: subcategory>`` named in a normalised file stem, or null."""
    return longest_keyword(normal, dims.entries(dims.INSTRUMENTS))


def genre_of(normal: Column) -> Column:
    """Genre named in a normalised folder and stem."""
    return F.coalesce(longest_keyword(normal, dims.entries(dims.GENRE_KEYWORDS))["v1"], F.lit(dims.DEFAULT_GENRE))


def descriptors_of(normal: Column) -> Column:
    """Sorted array of descriptors named in a normalised file stem."""
    return all_keywords(normal, dims.entries(dims.DESCRIPTOR_KEYWORDS))


def key_text(key: Column, key_type: Column) -> Column:
    """``Am``-style spelling of a key; null without a key."""
    return F.concat(F.nullif(key, F.lit("")), F.when(key_type == "minor", F.lit("m")).otherwise(F.lit("")))


def time_sig_text(numerator: Column, denominator_power: Column) -> Column:
    """``n/d`` where the denominator is stored as a power of two."""
    denominator = F.pow(F.lit(2.0), denominator_power).try_cast("decimal(38,0)")
    return F.concat(numerator.cast("string"), F.lit("/"), denominator.cast("string"))


def time_sig_parts(signature: Column) -> Column:
    """``struct<numerator, denominator>`` of an ``n/d`` text."""
    parts = F.split(signature, "/")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("int").alias("numerator"),
        F.get(parts, F.lit(1)).try_cast("int").alias("denominator"),
    )


def pitch_class(key: Column) -> Column:
    """0-11 for a key name, sharps and flats alike, so that enharmonic spellings compare equal."""
    letter = F.instr(F.lit("C D EF G A B"), F.upper(F.substring(key, 1, 1))) - 1
    accidental = F.substring(key, 2, 1)
    shift = F.when(accidental == "#", F.lit(1)).when(accidental == "b", F.lit(-1)).otherwise(F.lit(0))
    return F.when(letter >= 0, F.pmod(letter + shift, F.lit(12))).cast("int")


def pitch_class_name(n: Column) -> Column:
    """Name of MIDI note ``n`` counted from 48 (a C)."""
    names = F.array(*[F.lit(v) for v in dims.NOTE_NAMES.split()])
    return F.get(names, F.pmod(n - 48, F.lit(12)).cast("int"))


def parse_report_key(text: Column) -> Column:
    """``struct<key, key_type>`` of a printed key such as ``F# minor``, ``Am``, ``A`` or ``None``."""
    key = F.nullif(F.regexp_extract(text, r"^([A-G][#b]?)(m?)(?:\s+(\w+))?$", 1), F.lit(""))
    word = F.lower(F.regexp_extract(text, r"^([A-G][#b]?)(m?)(?:\s+(\w+))?$", 3))
    short = F.regexp_extract(text, r"^([A-G][#b]?)(m?)(?:\s+(\w+))?$", 2)
    alone = F.lower(F.regexp_extract(text, r"^None\s+(\w+)$", 1))
    key_type = (
        F.when(word != "", word).when(short == "m", F.lit("minor")).when(key.isNotNull(), F.lit("major"))
        .when(alone != "", alone)
    )
    return F.struct(key.alias("key"), key_type.alias("key_type"))
