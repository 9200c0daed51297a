"""Building blocks of the comparison SQL: the fixed values as rows, and the rules written out as expressions."""

from __future__ import annotations

from loomtone import dims


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dictionary(name: str, text: str) -> str:
    """A keyword dictionary as a CTE ``name(pos, kw, v1, v2)``."""
    rows = []
    for i, e in enumerate(dims.entries(text)):
        rows.append(f"({i}, {quote(e[0])}, {quote(e[1])}, {quote(e[2]) if len(e) > 2 else 'NULL'})")
    return f"{name}(pos, kw, v1, v2) AS (VALUES {', '.join(rows)})"


INSTRUMENTS = dictionary("d_instrument", dims.INSTRUMENTS)
GENRES = dictionary("d_genre", dims.GENRE_KEYWORDS)
DESCRIPTORS = dictionary("d_descriptor", dims.DESCRIPTOR_KEYWORDS)
PROGRAMS = "d_program(lo, hi, category, subcategory) AS (VALUES " + ", ".join(
    f"({lo}, {hi}, {quote(c)}, {quote(s)})" for lo, hi, c, s in dims.entries(dims.PROGRAM_RANGES)
) + ")"
KEYS = "d_key(sf, mi, key, key_type) AS (VALUES " + ", ".join(
    f"({i - 7}, {mi}, {quote(k)}, {quote(t)})"
    for mi, (names, t) in enumerate(((dims.MAJOR_KEYS, "major"), (dims.MINOR_KEYS, "minor")))
    for i, k in enumerate(names.split())
) + ")"


def normal(expr: str) -> str:
    return f"replace(replace(lower({expr}), '_', ' '), '-', ' ')"


def longest(source: str, key: str, text: str, dictionary_name: str) -> str:
    """Subquery ``(key, v1, v2)`` of the longest keyword contained in ``text``."""
    return (
        f"(SELECT s.{key}, arg_min(d.v1, -length(d.kw) * 10000 + d.pos) AS v1, "
        f"arg_min(d.v2, -length(d.kw) * 10000 + d.pos) AS v2 "
        f"FROM {source} s JOIN {dictionary_name} d ON contains({text}, d.kw) GROUP BY s.{key})"
    )


def tempo(col: str) -> str:
    def marked(pattern: str) -> str:
        n = f"try_cast(nullif(regexp_extract(lower({col}), {quote(pattern)}, 1), '') AS INTEGER)"
        return f"CASE WHEN {n} BETWEEN 40 AND 300 THEN {n} END"

    def first(pattern: str, lo: int, hi: int) -> str:
        return (
            f"list_filter(list_transform(regexp_extract_all({col}, {quote(pattern)}, 1), lambda x: CAST(x AS INTEGER)), "
            f"lambda n: n BETWEEN {lo} AND {hi})[1]"
        )

    end = f"try_cast(nullif(regexp_extract({col}, {quote(r'_(\d{2,3})(?:\.[^.]+)?$')}, 1), '') AS INTEGER)"
    return "coalesce(" + ", ".join(
        [
            marked(r"(\d{2,3})\s*_?bpm"),
            marked(r"bpm\s*_?(\d{2,3})"),
            marked(r"\[(\d{2,3})\]"),
            marked(r"\((\d{2,3})\)"),
            first(r"_(\d{2,3})_[A-Ga-g][#b]?(?:[_.\s]|m|$)", 60, 200),
            first(r"_(\d{2,3})_", 90, 150),
            first(r"_(\d{2,3})_", 60, 200),
            f"CASE WHEN {end} BETWEEN 60 AND 200 THEN {end} END",
        ]
    ) + ")"


def key_columns(source: str, key: str, col: str) -> str:
    """Subquery ``(key, key_signature, key_type)`` of the key stated in a name."""
    clean = f"replace(replace({col}, '_', ' '), '-', ' ')"
    hit = lambda p, g=1: f"nullif(regexp_extract(c, {quote('(?i)' + p)}, {g}), '')"
    p1 = r"\b([A-Ga-g][#b]?)\s*(maj(?:or)?|min(?:or)?)\b"
    return f"""(
      SELECT {key}, coalesce(k, '') AS key_signature,
        CASE WHEN k IS NULL THEN '' WHEN scale = 'min' THEN 'minor' WHEN scale = 'maj' THEN 'major'
          WHEN regexp_matches(c, '(?i)\\b' || k || 'm\\b') THEN 'minor' ELSE 'major' END AS key_type
      FROM (SELECT {key}, c, upper(r[1]) || lower(substr(r, 2)) AS k, lower(substr(scale0, 1, 3)) AS scale FROM (
        SELECT {key}, c, coalesce({hit(p1)}, {hit(r'\b([A-Ga-g][#b]?)m\b')}, {hit(r'\b([A-Ga-g][#b])\b')},
          {hit(r'(?:^|[_\s\-])([A-Ga-g])(?:[_\s\-]|$)')}) AS r, {hit(p1, 2)} AS scale0
        FROM (SELECT {key}, {clean} AS c FROM {source}))))"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
