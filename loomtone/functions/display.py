"""Column functions for the texts shown in reports. Values are rounded here and nowhere earlier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtone.functions.numbers import fixed_text
from loomtone.functions.text import key_text

MISSING = "-"
MISSING_LONG = "—"


def dash(text: Column) -> Column:
    """The text, or a dash when it is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(MISSING))


def positive_text(n: Column) -> Column:
    """A positive number as text, else a dash."""
    return F.when(n > 0, n.cast("string")).otherwise(F.lit(MISSING))


def seconds_text(seconds: Column) -> Column:
    """``1.23s``, or a dash when missing or zero."""
    return F.when(seconds != 0, F.concat(fixed_text(seconds, 2), F.lit("s"))).otherwise(F.lit(MISSING))


def fmt_duration(seconds: Column) -> Column:
    """``M:SS.mmm``; anything not positive is ``0:00.000``."""
    rest = seconds % 60
    minutes = F.rint((seconds - rest) / 60).cast("bigint")
    text = F.concat(minutes.cast("string"), F.lit(":"), fixed_text(rest, 3, width=2))
    return F.when(seconds > 0, text).otherwise(F.lit("0:00.000"))


def fmt_duration_short(seconds: Column) -> Column:
    """``M:SS.cc``, truncated; ``--:--`` when unknown."""
    whole = seconds.cast("bigint")
    cents = ((seconds % 1) * 100).cast("bigint")
    text = F.concat(
        F.floor(whole / 60).cast("string"),
        F.lit(":"),
        F.lpad((whole % 60).cast("string"), 2, "0"),
        F.lit("."),
        F.lpad(cents.cast("string"), 2, "0"),
    )
    return F.when(seconds.isNull(), F.lit("--:--")).otherwise(text)


def fmt_size(size: Column) -> Column:
    """Bytes as B, KB (one decimal) or MB (two decimals)."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(fixed_text(size / F.lit(1024.0), 1), F.lit(" KB")))
        .otherwise(F.concat(fixed_text(size / F.lit(1048576.0), 2), F.lit(" MB")))
    )


def _auto(flag: Column) -> Column:
    return F.when(flag, F.lit(" (auto)")).otherwise(F.lit(""))


def fmt_tempo(tempo: Column, auto: Column) -> Column:
    """``120.0 BPM``, marked when it was detected rather than set."""
    text = F.concat(fixed_text(tempo.cast("double"), 1), F.lit(" BPM"), _auto(auto))
    return F.when(tempo.isNull(), F.lit(MISSING_LONG)).otherwise(text)


def fmt_key(key: Column, key_type: Column, auto: Column) -> Column:
    """``Am``, marked when it was detected rather than set."""
    return F.coalesce(F.concat(key_text(key, key_type), _auto(auto)), F.lit(MISSING_LONG))


def status_text(state: Column, error: Column) -> Column:
    """Display name of a conversion state."""
    return (
        F.when(state == "pending", F.lit("Pending"))
        .when(state == "queued", F.lit("Queued"))
        .when(state == "converting", F.lit("Converting..."))
        .when(state == "completed", F.lit("Completed"))
        .when(state == "failed", F.concat(F.lit("Failed: "), F.coalesce(error, F.lit(""))))
    )
