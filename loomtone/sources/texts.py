"""Facts kept as text: probe logs of audio files and printed reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtone.functions.text import first_group, parse_report_key

# ---- FIXED VALUES: labels of the probe log and of the text report ---------------------------------------------------
PROBE_LABELS = {
    "sample_rate": "sample rate:",
    "channels": "channels:",
    "duration": "estimated duration:",
    "codec": "data format:",
}
REPORT_LABELS = {
    "tempo": "Tempo",
    "key": "Key",
    "category": "Category",
    "subcategory": "Subcategory",
    "genre": "Genre",
}
REPORT_LINE = r"^\s*([\w ]+): (.*)$"
# ---- END OF FIXED VALUES --------------------------------------------------------------------------------------------


def _labelled(df: DataFrame, text: str, read: Callable[[Column], Column]) -> DataFrame:
    """Add ``_lines``: the structs ``read`` makes of each line of a text. Lines never leave their row."""
    return df.withColumn("_lines", F.transform(F.split(text, "\n"), read))


def _last(label: str, field: str) -> Column:
    """The field of the last line with a label that has one."""
    fit = F.filter("_lines", lambda line: (line["label"] == label) & line[field].isNotNull())
    return F.try_element_at(fit, F.lit(-1))[field]


def afinfo_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sample rate, channels, duration and data format out of collected probe logs, one row per file.

    A line is read as the first label it contains; a later line of the same label wins.
    """

    def read(line: Column) -> Column:
        low = F.lower(line)
        label = F.coalesce(*[F.when(F.contains(low, F.lit(t)), F.lit(n)) for n, t in PROBE_LABELS.items()])
        return F.struct(
            label.alias("label"),
            first_group(line, r"(\d+\.?\d*)").alias("number"),
            first_group(line, r"(\d+)").alias("whole"),
            first_group(line, r"(\d+\.?\d*)\s*sec").alias("seconds"),
            F.trim(F.get(F.split(line, ":"), F.lit(1))).alias("rest"),
        )

    return _labelled(df, text, read).select(
        key,
        _last("sample_rate", "number").cast("double").alias("sample_rate"),
        _last("channels", "whole").try_cast("int").alias("channels"),
        _last("duration", "seconds").cast("double").alias("duration"),
        _last("codec", "rest").alias("codec"),
    )


def report_parse(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``Label: value`` lines of a printed report back as columns, one row per file."""

    def read(line: Column) -> Column:
        return F.struct(
            first_group(line, REPORT_LINE).alias("label"), F.trim(first_group(line, REPORT_LINE, 2)).alias("value")
        )

    got = _labelled(df, text, read).select(key, *[_last(t, "value").alias(n) for n, t in REPORT_LABELS.items()])
    parsed = parse_report_key(F.col("key"))
    return got.select(
        key,
        first_group(F.col("tempo"), r"^(\d+\.?\d*)(?: BPM)?$").cast("double").alias("tempo"),
        parsed["key"].alias("key_signature"),
        parsed["key_type"].alias("key_type"),
        "category",
        "subcategory",
        "genre",
    )
