"""Checks that report violations as rows; they never drop or change data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.functions.rows import struct_rows, value_rows
from loomtone.operators.blocked import with_halo
from loomtone.workspace import broadcast_if_small

# ---- FIXED VALUES: what a finished loop must hold -------------------------------------------------------------------
REQUIRED_TAGS = ["category", "subcategory", "genre", "beat count", "time signature", "descriptors"]
REQUIRED_UNLESS_UNPITCHED = ["key signature", "key type"]
REQUIRED_CHUNKS = ["desc", "data", "info", "uuid"]
REQUIRED_CHUNKS_AAC = ["pakt", "kuki"]
LIST_KINDS = ["descriptor"]
# ---- END OF FIXED VALUES --------------------------------------------------------------------------------------------


def vocab_check(df: DataFrame, key: str, columns: dict[str, str], vocab: DataFrame | None = None) -> DataFrame:
    """``(key, kind, value)`` of values outside their controlled list; empty and null values are not judged.

    ``columns`` maps a vocabulary kind to the column holding it; lists (``LIST_KINDS``) are judged value by value. Without a table of
    one's own the built-in lists are compiled into the filter.
    """
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in columns.items()])
    parts = struct_rows(df, [key], values, "kind")
    single = F.when(F.col("text").isNotNull(), F.array("text"))
    long = value_rows(parts, [key, "kind"], F.when(F.col("kind").isin(LIST_KINDS), F.split("text", ",")).otherwise(single), "value")
    long = long.withColumn("value", F.trim("value")).filter("value <> ''")
    if vocab is not None:
        return long.join(broadcast_if_small(vocab.select("kind", "value").distinct()), ["kind", "value"], "left_anti").select(
            key, "kind", "value"
        )
    known = F.lit(False)
    for kind in columns:
        known = known | ((F.col("kind") == kind) & F.col("value").isin(dims.values(dims.VOCABULARIES[kind])))
    return long.filter(~known)


def vocab_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace values outside their controlled list by null."""
    return df.withColumns(
        {c: F.when(F.col(c).isin(dims.values(dims.VOCABULARIES[k])), F.col(c)) for k, c in columns.items()}
    )


def _with_listed(facts: DataFrame, key: str, listed: DataFrame | None) -> DataFrame:
    return facts if listed is None else listed.select(key).distinct().join(facts, key, "left")


def check_required_tags(tags: DataFrame, key: str, listed: DataFrame | None = None) -> DataFrame:
    """``(key, rule)`` of missing tags, from long ``(key, tag, value)`` rows; keys are optional without pitch.

    Files of ``listed(key)`` without any tag miss all of them; without that list such files are not seen.
    """
    has = lambda t: F.max(((F.col("tag") == t) & (F.col("value") != "")).cast("int")).alias(f"_{t}")
    wanted = REQUIRED_TAGS + REQUIRED_UNLESS_UNPITCHED
    category = F.max(F.when(F.col("tag") == "category", F.col("value"))).alias("_cat")
    files = _with_listed(tags.groupBy(key).agg(*[has(t) for t in wanted], category), key, listed)
    unpitched = F.coalesce(F.col("_cat").isin(dims.UNPITCHED_CATEGORIES), F.lit(False))
    rules = []
    for t in wanted:
        missing = F.coalesce(F.col(f"_{t}"), F.lit(0)) == 0
        if t in REQUIRED_UNLESS_UNPITCHED:
            missing = missing & ~unpitched
        rules.append(F.when(missing, F.lit(f"missing {t}")))
    return value_rows(files, [key], F.array_compact(F.array(*rules)), "rule")


def check_required_chunks(
    chunks: DataFrame, key: str, codec: DataFrame | None = None, listed: DataFrame | None = None
) -> DataFrame:
    """``(key, rule)`` of missing chunks, from long ``(key, type)`` rows; ``codec``: ``(key, format_id)`` per file.

    Files of ``listed(key)`` without any chunk miss all of them; without that list such files are not seen.
    """
    wanted = REQUIRED_CHUNKS + REQUIRED_CHUNKS_AAC
    files = chunks.groupBy(key).agg(
        *[F.max((F.col("type") == t).cast("int")).alias(f"_{t}") for t in wanted]
    )
    files = _with_listed(files, key, listed)
    if codec is not None:
        files = files.join(codec.select(key, (F.col("format_id") == "aac").alias("_is_aac")), key, "left")
    aac = F.coalesce(F.col("_is_aac"), F.lit(False)) if codec is not None else F.lit(False)
    rules = [F.when(F.coalesce(F.col(f"_{t}"), F.lit(0)) == 0, F.lit(f"missing {t}")) for t in REQUIRED_CHUNKS]
    rules += [F.when((F.coalesce(F.col(f"_{t}"), F.lit(0)) == 0) & aac, F.lit(f"missing {t}")) for t in REQUIRED_CHUNKS_AAC]
    return value_rows(files, [key], F.array_compact(F.array(*rules)), "rule")


def check_markers(markers: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``(key, rule)``: first marker at zero, last at the frame count, never going back, as many as declared.

    ``files``: ``(key, num_frames, declared)``; a null ``declared`` is not judged.
    """
    blocks = with_halo(markers.select(key, "idx", "pos"), "idx", 1, 0)
    w = Window.partitionBy(key, "_block").orderBy("idx")
    back = (F.col("pos") < F.lag("pos").over(w)) & ~F.col("_halo")
    facts = (
        blocks.withColumn("_back", back)
        .filter("NOT _halo")
        .groupBy(key)
        .agg(
            F.count("*").alias("_n"),
            F.min_by("pos", "idx").alias("_first"),
            F.max_by("pos", "idx").alias("_last"),
            F.count_if("_back").alias("_backs"),
        )
    )
    joined = files.select(key, "num_frames", "declared").join(facts, key, "left")
    count = F.coalesce(F.col("_n"), F.lit(0))
    rules = F.array(
        F.when(F.col("_first") != 0, F.lit("first marker not at zero")),
        F.when(F.col("_last") != F.col("num_frames"), F.lit("last marker not at end")),
        F.when(F.col("_backs") > 0, F.lit("markers go back")),
        F.when(F.col("declared") != count, F.lit("marker count differs")),
    )
    return value_rows(joined, [key], F.array_compact(rules), "rule")
