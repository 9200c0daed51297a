"""An inverted index of tags: which files have a value, as bitmaps over file numbers.

A posting list is cut into buckets of 32,768 numbers, one small row each, so a genre that most files have is many rows of equal size and no list of files is ever one
value. Lists meet bucket by bucket: unions and intersections are grouped aggregations on the bucket, counts never look at single files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtone.functions.rows import struct_rows, value_rows

#: Numbers of a bucket, a fixed value of the bitmap functions.
BUCKET = 32_768


def tag_postings(files: DataFrame, number: str, tags: Iterable[str]) -> DataFrame:
    """``(tag, value, bucket, bits)``: for each value of each tag column the files that have it.

    ``number``: whole numbers from 1 on, one per file, best without large gaps (:func:`loomtone.operators.blocked.numbered` gives such); rows with other numbers are
    left out. Tags that are arrays list each of their values; a missing value is in no list. Rows of one number count as one file.
    """
    def held(tag: str):
        is_list = files.schema[tag].dataType.typeName() == "array"
        values = F.col(tag).cast("array<string>") if is_list else F.array(F.col(tag).cast("string"))
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(tag).alias("tag"), v.alias("value")))

    wanted = files.where(F.col(number) >= 1).select(F.col(number).cast("bigint").alias("_number"), F.concat(*(held(t) for t in tags)).alias("_tags"))
    long = struct_rows(wanted, ["_number"], F.col("_tags"), "tag").where("value IS NOT NULL")
    place = {"bucket": F.bitmap_bucket_number("_number"), "_bit": F.bitmap_bit_position("_number")}
    return long.withColumns(place).groupBy("tag", "value", "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def matching(postings: DataFrame, *terms: tuple[str, Iterable[str]]) -> DataFrame:
    """``(bucket, bits)`` of the files that have, for each term ``(tag, values)``, at least one of the values."""
    asked = [(k, tag, v) for k, (tag, values) in enumerate(terms) for v in dict.fromkeys(values)]
    wanted = F.broadcast(postings.sparkSession.createDataFrame(asked, "_term int, tag string, value string"))  # the caller's own few values
    lists = postings.join(wanted, ["tag", "value"])
    either = lists.groupBy("bucket", "_term").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = either.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_terms"))
    return both.where((F.col("_terms") == len(terms)) & (F.bitmap_count("bits") > 0)).drop("_terms")


def file_count(bitmaps: DataFrame, *by: str) -> DataFrame:
    """How many files the bitmaps hold, in all or by columns."""
    total = F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("files")
    return bitmaps.groupBy(*by).agg(total) if by else bitmaps.agg(total)


def facet_counts(postings: DataFrame, tag: str, within: DataFrame) -> DataFrame:
    """``(value, files)``: for each value of ``tag`` how many of the files of ``within(bucket, bits)`` have it; values of no such file are left out."""
    lists = postings.where(F.col("tag") == tag).select("value", "bucket", "bits")
    pairs = lists.join(within.withColumnRenamed("bits", "_within"), "bucket")
    met = value_rows(pairs, ["value", "bucket"], F.array("bits", "_within"), "bits").groupBy("value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return file_count(met.where(F.bitmap_count("bits") > 0), "value")


def members(bitmaps: DataFrame, *keep: str, out: str = "number") -> DataFrame:
    """The file numbers in the bitmaps, one row each, beside the columns ``keep``."""
    held = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1)), lambda k: F.struct(
            k.alias("at"), F.conv(F.hex(F.substring("bits", k + 1, F.lit(1))), 16, 10).cast("int").alias("byte"))),
        lambda b: b["byte"] > 0)
    rows = struct_rows(bitmaps, [*keep, "bucket"], held, "at")
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.call_function("shiftright", F.col("byte"), j).bitwiseAND(F.lit(1)) == 1)
    numbered = value_rows(rows, [*keep, "bucket", "at"], bits, "_bit")
    return numbered.select(*keep, ((F.col("bucket") - 1) * BUCKET + F.col("at") * 8 + F.col("_bit") + 1).alias(out))
