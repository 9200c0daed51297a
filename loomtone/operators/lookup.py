"""Dictionary lookups. Built-in dictionaries compile into the plan; dictionaries brought as tables are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtone import dims
from loomtone.functions import text as X
from loomtone.functions.automaton import find_keywords
from loomtone.operators.blocked import numbered
from loomtone.workspace import broadcast_if_small


def folder_and_name(stem: str, path: str) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(path), F.lit("")), F.col(stem))


def lookup_instrument(
    df: DataFrame, stem: str = "stem", programs: Column | None = None, dictionary: DataFrame | None = None
) -> DataFrame:
    """Add category and subcategory: named in the stem, else implied by MIDI programs, else the defaults.

    The text is normalised in a projection of its own: keyword tests then share one copy instead of redoing it. ``dictionary``:
    ``(keyword, position, value1, value2)`` in place of the built-in one.
    """
    df = df.withColumn("_normal", X.normalize_text(F.col(stem)))
    if dictionary is None:
        df = df.withColumn("_named", X.instrument_of(F.col("_normal")))
    else:
        df = own_instrument(df, "_normal", "_named", dictionary)
    by_program = lookup_program(programs) if programs is not None else F.lit(None).cast("struct<v1:string,v2:string>")
    return df.withColumns(
        {
            "category": F.coalesce(F.col("_named")["v1"], by_program["v1"], F.lit(dims.DEFAULT_CATEGORY)),
            "subcategory": F.coalesce(F.col("_named")["v2"], by_program["v2"], F.lit(dims.DEFAULT_SUBCATEGORY)),
        }
    ).drop("_named", "_normal")


def own_instrument(df: DataFrame, text: str, out: str, dictionary: DataFrame) -> DataFrame:
    """Add ``struct<v1: category, v2: subcategory>`` of a dictionary table's longest keyword, null where none is named."""
    pairs = F.struct(F.col("value1").alias("v1"), F.col("value2").alias("v2")).alias(out)
    return dictionary_longest(df, text, dictionary.select("keyword", "position", pairs), [out])


def own_genre(df: DataFrame, text: str, out: str, dictionary: DataFrame) -> DataFrame:
    """Add the value of a dictionary table's longest keyword, or the default genre."""
    named = dictionary_longest(df, text, dictionary.select("keyword", "position", F.col("value1").alias(out)), [out])
    return named.withColumn(out, F.coalesce(out, F.lit(dims.DEFAULT_GENRE)))


def own_descriptors(df: DataFrame, text: str, out: str, dictionary: DataFrame) -> DataFrame:
    """Add the sorted distinct values of all keywords of a dictionary table; an empty array where none is named."""
    kept = df.drop(out).withColumn("_mark", F.md5(text))
    found = dictionary_all(kept, "_mark", text, dictionary.select("keyword", F.col("value1").alias("_value")), "_value")
    lists = found.groupBy("_mark").agg(F.sort_array(F.collect_set("_value")).alias(out))
    empty = F.array().cast("array<string>")
    return kept.join(lists, "_mark", "left").withColumn(out, F.coalesce(out, empty)).drop("_mark")


def lookup_genre(
    df: DataFrame, stem: str = "stem", path: str = "rel_parent", dictionary: DataFrame | None = None
) -> DataFrame:
    """Add the genre named in folder or stem. ``dictionary``: ``(keyword, position, value1)`` in place of the built-in one."""
    normal = df.withColumn("_normal", X.normalize_text(folder_and_name(stem, path)))
    if dictionary is not None:
        return own_genre(normal, "_normal", "genre", dictionary).drop("_normal")
    return normal.withColumn("genre", X.genre_of(F.col("_normal"))).drop("_normal")


def lookup_descriptors(df: DataFrame, stem: str = "stem", dictionary: DataFrame | None = None) -> DataFrame:
    """Add the sorted array of descriptors named in the stem. ``dictionary``: ``(keyword, value1)`` in place of the built-in one."""
    normal = df.withColumn("_normal", X.normalize_text(F.col(stem)))
    if dictionary is not None:
        return own_descriptors(normal, "_normal", "descriptors", dictionary).drop("_normal")
    return normal.withColumn("descriptors", X.descriptors_of(F.col("_normal"))).drop("_normal")


def with_tempo(df: DataFrame, text: str = "stem", out: str = "tempo") -> DataFrame:
    """Add the tempo stated in a name."""
    low = df.withColumn("_low", F.lower(text))
    return low.withColumn(out, X.extract_tempo(F.col(text), F.col("_low"))).drop("_low")


def with_key(df: DataFrame, text: str = "stem", out: str = "key") -> DataFrame:
    """Add the key stated in a name as ``struct<key, key_type>``."""
    clean = df.withColumn("_clean", X.key_clean(F.col(text)))
    found = clean.withColumn("_found", X.key_found(F.col("_clean")))
    return found.withColumn(out, X.key_settled(F.col("_clean"), F.col("_found"))).drop("_clean", "_found")


def lookup_program(programs: Column) -> Column:
    """``struct<v1: category, v2: subcategory>`` of the lowest range that holds any of the programs, or null."""
    lowest = F.array_min(programs)
    chain: Column | None = None
    for _, hi, category, subcategory in dims.entries(dims.PROGRAM_RANGES):
        value = F.struct(F.lit(category).alias("v1"), F.lit(subcategory).alias("v2"))
        test = lowest < int(hi)
        chain = F.when((lowest >= 0) & test, value) if chain is None else chain.when((lowest >= 0) & test, value)
    return chain


def range_lookup(df: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """Join rows to the ranges ``lo <= value < hi`` of a table of whole numbers, as an equi-join on buckets.

    A range belongs to the level whose buckets are at least as wide as it is, so it touches two buckets at most, however wide it is; a row
    looks into one bucket of each level that the table has.
    """
    size = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).cast("bigint")
    level = F.ceil(F.log2(size.cast("double"))).cast("int")
    bucket = lambda n: F.call_function("shiftright", n.cast("bigint"), F.col("_level"))
    leveled = ranges.where("lo < hi").withColumn("_level", level)
    bucketed = leveled.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("lo")), bucket(F.col("hi") - 1)))))
    levels = [r[0] for r in leveled.select("_level").distinct().orderBy("_level").collect()]
    rows = df.withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("_bucket", bucket(F.floor(F.col(value))))
    joined = rows.join(broadcast_if_small(bucketed), ["_level", "_bucket"])
    return joined.filter((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))).drop("_level", "_bucket")


def lookup_program_table(programs: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Category per ``key`` from long ``(key, program)`` rows and a table of ranges; the lowest range wins."""
    hit = range_lookup(programs, "program", ranges)
    return hit.groupBy(key).agg(
        F.min_by("category", "lo").alias("category"), F.min_by("subcategory", "lo").alias("subcategory")
    )


def lookup_key_signature(sharps: Column, minor: Column) -> Column:
    """``struct<key, key_type>`` of a signature (sharps from -7 to 7, 0 major or 1 minor); null for any other pair."""
    names = {0: (dims.MAJOR_KEYS, "major"), 1: (dims.MINOR_KEYS, "minor")}
    chain: Column | None = None
    for flag, (keys, key_type) in names.items():
        found = F.get(F.array(*[F.lit(k) for k in keys.split()]), (sharps + 7).cast("int"))
        value = F.struct(found.alias("key"), F.lit(key_type).alias("key_type"))
        test = (minor == flag) & sharps.between(-7, 7)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def rank_keywords(dictionary: DataFrame, out: str = "rank") -> DataFrame:
    """Add the place of each keyword in matching order: longest first, ties by ``position``."""
    ordered = dictionary.withColumn("_order", F.struct(-F.length("keyword"), F.col("position"), F.col("keyword")))
    return numbered(ordered, "_order", out, "_total").drop("_order", "_total")


def _spread(texts: DataFrame, spread: bool) -> DataFrame:
    """Texts dealt evenly over the tasks, repeated ones too."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if spread else texts


def dictionary_longest(
    texts: DataFrame, text: str, dictionary: DataFrame, values: list[str], spread: bool = True
) -> DataFrame:
    """Add the values of the longest keyword of a dictionary table contained in ``text``; null where none is, and for a null text.

    ``dictionary``: ``keyword``, ``position`` (breaks ties between equal lengths) and the value columns; null and empty keywords match
    nothing. Columns of ``texts`` that are called like a value are replaced. The way is the same for dictionaries of any size: each shard's automaton
    tells one keyword per text, and the best of these is joined back. ``spread`` deals texts over the tasks; switch it off for texts that already
    come in many even partitions.
    """
    kept = texts.drop(*values)
    order = F.struct(-F.length("keyword"), F.col("position"), F.col("keyword"))
    marked = _spread(texts.select(F.col(text).alias("_text"), F.md5(text).alias("_mark")), spread)
    best = find_keywords(marked, ["_mark"], "_text", dictionary.select("keyword", "position", F.struct(*values).alias("_values")), best=True)
    best = best.groupBy("_mark").agg(F.min_by("_values", order).alias("_values"))
    return kept.withColumn("_mark", F.md5(text)).join(best, "_mark", "left").select(
        *kept.columns, *[F.col("_values")[v].alias(v) for v in values])


def dictionary_all(texts: DataFrame, key: str, text: str, dictionary: DataFrame, value: str, spread: bool = True) -> DataFrame:
    """Long ``(key, value)``: every distinct value whose keyword is contained in a text of that key; null and empty keywords match nothing."""
    marked = _spread(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")), spread)
    hit = find_keywords(marked, ["_key"], "_text", dictionary.select("keyword", F.col(value).alias("_value")))
    return hit.select(F.col("_key").alias(key), F.col("_value").alias(value)).distinct()
