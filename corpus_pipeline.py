"""A training corpus from raw documents: each stage reads what the one before has written.

Every stage works on all documents that it is given; null, empty, repeated and very long texts are answered as the operators' docstrings say. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtone.llm import decontamination, mixing, privacy, quality, simhash
from loomtone.llm.shared import keep

#: Documents that the quality model scores below this go.
LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; labels of the held-out fold are not learnt from."""
    judged = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, judged, LEAST_QUALITY, "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the least id."""
    return simhash.keep_one(docs, "doc_id", "text")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.drop_contaminated(docs, benchmark, "doc_id", "text", "item_id", "text")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a tag in place of personal data; ``n_chars`` follows the text."""
    clean = docs.withColumn("text", privacy.redact(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their block, slot and place in the mix of sources."""
    return mixing.mix(docs, mixing.damped_weights(docs, "source"), "doc_id", "source")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]

#: Fingerprints, neighbour votes and rewritten texts are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
