"""From raw documents to a packed training set: quality rules, near-duplicates, PII, mixing, packing.

Every stage takes and (but for the last) gives the columns of documents. Null columns, repeated rows, ties, empty tables
and further columns are treated as each stage says. run() returns the packed texts themselves, batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import mixing, neardup, packing, pii, quality
from factlens.llm.store import written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts go, repeated rows are judged alike."""
    return quality.quality_filter(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id (of equal ids, the least text).

    Sets are of five-word shingles, links from a similarity of 0.8. Rows without an id link with nothing and stay.
    """
    return neardup.deduplicated(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by marks and n_chars after that; null texts stay null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most twice; a null source is a source of its own."""
    return mixing.mixed_rows(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place in the training set (bucket, shard, batch, slot) with its text, language and source."""
    return packing.pack(docs, carry=("text", "lang", "source"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_lengths),
]

#: Near-duplicates, PII and packing can't be said in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
