"""Schemas of records that come as JSON text or maps, and distributions of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.strings import is_json


def json_type(value: Column) -> Column:
    """The type name of a variant: object, array, string, bigint, double, boolean or void."""
    kind = F.schema_of_variant(value)
    return F.regexp_replace(F.lower(kind), r"[<(].*$", "")


def record_schema(df: DataFrame, column: str, least_share: float = 0.8) -> DataFrame:
    """(key, n, n_records, consistent, types) of the top-level keys of JSON objects.

    A key is consistent if at least int(share * records) have it. Texts that aren't objects are no records.
    """
    text = F.col(column).cast("string")
    variant = F.when(is_json(text), F.try_parse_json(text))
    records = df.select(F.when(F.json_object_keys(F.when(variant.isNotNull(), text)).isNotNull(), variant).alias("v"), text.alias("t")).filter("v IS NOT NULL")
    pairs = records.select("v", F.explode(F.json_object_keys("t")).alias("key"))
    typed = pairs.select("key", F.coalesce(json_type(F.try_variant_get(F.col("v"), F.lit("$"), "map<string,variant>")[F.col("key")]), F.lit("void")).alias("type"))
    total = records.agg(F.count("*").alias("n_records"))
    per_type = typed.groupBy("key", "type").agg(F.count("*").alias("c"))
    keys = per_type.groupBy("key").agg(F.sum("c").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
    joined = keys.join(F.broadcast(total))  # one row
    return joined.select("key", "n", "n_records", (F.col("n") >= F.floor(F.lit(least_share) * F.col("n_records"))).alias("consistent"), "types")


def json_key_counts(df: DataFrame, column: str) -> DataFrame:
    """(key, n) of top-level keys."""
    return df.select(F.explode(F.json_object_keys(F.col(column))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def type_distribution(df: DataFrame, column: str) -> DataFrame:
    """(type, n) of the JSON values in a text column; text that doesn't parse counts as invalid."""
    text = F.col(column).cast("string")
    kind = json_type(F.when(is_json(text), F.try_parse_json(text)))
    return df.select(F.coalesce(kind, F.when(F.col(column).isNull(), "void").otherwise("invalid")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def counter_facts(df: DataFrame, column: str) -> DataFrame:
    """One row on the counts of a column's values: unique, total, and least, greatest and mean count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.avg("n").alias("mean")
    )


def map_value_stats(df: DataFrame, column: str) -> DataFrame:
    """(key, n, min, max, mean) of the values of a map<string, number> column."""
    pairs = df.select(F.explode(F.col(column)).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(category, n, share) of the non-null values; of as many categories as there are."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("total")).alias("share"))  # one row is broadcast
