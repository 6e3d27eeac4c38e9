"""Graphs as edge tables, sparse matrices as coordinates, vectors as array columns, byte and text totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions.nested import bound


def graph_facts(edges: DataFrame, src: str = "src", dst: str = "dst", directed: bool = False) -> DataFrame:
    """One row: node_count, edge_count (distinct), density. Undirected edges count once in either direction; a null end
    is no edge."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    if not directed:
        e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = e.distinct()
    zero = F.lit(0).cast("long")
    nodes = e.select(F.explode(F.array("a", "b")).alias("n")).distinct().agg(F.count("*").alias("node_count")).withColumn("edge_count", zero)
    total = e.agg(F.count("*").alias("edge_count")).select(zero.alias("node_count"), "edge_count")
    n, m = F.col("node_count"), F.col("edge_count")
    density = F.coalesce(F.try_divide((m if directed else 2 * m).cast("double"), (n * (n - 1)).cast("double")), F.lit(0.0))
    return nodes.union(total).agg(F.max("node_count").alias("node_count"), F.max("edge_count").alias("edge_count")).withColumn("density", density)


def sparse_facts(coords: DataFrame, rows: int, columns: int, value: str = "v") -> DataFrame:
    """One row on a matrix stored as (i, j, v): stored entries, non-zeros, density, and statistics of stored values."""
    v = F.col(value).cast("double")
    stored = F.count(v)
    return coords.agg(
        stored.alias("stored"), F.count_if(v != 0).alias("nnz"), F.try_divide(stored.cast("double"), F.lit(float(rows * columns))).alias("density"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
    )


def vector_facts(df: DataFrame, column: str) -> DataFrame:
    """One row on an array column: rows, shortest and longest, and minimum, maximum and mean of the elements."""
    a = F.col(column)
    x = F.transform(a, lambda e: e.cast("double"))
    sums = F.aggregate(x, F.lit(0.0), lambda s, e: s + F.coalesce(e, F.lit(0.0)))
    return df.agg(
        F.count(a).alias("n_rows"), F.min(F.size(a)).alias("shortest"), F.max(F.size(a)).alias("longest"), F.min(F.array_min(x)).alias("min"), F.max(F.array_max(x)).alias("max"),
        F.try_divide(F.sum(sums), F.sum(F.size(a)).cast("double")).alias("mean"),
    )


def byte_entropy(df: DataFrame, column: str) -> DataFrame:
    """One row: bytes and Shannon entropy over all values of a binary column; 256 counters at most meet."""
    length = F.length(F.col(column))
    codes = bound(F.hex(F.col(column)), lambda hexed: F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2))))
    counts = df.filter(F.length(F.col(column)) > 0).select(F.explode(codes).alias("b")).groupBy("b").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    return counts.join(F.broadcast(total)).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum(-p * F.log2(p)), F.lit(0.0)).alias("entropy"))
