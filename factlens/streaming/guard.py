"""Streams: described by schema and plan without starting them; profiled batch by batch on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factlens.operators.profile import null_counts, numeric_stats


def describe_stream(df: DataFrame) -> dict:
    """Facts of a stream that need no data."""
    if not df.isStreaming:
        raise ValueError("not a stream")
    return {
        "object_type": "spark.StreamingDataFrame",
        "columns": df.columns,
        "dtypes": dict(df.dtypes),
        "streaming": True,
        "plan": df._jdf.queryExecution().logical().toString()[:2000],
        "nl_summary": f"A streaming Spark DataFrame with {len(df.columns)} columns; not started.",
    }


def profile_stream(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that appends, for each micro-batch, nulls and numeric statistics of every column to Parquet."""

    def one(batch: DataFrame, batch_id: int) -> None:
        facts = null_counts(batch).join(numeric_stats(batch), "column", "left").withColumn("batch_id", F.lit(batch_id).cast("long"))
        facts.coalesce(1).write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(df: DataFrame, time: str, key: str, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Counts by key and tumbling window; on streams rows later than `lateness` are left out."""
    marked = df.withWatermark(time, lateness) if df.isStreaming else df
    return marked.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
