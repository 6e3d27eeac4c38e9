"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it again: the files
survive lost executors, keep column pruning, and are compressed. Only where the setting is absent
(tests, local runs) is a folder of our own chosen.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.session import ship

__all__ = ["bounded_sample", "release", "shared_dir", "ship", "written"]


def bounded_sample(df: DataFrame, k: int, n: int, *keys: str) -> DataFrame:
    """About the k of n rows with the lowest hashes of the keys, and no more than k.

    The hash range is cut first, so that only some k rows meet, however many partitions there are.
    """
    h = F.xxhash64(*keys, F.lit(7))
    share = min(1.0, 1.3 * k / max(n, 1) + 100 / max(n, 1))
    near = df.withColumn("__h", h).filter(F.pmod(F.col("__h"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return near.orderBy(F.pmod(F.col("__h"), F.lit(1_000_000)), "__h", *keys).limit(k).drop("__h")


_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; what reads it does not depend on df's lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete all tables that written() made. Results that still read them must be done by then."""
    for path, spark in list(_WRITTEN.items()):
        if spark.sparkContext._jsc is not None:  # else the session has ended; its owner clears the folder
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _WRITTEN.pop(path, None)


atexit.register(release)
