"""A library of patterns that a column may follow; one aggregation tells how many values follow each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions import strings

Detector = Callable[[Column], Column]


class PatternLibrary:
    """Named tests of one value. Registering a name again replaces it."""

    def __init__(self, detectors: dict[str, Detector] | None = None):
        self._detectors = dict(detectors or {})

    def register(self, name: str, detector: Detector) -> None:
        self._detectors[name] = detector

    def names(self) -> list[str]:
        return list(self._detectors)

    def detect_all(self, df: DataFrame, column: str, least: float = 0.0) -> DataFrame:
        """(pattern, matched, confidence), surest first: the share of non-null values that follow each pattern.

        Patterns that no value follows are left out, as are those under `least`; a column without values has none.
        """
        c = F.col(column)
        counts = [F.count_if(F.coalesce(test(c), F.lit(False))).alias(f"__{i}") for i, test in enumerate(self._detectors.values())]
        total = df.agg(F.count(c).alias("__n"), *counts)
        rows = F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"__{i}").alias("matched")) for i, n in enumerate(self._detectors)])
        found = total.select("__n", F.explode(rows).alias("r")).select("r.*", F.try_divide(F.col("r.matched").cast("double"), F.col("__n").cast("double")).alias("confidence"))
        return found.filter((F.col("matched") > 0) & (F.col("confidence") >= least)).orderBy(F.col("confidence").desc(), "pattern")


def _string(regex: str) -> Detector:
    return lambda c: c.cast("string").rlike(regex)


def string_library() -> PatternLibrary:
    return PatternLibrary({label: _string(regex) for label, regex in strings.SHORT_PATTERNS})


def number_library() -> PatternLibrary:
    between = lambda low, high: lambda c: c.between(low, high)
    return PatternLibrary(
        {
            "percent_0_1": between(0, 1), "percent_0_100": between(0, 100), "latitude": between(-90, 90), "longitude": between(-180, 180), "year": between(1900, 2100),
            "timestamp_unix": between(10**9, 10**10 - 1), "timestamp_unix_ms": between(10**12, 10**13 - 1), "zero": lambda c: c == 0, "binary": lambda c: c.isin(0, 1),
            "currency": lambda c: (F.abs(c) < 10**6) & (F.round(c * 100) / 100 == c),
        }
    )


def monotonic(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row: whether a column never falls, and never rises, along an order.

    Neighbours are compared inside ranges of the order; a range hands on only its first and last value.
    """
    rows = df.select(F.col(order).alias("o"), F.col(column).alias("x")).filter("o IS NOT NULL AND x IS NOT NULL")
    sliced = rows.repartitionByRange("o").withColumn("s", F.spark_partition_id())
    before = F.lag("x").over(Window.partitionBy("s").orderBy("o", "x"))
    parts = (
        sliced.withColumn("p", before)
        .groupBy("s")
        .agg(F.min_by("x", F.struct("o", "x")).alias("first"), F.max_by("x", F.struct("o", "x")).alias("last"), F.bool_and(F.coalesce(F.col("x") >= F.col("p"), F.lit(True))).alias("up"), F.bool_and(F.coalesce(F.col("x") <= F.col("p"), F.lit(True))).alias("down"))
    )
    joined = parts.withColumn("p", F.lag("last").over(Window.orderBy("s")))  # a row per range
    return joined.agg(
        F.coalesce(F.bool_and(F.col("up") & F.coalesce(F.col("first") >= F.col("p"), F.lit(True))), F.lit(True)).alias("increasing"),
        F.coalesce(F.bool_and(F.col("down") & F.coalesce(F.col("first") <= F.col("p"), F.lit(True))), F.lit(True)).alias("decreasing"),
    )
