"""Facts of whole tables: numeric statistics, cardinality, nulls, top values. Every operator is DataFrame -> DataFrame,
exact over all rows.

Numeric facts of all columns come from one aggregation. Cardinality unpivots to (column, value) and counts values once:
one shuffle on well-spread keys serves distinct counts, classes and top values of all columns. Order statistics narrow
down the ranges of values that hold the wanted places, never a list of a column's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Integers, floats and decimals; booleans, dates and times are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _as_double(c: Column) -> tuple[Column, Column, Column, Column]:
    x = c.cast("double")
    nan, inf = F.isnan(x), F.abs(x) == float("inf")
    return x, nan, inf, F.when(~nan & ~inf, x)


def _rows(df: DataFrame, names: list[str], facts: dict[str, list[Column]], keys: list[str]) -> DataFrame:
    """One aggregation with facts of every column, turned into a row per column."""
    total = df.agg(*[f.alias(f"__{i}_{k}") for i, n in enumerate(names) for k, f in zip(keys, facts[n], strict=True)])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"__{i}_{k}").alias(k) for k in keys]) for i, n in enumerate(names)])
    return total.select(F.explode(rows).alias("r")).select("r.*")


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per numeric column: total (non-null), n_zeros, n_nan, n_inf, min, max, mean, std (sample, null for one value).

    NaN and infinities are counted and left out. A column without a finite value has null statistics; an empty table
    totals of 0.
    """
    names = columns or numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, total long, n_zeros long, n_nan long, n_inf long, min double, max double, mean double, std double")
    facts = {}
    for n in names:
        x, nan, inf, ok = _as_double(quoted(n))
        facts[n] = [F.count(x), F.count_if(ok == 0), F.count_if(nan), F.count_if(inf), F.min(ok), F.max(ok), F.avg(ok), F.stddev_samp(ok)]
    return _rows(df, names, facts, ["total", "n_zeros", "n_nan", "n_inf", "min", "max", "mean", "std"])


def unpivoted(df: DataFrame, columns: list[str], as_type: str) -> DataFrame:
    """(column, value) rows; one projection and one generator, no shuffle."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), _text(quoted(n), df.schema[n].dataType, as_type).alias("value")) for n in columns])).alias("r")).select("r.*")


def _text(c: Column, kind: T.DataType, as_type: str) -> Column:
    if as_type == "string" and isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if as_type == "string" and isinstance(kind, T.BinaryType):
        return F.hex(c)
    return c.cast(as_type)


def _slice_of(value: Column, low: Column, high: Column, parts: int) -> Column:
    """Which of `parts` equal slices of [low, high] a value lies in. Ends may be far apart, so halves are subtracted."""
    width = high / 2 - low / 2
    share = F.try_divide(value / 2 - low / 2, width)
    return F.when(width > 0, F.least(F.floor(share * parts), F.lit(parts - 1))).otherwise(F.lit(0)).cast("int")


def order_stats(df: DataFrame, columns: list[str] | None = None, parts: int = 512, few: int = 1_000_000, rounds: int = 40) -> DataFrame:
    """A row per numeric column: n (finite), median (mean of the middle two), and q1, q3: the values at the 0-based
    places n // 4 and 3n // 4, for n >= 4.

    Nothing is sorted as a whole. Each wanted place has a range of values that holds it, at first the column's. A round
    counts the rows in `parts` equal slices of every such range, in one aggregation over the table, and the slice with the
    place becomes the range; this ends when all ranges hold at most `few` rows in total or a single value. Then the rows of
    these ranges alone are counted by value and looked up. So no task sees more than a slice, and a table that is small
    from the start is read once more only.
    """
    names = columns or numeric_columns(df)
    empty = "column string, n long, q1 double, median double, q3 double"
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], empty)
    values = {n: _as_double(quoted(n))[3] for n in names}
    long = unpivoted(df, names, "double").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    ends = df.agg(*[f(v).alias(f"{k}{i}") for i, v in enumerate(values.values()) for k, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    # (column, place) -> rows before the range, rows in it, its ends; four to a column
    open_ = {}
    for i, name in enumerate(names):
        n = ends[f"n{i}"]
        for place, at in (("q1", n // 4), ("m1", (n - 1) // 2), ("m2", n // 2), ("q3", 3 * n // 4)):
            if n:
                open_[name, place] = (at, n, ends[f"low{i}"], ends[f"high{i}"])
    if not open_:
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        ranges = sorted({(name, low, high) for (name, _), (_, n, low, high) in open_.items() if low < high and n > few // (4 * len(names))})
        if not ranges:
            break
        index = {r: j for j, r in enumerate(ranges)}
        found = _sliced(long, ranges, parts).groupBy("i", "s").agg(F.count("*").alias("c"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
        slices: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["i"], r["s"])):  # parts rows for each range, four ranges a column at most
            slices.setdefault(r["i"], []).append(r)
        for key, (at, n, low, high) in list(open_.items()):
            if (key[0], low, high) not in index:
                continue
            for r in slices[index[key[0], low, high]]:
                if at < r["c"]:
                    open_[key] = (at, r["c"], r["low"], r["high"])
                    break
                at -= r["c"]
    ranges = sorted({(name, low, high) for (name, _), (_, _, low, high) in open_.items()})
    index = {r: j for j, r in enumerate(ranges)}
    counts = _sliced(long, ranges, 1).groupBy("i", "value").agg(F.count("*").alias("c"))
    asked = [(index[name, low, high], name, place, at, ends[f"n{names.index(name)}"]) for (name, place), (at, _, low, high) in open_.items()]
    asked = spark.createDataFrame(asked, "i int, column string, place string, at long, n long")
    inside = Window.partitionBy("i").orderBy("value")
    reached = counts.withColumn("upto", F.sum("c").over(inside))  # few rows, or one value, to a range
    hits = reached.join(F.broadcast(asked), "i").filter("at < upto AND at >= upto - c").groupBy("column", "n")
    hits = hits.agg(*[F.max(F.when(F.col("place") == k, F.col("value"))).alias(k) for k in ("q1", "m1", "m2", "q3")])
    four = lambda c: F.when(F.col("n") >= 4, F.col(c))
    return hits.select("column", "n", four("q1").alias("q1"), ((F.col("m1") + F.col("m2")) / 2).alias("median"), four("q3").alias("q3"))


def _sliced(long: DataFrame, ranges: list[tuple[str, float, float]], parts: int) -> DataFrame:
    """(i, s, value) of the values inside the i-th range of their column and the slice s they lie in."""
    rows = [(i, name, float(low), float(high)) for i, (name, low, high) in enumerate(ranges)]
    at = long.sparkSession.createDataFrame(rows, "i int, c string, low double, high double")  # four to a column at most
    inside = long.join(F.broadcast(at), (F.col("column") == F.col("c")) & F.col("value").between(F.col("low"), F.col("high")))
    return inside.select("i", _slice_of(F.col("value"), F.col("low"), F.col("high"), parts).alias("s"), "value")


def null_counts(df: DataFrame) -> DataFrame:
    """A row per column: n_rows, null_count (NULL), nan_count, missing (both)."""
    names, facts = df.columns, {}
    for f in df.schema.fields:
        c = quoted(f.name)
        nan = F.count_if(F.isnan(c)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.sum(F.lit(0))
        nan = F.coalesce(nan.cast("long"), F.lit(0).cast("long"))
        facts[f.name] = [F.count(F.lit(1)), F.count_if(c.isNull()), nan, F.count_if(c.isNull()) + nan]
    return _rows(df, names, facts, ["n_rows", "null_count", "nan_count", "missing"])


def table_facts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing values in all columns, and the planner's estimate of the size in bytes."""
    missing = sum((F.count_if(_missing(f)) for f in df.schema.fields), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), missing.alias("missing"))


def _missing(f: T.StructField) -> Column:
    c = quoted(f.name)
    return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; the nearest thing to memory use that a plan has."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value as text, n) of the non-null values."""
    return unpivoted(df, columns or df.columns, "string").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_facts(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, unique_count, total_count, top: array of rank, value, n) of columns with values, from one value count.

    In each of 64 hash groups the values are counted and cut to the k most common; only these meet.
    """
    counts = value_counts(df, columns).withColumn("g", F.pmod(F.xxhash64("value"), F.lit(64)))
    order = [F.col("n").desc(), F.col("value")]
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("column", "g").orderBy(*order)))
    held = F.when(F.col("r") <= k, F.struct((-F.col("n")).alias("m"), "value"))
    parts = ranked.groupBy("column", "g").agg(F.count("*").alias("u"), F.sum("n").alias("t"), F.collect_list(held).alias("few"))
    whole = parts.groupBy("column").agg(F.sum("u").alias("unique_count"), F.sum("t").alias("total_count"), F.slice(F.sort_array(F.flatten(F.collect_list("few"))), 1, k).alias("few"))
    top = F.transform("few", lambda x, i: F.struct((i + 1).alias("rank"), x["value"].alias("value"), (-x["m"]).alias("n")))
    return whole.select("column", "unique_count", "total_count", top.alias("top"))


def cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: unique_count, total_count, ratio, is_constant, is_categorical, is_id_like.

    Categorical: at most 20 values, or at most 50 and a ratio under 0.05. Like ids: ratio over 0.95 and more than 10.
    A column without values counts as constant, with a ratio of 0.
    """
    names = columns or df.columns
    counted = value_counts(df, names).groupBy("column").agg(F.count("*").alias("unique_count"), F.sum("n").alias("total_count"))
    return _classes(df, names, counted)


def _classes(df: DataFrame, names: list[str], counted: DataFrame, *more: str) -> DataFrame:
    every = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    u, t = F.coalesce("unique_count", F.lit(0).cast("long")), F.coalesce("total_count", F.lit(0).cast("long"))
    ratio = F.coalesce(F.col("unique_count") / F.col("total_count"), F.lit(0.0))
    return (
        every.join(counted, "column", "left")
        .select("column", u.alias("unique_count"), t.alias("total_count"), ratio.alias("ratio"), *more)
        .withColumn("is_constant", F.col("unique_count") <= 1)
        .withColumn("is_categorical", ((F.col("unique_count") <= 20) | ((F.col("unique_count") <= 50) & (F.col("ratio") < 0.05))) & (F.col("total_count") > 0))
        .withColumn("is_id_like", (F.col("ratio") > 0.95) & (F.col("unique_count") > 10))
    )


def cardinality_text(c: DataFrame) -> DataFrame:
    """cardinality() with a text column; the first class that holds counts: constant, ids, categories, plain."""
    u = F.col("unique_count").cast("string")
    return c.withColumn(
        "text",
        F.when(F.col("is_constant"), "constant (single value)")
        .when(F.col("is_id_like"), F.concat(u, F.lit(" unique values (likely identifiers)")))
        .when(F.col("is_categorical"), F.concat(u, F.lit(" categories")))
        .otherwise(F.concat(u, F.lit(" unique values out of "), F.col("total_count").cast("string"))),
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, rank, value, n) of the k most common values; ties by value.

    A column's distinct values are cut to k in each of 64 hash groups before they meet.
    """
    return distinct_facts(df, columns, k).select("column", F.explode("top").alias("t")).select("column", "t.rank", "t.value", "t.n")


def profile(df: DataFrame) -> DataFrame:
    """A row per column: position, type, nulls, numeric and order statistics, cardinality classes, top values."""
    spark = df.sparkSession
    base = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "position int, column string, type string")
    distinct = _classes(df, df.columns, distinct_facts(df), "top")
    out = base.join(null_counts(df), "column", "left").join(numeric_stats(df), "column", "left").join(order_stats(df).drop("n"), "column", "left")
    out = out.join(distinct, "column", "left")
    return out.withColumn("top", F.when(F.col("is_categorical"), F.col("top"))).orderBy("position")


def sample_rows(df: DataFrame, k: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Exactly k rows (or all), the same for the same data however it is partitioned: the lowest md5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[quoted(c).cast("string") for c in keys])
    return df.withColumn("__h", F.md5(text.cast("binary"))).orderBy("__h", *[quoted(c) for c in keys]).limit(k).drop("__h")


def head(df: DataFrame, n: int = 5) -> tuple[list, bool]:
    """The first n rows and whether there are more; reads no more than it needs."""
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n


def is_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether the columns identify rows."""
    counts = df.groupBy(*[quoted(c) for c in columns]).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("is_unique"), F.count("*").alias("n_keys"))
