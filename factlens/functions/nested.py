"""Facts of arrays, maps and structs, per row; and of their types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bound(value: Column, body) -> Column:
    """body(value) with value computed once for the row; a lambda would compute it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def array_stats(a: Column, limit: int | None = None) -> Column:
    """Numeric facts of an array column: like numeric_stats, row by row; all elements unless a limit is given."""
    a = a if limit is None else F.slice(a, 1, limit)

    def facts(ok: Column, mean: Column) -> Column:
        n = F.size(ok)
        spread = F.aggregate(ok, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        at = lambda i: F.get(ok, i.cast("int"))
        half = F.floor(n / 2)
        return F.struct(
            F.get(ok, F.lit(0)).alias("min"),
            F.get(ok, n - 1).alias("max"),
            mean.alias("mean"),
            F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"),
            F.when(n % 2 == 1, at(half)).otherwise((at(F.greatest(half - 1, F.lit(0))) + at(half)) / 2).alias("median"),
            F.when(n >= 4, at(F.floor(n / 4))).alias("q1"),
            F.when(n >= 4, at(F.floor(n * 3 / 4))).alias("q3"),
            F.size(F.filter(ok, lambda x: x == 0)).cast("long").alias("n_zeros"),
            F.size(F.filter(a, lambda x: F.isnan(x.cast("double")))).cast("long").alias("n_nan"),
            F.size(F.filter(a, lambda x: F.abs(x.cast("double")) == float("inf"))).cast("long").alias("n_inf"),
            F.size(a).cast("long").alias("total"),
        )

    def of_finite(ok: Column) -> Column:
        mean = F.aggregate(ok, F.lit(0.0), lambda s, x: s + x) / F.size(ok)
        return F.when(F.size(ok) > 0, bound(mean, lambda m: facts(ok, m)))

    return bound(F.array_sort(finite(a)), of_finite)


def array_facts(a: Column, sample: int = 5) -> Column:
    return F.when(
        a.isNotNull(),
        F.struct(F.size(a).cast("long").alias("length"), F.slice(a, 1, sample).alias("sample_items"), F.size(F.array_distinct(a)).cast("long").alias("n_distinct")),
    )


def head_tail(a: Column, n: int = 5) -> Column:
    """First and last n elements; of short arrays all elements are in the head."""
    size = F.size(a)
    return F.struct(F.slice(a, 1, n).alias("head"), F.when(size > n, F.slice(a, F.greatest(F.lit(n + 1), size - n + 1), n)).alias("tail"))


def corner(a: Column, n: int = 3) -> Column:
    return F.transform(F.slice(a, 1, n), lambda r: F.slice(r, 1, n))


def rectangular(a: Column) -> Column:
    """Of an array of arrays: rows, whether all rows have one length, and that length."""
    lengths = F.array_distinct(F.transform(a, lambda r: F.size(r)))
    same = F.size(lengths) == 1
    return F.struct(F.size(a).alias("rows"), same.alias("rectangular"), F.when(same, F.get(lengths, F.lit(0))).alias("width"))


def map_facts(m: Column, sample: int = 5) -> Column:
    return F.when(
        m.isNotNull(),
        F.struct(F.size(m).cast("long").alias("length"), F.slice(F.array_sort(F.map_keys(m)), 1, sample).alias("keys"), F.slice(F.map_values(m), 1, sample).alias("sample_values")),
    )


def range_facts(start: Column, stop: Column, step: Column) -> Column:
    """Length, and first and last three elements, of a half-open range."""
    n = F.greatest(F.ceil((stop - start) / step), F.lit(0)).cast("long")
    at = lambda i: start + i * step
    three = lambda first: F.array(*[at(first + k) for k in range(3)])
    return F.struct(
        n.alias("length"), F.slice(three(F.lit(0)), 1, F.least(n, F.lit(3)).cast("int")).alias("sample_start"), F.when(n >= 3, three(n - 3)).alias("sample_end")
    )


def depth(kind: T.DataType, most: int = 5) -> int:
    """Levels of nesting of a type: 0 for scalars."""
    if most <= 0:
        return 0
    if isinstance(kind, T.ArrayType):
        return 1 + depth(kind.elementType, most - 1)
    if isinstance(kind, T.MapType):
        return 1 + depth(kind.valueType, most - 1)
    if isinstance(kind, T.StructType):
        return 1 + max((depth(f.dataType, most - 1) for f in kind.fields), default=0)
    return 0


def is_nested(kind: T.DataType) -> bool:
    return depth(kind) > 0
