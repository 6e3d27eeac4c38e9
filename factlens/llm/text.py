"""Column expressions on whole texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. Inside lambdas the optimizer would repeat it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words in order; null counts as empty. Trimmed first, the text has no empty piece between gaps."""
    return let(
        F.btrim(text_of(text), F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)),
    )


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a class the text has: it is cut at each of them."""
    return (F.size(F.split(text, pattern, -1)) - 1).cast("long")


def unit_hash(value: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the value and the seed only: the first 52 bits of an md5."""
    digest = F.md5(F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def running_sum(lengths: Column) -> Column:
    """Running totals of array<int>, in blocks of 256 so that long arrays stay far from quadratic cost."""
    block = 256

    def prefix(a: Column) -> Column:
        return F.aggregate(
            a,
            F.array().cast("array<int>"),
            lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)),
        )

    def blocks(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        totals = F.transform(at, lambda b: F.aggregate(F.slice(a, b * block + 1, block), F.lit(0), lambda x, y: x + y))
        return let(
            prefix(totals),
            lambda ends: F.flatten(
                F.transform(
                    at,
                    lambda b: F.transform(
                        prefix(F.slice(a, b * block + 1, block)),
                        lambda x: x + F.when(b > 0, F.get(ends, b - 1)).otherwise(F.lit(0)),
                    ),
                )
            ),
        )

    return let(lengths, lambda a: F.when(F.size(a) <= block, prefix(a)).otherwise(blocks(a)))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>> in code points.

    The text is cut at the matches; lengths of the pieces and matches give the offsets, added up in one pass.
    """
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    )

    def offsets(z: Column) -> Column:
        return let(
            running_sum(F.transform(z, lambda x: x["0"] + F.length(x["1"]))),
            lambda ends: F.transform(
                z,
                lambda x, i: F.struct(
                    (F.get(ends, i) - F.length(x["1"])).alias("start"), F.get(ends, i).alias("end"), x["1"].alias("value")
                ),
            ),
        )

    return let(let(found, lambda z: F.slice(z, 1, F.size(z) - 1)), offsets)


NO_SPANS = "array<struct<start:int,end:int,value:string>>"


def span_list(columns: list[tuple[str, Column]], by_start: bool) -> Column:
    """'kind:start:end' of arrays of spans, comma-joined: by kind as listed then start, or by start then kind."""
    def named(i: int, kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            *((s["start"].alias("a"), F.lit(i).alias("b")) if by_start else (F.lit(i).alias("a"), s["start"].alias("b"))),
            F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("c"),
        )

    arrays = [F.transform(c, named(i, kind)) for i, (kind, c) in enumerate(columns)]
    return F.array_join(F.transform(F.sort_array(F.concat(*arrays)), lambda x: x["c"]), ",")
