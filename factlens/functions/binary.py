"""Per-row facts of binary values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlens.functions.formatting import format_bytes
from factlens.functions.nested import bound

#: Format and the bytes that it begins with, in the order of trial.
SIGNATURES = [
    ("png", b"\x89PNG\r\n\x1a\n"),
    ("jpeg", b"\xff\xd8\xff"),
    ("gif", b"GIF87a"),
    ("gif", b"GIF89a"),
    ("pdf", b"%PDF"),
    ("zip", b"PK\x03\x04"),
    ("gzip", b"\x1f\x8b"),
    ("sqlite", b"SQLite format 3\x00"),
]


def begins(data: Column, with_: bytes, at: int = 0) -> Column:
    return F.substring(data, at + 1, len(with_)) == F.lit(bytearray(with_))


def magic(data: Column) -> Column:
    chain = None
    for label, sig in SIGNATURES:
        chain = F.when(begins(data, sig), label) if chain is None else chain.when(begins(data, sig), label)
    return chain


def entropy(data: Column) -> Column:
    """Shannon entropy of the bytes in bits; 0 for none. At most 256 different values are counted in the sorted array."""
    values = bound(F.hex(data), lambda hexed: F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2))))
    n = F.length(data).cast("double")

    def bits(a: Column) -> Column:
        counts = F.transform(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda x: x == v)))
        return F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - (c / n) * F.log2(c / n))

    return F.when(F.length(data) > 0, bound(values, bits)).when(data.isNotNull(), F.lit(0.0))


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def bytes_facts(data: Column) -> Column:
    return F.when(
        data.isNotNull(),
        F.struct(
            F.length(data).alias("length"),
            format_bytes(F.length(data)).alias("size"),
            F.lower(F.hex(F.substring(data, 1, 20))).alias("preview_hex"),
            F.round(entropy(data), 2).alias("entropy"),
            magic(data).alias("format"),
            is_utf8(data).alias("utf8"),
        ),
    )


def bytes_sentence(data: Column) -> Column:
    m, n = magic(data), F.length(data).cast("string")
    return F.when(m.isNotNull(), F.concat(F.lit("A bytes object containing "), m, F.lit(" data ("), n, F.lit(" bytes)."))).otherwise(
        F.concat(F.lit("A bytes object of "), n, F.lit(" bytes."))
    )


def unsigned(data: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned integer of `size` bytes at an offset; null if the data are shorter."""
    parts = [F.conv(F.hex(F.substring(data, at + i + 1, 1)), 16, 10).cast("long") for i in range(size)]
    total = sum((p * F.lit(256 ** (i if little else size - 1 - i)) for i, p in enumerate(parts)), F.lit(0).cast("long"))
    return F.when(F.length(data) >= at + size, total)


def signed32(data: Column, at: int, little: bool = True) -> Column:
    u = unsigned(data, at, 4, little)
    return F.when(u >= 1 << 31, u - (1 << 32)).otherwise(u)
