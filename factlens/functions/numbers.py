"""Per-row facts of numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_magnitude(x: Column) -> Column:
    size = F.abs(x.cast("decimal(20,0)"))
    return F.when(size < 100, "small").when(size < 1_000_000, "medium").when(x.isNotNull(), "large")


def sign(x: Column) -> Column:
    return F.when(x == 0, "zero").when(x > 0, "positive").when(x < 0, "negative")


def int_special(x: Column) -> Column:
    """The special form of an integer: bit_flag, year, http_status, exit_code, port_number, timestamp_unix or null."""
    return (
        F.when(x == 0, F.lit(None).cast("string"))
        .when((x > 0) & (F.bit_count(x) == 1), "bit_flag")
        .when(x.between(1900, 2100), "year")
        .when(x.between(100, 599), "http_status")
        .when(x.between(0, 255), "exit_code")
        .when(x.between(0, 65535), "port_number")
        .when(x >= 1_000_000_000, "timestamp_unix")
    )


def int_facts(x: Column) -> Column:
    x = x.cast("long")
    special = int_special(x)
    last = 9_223_372_036_854  # what a timestamp of microseconds holds, in the year 294247
    facts = F.struct(
        x.alias("value"),
        int_magnitude(x).alias("magnitude"),
        sign(x).alias("sign"),
        special.alias("special_form"),
        F.when(special == "bit_flag", F.length(F.bin(x)) - 1).alias("bit"),
        F.when(special == "bit_flag", F.concat(F.lit("0x"), F.lower(F.hex(x)))).alias("hex"),
        F.when((special == "timestamp_unix") & (x <= last), F.date_format(F.timestamp_seconds(F.least(x, F.lit(last))), "y-MM-dd'T'HH:mm:ss'Z'")).alias("utc"),
    )
    return F.when(x.isNotNull(), facts)


def int_sentence(x: Column) -> Column:
    special = int_special(x)
    return F.when(special.isNotNull(), F.concat(F.lit("The integer "), x.cast("string"), F.lit(", likely a "), special, F.lit("."))).otherwise(
        F.concat(F.lit("An integer with value "), x.cast("string"), F.lit("."))
    )


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def float_pattern(x: Column) -> Column:
    """probability, percentage, latitude, longitude, currency_like (two decimals, under a million) or null."""
    two = F.abs(x) < 1_000_000
    return F.when(
        _finite(x),
        F.when(x.between(0, 1), "probability")
        .when(x.between(0, 100), "percentage")
        .when(x.between(-90, 90), "latitude")
        .when(x.between(-180, 180), "longitude")
        .when(two & (F.round(F.when(two, x) * 100, 0) / 100 == x), "currency_like"),
    )


def float_precision(x: Column) -> Column:
    """Digits of the shortest decimal form, without exponent."""
    mantissa = F.get(F.split(x.cast("string"), "[eE]"), F.lit(0))
    return F.when(_finite(x), F.length(F.regexp_replace(mantissa, "[^0-9]", "")))


def float_special(x: Column) -> Column:
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")


def float_facts(x: Column) -> Column:
    x = x.cast("double")
    return F.when(
        x.isNotNull(),
        F.struct(x.alias("value"), float_special(x).alias("special"), float_precision(x).alias("precision"), float_pattern(x).alias("pattern")),
    )


def float_text(x: Column) -> Column:
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))


def float_sentence(x: Column) -> Column:
    p = float_pattern(x)
    return F.when(p.isNotNull(), F.concat(F.lit("A float "), float_text(x), F.lit(", likely representing a "), p, F.lit("."))).otherwise(
        F.concat(F.lit("A floating-point number with value "), float_text(x), F.lit("."))
    )


def complex_facts(real: Column, imag: Column) -> Column:
    return F.struct(
        real.alias("real"), imag.alias("imag"), F.hypot(real, imag).alias("magnitude"), F.round(F.degrees(F.atan2(imag, real)), 2).alias("phase_degrees")
    )


def decimal_facts(x: Column) -> Column:
    """Of a decimal column: its text, sign, number of digits and exponent."""
    text = x.cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0+(?=[0-9])", "")
    places = F.when(text.contains("."), F.length(F.regexp_extract(text, r"\.([0-9]*)", 1))).otherwise(F.lit(0))
    return F.when(
        x.isNotNull(),
        F.struct(text.alias("value"), F.when(x < 0, "-").otherwise("+").alias("sign"), F.length(digits).alias("precision"), (-places).alias("exponent")),
    )


def fraction_facts(numerator: Column, denominator: Column) -> Column:
    return F.struct(
        numerator.alias("numerator"),
        denominator.alias("denominator"),
        F.try_divide(numerator.cast("double"), denominator.cast("double")).alias("float_value"),
        (denominator == 1).alias("is_integer"),
    )
