"""Per-row facts of dates and times. Days relative to now take an explicit date, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def datetime_facts(ts: Column, as_of: Column, timezone: str | None = None) -> Column:
    return F.when(
        ts.isNotNull(),
        F.struct(
            iso(ts).alias("iso"),
            F.lit(timezone).cast("string").alias("timezone"),
            weekday(ts).alias("weekday"),
            F.datediff(ts.cast("date"), as_of.cast("date")).alias("relative_days"),
        ),
    )


def iso(ts: Column) -> Column:
    """ISO form; the fraction only where there is one."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))


def date_facts(d: Column, as_of: Column) -> Column:
    return F.when(d.isNotNull(), F.struct(F.date_format(d, "yyyy-MM-dd").alias("iso"), weekday(d).alias("weekday"), F.datediff(d, as_of.cast("date")).alias("relative_days")))


def time_facts(ts: Column) -> Column:
    return F.when(ts.isNotNull(), F.struct(F.date_format(ts, "HH:mm:ss").alias("iso"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute")))


def timedelta_facts(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.struct(seconds.cast("long").alias("total_seconds"), F.floor(seconds / 86400).cast("long").alias("days")))


def datetime_sentence(ts: Column, timezone: str | None = None) -> Column:
    return F.concat(F.lit("A datetime: "), iso(ts), F.lit(f". Timezone: {timezone or 'naive'}. "), weekday(ts), F.lit("."))


def date_sentence(d: Column) -> Column:
    return F.concat(F.lit("A date: "), F.date_format(d, "yyyy-MM-dd"), F.lit(". "), weekday(d), F.lit("."))


def timedelta_sentence(seconds: Column) -> Column:
    days, total = F.floor(seconds / 86400).cast("long"), seconds.cast("long").cast("string")
    return F.when(days != 0, F.concat(F.lit("A duration of "), days.cast("string"), F.lit(" days ("), total, F.lit(" seconds)."))).otherwise(
        F.concat(F.lit("A duration of "), total, F.lit(" seconds."))
    )


def relative_text(days: Column) -> Column:
    return F.when(days == 0, "Today.").when(days > 0, F.concat(F.lit("In "), days, F.lit(" days."))).otherwise(F.concat(F.abs(days), F.lit(" days ago.")))


def uuid_facts(s: Column) -> Column:
    """Version and variant of a UUID's text."""
    bare = F.lower(F.regexp_replace(s, "[-{}]|urn:uuid:", ""))
    top = F.conv(F.substring(bare, 17, 1), 16, 10).cast("int")
    ok = bare.rlike("^[0-9a-f]{32}$")
    variant = F.when(top < 8, "reserved for NCS compatibility").when(top < 12, "specified in RFC 4122").when(top < 14, "reserved for Microsoft compatibility").otherwise("reserved for future definition")
    return F.when(ok, F.struct(F.when((top >= 8) & (top < 12), F.conv(F.substring(bare, 13, 1), 16, 10).cast("int")).alias("version"), variant.alias("variant"), bare.alias("hex")))
