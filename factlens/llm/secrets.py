"""Secrets: strict base spans, and weak credential parts that count only together.

An access identifier, a secret or an endpoint alone is weak evidence. Parts are linked by an interval join within one
text: two parts are near if neither overlaps the other and at most `scope` characters lie between the end of one and
the start of the next, however long they are. A secret is reported if an identifier is near, an identifier if a secret
is, an endpoint if both are. So a part never completes itself or one that it overlaps (a token inside an address), and
an address next to a token says nothing without an identifier.

The join is on (text, bin of `scope` characters). A bin keeps the first and last start of every sort of part that starts
in it, and the first and last end of those that end in it; a part looks at the bin of its own end and the one after it,
and at the bin of its own start and the one before. That answers the question exactly, a crowded bin costs no more than
a sparse one, and no pairs are formed.

Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm import text as T
from factlens.llm.store import written

KINDS = ("assign", "access", "hex")
PARTS = ("identifier", "secret", "endpoint")
KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORDS + r"[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Weak forms: key ids of 8 characters and more, mixed tokens of 16 and more, addresses with a scheme, whole.
IDENTIFIER = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA|GOOG|LTAI)[A-Z0-9]{4,}+"
TOKEN = r"[A-Za-z0-9+/_-]{16,}+"
ENDPOINT = r"(?:https?|ftp|amqps?|postgres(?:ql)?|mysql|mongodb|redis|s3)://[A-Za-z0-9.-]++(?::[0-9]++)?+(?:[/?#][^\s\"'<>]*+)?+"


def _value(s: Column) -> Column:
    """What follows the separator, the quote and the spaces: group 2 of the plain pattern."""
    return F.regexp_replace(s["value"], "^" + KEYWORDS + r"[\"']?+\x20*+[:=]\x20*+[\"']?+", "")


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(T.NO_SPANS)
    return {
        "assign": F.when(
            text.rlike(KEYWORDS + r"[\"']?+\x20*+[:=]"), F.filter(T.spans(text, ASSIGN), lambda s: F.length(_value(s)) >= 6)
        ).otherwise(none),
        "access": F.when(text.contains("AKIA"), T.spans(text, ACCESS)).otherwise(none),
        "hex": F.when(text.rlike("[0-9a-f]{24}"), T.spans(text, HEX)).otherwise(none),
    }


def part_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(T.NO_SPANS)
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    return {
        "identifier": F.when(text.rlike("AKIA|ASIA|AROA|AIDA|GOOG|LTAI"), T.spans(text, IDENTIFIER)).otherwise(none),
        "secret": F.when(text.rlike("[A-Za-z0-9+/_-]{16}"), F.filter(T.spans(text, TOKEN), mixed)).otherwise(none),
        "endpoint": F.when(text.contains("://"), T.spans(text, ENDPOINT)).otherwise(none),
    }


def _bare(a: Column) -> Column:
    return F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, key, the spans of each base kind and of each weak part.

    Strong spans also serve as parts: assigned and hex values as secrets, access keys as identifiers. The key is
    the text's md5 where there is a weak part that could be linked, and otherwise one that spreads evenly.
    """
    t = docs.withColumn("__text", T.text_of(F.col("text")))
    t = t.withColumns({f"b_{k}": _bare(c) for k, c in base_spans(F.col("__text")).items()})
    t = t.withColumns({f"p_{k}": _bare(c) for k, c in part_spans(F.col("__text")).items()})
    weak = sum((F.size(f"p_{k}") for k in PARTS), F.lit(0)) > 0
    key = F.when(weak, F.md5(F.col("__text").cast("binary"))).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", F.length("__text")).cast("string")))
    return t.withColumn("weak", weak).withColumn("key", key).drop("__text", "text")


def linked_parts(scan: DataFrame, scope: int = 200) -> DataFrame:
    """key, part, start, end of the weak parts that have their complements near (see above)."""
    strong = {"identifier": F.col("b_access"), "secret": F.concat("b_assign", "b_hex"), "endpoint": F.array().cast("array<struct<start:int,end:int>>")}

    def listed(part: str, spans: Column, weak: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(part).alias("part"), s["start"].alias("start"), s["end"].alias("end"), F.lit(weak).alias("weak")))

    every = F.concat(*[c for p in PARTS for c in (listed(p, F.col(f"p_{p}"), True), listed(p, strong[p], False))])
    # equal texts have equal keys and parts: duplicates merge before anything is joined
    parts = scan.filter("weak").select("key", F.explode(every).alias("x")).select("key", "x.*").distinct()
    bin_of = lambda c: F.floor(c / scope).cast("int")
    ends = parts.select("key", "part", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), bin_of(F.col(side)).alias("bin"), F.col(side).alias("at")) for side in ("start", "end")])).alias("x"))
    of = lambda side, p: F.when((F.col("x.side") == side) & (F.col("part") == p), F.col("x.at"))
    bins = ends.groupBy(F.col("key").alias("k"), F.col("x.bin").alias("b")).agg(
        *[f(of(side, p)).alias(f"{name}_{side}_{p}") for p in PARTS for side in ("start", "end") for name, f in (("first", F.min), ("last", F.max))]
    )
    end, start = bin_of(F.col("end")), bin_of(F.col("start"))
    asked = [("begins", end), ("begins_next", end + 1), ("ends", start), ("ends_before", start - 1)]
    looks = parts.filter("weak").select("key", "part", "start", "end", F.explode(F.array(*[F.struct(F.lit(what).alias("what"), at.alias("at")) for what, at in asked])).alias("q"))
    what = F.col("q.what")

    def near(p: str) -> Column:
        return (
            F.when(what == "begins", F.col(f"last_start_{p}") >= F.col("end"))
            .when(what == "begins_next", F.col(f"first_start_{p}") - F.col("end") <= scope)
            .when(what == "ends", F.col(f"first_end_{p}") <= F.col("start"))
            .otherwise(F.col("start") - F.col(f"last_end_{p}") <= scope)
        )

    met = looks.join(bins, (F.col("key") == F.col("k")) & (F.col("q.at") == F.col("b"))).groupBy("key", "part", "start", "end")
    met = met.agg(*[F.coalesce(F.bool_or(near(p)), F.lit(False)).alias(f"near_{p}") for p in PARTS])
    needs = {"secret": F.col("near_identifier"), "identifier": F.col("near_secret"), "endpoint": F.col("near_secret") & F.col("near_identifier")}
    complete = F.lit(False)
    for p in PARTS:
        complete = complete | ((F.col("part") == p) & needs[p])
    return met.filter(complete).select("key", "part", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """A row per input row: doc_id, assign, access, hex (base spans), linked (array<struct<part, start, end>>).

    A linked part that overlaps a base span is left to it. Null and empty texts have no spans, repeated rows give
    equal rows, an empty table an empty result; other columns are left out.
    """
    scan = written(scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "secret-scan")
    linked = linked_parts(scan, scope).groupBy("key").agg(F.collect_set(F.struct("part", "start", "end")).alias("linked"))
    base = F.concat(*[F.col(f"b_{k}") for k in KINDS])
    free = F.filter(
        F.coalesce("linked", F.array().cast("array<struct<part:string,start:int,end:int>>")),
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return scan.join(linked, "key", "left").select("doc_id", *[F.col(f"b_{k}").alias(k) for k in KINDS], F.sort_array(free).alias("linked"))
