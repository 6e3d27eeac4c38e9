"""Per-row facts of strings as Column expressions; patterns are tried in order, the first that fits counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = 100  # strings under this length are values, others are documents

#: Label and pattern, in the order of trial. \p{Nd} is any decimal digit.
SHORT_PATTERNS = [
    ("url", r"^https?://[^\s<>]+$"),
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("iso_date", r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}$"),
    ("iso_datetime", r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[T ]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("file_path", r"^(/[^/\x00]+)+/?$|^[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*$"),
    ("phone", r"^\b(\+?1?[-.\s]?)?\(?\p{Nd}{3}\)?[-.\s]?\p{Nd}{3}[-.\s]?\p{Nd}{4}\b"),
    ("hex_color", r"^#(?:[0-9a-fA-F]{3}){1,2}$"),
    ("ip_address", r"^\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}$"),
]


def is_json(s: Column) -> Column:
    """Whether the whole text is one JSON value; false for null.

    The parser ignores what follows the first value. So the text must parse as an array's only element and as an object's
    only value: what follows would have to begin with ] or a comma for the one, with } or a comma for the other; and a
    comma needs a key and a colon in the object, which the array refuses.
    """
    within = lambda start, end: F.try_parse_json(F.concat(F.lit(start), s, F.lit(end))).isNotNull()
    return F.coalesce(within("[", "]") & within('{"_":', "}"), F.lit(False))


def pattern(s: Column) -> Column:
    """The label of the first pattern that fits a short string, or null; JSON is tried last."""
    chain = None
    for label, regex in SHORT_PATTERNS:
        chain = F.when(s.rlike(regex), label) if chain is None else chain.when(s.rlike(regex), label)
    text = F.btrim(s, F.lit(" \t\r\n\x0b\f"))
    return chain.when(text.rlike(r"^[{\[]") & is_json(text), "json")


def looks_like_csv(s: Column) -> Column:
    """At least two non-blank lines, and the first five have one positive count of commas."""
    lines = F.filter(F.split(s, r"\r\n|\r|\n"), lambda x: F.btrim(x) != "")
    counts = F.array_distinct(F.transform(F.slice(lines, 1, 5), lambda x: F.size(F.split(x, ",")) - 1))
    return (F.size(lines) >= 2) & (F.size(counts) == 1) & (F.get(counts, F.lit(0)) > 0)


def document_type(s: Column) -> Column:
    bare = F.regexp_replace(s, r"^\s+", "")
    upper = F.upper(s)
    return (
        F.when(is_json(s), "json")
        .when(bare.startswith("<") & (s.contains("</") | s.contains("<html")), "html_or_xml")
        .when(bare.startswith("#") | s.contains("```"), "markdown")
        .when(s.contains("def ") | s.contains("import ") | s.contains("class "), "python_code")
        .when(upper.contains("SELECT ") & upper.contains(" FROM "), "sql")
        .when(looks_like_csv(s), "csv")
        .when(s.isNotNull(), "prose")
    )


def charset(s: Column) -> Column:
    """ascii, unicode, or unicode_with_emoji if a code point is above U+1F000."""
    return F.when(~s.rlike(r"[^\x00-\x7F]"), "ascii").when(s.rlike(r"[\x{1F001}-\x{10FFFF}]"), "unicode_with_emoji").when(s.isNotNull(), "unicode")


def content_type(s: Column) -> Column:
    return (
        F.when(s.rlike(r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*$") & ~s.rlike(r"\n$"), "identifier")
        .when(s.contains(" "), F.when(s.rlike(r"[.!?]$") & ~s.rlike(r"\n$"), "sentence").otherwise("phrase"))
        .when(s.rlike(r"^[\p{L}\p{N}]+$") & ~s.rlike(r"\n$"), "alphanumeric")
    )


def line_count(s: Column) -> Column:
    return F.size(F.split(s, "\n")).cast("long")


def word_count(s: Column) -> Column:
    """Runs of characters other than white space of any alphabet."""
    return F.size(F.filter(F.split(s, r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")).cast("long")


def text_stats(s: Column) -> Column:
    return F.struct(F.length(s).cast("long").alias("chars"), line_count(s).alias("lines"), word_count(s).alias("words"))


def string_facts(s: Column, preview: int = 100) -> Column:
    """One struct for short and long strings; facts of the other sort are null; null for null."""
    short = F.length(s) < SHORT
    facts = F.struct(
        F.length(s).alias("length"),
        F.substring(s, 1, preview).alias("preview"),
        F.when(~short & (F.length(s) > preview), F.right(s, F.lit(preview))).alias("tail_preview"),
        F.when(short, pattern(s)).alias("pattern"),
        F.when(short, content_type(s)).alias("content_type"),
        F.when(~short, line_count(s)).alias("line_count"),
        F.when(~short, word_count(s)).alias("word_count"),
        F.when(~short, document_type(s)).alias("document_type"),
        charset(s).alias("charset"),
    )
    return F.when(s.isNotNull(), facts)


def string_sentence(s: Column, preview: int = 100) -> Column:
    """The one-sentence description of a string."""
    f = string_facts(s, preview)
    return (
        F.when(f["document_type"].isNotNull(), F.concat(F.lit("A "), f["document_type"], F.lit(" document string ("), f["length"], F.lit(" chars).")))
        .when(f["pattern"].isNotNull(), F.concat(F.lit("A string containing a "), f["pattern"], F.lit(": '"), f["preview"], F.lit("'.")))
        .otherwise(F.concat(F.lit("A string '"), f["preview"], F.lit("' ("), f["length"], F.lit(" characters).")))
    )


def strip_addresses(s: Column) -> Column:
    return F.regexp_replace(s, " at 0x[0-9A-Fa-f]+", "")


def first_line(s: Column) -> Column:
    return F.get(F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\r\n|\r|\n"), F.lit(0))


def shown(s: Column, most: int = 50) -> Column:
    """A quoted, address-free, capped form of a string value."""
    text = F.concat(F.lit("'"), strip_addresses(s), F.lit("'"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
