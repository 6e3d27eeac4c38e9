"""Recognition of structured text: JSON, YAML, HTML, XML and CSV, in this order.

JSON, HTML, and the shape and keys of YAML are Column expressions. XML roots and CSV dialects need parsers, which run in
an Arrow-batched function; `text_format` uses it only for texts that the expressions leave open.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.functions.strings import is_json
from factlens.session import ship

HTML = r"(?i)<!doctype\s+html|<html\b|<body\b|<head\b|<(div|span|p|a|img|table|section)\b"
#: A mapping line without indent: the colon ends the line or is followed by a space, so that addresses don't count.
YAML_MAPPING = r"^[A-Za-z_][\w .\-]*:(\s.*)?$"
#: Column types in the order of trial; all values of a column must match.
COLUMN_TYPES = [
    ("int", r"-?\d+"), ("float", r"-?\d+\.\d+"), ("date", r"\d{4}-\d{2}-\d{2}"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("bool", r"(?i:true|false)"),
]

FORMAT = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("parsed_type", T.StringType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("length", T.LongType()),
        T.StructField("root_tag", T.StringType()),
        T.StructField("delimiter", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("columns", T.LongType()),
        T.StructField("header", T.ArrayType(T.StringType())),
        T.StructField("sample_row", T.ArrayType(T.StringType())),
        T.StructField("column_types", T.ArrayType(T.StringType())),
    ]
)


def _facts(**known: Column) -> Column:
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FORMAT.fields])


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def json_facts(s: Column) -> Column:
    """Parsed type, first ten keys of an object, number of elements of an array; null if it isn't JSON text."""
    t = _trimmed(s)
    is_object = t.startswith("{")
    return F.when(
        t.rlike(r"^[{\[]") & is_json(t),
        _facts(
            format=F.lit("json"),
            parsed_type=F.when(is_object, "dict").otherwise("list"),
            keys=F.when(is_object, F.slice(F.json_object_keys(t), 1, 10)),
            length=F.when(~is_object, F.json_array_length(t)),
        ),
    )


def is_html(s: Column) -> Column:
    return s.rlike(HTML)


def _yaml_lines(t: Column) -> Column:
    return F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(" \t")) != "")


def looks_like_yaml(s: Column) -> Column:
    """Every significant line is a mapping, list item, comment, marker or indented; at least one gives structure."""
    t = _trimmed(s)
    item = lambda x: _trimmed(x).startswith("- ")
    aside = lambda x: _trimmed(x).isin("---", "...") | _trimmed(x).startswith("#") | x.rlike(r"^[ \t]")
    lines = _yaml_lines(t)
    return (
        (F.size(lines) > 0)
        & F.forall(lines, lambda x: aside(x) | item(x) | x.rlike(YAML_MAPPING))
        & (F.exists(lines, lambda x: ~aside(x) & (item(x) | x.rlike(YAML_MAPPING))) | t.startswith("---"))
    )


def yaml_keys(s: Column) -> Column:
    """Keys of a block mapping without indent, in order."""
    lines = F.filter(F.split(_trimmed(s), r"\r\n|\r|\n"), lambda x: ~x.rlike(r"^[ \t#-]") & x.rlike(YAML_MAPPING))
    return F.transform(lines, lambda x: F.btrim(F.get(F.split(x, ":"), F.lit(0))))


def yaml_facts(s: Column) -> Column:
    keys = yaml_keys(s)
    kind = F.when(F.size(keys) > 0, "dict").when(_trimmed(s).startswith("- "), "list").otherwise("str")
    return F.when(
        looks_like_yaml(s) & ((F.size(keys) > 0) | _trimmed(s).rlike("^(- |---)")),
        _facts(format=F.lit("yaml"), parsed_type=kind, keys=F.when(F.size(keys) > 0, F.slice(keys, 1, 10))),
    )


def infer_type(values: Column) -> Column:
    """The first column type that all values of an array match, else str."""
    chain = None
    for name, regex in COLUMN_TYPES:
        test = F.forall(values, lambda v: F.coalesce(v.rlike(rf"^(?:{regex})$") & ~v.rlike(r"\n"), F.lit(False)))  # noqa: B023
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise("str")


def infer_types(rows: DataFrame, column: str, value: str) -> DataFrame:
    """(column, type) over all rows of (column, value): the first type that every value matches, else str; one aggregation."""
    tests = [F.bool_and(F.coalesce(F.col(value).rlike(rf"^(?:{regex})$") & ~F.col(value).rlike(r"\n"), F.lit(False))).alias(name) for name, regex in COLUMN_TYPES]
    chain = None
    for name, _ in COLUMN_TYPES:
        chain = F.when(F.col(name), name) if chain is None else chain.when(F.col(name), name)
    return rows.groupBy(column).agg(*tests).select(column, chain.otherwise("str").alias("type"))


def type_of_values(values: list[str]) -> str:
    return next((n for n, regex in COLUMN_TYPES if all(re.fullmatch(regex, v or "") for v in values)), "str")


def xml_root(text: str) -> str | None:
    if not text.startswith("<"):
        return None
    try:
        return ET.fromstring(text).tag
    except (ET.ParseError, ValueError):
        return None


def _quoted(value: str, most: int = 50) -> str:
    text = repr(value)
    return text if len(text) <= most else text[: most - 3] + "..."


def csv_facts(text: str) -> dict | None:
    """Dialect, header, one sample row and column types of CSV text; None if the dialect isn't clear."""
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) < 2:
        return None
    try:
        dialect = csv.Sniffer().sniff("\n".join(lines[:5]), delimiters=",\t;|")
        rows = list(csv.reader(io.StringIO("\n".join(lines[:5])), dialect))
    except csv.Error:
        return None
    if len(rows) < 2:
        return None
    body = rows[1:3]
    return {
        "format": "csv", "delimiter": dialect.delimiter, "rows": len(lines), "columns": len(rows[0]),
        "header": [_quoted(h) for h in rows[0]], "sample_row": [_quoted(c) for c in rows[1]],
        "column_types": [type_of_values([r[i] for r in body if len(r) > i]) for i in range(max(map(len, body)))],
    }


@F.pandas_udf(FORMAT)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    def one(text):
        if text is None:
            return {}
        root = xml_root(text.strip())
        return {"format": "xml", "root_tag": root} if root else (csv_facts(text) or {})

    rows = [one(t) for t in texts]
    return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in FORMAT.fields})


def text_format(s: Column) -> Column:
    """struct of format facts; its format is null for unstructured text. Only open cases reach the Arrow function."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ship(active)
    blank = _trimmed(s) == ""
    native = F.coalesce(json_facts(s), yaml_facts(s), F.when(is_html(_trimmed(s)), _facts(format=F.lit("html"))))
    return F.when(blank | s.isNull(), _facts()).otherwise(F.coalesce(native, _parsed(F.when(native.isNull(), s))))


def format_sentence(f: Column) -> Column:
    """The description of a text_format struct."""
    keys = F.concat_ws(", ", f["keys"])
    csv_text = F.concat(
        F.lit("A CSV string with "), f["rows"], F.lit(" rows and "), f["columns"], F.lit(" columns ("), f["delimiter"], F.lit("-delimited). Header: "),
        F.concat_ws(", ", f["header"]), F.lit('. Sample: ["'), F.concat_ws('", "', f["sample_row"]), F.lit('"]. Column types: '), F.concat_ws(", ", f["column_types"]), F.lit(". Best displayed as sortable table."),
    )
    return (
        F.when(f["format"] == "csv", csv_text)
        .when((f["format"] == "json") & (F.size(f["keys"]) > 0), F.concat(F.lit("A valid JSON string containing an object with keys: "), keys, F.lit(".")))
        .when(f["format"] == "json", "A valid JSON string.")
        .when((f["format"] == "yaml") & (F.size(f["keys"]) > 0), F.concat(F.lit("A valid YAML string containing keys: "), keys, F.lit(".")))
        .when(f["format"] == "yaml", "A valid YAML string.")
        .when(f["format"] == "xml", F.concat(F.lit("A valid XML document with root <"), f["root_tag"], F.lit(">.")))
        .when(f["format"] == "html", "An HTML document or fragment.")
    )
