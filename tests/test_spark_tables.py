"""Spark operators on small tables: nulls, special values, empty tables, nested types, streams."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlens import describe
from factlens.config import DescribeConfig, RedactionConfig
from factlens.functions import binary, datetimes, formats, formatting, nested, numbers, redaction, strings
from factlens.objects import describers as D
from factlens.objects.render import numeric_facts, stats_text
from factlens.operators import profile, records, shapes
from factlens.streaming import guard


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


def test_describe_table(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, "z")], "a double, b string")
    d = describe(df)
    assert d.content.startswith("A Spark DataFrame with 3 rows and 2 columns. Nulls: 1. Estimated size: ")
    assert "Columns: a (double, 1 nulls, stats: range 1 to 2, mean 1.5, std 0.71), b (string, cardinality: 3 categories including 'x', 'y', 'z')." in d.content
    assert "Sample row: {'a': '1.0', 'b': \"'x'\"}." in d.content
    hidden = describe(spark.createDataFrame([("a@b.org", "s3cret")], "mail string, password string"), config=DescribeConfig(redact=RedactionConfig(enabled=True)))
    assert "a@b.org" not in hidden.content and "s3cret" not in str(hidden.meta)
    assert "0 rows" in describe(df.limit(0)).content
    assert "a#2" in describe(df.select("a", F.col("b").alias("a"))).content


def test_numeric_special_values(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (0.0,), (1.0,), (2.0,), (3.0,), (10.0,)]
    df = spark.createDataFrame(rows, "x double")
    s, o, n = profile.numeric_stats(df).first(), profile.order_stats(df).first(), profile.null_counts(df).first()
    assert (s["total"], s["n_nan"], s["n_inf"], s["n_zeros"], s["min"], s["max"]) == (7, 1, 1, 1, 0.0, 10.0)
    assert math.isclose(s["std"], statistics.stdev([0, 1, 2, 3, 10]))
    assert (o["n"], o["q1"], o["median"], o["q3"]) == (5, 1.0, 2.0, 3.0)
    assert (n["null_count"], n["nan_count"], n["missing"]) == (1, 1, 2)
    empty = profile.numeric_stats(df.limit(0)).first()
    assert empty["total"] == 0 and empty["min"] is None
    assert profile.cardinality(df.limit(0)).first()["is_constant"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_order_stats_equal_sorting(spark, values):
    got = profile.order_stats(spark.createDataFrame([(v,) for v in values], "x double")).first()
    s, n = sorted(values), len(values)
    assert math.isclose(got["median"], statistics.median(s), abs_tol=1e-9)
    assert got["q1"] == (s[n // 4] if n >= 4 else None) and got["q3"] == (s[3 * n // 4] if n >= 4 else None)


def test_nested_values_have_cardinality(spark):
    df = spark.createDataFrame([([1, 2], {"k": 1}, b"\x00"), ([1, 2], {"k": 2}, None)], "a array<int>, m map<string,int>, b binary")
    found = {r["column"]: r["unique_count"] for r in profile.cardinality(df).collect()}
    assert found == {"a": 1, "m": 2, "b": 1}
    top = profile.top_values(df, ["a"]).first()
    assert (top["value"], top["n"]) == ("[1,2]", 2)
    assert nested.depth(df.schema["m"].dataType) == 1


def test_sample_is_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id"))
    a = profile.sample_rows(df.repartition(7), 10, ["id"]).collect()
    assert a == profile.sample_rows(df.coalesce(1), 10, ["id"]).collect() and len(a) == 10
    rows, more = profile.head(df, 5)
    assert len(rows) == 5 and more


@pytest.mark.parametrize("s", ["https://a.b/c", "a@b.org", "2024-01-02", "2024-01-02 03:04:05", "FD2559FE-4d56-4dd3-893c-2650a015551c", "/usr/bin/x", "C:\\a\\b", "555-123-4567", "#a1b2c3", "1.2.3.4", "plain", "two words.", "x y", "é9", "_id", "🎉", ""])
def test_strings_like_driver(spark, s):
    assert one(spark, s, strings.pattern) == D.string_pattern(s)
    assert one(spark, s, strings.charset) == D._charset(s)
    assert one(spark, s, strings.content_type) == D._content_type(s)


@pytest.mark.parametrize("s", ["# head\n" + "x" * 100, "<p>" + "x" * 100 + "</p>", "def f(): pass " * 9, "SELECT a FROM b " * 9, "a,b\n1,2\n" * 20, "some words " * 20])
def test_document_types_like_driver(spark, s):
    assert one(spark, s, strings.document_type) == D.document_type(s)
    assert one(spark, s, strings.string_sentence) == describe(s).content or D.text_format(s)


@pytest.mark.parametrize(
    ("s", "valid"),
    [
        ("4703443633947811 words after a number", False), ('{"a": 1} {"b": 2}', False), ("[1] x", False), ("1]", False), ("1] x", False), ("1}", False), ("1} x", False), ("1,2", False), ('1,"a":2', False),
        ("1,", False), ("", False), (None, False), (' {"a": [1, "]}"]}\n', True), ("12", True), ("null", True),
    ],
)
def test_json_is_the_whole_text(spark, s, valid):
    assert one(spark, s, strings.is_json) is valid
    assert (one(spark, s, strings.document_type) == "json") is valid


def test_sentence_of_a_text_that_begins_with_a_number(spark):
    s = "4703443633947811 " + "some words " * 9
    assert one(spark, s, strings.string_sentence) == "A prose document string (116 chars)." == describe(s).content
    assert one(spark, '{"a": "' + "x" * 92 + '"}', strings.string_sentence) == "A json document string (101 chars)."


@pytest.mark.parametrize("x", [0, 1, 7, 64, 99, 255, 300, 1999, 2100, 5000, 70000, -5, 1_700_000_001, 2**40])
def test_integers_like_driver(spark, x):
    special = D.int_special(x)
    f = one(spark, x, numbers.int_facts, "long")
    assert f["special_form"] == (special or {}).get("type")
    assert f["utc"] == (special or {}).get("utc")
    assert one(spark, x, numbers.int_sentence, "long") == describe(x).content


@pytest.mark.parametrize(
    ("x", "utc"),
    [
        (1_000_000_001, "2001-09-09T01:46:41Z"), (253_402_300_799, "9999-12-31T23:59:59Z"), (253_402_300_800, "10000-01-01T00:00:00Z"),
        (900_894_000_001, "30518-03-12T21:20:01Z"), (9_223_372_036_854, "294247-01-10T04:00:54Z"), (9_223_372_036_855, None),
    ],
)
def test_timestamps_after_the_year_9999(spark, x, utc):
    f = one(spark, x, numbers.int_facts, "long")
    assert f["special_form"] == "timestamp_unix" and f["utc"] == utc == D.int_special(x).get("utc")


@pytest.mark.parametrize("x", [0.5, 42.0, -45.5, 150.25, -170.0, 1234.56, 1234.567, 1e9])
def test_floats_like_driver(spark, x):
    assert one(spark, x, numbers.float_pattern, "double") == D.float_pattern(x)


def test_float_special_and_others(spark):
    f = one(spark, float("nan"), numbers.float_facts, "double")
    assert f["special"] == "nan" and f["pattern"] is None
    d = one(spark, "12.34", lambda v: numbers.decimal_facts(v.cast("decimal(10,2)")))
    assert (d["precision"], d["exponent"], d["sign"]) == (4, -2, "+")
    c = one(spark, 3.0, lambda v: numbers.complex_facts(v, v + 1), "double")
    assert c["magnitude"] == 5.0 and c["phase_degrees"] == 53.13
    assert one(spark, 1, lambda v: numbers.fraction_facts(v, v * 3), "long")["float_value"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("text", ['{"a": 1, "b": [2]}', "[1, 2, 3]", "name: x\nage: 3", "- a\n- b", "<html><p>x</p></html>", "<root><x>1</x></root>", "a,b\n1,2\n3,4", "a;b\n1.5;2024-01-02\n2.5;2024-01-03", "plain words here", "", "Note: see below."])
def test_formats_like_driver(spark, text):
    got, want = one(spark, text, formats.text_format), D.text_format(text) or {}
    for k in ("format", "parsed_type", "keys", "length", "root_tag", "delimiter", "rows", "columns", "header", "column_types"):
        assert got[k] == want.get(k), k


def test_bytes(spark):
    for data in (b"\x89PNG\r\n\x1a\n123", b"", b"aaaa", bytes(range(256)), b"\xff\xfe"):
        f = one(spark, data, binary.bytes_facts, "binary")
        want = describe(data).meta["metadata"]
        assert (f["length"], f["preview_hex"], f["entropy"], f["format"]) == (want["length"], want["preview_hex"], want["entropy"], want["format"])
        assert one(spark, data, binary.bytes_sentence, "binary") == describe(data).content
    assert one(spark, b"\xff\xfe", binary.is_utf8, "binary") is False


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(width=32)), max_size=30))
def test_array_stats_like_driver(spark, values):
    got, want = one(spark, values, nested.array_stats, "array<double>"), numeric_facts([v for v in values if v is not None])
    if want is None:
        assert got is None
        return
    for k in ("min", "max", "median", "q1", "q3", "n_zeros", "n_nan", "n_inf"):
        assert got[k] == pytest.approx(want[k]), k


def test_redaction(spark):
    text = "mail a@b.org card 4111-1111-1111-1111 ssn 123-45-6789 key sk-abcdefghijklmnopqrstuv ip 10.0.0.1"
    full = RedactionConfig(redact_ip_addresses=True)
    got = one(spark, text, lambda v: redaction.redact_text(v, full))
    assert got == "mail [REDACTED:EMAIL] card [REDACTED:CREDIT_CARD] ssn [REDACTED:SSN] key [REDACTED:API_KEY] ip [REDACTED:IP_ADDRESS]"
    assert "10.0.0.1" in one(spark, text, redaction.redact_text)
    hashed = one(spark, "a@b.org and c@d.org", lambda v: redaction.redact_text(v, RedactionConfig(hash_identifiers=True)))
    assert hashed.count("[REDACTED:EMAIL:") == 2 and "@" not in hashed
    custom = RedactionConfig(custom_patterns=(("order", r"ORD-\d+"),))
    assert one(spark, "see ORD-77", lambda v: redaction.redact_text(v, custom)) == "see [REDACTED:ORDER]"
    df = spark.sql("SELECT named_struct('token', 't', 'x', 'a@b.org') AS s, map('api_key', 'k', 'y', 'a@b.org') AS m, array('a@b.org') AS l, 5 AS private_n, 1 AS n")
    r = redaction.redact(df).first()
    assert r["s"]["token"] == "[REDACTED:SENSITIVE_FIELD]" and r["s"]["x"] == "[REDACTED:EMAIL]"
    assert r["m"] == {"api_key": "[REDACTED:SENSITIVE_FIELD]", "y": "[REDACTED:EMAIL]"} and r["l"] == ["[REDACTED:EMAIL]"]
    assert r["private_n"] is None and r["n"] == 1


def test_formatting(spark):
    assert one(spark, 306, formatting.format_bytes, "long") == "306.0 B" == formatting.bytes_text(306)
    assert one(spark, 5 * 1024**3, formatting.format_bytes, "long") == "5.0 GB"
    assert one(spark, 5 * 1024**4, formatting.format_bytes, "long") == "5.0 TB" and one(spark, 3 * 1024**5, formatting.format_bytes, "long") == "3.0 PB"
    assert one(spark, 90.0, formatting.format_duration, "double") == "1.5 minutes"
    assert one(spark, ["a", "b", "c"], formatting.oxford_comma, "array<string>") == "a, b, and c" == formatting.oxford_text(["a", "b", "c"])
    assert one(spark, list("abcdefg"), formatting.truncate_list, "array<string>") == "a, b, c, d, e, and 2 more"
    assert one(spark, 1234, lambda v: formatting.format_count(v, "row"), "long") == "1,234 rows"
    assert formatting.views_text(["table", "tree", "image"]) == "Best displayed as a table, or alternatively a tree view or an image viewer."
    assert formatting.affordances_text([formatting.Affordance.SORTABLE]) == "You can sort."
    assert stats_text({"min": 0.0001, "max": 1, "mean": 0.5, "std": None, "total": 4, "n_nan": 1, "n_zeros": 3}) == "range 0.0001 to 1, mean 0.5 (25.0% NaN, 75% zeros)"


def test_dates_and_uuid(spark):
    ts = dt.datetime(2024, 1, 1, 12, 0, 0)
    assert one(spark, ts, datetimes.datetime_sentence, "timestamp_ntz") == describe(ts).content
    f = one(spark, ts, lambda v: datetimes.datetime_facts(v, F.lit("2023-12-30")), "timestamp_ntz")
    assert (f["weekday"], f["relative_days"]) == ("Monday", 2)
    assert one(spark, 183600, datetimes.timedelta_sentence, "long") == "A duration of 2 days (183600 seconds)."
    assert one(spark, -3, datetimes.relative_text, "int") == "3 days ago."
    assert one(spark, "fd2559fe-4d56-4dd3-893c-2650a015551c", datetimes.uuid_facts)["version"] == 4


def test_records_and_shapes(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":2.5,"b":"y"}',), ('{"a":null}',), ("nonsense",), (None,)], "j string")
    found = {r["key"]: r for r in records.record_schema(df, "j").collect()}
    assert found["a"]["n"] == 3 and found["a"]["n_records"] == 3 and found["a"]["consistent"]
    assert found["b"]["n"] == 2 and found["b"]["types"] == ["string"]
    types = {r["type"]: r["n"] for r in records.type_distribution(df, "j").collect()}
    assert types == {"object": 3, "invalid": 1, "void": 1}
    followed = spark.createDataFrame([('{"a":1} {"a":2}',), ("4703 words",), ('{"a":3}',), ("12",)], "j string")
    assert {r["type"]: r["n"] for r in records.type_distribution(followed, "j").collect()} == {"object": 1, "bigint": 1, "invalid": 2}
    assert [(r["key"], r["n"], r["n_records"]) for r in records.record_schema(followed, "j").collect()] == [("a", 1, 1)]
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (None, 3)], "src int, dst int")
    g = shapes.graph_facts(edges).first()
    assert (g["node_count"], g["edge_count"]) == (3, 2) and g["density"] == pytest.approx(2 / 3)
    assert shapes.graph_facts(edges, directed=True).first()["edge_count"] == 3
    assert shapes.graph_facts(edges.limit(0)).first()["density"] == 0
    coo = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.0)], "i int, j int, v double")
    assert shapes.sparse_facts(coo, 2, 2).first()["density"] == 0.5
    assert shapes.byte_entropy(spark.createDataFrame([(bytes(range(256)),)], "b binary"), "b").first()["entropy"] == pytest.approx(8.0)
    r = one(spark, [[1, 2], [3, 4]], nested.rectangular, "array<array<int>>")
    assert (r["rows"], r["rectangular"], r["width"]) == (2, True, 2)
    rng = one(spark, 10, lambda v: nested.range_facts(F.lit(0), v, F.lit(2)), "int")
    assert (rng["length"], rng["sample_start"], rng["sample_end"]) == (5, [0, 2, 4], [4, 6, 8])


def test_streams(spark, tmp_path):
    stream = spark.readStream.format("rate").load()
    d = describe(stream)
    assert d.content == "A streaming Spark DataFrame with 2 columns; not started." and d.meta["streaming"]
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1.5), (2, None)], "k long, x double").write.parquet(str(src))
    files = spark.readStream.schema("k long, x double").parquet(str(src))
    q = guard.profile_stream(files, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    found = {r["column"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found["x"]["null_count"] == 1 and found["k"]["max"] == 2.0
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "a") for m in (1, 2, 11)], "t timestamp, k string")
    assert sorted(r["n"] for r in guard.windowed_counts(ts, "t", "k").collect()) == [1, 2]
    with pytest.raises(ValueError):
        guard.describe_stream(ts)


def test_numpy_scalars():
    assert describe(np.int32(7)).content == "A numpy int32 scalar with value 7."


def test_order_stats_narrow_down(spark):
    """Slices small enough that several rounds are needed: spread, clustered, tied and extreme values, nulls and NaN."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(4000):
        tied = rng.choice([1.0, 2.0, 2.0, 3.0])
        near = 1.7e9 + i * 1e-3
        wide = rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308)
        rows.append((None if i % 7 == 0 else tied, near, float("nan") if i % 11 == 0 else wide, i % 3))
    df = spark.createDataFrame(rows, "tied double, near double, wide double, few int").withColumn("none", F.lit(None).cast("double"))
    got = {r["column"]: r for r in profile.order_stats(df, parts=8, few=40).collect()}
    assert set(got) == {"tied", "near", "wide", "few"}
    for j, name in enumerate(("tied", "near", "wide", "few")):
        x = sorted(r[j] for r in rows if r[j] is not None and r[j] == r[j])
        n = len(x)
        assert tuple(got[name]) == (name, n, x[n // 4], (x[(n - 1) // 2] + x[n // 2]) / 2, x[3 * n // 4])
