"""Queries of facts of single values (numbers, dates, texts, bytes, lists), with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.config import RedactionConfig
from factlens.functions import binary, datetimes, formats, formatting, nested, numbers, redaction, strings
from factlens.operators import profile, records
from factlens.plans.registry import query, table

_FLOAT_PATTERN = """CASE WHEN x BETWEEN 0 AND 1 THEN 'probability' WHEN x BETWEEN 0 AND 100 THEN 'percentage' WHEN x BETWEEN -90 AND 90 THEN 'latitude'
    WHEN x BETWEEN -180 AND 180 THEN 'longitude' WHEN abs(x) < 1000000 AND round(x, 2) = x THEN 'currency_like' END"""


@query(
    "float_facts",
    f"""SELECT k, special, CASE WHEN special IS NULL THEN length(regexp_replace(x::VARCHAR, '[^0-9]', '', 'g')) END::INTEGER AS precision, pattern,
        CASE WHEN pattern IS NULL THEN 'A floating-point number with value ' || coalesce(special, x::VARCHAR) || '.' ELSE 'A float ' || x || ', likely representing a ' || pattern || '.' END AS sentence
      FROM (SELECT *, CASE WHEN isfinite(x) THEN {_FLOAT_PATTERN} END AS pattern, CASE WHEN isnan(x) THEN 'nan' WHEN isinf(x) THEN CASE WHEN x > 0 THEN 'inf' ELSE '-inf' END END AS special
        FROM (SELECT c_custkey AS k, CASE c_custkey % 50 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE
          WHEN 3 THEN c_custkey + 0.125 WHEN 4 THEN (c_custkey % 8) / 8.0::DOUBLE ELSE c_acctbal END AS x FROM customer))""",
)
def float_facts(spark, sf_dir):
    k = F.col("c_custkey")
    special = {0: F.lit(float("nan")), 1: F.lit(float("inf")), 2: F.lit(float("-inf")), 3: k + F.lit(0.125), 4: (k % 8) / F.lit(8.0)}
    x = F.col("c_acctbal")
    for i, v in special.items():
        x = F.when(k % 50 == i, v).otherwise(x)
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), x.alias("x"))
    f = numbers.float_facts(F.col("x"))
    return rows.select("k", f["special"].alias("special"), f["precision"].alias("precision"), f["pattern"].alias("pattern"), numbers.float_sentence(F.col("x")).alias("sentence"))


@query(
    "complex_and_fractions",
    """SELECT p_partkey AS k, round(sqrt(a * a + b * b), 6) AS magnitude, round(degrees(atan2(b, a)), 2) AS phase_degrees,
        CASE WHEN d = 0 THEN NULL ELSE round(n / d, 9) END AS float_value, d = 1 AS is_integer
      FROM (SELECT p_partkey, p_size::DOUBLE - 20 AS a, (p_partkey % 13)::DOUBLE - 6 AS b, p_size::DOUBLE AS n, (p_partkey % 6)::DOUBLE AS d FROM part)""",
)
def complex_and_fractions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 20).cast("double").alias("a"), ((F.col("p_partkey") % 13) - 6).cast("double").alias("b"), "p_size")
    c, f = numbers.complex_facts(F.col("a"), F.col("b")), numbers.fraction_facts(F.col("p_size"), F.col("p_partkey") % 6)
    return p.select(F.col("p_partkey").alias("k"), F.round(c["magnitude"], 6).alias("magnitude"), c["phase_degrees"].alias("phase_degrees"), F.round(f["float_value"], 9).alias("float_value"), f["is_integer"].alias("is_integer"))


@query(
    "decimal_facts",
    """SELECT k, x::VARCHAR AS value, CASE WHEN x < 0 THEN '-' ELSE '+' END AS sign, length(regexp_replace(regexp_replace(x::VARCHAR, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1'))::INTEGER AS precision,
        -2::INTEGER AS exponent FROM (SELECT s_suppkey AS k, s_acctbal::DECIMAL(12, 2) AS x FROM supplier)""",
)
def decimal_facts(spark, sf_dir):
    x = F.col("s_acctbal").cast("decimal(12,2)")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), numbers.decimal_facts(x).alias("f")).select("k", "f.*")


@query(
    "int_magnitude_sign",
    """SELECT magnitude, sign, count(*)::BIGINT AS n FROM (SELECT CASE WHEN abs(x) < 100 THEN 'small' WHEN abs(x) < 1000000 THEN 'medium' ELSE 'large' END AS magnitude,
        CASE WHEN x = 0 THEN 'zero' WHEN x > 0 THEN 'positive' ELSE 'negative' END AS sign FROM (SELECT (user_id - 75) * (event_id % 2000) * 300 AS x FROM events)) GROUP BY ALL""",
)
def int_magnitude_sign(spark, sf_dir):
    x = (F.col("user_id") - 75) * (F.col("event_id") % 2000) * 300
    return table(spark, sf_dir, "events").select(numbers.int_magnitude(x).alias("magnitude"), numbers.sign(x).alias("sign")).groupBy("magnitude", "sign").agg(F.count("*").alias("n"))


@query(
    "datetime_facts",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END AS iso,
        dayname(ts) AS weekday, strftime(ts, '%H:%M:%S') AS time, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute, strftime(ts, '%Y-%m-%d') AS date,
        date_diff('day', DATE '2024-06-01', ts::DATE)::INTEGER AS relative_days,
        CASE WHEN d = 0 THEN 'Today.' WHEN d > 0 THEN 'In ' || d || ' days.' ELSE abs(d) || ' days ago.' END AS relative,
        'A datetime: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END
          || '. Timezone: naive. ' || dayname(ts) || '.' AS sentence
      FROM (SELECT event_id, ts, date_diff('day', DATE '2024-06-01', ts::DATE) AS d FROM events)""",
)
def datetime_facts(spark, sf_dir):
    ts, as_of = F.col("ts"), F.lit("2024-06-01").cast("date")
    f, d, t = datetimes.datetime_facts(ts, as_of), datetimes.date_facts(ts.cast("date"), as_of), datetimes.time_facts(ts)
    return table(spark, sf_dir, "events").select(
        "event_id", f["iso"].alias("iso"), d["weekday"].alias("weekday"), t["iso"].alias("time"), t["hour"].alias("hour"), t["minute"].alias("minute"), d["iso"].alias("date"),
        f["relative_days"].alias("relative_days"), datetimes.relative_text(f["relative_days"]).alias("relative"), datetimes.datetime_sentence(ts).alias("sentence"),
    )


_OXFORD = """CASE WHEN len({a}) = 0 THEN '' WHEN len({a}) = 1 THEN {a}[1] WHEN len({a}) = 2 THEN {a}[1] || ' and ' || {a}[2]
    ELSE array_to_string({a}[1:len({a}) - 1], ', ') || ', and ' || {a}[len({a})] END"""


@query(
    "texts_of_numbers",
    f"""SELECT k, CASE WHEN n = 1 THEN 'row' ELSE 'rows' END AS word, CASE WHEN n = 1 THEN 'entry' ELSE 'entries' END AS plural,
        format('{{:,}}', n) || CASE WHEN n = 1 THEN ' row' ELSE ' rows' END AS counted, printf('%.1f%%', n / 77.0::DOUBLE * 100) AS percent,
        CASE WHEN n * 7 < 60 THEN printf('%.1f seconds', (n * 7)::DOUBLE) WHEN n * 7 < 3600 THEN printf('%.1f minutes', n * 7 / 60.0::DOUBLE) ELSE printf('%.1f hours', n * 7 / 3600.0::DOUBLE) END AS duration,
        {_OXFORD.format(a="a")} AS listed, CASE WHEN len(a) <= 3 THEN {_OXFORD.format(a="a")} ELSE array_to_string(a[1:3], ', ') || ', and ' || (len(a) - 3) || ' more' END AS cut
      FROM (SELECT p_partkey AS k, (p_partkey * p_size % 8192)::BIGINT AS n, list_transform(range(1, p_partkey % 7 + 1), lambda i: 'item' || i) AS a FROM part)""",
)
def texts_of_numbers(spark, sf_dir):
    n, size = F.col("n"), (F.col("p_partkey") % 7).cast("int")
    a = F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat(F.lit("item"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * F.col("p_size") % 8192).alias("n"), a.alias("a"))
    return rows.select(
        "k", formatting.pluralize(n, "row").alias("word"), formatting.pluralize(n, "entry", "entries").alias("plural"), formatting.format_count(n, "row").alias("counted"),
        formatting.format_percent(n / F.lit(77.0)).alias("percent"), formatting.format_duration(n * 7).alias("duration"), formatting.oxford_comma(F.col("a")).alias("listed"), formatting.truncate_list(F.col("a"), 3).alias("cut"),
    )


@query(
    "texts_of_values",
    r"""SELECT k, CASE WHEN length(q) > 50 THEN q[1:47] || '...' ELSE q END AS shown, bare, trim(split_part(ltrim(doc, chr(10) || ' '), chr(10), 1)) AS first_line
      FROM (SELECT *, '''' || bare || '''' AS q FROM (SELECT p_partkey AS k, p_name || ' object' || repeat('!', (p_partkey % 40)::INTEGER) AS bare, chr(10) || '  ' || p_name || chr(10) || 'more ' || p_partkey AS doc FROM part))""",
)
def texts_of_values(spark, sf_dir):
    k = F.col("p_partkey")
    at = F.concat(F.lit(" at 0x"), F.lower(F.hex(k + 4096)))
    value = F.concat("p_name", F.lit(" object"), at, F.repeat(F.lit("!"), (k % 40).cast("int")))
    doc = F.concat(F.lit("\n  "), "p_name", F.lit("\nmore "), k.cast("string"))
    return table(spark, sf_dir, "part").select(k.alias("k"), strings.shown(value).alias("shown"), strings.strip_addresses(value).alias("bare"), strings.first_line(doc).alias("first_line"))


@query(
    "string_facts",
    r"""SELECT doc_id, length(text)::INTEGER AS length, text[1:40] AS preview, CASE WHEN length(text) >= 100 THEN right(text, 40) END AS tail_preview,
        CASE WHEN length(text) >= 100 THEN len(string_split(text, chr(10))) END::BIGINT AS line_count,
        CASE WHEN length(text) >= 100 THEN len(list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda w: w <> '')) END::BIGINT AS word_count FROM documents""",
)
def string_facts(spark, sf_dir):
    f = strings.string_facts(F.col("text"), preview=40)
    return table(spark, sf_dir, "documents").select("doc_id", f["length"].alias("length"), f["preview"].alias("preview"), f["tail_preview"].alias("tail_preview"), f["line_count"].alias("line_count"), f["word_count"].alias("word_count"))


_BYTES = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"%PDF", b"PK\x03\x04", b"\x1f\x8b", b"SQLite format 3\x00", b"\xc3\xa9", b"\xe2\x82"]
_BYTES_SQL = " ".join(f"WHEN {i} THEN '{''.join(f'\\x{b:02X}' for b in sig)}'::BLOB" for i, sig in enumerate(_BYTES))


@query(
    "bytes_magic",
    f"""WITH t AS (SELECT p_partkey AS k, (CASE p_partkey % 10 {_BYTES_SQL} END) || encode(p_name) AS b FROM part)
      SELECT k, octet_length(b)::INTEGER AS length, lower(hex(b))[1:40] AS preview_hex,
        CASE k % 10 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'gif' WHEN 4 THEN 'pdf' WHEN 5 THEN 'zip' WHEN 6 THEN 'gzip' WHEN 7 THEN 'sqlite' END AS format,
        k % 10 IN (2, 3, 4, 5, 7, 8) AS utf8,
        CASE WHEN k % 10 < 8 THEN 'A bytes object containing ' || (CASE k % 10 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'gif' WHEN 4 THEN 'pdf' WHEN 5 THEN 'zip' WHEN 6 THEN 'gzip' ELSE 'sqlite' END)
          || ' data (' || octet_length(b) || ' bytes).' ELSE 'A bytes object of ' || octet_length(b) || ' bytes.' END AS sentence,
        (SELECT round(sum(-(c / m) * log2(c / m)), 2) FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS m FROM (SELECT unnest(regexp_extract_all(hex(b), '..')) AS v) GROUP BY v)) AS entropy
      FROM t""",
)
def bytes_magic(spark, sf_dir):
    k = F.col("p_partkey")
    start = F.lit(bytearray(_BYTES[0]))
    for i, sig in enumerate(_BYTES[1:], 1):
        start = F.when(k % 10 == i, F.lit(bytearray(sig))).otherwise(start)
    b = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(start, F.col("p_name").cast("binary")).alias("b"))
    f = binary.bytes_facts(F.col("b"))
    return b.select("k", f["length"].alias("length"), f["preview_hex"].alias("preview_hex"), f["format"].alias("format"), f["utf8"].alias("utf8"), binary.bytes_sentence(F.col("b")).alias("sentence"), f["entropy"].alias("entropy"))


@query(
    "uuid_facts",
    """SELECT doc_id, CASE WHEN v >= 8 AND v < 12 THEN ('0x' || h[13])::INTEGER END AS version,
        CASE WHEN v < 8 THEN 'reserved for NCS compatibility' WHEN v < 12 THEN 'specified in RFC 4122' WHEN v < 14 THEN 'reserved for Microsoft compatibility' ELSE 'reserved for future definition' END AS variant, h AS hex
      FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS h, ('0x' || md5(doc_id::VARCHAR)[17])::INTEGER AS v FROM documents)""",
)
def uuid_facts(spark, sf_dir):
    """UUIDs of all versions and variants: any 32 hex digits, written with dashes, in braces or as an urn."""
    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    u = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{"), F.upper(dashed), F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("urn:uuid:"), dashed)).otherwise(dashed)
    return table(spark, sf_dir, "documents").select("doc_id", datetimes.uuid_facts(u).alias("f")).select("doc_id", "f.version", "f.variant", "f.hex")


@query(
    "map_value_stats",
    """SELECT key, count(v)::BIGINT AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM (
        SELECT event_type AS key, value AS v FROM events UNION ALL SELECT 'user' || (user_id % 3), user_id FROM events UNION ALL SELECT 'all', CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END FROM events) GROUP BY key""",
)
def map_value_stats(spark, sf_dir):
    third = F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("double"))
    m = F.create_map("event_type", "value", F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string")), F.col("user_id").cast("double"), F.lit("all"), third)
    return records.map_value_stats(table(spark, sf_dir, "events").select(m.alias("m")), "m").withColumn("mean", F.round("mean", 6))


@query("label_counts", "SELECT toxic::VARCHAR || '/' || quality AS category, count(*)::BIGINT AS n, count(*) / (SELECT count(*) FROM labels) AS share FROM labels GROUP BY ALL")
def label_counts(spark, sf_dir):
    return records.category_counts(table(spark, sf_dir, "labels").select(F.concat_ws("/", "toxic", "quality").alias("c")), "c")


@query(
    "nested_facts",
    """SELECT l_orderkey AS k, len(rows)::INTEGER AS rows, len(list_distinct(list_transform(rows, lambda r: len(r)))) = 1 AS rectangular, list_transform(rows[1:3], lambda r: r[1:3]) AS corner,
        list_max(flatten(rows))::DOUBLE AS max, round(list_avg(flatten(rows)), 6) AS mean, len(m)::BIGINT AS map_length, list_sort(m)[1:2] AS map_keys
      FROM (SELECT l_orderkey, list(list_transform(range(0, CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE l_linenumber END), lambda i: l_linenumber * 10 + i) ORDER BY l_linenumber) AS rows,
        list_distinct(list(l_returnflag || l_linestatus || (l_linenumber % 3))) AS m FROM lineitem GROUP BY l_orderkey)""",
)
def nested_facts(spark, sf_dir):
    n = F.when(F.col("l_orderkey") % 2 == 0, F.lit(4)).otherwise(F.col("l_linenumber"))
    row = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.col("l_linenumber") * 10 + i).cast("long"))
    key = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("s"), F.collect_set(key).alias("keys"))
    lists = lists.select("l_orderkey", F.col("s.r").alias("a"), F.map_from_arrays("keys", "keys").alias("m"))
    shape, stats, m = nested.rectangular(F.col("a")), nested.array_stats(F.flatten("a")), nested.map_facts(F.col("m"), sample=2)
    return lists.select(
        F.col("l_orderkey").alias("k"), shape["rows"].alias("rows"), shape["rectangular"].alias("rectangular"), nested.corner(F.col("a")).alias("corner"), stats["max"].alias("max"), F.round(stats["mean"], 6).alias("mean"),
        m["length"].alias("map_length"), m["keys"].alias("map_keys"),
    )


@query(
    "range_facts",
    """SELECT k, len(r)::BIGINT AS length, r[1:3] AS sample_start, CASE WHEN len(r) >= 3 THEN r[len(r) - 2:len(r)] END AS sample_end FROM (SELECT p_partkey AS k, range(p_size::BIGINT, p_partkey, p_partkey % 5 + 1) AS r FROM part)""",
)
def range_facts(spark, sf_dir):
    f = nested.range_facts(F.col("p_size").cast("long"), F.col("p_partkey"), F.col("p_partkey") % 5 + 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), f.alias("f")).select("k", "f.*")


@query(
    "first_elements",
    """SELECT vec_id, embedding[1:7] AS first, round(list_avg(list_transform(embedding[1:10], lambda x: x::DOUBLE)), 6) AS mean_of_10, 10::BIGINT AS total FROM embeddings""",
)
def first_elements(spark, sf_dir):
    s = nested.array_stats(F.col("embedding"), limit=10)
    f = nested.array_facts(F.col("embedding"), sample=7)
    return table(spark, sf_dir, "embeddings").select("vec_id", f["sample_items"].alias("first"), F.round(s["mean"], 6).alias("mean_of_10"), s["total"].alias("total"))


@query("deterministic_sample", "SELECT * FROM orders ORDER BY md5('0:' || o_orderkey) LIMIT 100")
def deterministic_sample(spark, sf_dir):
    """A sampling operator: 100 rows, the same however the table is partitioned."""
    return profile.sample_rows(table(spark, sf_dir, "orders"), 100, ["o_orderkey"])


@query("sample_statistics", "SELECT 'value' AS \"column\", count(value)::BIGINT AS total, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM (SELECT value FROM events ORDER BY md5('0:' || event_id) LIMIT 1000)")
def sample_statistics(spark, sf_dir):
    """Statistics of a bounded sample, where a description asks for one (sample_limit)."""
    sample = profile.sample_rows(table(spark, sf_dir, "events"), 1000, ["event_id"])
    return profile.numeric_stats(sample, ["value"]).select("column", "total", "min", "max", F.round("mean", 6).alias("mean"))


@query(
    "redact_hashed",
    """SELECT c_custkey AS k, 'write [REDACTED:EMAIL:' || sha256('user' || c_custkey || '@mail.example.com')[1:12] || '] about [REDACTED:TICKET:' || sha256('T-' || c_custkey)[1:12] || '] from 10.0.0.' || (c_custkey % 200) AS text,
        true AS sensitive FROM customer""",
)
def redact_hashed(spark, sf_dir):
    """Identifiers as digests, a pattern of one's own, and addresses of hosts left as they are (the default)."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("write user"), k, F.lit("@mail.example.com about T-"), k, F.lit(" from 10.0.0."), (F.col("c_custkey") % 200).cast("string"))
    config = RedactionConfig(hash_identifiers=True, redact_pii=False, custom_patterns=(("ticket", r"T-[0-9]+"),))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), redaction.redact_text(text, config).alias("text"), redaction.has_sensitive(text, config).alias("sensitive"))


#: event_id % 8 -> a text of each format.
_TEXTS = [
    ("json", lambda i: F.concat(F.lit('{"id": '), i, F.lit(', "x": [1, 2]}')), """'{"id": ' || event_id || ', "x": [1, 2]}'"""),
    ("json", lambda i: F.concat(F.lit(" ["), i, F.lit(", 2, 3] ")), "' [' || event_id || ', 2, 3] '"),
    ("yaml", lambda i: F.concat(F.lit("id: "), i, F.lit("\n# note\nname: x\n  deep: y\n")), "'id: ' || event_id || chr(10) || '# note' || chr(10) || 'name: x' || chr(10) || '  deep: y' || chr(10)"),
    ("yaml", lambda i: F.concat(F.lit("- "), i, F.lit("\n- b\n")), "'- ' || event_id || chr(10) || '- b' || chr(10)"),
    ("html", lambda i: F.concat(F.lit("<div><p>"), i, F.lit("</p></div>")), "'<div><p>' || event_id || '</p></div>'"),
    ("xml", lambda i: F.concat(F.lit("<order><id>"), i, F.lit("</id></order>")), "'<order><id>' || event_id || '</id></order>'"),
    ("csv", lambda i: F.concat(F.lit("id,day,ok\n"), i, F.lit(",2024-01-01,true\n7,2024-01-02,false\n")), "'id,day,ok' || chr(10) || event_id || ',2024-01-01,true' || chr(10) || '7,2024-01-02,false' || chr(10)"),
    (None, lambda i: F.concat(F.lit("plain words "), i), "'plain words ' || event_id"),
]


@query(
    "text_format",
    """SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'yaml' WHEN 3 THEN 'yaml' WHEN 4 THEN 'html' WHEN 5 THEN 'xml' WHEN 6 THEN 'csv' END AS format,
        CASE event_id % 8 WHEN 0 THEN ['id', 'x'] WHEN 2 THEN ['id', 'name'] END AS keys, CASE event_id % 8 WHEN 1 THEN 3 END::BIGINT AS length, CASE event_id % 8 WHEN 5 THEN 'order' END AS root_tag,
        CASE event_id % 8 WHEN 6 THEN ['int', 'date', 'bool'] END AS column_types, CASE event_id % 8 WHEN 6 THEN 3 END::BIGINT AS rows,
        CASE event_id % 8 WHEN 0 THEN 'A valid JSON string containing an object with keys: id, x.' WHEN 1 THEN 'A valid JSON string.' WHEN 2 THEN 'A valid YAML string containing keys: id, name.'
          WHEN 3 THEN 'A valid YAML string.' WHEN 4 THEN 'An HTML document or fragment.' WHEN 5 THEN 'A valid XML document with root <order>.'
          WHEN 6 THEN 'A CSV string with 3 rows and 3 columns (,-delimited). Header: ''id'', ''day'', ''ok''. Sample: ["''' || event_id || '''", "''2024-01-01''", "''true''"]. Column types: int, date, bool. Best displayed as sortable table.' END AS sentence
      FROM events""",
)
def text_format(spark, sf_dir):
    i = F.col("event_id").cast("string")
    s = F.lit(None).cast("string")
    for k, (_, spark_text, _) in enumerate(_TEXTS):
        s = F.when(F.col("event_id") % 8 == k, spark_text(i)).otherwise(s)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), s.alias("s")).select("id", formats.text_format(F.col("s")).alias("f"))
    return rows.select("id", "f.format", "f.keys", "f.length", "f.root_tag", "f.column_types", "f.rows", formats.format_sentence(F.col("f")).alias("sentence"))


@query(
    "column_types",
    """SELECT c, t AS type FROM (SELECT 'l_orderkey' AS c, 'int' AS t UNION ALL SELECT 'l_quantity', 'float' UNION ALL SELECT 'day', 'date' UNION ALL SELECT 'mail', 'email' UNION ALL SELECT 'flag', 'bool' UNION ALL SELECT 'mixed', 'str')
       WHERE (SELECT count(*) FROM lineitem) > 0""",
)
def column_types(spark, sf_dir):
    """The type of whole columns of text: that of all values, grouped by 1,000 first and then by these types."""
    k, q = F.col("l_orderkey").cast("string"), F.col("l_quantity")
    cells = {
        "l_orderkey": k, "l_quantity": F.format_string("%.1f", q), "day": F.concat(F.lit("2024-01-"), F.lpad((F.col("l_orderkey") % 28 + 1).cast("string"), 2, "0")), "mail": F.concat(F.lit("u"), k, F.lit("@x.org")),
        "flag": F.when(q > 25, "true").otherwise("FALSE"), "mixed": F.when(q > 25, "true").otherwise(k),
    }
    rows = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(n).alias("c"), v.alias("v")) for n, v in cells.items()])).alias("x")).select("x.*")
    return formats.infer_types(rows, "c", "v").select("c", "type")
