"""Descriptions of Spark DataFrames: aggregations over all rows, a few collected rows, and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factlens.config import DescribeConfig
from factlens.functions.formatting import bytes_text
from factlens.functions.redaction import redact
from factlens.objects.render import cardinality_text, columns_text, shown, stats_text
from factlens.operators import profile as P
from factlens.streaming.guard import describe_stream


def column_facts(df: DataFrame, config: DescribeConfig) -> list[dict]:
    """Facts of the first columns: one collected row per column."""
    names = list(dict.fromkeys(df.columns))[: config.max_columns]
    rows = {r["column"]: r.asDict(recursive=True) for r in P.profile(df.select(*[P.quoted(n) for n in names])).collect()}
    out = []
    for f in (df.schema[n] for n in names):
        r = rows[f.name]
        c = {"name": f.name, "dtype": f.dataType.simpleString(), "null_count": r["missing"]}
        if isinstance(f.dataType, P.NUMERIC):
            c["stats"] = stats_text(r)
            c["quartiles"] = {k: r[k] for k in ("q1", "median", "q3")}
        else:
            c["cardinality"] = cardinality_text(r, [t["value"] for t in r["top"] or []])
        out.append(c)
    return out


def describe_table(df: DataFrame, config: DescribeConfig) -> dict:
    """The fact document of a DataFrame; of a stream only schema and plan."""
    if df.isStreaming:
        return describe_stream(df) | {"adapter_used": "spark"}
    if config.redact.enabled:
        df = redact(df, config.redact)
    if len(set(df.columns)) < len(df.columns):  # equal names are told apart by position
        seen: dict[str, int] = {}
        names = []
        for c in df.columns:
            seen[c] = seen.get(c, 0) + 1
            names.append(c if seen[c] == 1 else f"{c}#{seen[c]}")
        df = df.toDF(*names)
    if config.sample_limit:
        df = P.sample_rows(df, config.sample_limit, [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    if not df.columns:
        return {"object_type": "spark.DataFrame", "adapter_used": "spark", "shape": [df.count(), 0], "columns": [], "nl_summary": "A Spark DataFrame without columns."}
    facts = P.table_facts(df).first()
    columns = column_facts(df, config)
    few = facts["n_rows"] <= config.max_sample_rows and facts["n_rows"] * facts["n_columns"] <= config.max_sample_cells
    sample = [{k: shown(v, config.max_sample_repr) for k, v in r.asDict().items()} for r in df.limit(config.sample_size).collect()] if few else None
    size = P.estimated_bytes(df)
    parts = [f"A Spark DataFrame with {facts['n_rows']} rows and {facts['n_columns']} columns.", f"Nulls: {facts['missing']}.", f"Estimated size: {bytes_text(size)}."]
    parts.append(f"Columns: {columns_text(columns)}.")
    if sample:
        parts.append(f"Sample row: {sample[0]}.")
    elif not few:
        parts.append("Sample rows omitted for size/perf.")
    return {
        "object_type": "spark.DataFrame", "adapter_used": "spark", "shape": [facts["n_rows"], facts["n_columns"]], "columns": df.columns, "dtypes": dict(df.dtypes),
        "metadata": {
            "type": "dataframe", "rows": facts["n_rows"], "columns": facts["n_columns"], "null_count": facts["missing"], "estimated_bytes": size,
            "column_analysis": columns, **({"sample_rows": sample} if sample else {"sample_rows_omitted": not few}),
        },
        "nl_summary": " ".join(parts),
    }


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
