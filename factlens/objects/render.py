"""Facts as text, on the driver. Numbers are rendered as Python's `.2g` does, which Java's formatting doesn't."""

from __future__ import annotations

import math
import re


def without_addresses(text: str) -> str:
    return re.sub(r" at 0x[0-9A-Fa-f]+", "", text)


def scalar(value):
    """A plain Python value of numpy-like scalars."""
    if type(value).__module__.split(".")[0] in ("numpy", "jax", "jaxlib", "torch", "tensorflow") and hasattr(value, "item"):
        try:
            return value.item()
        except (TypeError, ValueError):
            return value
    return value


def shown(value, most: int = 50) -> str:
    """repr without addresses, capped; a value whose repr fails shows its type."""
    try:
        text = without_addresses(repr(scalar(value)))
    except Exception:  # noqa: BLE001  any object may be given
        text = f"<{type(value).__name__}>"
    return text if len(text) <= most else text[: most - 3] + "..."


def shown_str(value, most: int = 100) -> str:
    try:
        text = without_addresses(str(scalar(value)))
    except Exception:  # noqa: BLE001
        text = f"<{type(value).__name__}>"
    return text if len(text) <= most else text[: most - 3] + "..."


def stats_text(s: dict | None, precision: int = 2) -> str | None:
    """'range a to b, mean m, std s' with shares of NaN, infinities and, if most are, zeros."""
    if not s or s.get("min") is None:
        return None
    g = lambda x: f"{float(x):.{precision}g}"
    parts = [f"range {g(s['min'])} to {g(s['max'])}", f"mean {g(s['mean'])}"]
    if s.get("std") is not None:
        parts.append(f"std {g(s['std'])}")
    total, extras = max(s.get("total") or 0, 1), []
    if s.get("n_nan"):
        extras.append(f"{100 * s['n_nan'] / total:.1f}% NaN")
    if s.get("n_inf"):
        extras.append(f"{s['n_inf']} infinite values")
    if (s.get("n_zeros") or 0) > (s.get("total") or 0) * 0.5:
        extras.append(f"{100 * s['n_zeros'] / total:.0f}% zeros")
    return ", ".join(parts) + (f" ({', '.join(extras)})" if extras else "")


def numeric_facts(values) -> dict | None:
    """The statistics of a plain sequence, as the Spark operators compute them for columns; None without a finite value."""
    finite, nan, inf, total = [], 0, 0, 0
    for v in values:
        total += 1
        try:
            x = float(v)
        except (TypeError, ValueError):
            continue
        if math.isnan(x):
            nan += 1
        elif math.isinf(x):
            inf += 1
        else:
            finite.append(x)
    if not finite:
        return None
    finite.sort()
    n, mean = len(finite), math.fsum(finite) / len(finite)
    return {
        "min": finite[0], "max": finite[-1], "mean": mean, "std": math.sqrt(math.fsum((x - mean) ** 2 for x in finite) / (n - 1)) if n > 1 else None,
        "median": (finite[(n - 1) // 2] + finite[n // 2]) / 2, "q1": finite[n // 4] if n >= 4 else None, "q3": finite[3 * n // 4] if n >= 4 else None,
        "n_zeros": finite.count(0.0), "n_nan": nan, "n_inf": inf, "total": total,
    }


def cardinality_text(c: dict, top: list | None = None) -> str:
    """The first class that holds: constant, identifiers, categories (with up to three values), plain."""
    if c["is_constant"]:
        return "constant (single value)"
    if c["is_id_like"]:
        return f"{c['unique_count']} unique values (likely identifiers)"
    if c["is_categorical"]:
        named = ", ".join(f"'{v}'" for v in (top or [])[:3])
        return f"{c['unique_count']} categories" + (f" including {named}" if named else "")
    return f"{c['unique_count']} unique values out of {c['total_count']}"


def columns_text(columns: list[dict]) -> str:
    """The first three columns with type, nulls, and statistics or cardinality."""
    out = []
    for c in columns[:3]:
        details = [c["dtype"]] if c.get("dtype") else []
        if c.get("null_count"):
            details.append(f"{c['null_count']} nulls")
        if c.get("stats"):
            details.append(f"stats: {c['stats']}")
        elif c.get("cardinality"):
            details.append(f"cardinality: {c['cardinality']}")
        out.append(f"{c['name']} ({', '.join(details)})" if details else c["name"])
    return ", ".join(out)


#: Facts that a summary without a text of its own names, with their labels.
_LABELS = [
    ("shape", "Shape"), ("columns", "Columns"), ("node_count", "Nodes"), ("edge_count", "Edges"), ("parameter_count", "Parameters"),
    ("status_code", "Status"), ("url", "URL"), ("chart_type", "Chart"),
]


def summary(meta: dict) -> str:
    """The text of a fact document: its own, or its facts joined by bars and the describer's name."""
    if meta.get("nl_summary"):
        return meta["nl_summary"]
    parts = [meta.get("object_type", "Unknown")]
    for key, label in _LABELS:
        value = meta.get(key)
        if value is None or value == []:
            continue
        if key == "columns":
            value = ", ".join(map(str, value[:5])) + (f", ... ({len(value)} total)" if len(value) > 5 else "")
        elif key == "parameter_count":
            value = f"{value:,}"
        elif key == "url" and len(value) > 50:
            value = value[:50] + "..."
        parts.append(f"{label}: {value}")
    if "is_fitted" in meta:
        parts.append(f"Status: {'fitted' if meta['is_fitted'] else 'not fitted'}")
    inner = meta.get("metadata") or {}
    if "length" in inner:
        parts.append(f"Length: {inner['length']}")
    if inner.get("keys"):
        parts.append("Keys: " + ", ".join(map(str, inner["keys"][:5])) + ("..." if len(inner["keys"]) > 5 else ""))
    if "value" in inner:
        parts.append(f"Value: {shown_str(inner['value'])}")
    return " | ".join(parts) + f" [via {meta.get('adapter_used', 'unknown')}]"


def with_verbosity(text: str, verbosity: str) -> str:
    """full; compact: the first two sentences; minimal: the first."""
    if verbosity == "full":
        return text
    pieces = re.split(r"(?<=[.!?]) ", text)
    return " ".join(pieces[: 2 if verbosity == "compact" else 1])
