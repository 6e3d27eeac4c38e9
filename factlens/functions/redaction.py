"""Redaction of strings, nested values and whole tables. Patterns run one after another, each on what the last left."""

from __future__ import annotations

from functools import partial
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.config import RedactionConfig
from factlens.functions.nested import bound

#: Name and pattern, in the order of replacement.
PATTERNS = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("api_key", r"(sk-[a-zA-Z0-9]{20,}|ghp_[a-zA-Z0-9]{36})"),
    ("credit_card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", r"\b(\+?1?[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
]
FIELD_MARK = "[REDACTED:SENSITIVE_FIELD]"


def active(config: RedactionConfig) -> list[tuple[str, str]]:
    on = {
        "email": config.redact_emails, "api_key": config.redact_api_keys, "ip_address": config.redact_ip_addresses,
        **dict.fromkeys(("credit_card", "ssn", "phone"), config.redact_pii),
    }
    return [(n, p) for n, p in PATTERNS if on[n]] + list(config.custom_patterns)


def _marked(s: Column, name: str, regex: str, hashed: bool) -> Column:
    mark = f"[REDACTED:{name.upper()}"
    if not hashed:
        return F.regexp_replace(s, regex, mark + "]")
    # what stands between the matches stays, each match becomes its digest
    between, found = F.split(s, regex, -1), F.regexp_extract_all(s, F.lit(regex), F.lit(0))
    marks = F.transform(found, lambda m: F.concat(F.lit(mark + ":"), F.substring(F.sha2(m, 256), 1, 12), F.lit("]")))
    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(marks, i), F.lit("")))), "")


#: What a text must have for a fixed pattern to find anything; marks add none of it, so the text as given tells.
_NEEDS = {"email": "@", "api_key": "sk-|ghp_", **dict.fromkeys(("credit_card", "ssn", "phone", "ip_address"), "[0-9]")}


def redact_text(s: Column, config: RedactionConfig = RedactionConfig()) -> Column:
    """Each pattern is one pass over what the last one left. Patterns that need the same characters run only where the
    text has them, in one branch, so the expression stays small."""
    text, out = s, s
    for need, group in groupby(active(config), key=lambda p: _NEEDS.get(p[0]) if p in PATTERNS else None):
        now = out
        for name, regex in group:
            marked = partial(_marked, name=name, regex=regex, hashed=config.hash_identifiers)
            # a digest cuts the text at its matches and needs it twice, so it is bound; a plain mark does not
            now = bound(now, lambda t: marked(t)) if config.hash_identifiers else marked(now)  # noqa: B023
        out = now if need is None else F.when(text.rlike(need), now).otherwise(out)
    return out


def has_sensitive(s: Column, config: RedactionConfig = RedactionConfig()) -> Column:
    found = F.lit(False)
    for _, regex in active(config):
        found = found | s.rlike(regex)
    return found


def _sensitive(name: str, config: RedactionConfig) -> bool:
    import re

    return config.redact_passwords and any(re.search(p, name, re.I) for p in config.field_name_patterns)


def redact_value(c: Column, kind: T.DataType, config: RedactionConfig = RedactionConfig()) -> Column:
    """Strings redacted at any depth of arrays, maps and structs. Sensitive fields and keys lose their values: text
    becomes the mark, other types null."""
    if isinstance(kind, T.StringType):
        return redact_text(c, config)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_value(x, kind.elementType, config))
    if isinstance(kind, T.StructType):
        parts = [
            (_hidden(f.dataType) if _sensitive(f.name, config) else redact_value(c.getField(f.name), f.dataType, config)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.MapType):
        secret = "(?i)" + "|".join(config.field_name_patterns)
        value = lambda k, v: redact_value(v, kind.valueType, config)
        if not config.redact_passwords or not isinstance(kind.keyType, T.StringType):
            return F.transform_values(c, value)
        return F.transform_values(c, lambda k, v: F.when(k.rlike(secret), _hidden(kind.valueType)).otherwise(value(k, v)))
    return c


def _hidden(kind: T.DataType) -> Column:
    return F.lit(FIELD_MARK) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)


def redact(df: DataFrame, config: RedactionConfig = RedactionConfig()) -> DataFrame:
    """All columns redacted in place; one projection, no shuffle."""
    return df.select(
        *[
            (_hidden(f.dataType) if _sensitive(f.name, config) else redact_value(F.col(f"`{f.name}`"), f.dataType, config)).alias(f.name)
            for f in df.schema.fields
        ]
    )
