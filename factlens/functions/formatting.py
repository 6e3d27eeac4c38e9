"""Numbers and lists as text: Column expressions, and plain functions for the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.functions.nested import bound

_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def fixed(x: Column, places: int = 1) -> Column:
    """A double with so many decimals, rounded by its exact binary value, exact ties to even, as Python and C do.

    Java's format rounds the shortest decimal form half up instead: 12.35 (a little less in binary) and 12.25 differ.
    x * 10^places is split into its rounded product and the error of that, so that the tie test is exact.
    """
    scale = float(10**places)

    def parts(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return F.struct(F.floor(v * scale).alias("k"), ((v * scale - F.floor(v * scale) - 0.5) + ((high * scale - v * scale) + (v - high) * scale)).alias("over"))

    def text(c: Column) -> Column:
        n = c["k"] + F.when((c["over"] > 0) | ((c["over"] == 0) & (c["k"] % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % int(scale)).cast("string"), places, "0"))

    x = x.cast("double")
    whole = F.abs(x) >= 1e13  # no decimals are lost there
    return F.when(whole | F.isnan(x), F.format_string(f"%.{places}f", x)).when(
        x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), bound(F.abs(x), lambda v: bound(parts(v), text)))
    )


def format_bytes(n: Column, largest: str = "PB") -> Column:
    """1024 steps up to the unit `largest`, always one decimal."""
    chain, scale = None, 1.0
    for unit in _UNITS[: _UNITS.index(largest)]:
        text = F.concat(fixed(n.cast("double") / scale), F.lit(f" {unit}"))
        test = F.abs(n.cast("double")) / scale < 1024.0
        chain = F.when(test, text) if chain is None else chain.when(test, text)
        scale *= 1024.0
    text = F.concat(fixed(n.cast("double") / scale), F.lit(f" {largest}"))
    return text if chain is None else chain.when(n.isNotNull(), text)


def bytes_text(n: float) -> str:
    for unit in _UNITS[:-1]:
        if abs(n) < 1024.0:
            return f"{n:.1f} {unit}"
        n /= 1024.0
    return f"{n:.1f} {_UNITS[-1]}"


def format_percent(ratio: Column, places: int = 1) -> Column:
    return F.concat(fixed(ratio.cast("double") * 100, places), F.lit("%"))


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    text = lambda x, unit: F.concat(fixed(x), F.lit(f" {unit}"))
    return F.when(s < 60, text(s, "seconds")).when(s < 3600, text(s / 60, "minutes")).otherwise(text(s / 3600, "hours"))


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.when(n == 1, F.lit(singular)).otherwise(F.lit(plural or singular + "s"))


def format_count(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), pluralize(n, singular, plural))


def oxford_comma(items: Column, conjunction: str = "and") -> Column:
    """'a', 'a and b', 'a, b, and c' of an array of strings."""
    n = F.size(items)
    return (
        F.when(n <= 0, "")
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.concat_ws(f" {conjunction} ", items))
        .otherwise(F.concat(F.concat_ws(", ", F.slice(items, 1, F.greatest(n - 1, F.lit(0)))), F.lit(f", {conjunction} "), F.get(items, n - 1)))
    )


def oxford_text(items: list[str], conjunction: str = "and") -> str:
    if len(items) < 3:
        return f" {conjunction} ".join(items)
    return f"{', '.join(items[:-1])}, {conjunction} {items[-1]}"


def truncate_list(items: Column, most: int = 5) -> Column:
    n = F.size(items)
    return F.when(n <= most, oxford_comma(items)).otherwise(
        F.concat(F.concat_ws(", ", F.slice(items, 1, most)), F.lit(", and "), (n - most).cast("string"), F.lit(" more"))
    )


class Affordance(Enum):
    """What one can do with data, as prose."""

    INDEXABLE = "access by index or key"
    SLICEABLE = "take ranges or slices"
    ITERABLE = "iterate over items"
    SEARCHABLE = "search contents"
    EXPANDABLE = "drill into nested structure"
    SORTABLE = "sort"
    FILTERABLE = "filter"
    GROUPABLE = "group by values"
    AGGREGATABLE = "compute aggregates"
    JOINABLE = "join with other data"
    PLOT_LINE = "plot as line chart"
    PLOT_BAR = "plot as bar chart"
    PLOT_SCATTER = "plot as scatter plot"
    PLOT_HISTOGRAM = "plot as histogram"
    PLOT_HEATMAP = "plot as heatmap"
    MAPPABLE = "display on map"
    EXPORTABLE = "export to file"
    DOWNLOADABLE = "download"
    SERIALIZABLE = "serialize to JSON"
    EDITABLE = "edit values"
    APPENDABLE = "add items"
    CALLABLE = "call or invoke"
    RENDERABLE = "render as formatted content"
    PLAYABLE = "play as audio or video"
    DISPLAYABLE = "display as image"


def affordances_text(found: list[Affordance]) -> str:
    return f"You can {oxford_text([a.value for a in found[:6]], 'or')}." if found else ""


#: Widget and how prose calls it.
WIDGETS = {
    "table": "a table",
    "json_tree": "a collapsible JSON tree",
    "line_chart": "a line chart",
    "bar_chart": "a bar chart",
    "scatter_plot": "a scatter plot",
    "histogram": "a histogram",
    "heatmap": "a heatmap",
    "image": "an image viewer",
    "image_grid": "an image grid",
    "map": "an interactive map",
    "network_graph": "a network diagram",
    "code_editor": "a code editor with syntax highlighting",
    "markdown": "rendered markdown",
    "form": "an editable form",
    "audio_player": "an audio player",
    "video_player": "a video player",
    "timeline": "a timeline",
    "tree": "a tree view",
    "figure": "an interactive figure",
}


@dataclass(frozen=True)
class ViewSuggestion:
    """A widget that suits the data: how sure, why, and with what settings."""

    widget: str
    confidence: float
    reason: str
    config: dict = field(default_factory=dict)


def views_text(found: list[ViewSuggestion | str]) -> str:
    """The best widget first, at most two alternatives."""
    names = [WIDGETS.get(w, w) for w in (v.widget if isinstance(v, ViewSuggestion) else v for v in found)]
    if not names:
        return ""
    best, *others = names
    return f"Best displayed as {best}, or alternatively {oxford_text(others[:2], 'or')}." if others else f"Best displayed as {best}."


def affordances_of(kind: T.DataType) -> list[Affordance]:
    """What one can do with a column of a type."""
    a = Affordance
    if isinstance(kind, T.StructType):
        return [a.INDEXABLE, a.EXPANDABLE, a.SERIALIZABLE]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return [a.INDEXABLE, a.ITERABLE, a.EXPANDABLE, a.SERIALIZABLE]
    if isinstance(kind, T.NumericType):
        return [a.SORTABLE, a.FILTERABLE, a.AGGREGATABLE, a.PLOT_HISTOGRAM]
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [a.SORTABLE, a.FILTERABLE, a.GROUPABLE, a.PLOT_LINE]
    if isinstance(kind, T.BinaryType):
        return [a.DOWNLOADABLE]
    return [a.SEARCHABLE, a.SORTABLE, a.FILTERABLE, a.GROUPABLE]


def views_of(kind: T.DataType) -> list[ViewSuggestion]:
    """Widgets that suit a column of a type, the surest first."""
    if isinstance(kind, (T.StructType, T.MapType, T.VariantType)):
        return [ViewSuggestion("json_tree", 0.9, "nested fields"), ViewSuggestion("table", 0.5, "fields as columns")]
    if isinstance(kind, T.ArrayType):
        return [ViewSuggestion("table", 0.6, "a row an element"), ViewSuggestion("json_tree", 0.5, "nested elements")]
    if isinstance(kind, T.NumericType):
        return [ViewSuggestion("histogram", 0.9, "numbers"), ViewSuggestion("table", 0.5, "values")]
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [ViewSuggestion("timeline", 0.9, "points in time"), ViewSuggestion("line_chart", 0.6, "counts over time")]
    return [ViewSuggestion("bar_chart", 0.6, "counts of values"), ViewSuggestion("table", 0.5, "values")]


def markdown(header: list[str], rows: list[list[str]]) -> str:
    """Rows as a Markdown table; bars inside cells are escaped."""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(header), "|" + "---|" * len(header), *map(line, rows)])
