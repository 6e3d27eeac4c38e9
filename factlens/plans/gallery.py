"""A gallery of driver-side objects, one or more for each describer, with the texts that they must get.

Objects of libraries that may be absent are stand-ins: classes whose module is the library's, with what the describer asks.
"""

from __future__ import annotations

import asyncio
import dataclasses
import enum
import io
import pathlib
import re
import types
import uuid
from collections import Counter, OrderedDict, defaultdict, deque, namedtuple
from datetime import date, datetime, time, timedelta, timezone
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

from factlens.api import describe, redacted
from factlens.config import DescribeConfig, RedactionConfig
from factlens.plans.registry import query


def _stand_in(module: str, class_: str, /, **has):
    """An object of a class that says it is from `module`; functions in `has` become methods."""
    return type(class_, (), {"__module__": module, **has})()


@dataclasses.dataclass
class Stop:
    name: str
    zone: int


class Signal(enum.Enum):
    GO = 1
    WAIT = 2


Pair = namedtuple("Pair", "left right")


def area(width, height=1):
    """The area of a rectangle."""
    return width * height


def _cancelled():
    loop = asyncio.new_event_loop()
    f = loop.create_future()
    f.cancel()
    loop.close()
    return f


def _closed():
    async def wait():
        pass

    c = wait()
    c.close()
    return c


def _traceback():
    try:
        raise KeyError("gone")
    except KeyError as e:
        return e.__traceback__


def _libraries() -> list[tuple[str, object, str]]:
    ns, method = types.SimpleNamespace, lambda v: lambda self: v
    chart = {"mark": "bar", "encoding": {"x": {"field": "a"}}, "data": {"values": [1] * 9}}
    axes = _stand_in("matplotlib.axes._axes", "Axes", lines=[1], patches=[], collections=[], images=[], get_title=method("T"), get_xlabel=method("x"), get_ylabel=method("y"), get_xlim=method((0, 1)), get_ylim=method((0, 2)))
    text = ns(title=ns(text="T"))
    model = type("Model", (), {"__module__": "sklearn.linear_model._base", "get_params": lambda self: {"alpha": 0.5}, "fit": lambda self, x: self})
    fitted = model()
    fitted.coef_, fitted.n_features_in_, fitted.classes_ = [1.0], 2, ["a", "b"]
    steps = type("Pipeline", (), {"__module__": "sklearn.pipeline", "get_params": lambda self: {}, "fit": lambda self, x: self})()
    steps.steps = [("scale", model()), ("guess", fitted)]
    graph = {"number_of_nodes": method(4), "number_of_edges": method(3), "is_directed": method(False), "nodes": [1, 2, 3, 4], "edges": [(1, 2), (2, 3), (3, 4)]}
    data = type("Item", (), {"__module__": "shop", "model_fields": {"name": 0, "price": 0}, "name": "pen", "price": 2, "model_json_schema": classmethod(lambda cls: {"type": "object"})})
    weights = [ns(numel=lambda: 6, requires_grad=True), ns(numel=lambda: 4, requires_grad=False)]
    picture = lambda: _stand_in("PIL.Image", "Image", size=(40, 30), mode="L", format="PNG")
    tensor = lambda module, name: _stand_in(module, name, shape=(3, 2), dtype="float32", device="cpu", numpy=method(np.zeros((3, 2))))
    frame = {"schema": {"id": "Int64", "tag": "String"}, "shape": (2, 2), "head": lambda self, n: self, "to_dicts": method([{"id": 1, "tag": "a"}])}
    return [
        ("AD4 polars", _stand_in("polars.dataframe.frame", "DataFrame", **frame), "A Polars DataFrame with shape (2, 2). Schema: id (Int64), tag (String)."),
        ("AD4 polars lazy", _stand_in("polars.lazyframe.frame", "LazyFrame", collect_schema=method({"id": "Int64"}), explain=method("SCAN")), "A lazy Polars frame. Schema: id (Int64)."),
        ("AD5 matplotlib axes", axes, "A matplotlib axes with plotted elements."),
        ("AD5 matplotlib figure", _stand_in("matplotlib.figure", "Figure", axes=[axes, axes], get_size_inches=method((6.0, 4.0))), "A matplotlib figure with 2 subplots."),
        ("AD6 altair", _stand_in("altair.vegalite.v5.api", "Chart", to_dict=method(chart)), "An Altair chart with mark 'bar'."),
        ("AD7 seaborn", _stand_in("seaborn.axisgrid", "PairGrid"), "A seaborn PairGrid."),
        ("AD8 plotly", _stand_in("plotly.graph_objs._figure", "Figure", data=[ns(type="bar", name="b"), ns(type="scatter", name=None)], layout=text, frames=()), "A Plotly figure with 2 traces."),
        ("AD9 bokeh", _stand_in("bokeh.plotting._figure", "figure", renderers=[1, 2, 3], title=ns(text="T")), "A Bokeh figure with 3 renderers."),
        ("AD10 pipeline", steps, "A fitted sklearn Pipeline with 2 steps:\n1. 'scale': Model\n2. 'guess': Model\nExpects input shape (*, ?), outputs class predictions."),
        ("AD11 sklearn", fitted, "A sklearn model sklearn.linear_model._base.Model."),
        ("AD12 statsmodels", _stand_in("statsmodels.regression.linear_model", "Results", rsquared=0.9), "A statsmodels results object Results."),
        ("AD14 scipy", _stand_in("scipy.sparse._csr", "csr_matrix", format="csr", shape=(3, 4), nnz=2, data=np.array([1.0, 2.0])), "A csr sparse matrix with shape (3, 4)."),
        ("AD16 h5py", _stand_in("h5py._hl.dataset", "Dataset", name="/x", shape=(2,), dtype="int64", chunks=None, compression=None, __getitem__=lambda self, i: 7), "An HDF5 Dataset '/x' with shape (2,) and dtype int64. Sample: 7."),
        ("AD17 PIL", picture(), "A PIL image 40x30 in L mode."),
        ("AD17 PIL list", [picture(), picture()], "A list of 2 PIL images."),
        ("AD18 PyTorch tensor", tensor("torch", "Tensor"), "A PyTorch tensor with shape (3, 2)."),
        ("G27 model parameters", _stand_in("nets", "Net", parameters=lambda self: weights, forward=method(0)), "A PyTorch model nets.Net."),
        ("AD19 TensorFlow", tensor("tensorflow.python.framework.ops", "EagerTensor"), "A TensorFlow tensor with shape (3, 2)."),
        ("AD20 JAX", tensor("jaxlib._jax", "ArrayImpl"), "A JAX array with shape (3, 2)."),
        ("AD21 xarray", _stand_in("xarray.core.dataarray", "DataArray", sizes={"y": 2, "x": 3}, coords=["x"], attrs={}, values=np.zeros((2, 3))), "An xarray DataArray with dims {'y': 2, 'x': 3}."),
        ("AD22 Pydantic", data(), "A Pydantic model shop.Item."),
        ("AD23 NetworkX", _stand_in("networkx.classes.graph", "Graph", **graph), "A networkx graph with 4 nodes and 3 edges."),
        ("AD24 requests", _stand_in("requests.models", "Response", status_code=404, url="https://example.org/x", headers={"a": "b"}, content=b"no"), "An HTTP response with status 404."),
        ("AD30 attrs", type("Crate", (), {"__module__": "shop", "__attrs_attrs__": [ns(name="size"), ns(name="weight"), ns(name="label")], "size": 1, "weight": 2, "label": "x"})(), "An attrs class Crate with 3 attributes."),
        ("AD31 display", _stand_in("IPython.core.display", "HTML", _repr_html_=method("<b>"), _repr_markdown_=method("b")), "An IPython display object with representations: _repr_html_, _repr_markdown_."),
    ]


def _plain() -> list[tuple[str, object, str]]:
    frame = pd.DataFrame({"n": [2, 4, None], "s": ["x", "x", "y"]})
    wide = pd.DataFrame({f"c{i}": [i, i + 1] for i in range(30)})
    two = timezone(timedelta(hours=2), "EET")
    return [
        ("M9 none", None, "A None value (null or missing)."), ("M9 bool", True, "A boolean value: True."), ("M1 zero", 0, "An integer with value 0."), ("M2 year", 1984, "The integer 1984, likely a year."),
        ("M2 bit flag", 4096, "The integer 4096, likely a bit_flag."), ("M2 status", 404, "The integer 404, likely a http_status."), ("M2 timestamp", 1700000000, "The integer 1700000000, likely a timestamp_unix."),
        ("M2 exit code", 77, "The integer 77, likely a exit_code."), ("M2 port", 8443, "The integer 8443, likely a port_number."), ("M1 negative", -5, "An integer with value -5."),
        ("M4 percentage", 42.5, "A float 42.5, likely representing a percentage."), ("M3 plain float", 1234.5678, "A floating-point number with value 1234.5678."), ("M3 nan", float("nan"), "A floating-point number with value NaN."),
        ("M6 complex", 2 - 1j, "A complex number 2.0 + -1.0i."), ("M7 decimal", Decimal("-7.250"), "A Decimal value -7.250 with 4 digits of precision."), ("M8 fraction", Fraction(6, 8), "A Fraction 3/4."),
        ("T11 email", "ann@example.org", "A string containing a email: 'ann@example.org'."), ("T19 words", "blue sky", "A string 'blue sky' (8 characters)."), ("T20 prose", "word " * 30, "A prose document string (150 chars)."),
        ("AD1 JSON", '{"k": 1, "v": 2}', "A valid JSON string containing an object with keys: k, v."), ("AD1 XML", "<note><to/></note>", "A valid XML document with root <note>."), ("AD1 HTML", "<p>hi</p>", "An HTML document or fragment."),
        ("AD1 YAML", "k: 1\nv: 2\n", "A valid YAML string containing keys: k, v."),
        ("AD1 CSV", "k,v\n1,a\n2,b\n", "A CSV string with 3 rows and 2 columns (,-delimited). Header: 'k', 'v'. Sample: [\"'1'\", \"'a'\"]. Column types: int, str. Best displayed as sortable table."),
        ("B1 bytes", b"plain", "A bytes object of 5 bytes."), ("B2 gzip", b"\x1f\x8b\x08", "A bytes object containing gzip data (3 bytes)."),
        ("A1 list", ["a", 1], "A list of 2 items."), ("A1 ints", [5, 6, 7], "A list of 3 integers."), ("G18 records", [{"a": 1}, {"a": 2, "b": 3}], "A list of 2 records with 2 consistent fields."),
        ("G19 list of lists", [[1, 2], [3, 4], [5, 6]], "A 2D list with 3 rows."), ("A2 tuple", (1, 2), "A tuple of 2 elements."), ("A3 dict", {"a": 1, "b": [2]}, "A dict with 2 keys."),
        ("A4 ordered", OrderedDict(a=1), "A ordered_dict with 1 keys."), ("A4 default", defaultdict(int, a=1, b=2), "A defaultdict with 2 keys."), ("A5 counter", Counter("abba"), "A Counter with 2 unique elements totaling 4 observations."),
        ("A6 set", {3, 1}, "A set of 2 unique items."), ("A6 frozenset", frozenset("ab"), "A frozenset of 2 unique items."), ("L10 deque", deque("abcde"), "A deque of 5 items."),
        ("L11 range", range(3, 30, 4), "A range from 3 to 30 with step 4."), ("A10 generator", (x for x in "ab"), "A generator '<genexpr>' (active)."), ("A10 iterator", iter([1]), "An iterator (list_iterator)."),
        ("AD25 datetime", datetime(2023, 5, 6, 7, 8, 9), "A datetime: 2023-05-06T07:08:09. Timezone: naive. Saturday."), ("D1 zone", datetime(2023, 5, 6, 7, tzinfo=two), "A datetime: 2023-05-06T07:00:00+02:00. Timezone: EET. Saturday."),
        ("D2 date", date(2023, 5, 6), "A date: 2023-05-06. Saturday."), ("D3 time", time(9, 30), "A time: 09:30:00. Timezone: naive."), ("D4 duration", timedelta(days=1, seconds=5), "A duration of 1 days (86405 seconds)."),
        ("D4 short duration", timedelta(seconds=90), "A duration of 90 seconds."), ("D6 timestamp", pd.Timestamp("2023-05-06 07:08"), "A pandas Timestamp: 2023-05-06T07:08:00."),
        ("AD26 pure path", pathlib.PurePosixPath("a/b.txt"), "A pure path 'a/b.txt'."), ("AD26 missing path", pathlib.Path("/nowhere/at/all"), "A path '/nowhere/at/all' pointing to a non-existent location."),
        ("AD27 pattern", re.compile("(a)b", re.I), "A compiled regex pattern /(a)b/. Flags: IGNORECASE. 1 capturing groups."), ("AD27 match", re.search("b+", "abbc"), "A regex match result: matched 'bb' at position 1:3."),
        ("AD28 uuid", uuid.UUID("12345678-1234-4234-8234-123456789abc"), "A UUID (version 4): 12345678-1234-4234-8234-123456789abc."),
        ("AD29 text buffer", io.StringIO("abc"), "An in-memory text buffer of 3 characters."), ("AD29 bytes buffer", io.BytesIO(b"abcd"), "An in-memory bytes buffer of 4 bytes."),
        ("AD32 dataclass", Stop("x", 2), "A structured object of type dataclass."), ("AD32 namedtuple", Pair(1, 2), "A structured object of type namedtuple."), ("AD32 enum", Signal.GO, "A structured object of type enum."),
        ("AD33 function", area, "A callable function named area."), ("AD33 class", Stop, "A callable class named Stop."), ("AD33 module", re, "A callable module named re."),
        ("AD34 future", _cancelled(), "An async future in state cancelled."), ("AD34 coroutine", _closed(), "An async coroutine in state closed."),
        ("AD35 exception", KeyError("gone"), "An KeyError exception: ''gone''."), ("AD37 generic", object(), "An object of type object."),
        ("AD13 array", np.arange(7), "A numpy array with shape (7,) and dtype int64. Sample: [0, 1, 2, 3, 4 ... 2, 3, 4, 5, 6]."), ("L9 corner", np.arange(8.0).reshape(2, 4), "A numpy array with shape (2, 4) and dtype float64. Sample corner: [[0.0, 1.0, 2.0], [4.0, 5.0, 6.0]]."),
        ("P7 element budget", np.zeros(1001), "A numpy array with shape (1001,) and dtype float64."), ("A9 scalar", np.float32(1.5), "A numpy float32 scalar with value 1.5."),
        ("AD3 DataFrame", frame, "A pandas DataFrame with 3 rows and 2 columns. Nulls: 1. Memory: MEMORY. Columns: n (float64, 1 nulls, stats: range 2 to 4, mean 3, std 1.4), s (object, cardinality: 2 categories including 'x', 'y'). Sample row: {'n': '2.0', 's': \"'x'\"}."),
        ("P3 P4 columns", wide, "A pandas DataFrame with 2 rows and 30 columns. Nulls: 0. Memory: MEMORY. Columns: c0 (int64, stats: range 0 to 1, mean 0.5, std 0.71), c1 (int64, stats: range 1 to 2, mean 1.5, std 0.71), c2 (int64, stats: range 2 to 3, mean 2.5, std 0.71). Sample row: " + str({f"c{i}": str(i) for i in range(30)}) + "."),
        ("P6 cell budget", pd.DataFrame({"a": range(11)}), "A pandas DataFrame with 11 rows and 1 columns. Nulls: 0. Memory: MEMORY. Columns: a (int64, stats: range 0 to 10, mean 5, std 3.3). Sample rows omitted for size/perf."),
        ("G15 series", pd.Series([1.0, None, 3.0], name="p"), "A pandas Series 'p' with 3 values. Nulls: 1. Dtype: float64. Stats: range 1 to 3, mean 2, std 1.4. Sample: [1.0, nan, 3.0]."),
        ("G12 zeros", pd.Series([0.0, 0.0, 0.0, 4.0], name="z"), "A pandas Series 'z' with 4 values. Nulls: 0. Dtype: float64. Stats: range 0 to 4, mean 1, std 2 (75% zeros). Sample: [0.0, 0.0, 0.0, 4.0]."),
        ("G24 categorical", pd.Categorical(list("aab")), "A pandas Categorical with 2 categories."), ("G32 index", pd.Index([1, 2, 2]), "A pandas Index with 3 entries."), ("G33 multi-index", pd.MultiIndex.from_product([[1, 2], list("ab")]), "A pandas MultiIndex with 2 levels and 4 entries."),
        ("AD15 PyArrow", pa.table({"k": pa.array([1, 2], pa.int64())}), "A PyArrow Table with 2 rows and 1 columns. Schema: k (int64). Memory: 16.0 B. Sample row: {'k': '1'}."),
    ]


def _cell(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({_cell(n)}, {_cell(t)})' for n, _, t in [*_plain(), *_libraries()])}) t(name, text)"


@query("describe_objects", _sql())
def describe_objects(spark: SparkSession, sf_dir: str):
    """The description of each object of the gallery; sizes in memory, which differ between versions, are left out."""
    rows = [(n, re.sub(r"Memory: [0-9.]+ [KM]?B(?=\. Columns)", "Memory: MEMORY", describe(o).content)) for n, o, _ in [*_plain(), *_libraries()]]
    return spark.createDataFrame(rows, "name string, text string")


_FACTS = [
    ("altair", "data stripped", "True"), ("matplotlib", "labels", "x, y"), ("sklearn", "n_features", "2"), ("networkx", "density", "0.5"), ("torch", "parameters", "10 of which 6 trainable"), ("depth", "nested dict", "3"),
    ("heterogeneous", "types", "int 2, str 1"), ("deque", "ends", "0 1 2 | 7 8 9"), ("range", "ends", "0 3 6 | 3 6 9"), ("generic", "attributes", "go"), ("redacted", "text", "[REDACTED:EMAIL]"), ("field", "password", "[REDACTED:SENSITIVE_FIELD]"),
    ("compact", "sentences", "2"), ("minimal", "sentences", "1"), ("fallback", "adapter", "generic"), ("views", "numbers", "Best displayed as a histogram, or alternatively a table."), ("affordances", "texts", "You can search contents, sort, filter, or group by values."),
    ("markdown", "rows", "| a | b |\n|---|---|\n| 1 | x\\|y |"), ("adapter", "register", "mine generic"), ("profiles", "names", "brief default"), ("consumed", "iterator", "0 1 2"), ("scalar", "unwrapped", "7"),
]


@query("describe_facts", f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_cell, r)) + ')' for r in _FACTS)}) t(what, fact, value)")
def describe_facts(spark: SparkSession, sf_dir: str):
    """Facts beside the texts: of libraries' objects, nested values, limits, verbosity, redaction, registries and profiles."""
    from pyspark.sql import types as T  # noqa: PLC0415

    from factlens.config import Profiles  # noqa: PLC0415
    from factlens.functions import formatting  # noqa: PLC0415
    from factlens.objects import describers as D  # noqa: PLC0415
    from factlens.objects.render import scalar  # noqa: PLC0415

    objects = {n: o for n, o, _ in _libraries()}
    meta = lambda o, **how: describe(o, config=DescribeConfig(**how)).meta
    inner = lambda o, **how: meta(o, **how)["metadata"]
    axes, net = inner(objects["AD5 matplotlib axes"]), meta(objects["G27 model parameters"])
    frame = pd.DataFrame({"a": range(20)})
    secret = DescribeConfig(redact=RedactionConfig(enabled=True))
    broken = _stand_in("polars.dataframe.frame", "DataFrame")
    registry = D.Registry()
    registry.register(D.Describer("mine", lambda o: o == "mine", lambda o, c: {"nl_summary": "Mine."}, 10))
    first = D.dispatch("mine", DescribeConfig(), registry)["adapter_used"]
    registry.unregister("mine")
    profiles = Profiles()
    profiles.register("brief", DescribeConfig(verbosity="minimal"))
    words = lambda xs: " ".join(map(str, xs))
    deq, rng = inner(deque(range(10))), inner(range(0, 12, 3))
    found = [
        ("altair", "data stripped", str("data" not in inner(objects["AD6 altair"])["spec"])), ("matplotlib", "labels", f"{axes['xlabel']}, {axes['ylabel']}"), ("sklearn", "n_features", str(inner(objects["AD11 sklearn"])["n_features"])),
        ("networkx", "density", str(meta(objects["AD23 NetworkX"])["density"])), ("torch", "parameters", f"{net['parameter_count']} of which {net['metadata']['trainable']} trainable"),
        ("depth", "nested dict", str(inner({"a": {"b": {"c": {"d": 1}}}})["depth"])), ("heterogeneous", "types", ", ".join(f"{k} {v}" for k, v in sorted(inner([1, "a", 2])["type_distribution"].items()))),
        ("deque", "ends", f"{words(deq['front_sample'])} | {words(deq['back_sample'])}"), ("range", "ends", f"{words(rng['sample_start'])} | {words(rng['sample_end'])}"),
        ("generic", "attributes", words(inner(_stand_in("shop", "Cart", go=1))["attributes"])), ("redacted", "text", describe("ann@example.org", config=secret).content.split("'")[-2]),
        ("field", "password", redacted({"password": 1}, secret)[0]["password"]), ("compact", "sentences", str(describe(frame, config=DescribeConfig(verbosity="compact")).content.count(". ") + 1)),
        ("minimal", "sentences", str(describe(frame, config=DescribeConfig(verbosity="minimal")).content.count(". ") + 1)), ("fallback", "adapter", meta(broken)["adapter_used"]),
        ("views", "numbers", formatting.views_text(formatting.views_of(T.DoubleType()))), ("affordances", "texts", formatting.affordances_text(formatting.affordances_of(T.StringType()))),
        ("markdown", "rows", formatting.markdown(["a", "b"], [["1", "x|y"]])), ("adapter", "register", f"{first} {registry.names()[-1]}"), ("profiles", "names", words(profiles.names())),
        ("consumed", "iterator", words(inner(iter(range(3)), allow_iterator_consumption=True)["sample_items"])), ("scalar", "unwrapped", str(scalar(np.int64(7)))),
    ]
    return spark.createDataFrame(found, "what string, fact string, value string")
