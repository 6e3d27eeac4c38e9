"""What files are: one row per file, from their first 64 KiB.

Signatures are compared in one ordered CASE on Column expressions, with header numbers read in place. Archives,
databases, pickles, TOML and JPEG segments need a parser and go through an Arrow-batched function, which sees only files
of these kinds. Nothing is ever unpickled: pickles are listed by their opcodes.

Only the head of a file is read, whatever its size, and no file is left out. Where Python itself can open the files (local
or mounted paths, S3, Google storage), tasks read 64 KiB of each and parsers seek in the open file. Elsewhere Spark's reader
delivers the contents; a file too large for it (2 GiB) keeps its row, with a head of null and the kind `unread`.

Decisions: JSON is tried before TOML; BMP needs its reserved zero bytes besides `BM`; JSON lines and CSV files are
recognised; a UTF-8 character cut at the end of the head doesn't make the text Latin-1.
"""

from __future__ import annotations

import io
import json
import pickletools
import re
import sqlite3
import struct
import tarfile
import tempfile
import tomllib
import wave
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from factlens.functions import formats as formats_
from factlens.functions import strings
from factlens.functions.binary import begins, signed32, unsigned
from factlens.functions.formatting import format_bytes
from factlens.session import ship

HEAD = 65_536
MAX_LISTED = 10
#: Endings of files that aren't worth a description, and the largest size that eligible() lets through.
SKIPPED_ENDINGS = (
    ".exe", ".dll", ".so", ".dylib", ".bin", ".zip", ".tar", ".gz", ".bz2", ".7z",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".mp3", ".mp4", ".avi", ".mov", ".wav",
)
MAX_BYTES = 100_000_000
#: Spark holds a file's contents in one array.
SPARK_LIMIT = 2**31 - 65_536


@dataclass(frozen=True)
class Sniffer:
    """A kind of file: its test on (path, head) and its own facts as a map<string, string>."""

    name: str
    test: Callable[[Column, Column], Column]
    facts: Callable[[Column, Column], Column]
    priority: int = 100


def _map(**facts: Column) -> Column:
    return F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))])


def _nothing(path: Column, head: Column) -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _text(head: Column) -> Column:
    """The head as text: UTF-8 without a cut last character, else Latin-1; null with NUL or over 2 % control bytes."""
    whole = F.when(F.length(head) < HEAD, head)
    cut = [F.substring(head, F.lit(1), F.length(head) - k) for k in range(1, 4)]
    utf8 = F.coalesce(
        F.when(F.is_valid_utf8(head.cast("string")), head.cast("string")),
        *[F.when(whole.isNull() & F.is_valid_utf8(c.cast("string")), c.cast("string")) for c in cut],
    )
    latin = F.decode(head, "ISO-8859-1")
    control = F.length(latin) - F.length(F.regexp_replace(latin, r"[\x01-\x08\x0e-\x1f]", ""))
    plain = ~latin.contains("\x00") & (control <= 0.02 * F.greatest(F.length(head), F.lit(1)))
    return F.when(plain, F.coalesce(utf8, latin))


def _size(w: Column, h: Column) -> Column:
    return _map(width=w, height=h)


def _is_jsonl(t: Column) -> Column:
    lines = F.slice(F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: F.btrim(x) != ""), 1, 20)
    return (F.size(lines) >= 2) & F.forall(lines, strings.is_json)


def _npy(path: Column, head: Column) -> Column:
    header = F.decode(F.substring(head, 1, 1024), "ISO-8859-1")
    return _map(
        dtype=F.regexp_extract(header, r"'descr':\s*'([^']*)'", 1),
        shape=F.regexp_extract(header, r"'shape':\s*(\([^)]*\))", 1),
        fortran_order=F.regexp_extract(header, r"'fortran_order':\s*(\w+)", 1),
    )


def _is_toml(path: Column, head: Column) -> Column:
    t = _text(head)
    return F.coalesce(F.lower(path).endswith(".toml") | ((F.size(_parsed_by_line(t)) > 0) & ~formats_.json_facts(t).isNotNull() & ~formats_.looks_like_yaml(t)), F.lit(False))


def _parsed_by_line(t: Column) -> Column:
    """Lines that only TOML has: a table header or key = value, if every significant line is one."""
    lines = F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: ~x.rlike(r"^\s*(#.*)?$"))
    ok = F.forall(lines, lambda x: x.rlike(r"^\s*(\[\[?[A-Za-z0-9_.\"' -]+\]\]?|[A-Za-z0-9_.\"'-]+\s*=\s*\S.*)$"))
    return F.when(ok, lines).otherwise(F.array().cast("array<string>"))


def _structured(path: Column, head: Column) -> Column:
    t = _text(head)
    native = F.coalesce(formats_.json_facts(t)["format"], formats_.yaml_facts(t)["format"], F.when(formats_.is_html(t), F.lit("html")))
    return F.when(_is_jsonl(t), "jsonl").otherwise(F.coalesce(native, F.when(t.rlike(r"^\s*<[?A-Za-z]"), F.lit("xml")), F.when(_comma_table(t), F.lit("csv"))))


def _comma_table(t: Column) -> Column:
    """At least two lines, the first five with one positive count of the same separator."""
    lines = F.slice(F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: F.btrim(x) != ""), 1, 5)
    even = lambda sep: F.transform(lines, lambda x: F.size(F.split(x, sep)))
    same = lambda a: (F.size(F.array_distinct(a)) == 1) & (F.get(a, F.lit(0)) > 1)
    return (F.size(lines) >= 2) & (same(even(",")) | same(even("\t")) | same(even(";")) | same(even(r"\|")))


def _pickle(path: Column, head: Column) -> Column:
    return F.lower(path).rlike(r"\.(pkl|pickle)$") & F.substring(head, 1, 1).isin(*[bytearray(c) for c in (b"\x80", b"(", b"]", b"}", b"c")])


SNIFFERS = [
    Sniffer("png", lambda p, h: begins(h, b"\x89PNG\r\n\x1a\n"), lambda p, h: _size(unsigned(h, 16, 4), unsigned(h, 20, 4))),
    Sniffer("gif", lambda p, h: begins(h, b"GIF87a") | begins(h, b"GIF89a"), lambda p, h: _size(unsigned(h, 6, 2, True), unsigned(h, 8, 2, True))),
    Sniffer("bmp", lambda p, h: begins(h, b"BM") & begins(h, b"\0\0\0\0", 6), lambda p, h: _size(signed32(h, 18), F.abs(signed32(h, 22)))),
    Sniffer("jpeg", lambda p, h: begins(h, b"\xff\xd8\xff"), _nothing),
    Sniffer("npy", lambda p, h: begins(h, b"\x93NUMPY"), _npy),
    Sniffer("sqlite", lambda p, h: begins(h, b"SQLite format 3\0"), _nothing),
    Sniffer("zip", lambda p, h: begins(h, b"PK\x03\x04") | begins(h, b"PK\x05\x06") | begins(h, b"PK\x07\x08"), _nothing),
    Sniffer("tar", lambda p, h: begins(h, b"ustar", 257), _nothing),
    Sniffer("wav", lambda p, h: begins(h, b"RIFF") & begins(h, b"WAVE", 8), _nothing),
    Sniffer("gzip", lambda p, h: begins(h, b"\x1f\x8b"), _nothing),
    Sniffer("parquet", lambda p, h: begins(h, b"PAR1"), _nothing),
    Sniffer("hdf5", lambda p, h: begins(h, b"\x89HDF\r\n\x1a\n"), _nothing),
    Sniffer("pdf", lambda p, h: begins(h, b"%PDF-"), lambda p, h: _map(version=F.decode(F.substring(h, 6, 3), "ISO-8859-1"))),
    Sniffer("pickle", _pickle, lambda p, h: _map(protocol=F.when(begins(h, b"\x80"), unsigned(h, 1, 1)).otherwise(F.lit(0)))),
    Sniffer("toml", _is_toml, _nothing, 50),
    Sniffer("structured", lambda p, h: _structured(p, h).isNotNull(), lambda p, h: _map(text_format=_structured(p, h)), 50),
    Sniffer(
        "text",
        lambda p, h: _text(h).isNotNull(),
        lambda p, h: _map(lines=F.size(F.split(_text(h), "\n")), preview=F.substring(_text(h), 1, 200), truncated=F.length(h) >= HEAD),
        0,
    ),
    Sniffer("unknown", lambda p, h: F.lit(True), lambda p, h: _map(first_bytes=F.lower(F.hex(F.substring(h, 1, 8)))), -100),
]


class SnifferRegistry:
    """Sniffers by priority, then in the order of registration."""

    def __init__(self, sniffers=SNIFFERS):
        self._known = list(sniffers)

    def register(self, sniffer: Sniffer) -> None:
        if sniffer.name not in {s.name for s in self._known}:
            self._known.append(sniffer)

    def unregister(self, name: str) -> None:
        self._known = [s for s in self._known if s.name != name]

    def sniffers(self) -> list[Sniffer]:
        return sorted(self._known, key=lambda s: -s.priority)


REGISTRY = SnifferRegistry()


# ---- parsers, for kinds that need one ----------------------------------------------------------------------------


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the frame segment."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 1 if kind == 0xFF else 2 + size
    return None


def pickle_globals(data: bytes) -> list[str]:
    """Names that a pickle would import, found in its opcodes without running them."""
    found, texts = [], []
    try:
        for op, arg, _ in pickletools.genops(data):
            if op.name in ("GLOBAL", "INST") and arg:
                found.append(arg.replace(" ", "."))
            elif op.name == "STACK_GLOBAL" and len(texts) >= 2:
                found.append(".".join(texts[-2:]))
            if isinstance(arg, str):
                texts.append(arg)
    except Exception:  # noqa: BLE001  a head cut short ends the listing
        pass
    return sorted(set(found))


def _jpeg(f, head):
    size = jpeg_size(head)
    return {"width": size[0], "height": size[1]} if size else {}


def _zip(f, head):
    names = zipfile.ZipFile(f).namelist()
    return {"entry_count": len(names), "entries": names[:MAX_LISTED]}


def _tar(f, head):
    names = tarfile.open(fileobj=f).getnames()
    return {"entry_count": len(names), "entries": names[:MAX_LISTED]}


def _sqlite(f, head):
    with tempfile.NamedTemporaryFile(suffix=".db") as copy:  # a database is opened by name; the copy is this task's own
        while block := f.read(1 << 20):
            copy.write(block)
        copy.flush()
        db = sqlite3.connect(f"file:{copy.name}?mode=ro&immutable=1", uri=True)
        try:
            tables = {}
            for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"):
                q = '"' + name.replace('"', '""') + '"'
                tables[name] = {"columns": [r[1] for r in db.execute(f"PRAGMA table_info({q})")], "rows": db.execute(f"SELECT count(*) FROM {q}").fetchone()[0]}
        finally:
            db.close()
    return {"table_count": len(tables), "tables": tables}


def _toml(f, head):
    return {"keys": list(tomllib.loads(head.decode("utf-8")))[:MAX_LISTED]}


def _wave(f, head):
    with wave.open(f) as w:
        rate, frames = w.getframerate(), w.getnframes()
        return {"channels": w.getnchannels(), "sample_rate": rate, "sample_width": w.getsampwidth(), "frames": frames, "duration": round(frames / rate, 3) if rate else None}


PARSERS = {"jpeg": _jpeg, "zip": _zip, "tar": _tar, "sqlite": _sqlite, "pickle": lambda f, head: {"globals": pickle_globals(head)}, "toml": _toml, "wav": _wave}


# ---- reading -----------------------------------------------------------------------------------------------------

#: Schemes that Python opens by itself, and what its file systems call them.
OPENED = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}


def _open(path: str):
    """The file of one of the schemes in OPENED, for seeking and reading."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")  # noqa: SIM115
    from pyarrow import fs  # noqa: PLC0415

    system, inner = fs.FileSystem.from_uri(f"{OPENED[scheme]}:{rest}")
    return system.open_input_file(inner)


@F.pandas_udf(BinaryType())
def _head_of(paths: pd.Series) -> pd.Series:
    def one(path):
        try:
            with _open(path) as f:
                return f.read(HEAD)
        except OSError:  # gone since it was listed
            return None

    return pd.Series([one(p) for p in paths], dtype=object)


@F.pandas_udf(StringType())
def _parse(kind: pd.Series, path: pd.Series, head: pd.Series, content: pd.Series) -> pd.Series:
    def one(k, path, head, data):
        if k not in PARSERS or head is None:
            return None
        try:
            with io.BytesIO(data) if data is not None else _open(path) as f:
                return json.dumps(PARSERS[k](f, head))
        except (ValueError, OSError, KeyError, EOFError, struct.error, zipfile.BadZipFile, tarfile.TarError, sqlite3.Error, wave.Error) as e:
            return json.dumps({"error": f"{type(e).__name__}: {e}"[:200]})

    return pd.Series([one(*row) for row in zip(kind, path, head, content, strict=True)], dtype=object)


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path, name, length, head, content of all files; content is null where Python can open them, else head's source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    listed = files.select("path", "length")  # without contents
    first = listed.first()
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    if first is None or first["path"].split(":")[0] in OPENED:
        ship(spark)
        return listed.select("path", name, "length", _head_of("path").alias("head"), F.lit(None).cast("binary").alias("content"))
    small = files.filter(F.col("length") < SPARK_LIMIT).select("path", name, "length", F.substring("content", 1, HEAD).alias("head"), "content")
    none = F.lit(None).cast("binary")
    return small.union(listed.filter(F.col("length") >= SPARK_LIMIT).select("path", name, "length", none, none))


def eligible(files: DataFrame, max_bytes: int = MAX_BYTES, skip_endings=SKIPPED_ENDINGS) -> DataFrame:
    """The files that are small enough and of an ending that can be described."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.filter((F.col("length") <= max_bytes) & ~ending.isin(*skip_endings))


def sniff(files: DataFrame, registry: SnifferRegistry = REGISTRY) -> DataFrame:
    """path, name, length, head, content -> path, name, size_bytes, size, kind, facts, parsed (JSON of the parser's facts)."""
    ship(files.sparkSession)
    known = registry.sniffers()
    chain, facts = F.when(F.col("head").isNull(), "unread"), None
    for s in known:
        chain = chain.when(F.coalesce(s.test(F.col("path"), F.col("head")), F.lit(False)), s.name)
    kinds = files.withColumn("kind", chain)
    for s in known:
        own = s.facts(F.col("path"), F.col("head"))
        facts = F.when(F.col("kind") == s.name, own) if facts is None else facts.when(F.col("kind") == s.name, own)
    needs = F.col("kind").isin(*PARSERS)
    parsed = _parse(F.when(needs, F.col("kind")), F.when(needs, F.col("path")), F.when(needs, F.col("head")), F.when(needs, F.col("content")))
    return kinds.select("path", "name", F.col("length").alias("size_bytes"), format_bytes(F.col("length")).alias("size"), "kind", facts.alias("facts"), F.when(needs, parsed).alias("parsed"))


def sniff_files(spark: SparkSession, path: str, **how) -> DataFrame:
    return sniff(read_files(spark, path, **how))


def directory_tree(sniffed: DataFrame, root: str, max_depth: int = 3, max_files: int = 100) -> DataFrame:
    """(relative, depth, is_dir, line) of the directories and files under a root, to a depth: of each directory first its
    directories, then its files, by name; the first max_files files and the directories among them."""
    inner = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    parts = F.split("relative", "/")
    files = sniffed.withColumn("relative", inner).withColumn("parts", parts).withColumn("depth", F.size("parts"))
    what = F.concat(F.lit(" ("), F.col("kind"), F.lit(", "), F.col("size"), F.lit(")"))
    # names of directories sort before those of files, level by level; a directory before what is in it
    place = lambda parts, dirs: F.concat_ws("/", F.transform(parts, lambda p, i: F.concat(F.when(i < dirs, "0").otherwise("1"), p)))
    indent = lambda depth: F.repeat(F.lit("  "), depth - 1)
    leaves = files.filter(F.col("depth") <= max_depth).withColumn("place", place(F.col("parts"), F.col("depth") - 1))
    leaves = leaves.orderBy("place").limit(max_files).select("relative", "depth", F.lit(False).alias("is_dir"), "place", F.concat(indent(F.col("depth")), F.col("name"), what).alias("line"))
    levels = F.sequence(F.lit(1), F.greatest(F.least(F.size("parts") - 1, F.lit(max_depth)), F.lit(1)))
    above = files.select("parts", F.explode(F.when(F.size("parts") > 1, levels)).alias("d"))
    above = above.select(F.slice("parts", 1, F.col("d")).alias("own"), "d").distinct()
    dirs = above.select(F.concat_ws("/", "own").alias("relative"), F.col("d").alias("depth"), F.lit(True).alias("is_dir"), place(F.col("own"), F.col("d")).alias("place"), F.concat(indent(F.col("d")), F.get("own", F.col("d") - 1), F.lit("/")).alias("line"))
    last = leaves.agg(F.max("place").alias("last"), F.count("*").alias("n"))
    shown = dirs.join(F.broadcast(last)).filter(F.coalesce(F.col("place") <= F.col("last"), F.lit(True)) | (F.col("n") < max_files)).select(*leaves.columns)  # one row is broadcast
    return leaves.union(shown).orderBy("place").select("relative", "depth", "is_dir", "line")


def directory_counts(sniffed: DataFrame, root: str | None = None) -> DataFrame:
    """One row: files, and directories below the root that hold files, at whatever depth; without a root, all that do."""
    folder = F.regexp_extract("path", "^(.*)/", 1)
    if root is None:
        return sniffed.agg(F.count("*").alias("n_files"), F.count_distinct(folder).alias("n_dirs"))
    inner = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    parts = F.split(inner, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: F.concat_ws("/", F.slice(parts, 1, d)))
    every = sniffed.select(F.explode_outer(F.when(F.size(parts) > 1, dirs)).alias("d"), F.col("path").alias("p"))
    return every.agg(F.count_distinct("p").alias("n_files"), F.count_distinct("d").alias("n_dirs"))
