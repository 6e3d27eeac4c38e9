"""Queries over files that the query writes itself, byte by byte, with the facts that they must have as SQL values."""

from __future__ import annotations

import atexit
import io
import json
import pickle
import sqlite3
import struct
import tarfile
import tempfile
import uuid
import wave
import zipfile

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factlens.functions import binary
from factlens.plans.registry import query
from factlens.sources import readers, sniff


def _zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in ("one.txt", "two.txt", "three.txt"):
            z.writestr(n, n)
    return out.getvalue()


def _tarred() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n in ("left", "right"):
            t.addfile(tarfile.TarInfo(n), io.BytesIO())
    return out.getvalue()


def _sounded() -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(1)
        w.setframerate(4000)
        w.writeframes(b"\0" * 6000)
    return out.getvalue()


def _database() -> bytes:
    with tempfile.NamedTemporaryFile(suffix=".db") as f:  # on the driver; its bytes are then written to the shared folder
        db = sqlite3.connect(f.name)
        db.execute("CREATE TABLE city (name TEXT, people INTEGER)")
        db.executemany("INSERT INTO city VALUES (?, ?)", [("a", 1), ("b", 2), ("c", 3)])
        db.commit()
        db.close()
        return open(f.name, "rb").read()


def _array(**more) -> bytes:
    out = io.BytesIO()
    np.savez(out, **more) if more else np.save(out, np.arange(6, dtype=np.int32).reshape(2, 3))
    return out.getvalue()


def contents() -> dict[str, bytes]:
    """Names and bytes of one file of each kind."""
    return {
        "picture.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 300, 200),
        "picture.gif": b"GIF89a" + struct.pack("<HH", 31, 41),
        "picture.bmp": b"BM" + b"\1\0\0\0" + b"\0" * 12 + struct.pack("<ii", 59, -26),
        "picture.jpg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 53, 58) + b"\x03" + b"\0" * 9 + b"\xff\xd9",
        "numbers.npy": _array(),
        "places.db": _database(),
        "parts.zip": _zipped(),
        "parts.tar": _tarred(),
        "tone.wav": _sounded(),
        "packed.gz": b"\x1f\x8b\x08\0rest",
        "columns.parquet": b"PAR1....PAR1",
        "matrix.h5": b"\x89HDF\r\n\x1a\nrest",
        "paper.pdf": b"%PDF-1.5\nrest",
        "object.pkl": pickle.dumps(json.JSONDecoder, protocol=3),
        "settings.toml": b'title = "x"\n[server]\nport = 1\n',
        "record.json": b'{"a": 1, "b": [2]}',
        "records.jsonl": b'{"a": 1}\n{"a": 2}\n',
        "settings.yaml": b"name: x\nport: 1\n",
        "table.csv": b"x,y\n1,2\n3,4\n",
        "page.html": b"<!doctype html><html><body>x</body></html>",
        "notes.txt": b"three plain words\nand a second line",
        "latin.txt": "caf\xe9 au lait".encode("latin-1"),
        "opaque.dat": b"\x00\x01\x02\x03\x04\x05\x06\x07\x08",
        "long.log": b"0123456789" * 20_000,
        "deep/er/inner.txt": b"deep",
        "deep/other.md": b"# Title\n\nwords",
    }


_FOLDERS: dict[str, SparkSession] = {}


def _system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(spark: SparkSession) -> str:
    """A folder with these files where all executors see it: beside the checkpoints, or in local runs a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='factlens-')).rstrip('/')}/files-{uuid.uuid4().hex}"
    for name, data in contents().items():
        p, system = _system(spark, f"{folder}/{name}")
        out = system.create(p)
        out.write(data)
        out.close()
    _FOLDERS[folder] = spark
    return folder


@atexit.register
def _clear() -> None:
    for folder, spark in _FOLDERS.items():
        if spark.sparkContext._jsc is not None:  # else the session has ended; its owner clears the folder
            p, system = _system(spark, folder)
            system.delete(p, True)


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


#: name, kind, two telling facts: sizes and shapes of pictures and arrays, entries of archives, tables, formats of texts.
_KINDS = [
    ("picture.png", "png", "300", "200"), ("picture.gif", "gif", "31", "41"), ("picture.bmp", "bmp", "59", "26"), ("picture.jpg", "jpeg", "58", "53"),
    ("numbers.npy", "npy", "<i4", "(2, 3)"), ("places.db", "sqlite", "1", "city: name, people: 3"), ("parts.zip", "zip", "3", "one.txt, two.txt, three.txt"), ("parts.tar", "tar", "2", "left, right"),
    ("tone.wav", "wav", "2 x 4000 x 1", "3000 in 0.75"), ("packed.gz", "gzip", None, None), ("columns.parquet", "parquet", None, None), ("matrix.h5", "hdf5", None, None),
    ("paper.pdf", "pdf", "1.5", None), ("object.pkl", "pickle", "3", "json.decoder.JSONDecoder"), ("settings.toml", "toml", "title, server", None),
    ("record.json", "structured", "json", None), ("records.jsonl", "structured", "jsonl", None), ("settings.yaml", "structured", "yaml", None), ("table.csv", "structured", "csv", None),
    ("page.html", "structured", "html", None), ("notes.txt", "text", "2", "three plain words\nand a second line"), ("latin.txt", "text", "1", "caf\xe9 au lait"),
    ("opaque.dat", "unknown", "0001020304050607", None), ("long.log", "text", "1", "0123456789" * 20), ("inner.txt", "text", "1", "deep"), ("other.md", "text", "3", "# Title\n\nwords"),
]


@query("sniff_kinds", _values([(n, k, a, b, len(c)) for (n, k, a, b), c in zip(_KINDS, contents().values(), strict=True)], "name, kind, a, b, size_bytes").replace("SELECT *", "SELECT name, kind, a, b, size_bytes::BIGINT AS size_bytes", 1))
def sniff_kinds(spark, sf_dir):
    """What one file of each kind is, with two facts of it from its header or by its parser."""
    s = sniff.sniff_files(spark, written(spark))
    fact, parsed = lambda k: F.col("facts")[k], lambda p: F.get_json_object("parsed", "$." + p)
    listed = lambda p: F.array_join(F.from_json(parsed(p), "array<string>"), ", ")
    join = lambda sep, *parts: F.concat_ws(sep, *parts)
    kind = F.col("kind")
    a = (
        F.when(kind == "jpeg", parsed("width")).when(kind == "npy", fact("dtype")).when(kind == "sqlite", parsed("table_count")).when(kind.isin("zip", "tar"), parsed("entry_count"))
        .when(kind == "wav", join(" x ", parsed("channels"), parsed("sample_rate"), parsed("sample_width"))).when(kind == "pdf", fact("version")).when(kind == "pickle", fact("protocol"))
        .when(kind == "toml", listed("keys")).when(kind == "structured", fact("text_format")).when(kind == "text", fact("lines")).when(kind == "unknown", fact("first_bytes")).otherwise(fact("width"))
    )
    b = (
        F.when(kind == "jpeg", parsed("height")).when(kind == "npy", fact("shape")).when(kind == "sqlite", join(": ", F.lit("city"), listed("tables.city.columns"), parsed("tables.city.rows")))
        .when(kind.isin("zip", "tar"), listed("entries")).when(kind == "wav", join(" in ", parsed("frames"), parsed("duration"))).when(kind == "pickle", listed("globals"))
        .when(kind == "text", fact("preview")).otherwise(fact("height"))
    )
    return s.select("name", "kind", a.alias("a"), b.alias("b"), "size_bytes")


def _size_text(n: int) -> str:
    return f"{n / 1024:.1f} KB" if n >= 1024 else f"{n:.1f} B"


def _tree_rows() -> list[tuple]:
    every = contents()
    kinds = {n: k for n, k, _, _ in _KINDS}
    line = lambda n: "  " * n.count("/") + f"{n.split('/')[-1]} ({kinds[n.split('/')[-1]]}, {_size_text(len(every[n]))})"
    top = sorted(n for n in every if "/" not in n)
    lines = ["deep/", "  er/", line("deep/er/inner.txt"), line("deep/other.md"), *map(line, top)]
    return [(i, x) for i, x in enumerate(lines)]


@query("directory_tree", _values(_tree_rows(), "place, line").replace("SELECT *", "SELECT place::INTEGER AS place, line", 1))
def directory_tree(spark, sf_dir):
    """A folder as a tree: directories first, then files, by name."""
    from pyspark.sql import Window  # noqa: PLC0415

    folder = written(spark)
    tree = sniff.directory_tree(sniff.sniff_files(spark, folder), folder)
    rows = tree.withColumn("m", F.monotonically_increasing_id())
    return rows.select((F.row_number().over(Window.orderBy("m")) - 1).alias("place"), "line")  # a hundred files at most


@query("directory_counts", "SELECT 26::BIGINT AS n_files, 2::BIGINT AS n_dirs, 21::BIGINT AS n_eligible, 2::BIGINT AS n_text_files")
def directory_counts(spark, sf_dir):
    """Files and directories below a folder, the files that are worth a description, and those of a name pattern."""
    folder = written(spark)
    sniffed = sniff.sniff_files(spark, folder)
    every = sniff.read_files(spark, folder)
    return sniff.directory_counts(sniffed, folder).select(
        "n_files", "n_dirs", F.lit(sniff.eligible(every).count()).alias("n_eligible"), F.lit(sniff.read_files(spark, folder, pattern="*t*.txt").count()).alias("n_text_files")
    )


_LOADED = [
    ("table.csv", "x,y", 2), ("record.json", "a,b", 1), ("records.jsonl", "a", 2), ("notes.txt", "path,text,truncated", 1), ("numbers.npy", "path,name,dtype,shape,values", 1),
    ("long.log", "path,text,truncated", 1), ("picture.png", "origin,width,height,nChannels,mode,data", 1), ("object.pkl", "refused", 0),
]


@query("load_by_ending", _values(_LOADED, "name, columns, n_rows").replace("SELECT *", "SELECT name, columns, n_rows::BIGINT AS n_rows", 1))
def load_by_ending(spark, sf_dir):
    """Files read by their ending: their columns and rows; a pickle is refused."""
    folder, found = written(spark), []
    for name, _, _ in _LOADED:
        try:
            df = readers.load(spark, f"{folder}/{name}")
            found.append((name, ",".join(df.columns), df.count()))
        except readers.RefusedError:
            found.append((name, "refused", 0))
    return spark.createDataFrame(found, "name string, columns string, n_rows long")


@query("text_heads", "SELECT 10041::INTEGER AS length, true AS truncated, '... (file truncated at 10000 characters)' AS mark")
def text_heads(spark, sf_dir):
    """A long text file: its first 10,000 characters and a mark."""
    t = readers.load(spark, f"{written(spark)}/long.log")
    return t.select(F.length("text").alias("length"), "truncated", F.get(F.split("text", "\n"), F.lit(1)).alias("mark"))


@query(
    "magic_of_files",
    _values([(n, {"picture.png": "png", "picture.gif": "gif", "picture.jpg": "jpeg", "paper.pdf": "pdf", "parts.zip": "zip", "packed.gz": "gzip", "places.db": "sqlite"}.get(n.split("/")[-1])) for n in (k for k, _, _, _ in _KINDS)], "name, format"),
)
def magic_of_files(spark, sf_dir):
    """The signature at the start of each file, by the same rule as for binary columns."""
    return sniff.read_files(spark, written(spark)).select("name", binary.magic(F.col("head")).alias("format"))
