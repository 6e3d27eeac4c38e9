"""File sniffers and readers on files made byte by byte."""

import io
import json
import pickle
import sqlite3
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.sources import readers
from factlens.sources import sniff as S


def _jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03" + b"\0" * 9 + b"\xff\xd9"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    put = lambda n, b: (d / n).write_bytes(b)
    put("a.png", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 64, 32))
    put("a.gif", b"GIF89a" + struct.pack("<HH", 5, 6))
    put("a.bmp", b"BM" + b"\1\0\0\0" + b"\0\0\0\0" + b"\0" * 8 + struct.pack("<ii", 7, -8))
    put("BMnotes.txt", b"BM is a prefix of this text")
    put("a.jpg", _jpeg(100, 50))
    buffer = io.BytesIO()
    np.save(buffer, np.zeros((2, 3), np.float32))
    put("a.npy", buffer.getvalue())
    db = sqlite3.connect(d / "a.db")
    db.execute("CREATE TABLE t (x, y)")
    db.execute("INSERT INTO t VALUES (1, 2)")
    db.commit()
    db.close()
    with zipfile.ZipFile(d / "a.zip", "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("two.txt", "2")
    with tarfile.open(d / "a.tar", "w") as t:
        t.add(d / "a.gif", "inner.gif")
    with wave.open(str(d / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 8000 * 4)
    put("a.gz", b"\x1f\x8b\x08rest")
    put("a.h5", b"\x89HDF\r\n\x1a\nrest")
    put("a.pdf", b"%PDF-1.7\nrest")
    put("a.pkl", pickle.dumps(json.JSONDecoder, protocol=4))
    put("a.toml", b'[tool]\nname = "x"\n')
    put("a.json", b'{"a": 1}')
    put("a.jsonl", b'{"a": 1}\n{"a": 2}\n')
    put("a.yaml", b"a: 1\nb: 2\n")
    put("a.csv", b"x,y\n1,2\n3,4\n")
    put("a.html", b"<!doctype html><html><body>x</body></html>")
    put("a.txt", "just words and é so on\n".encode() * 5000)
    put("latin.txt", "caf\xe9".encode("latin-1"))
    put("a.dat", b"\x00\x01\x02\x03binary\x00")
    put("one", b"[1]")
    (d / "sub").mkdir()
    put("sub/b.txt", b"deep")
    return d


def test_sniffers(spark, folder):
    found = {r["name"]: r for r in S.sniff_files(spark, str(folder)).collect()}
    kinds = {n: r["kind"] for n, r in found.items()}
    want = {
        "a.png": "png", "a.gif": "gif", "a.bmp": "bmp", "BMnotes.txt": "text", "a.jpg": "jpeg", "a.npy": "npy", "a.db": "sqlite", "a.zip": "zip", "a.tar": "tar",
        "a.wav": "wav", "a.gz": "gzip", "a.h5": "hdf5", "a.pdf": "pdf", "a.pkl": "pickle", "a.toml": "toml", "a.json": "structured", "a.jsonl": "structured",
        "a.yaml": "structured", "a.csv": "structured", "a.html": "structured", "a.txt": "text", "latin.txt": "text", "a.dat": "unknown", "one": "structured", "b.txt": "text",
    }
    assert kinds == want
    facts, parsed = {n: r["facts"] for n, r in found.items()}, {n: json.loads(r["parsed"]) for n, r in found.items() if r["parsed"]}
    assert facts["a.png"] == {"width": "64", "height": "32"} and facts["a.gif"] == {"width": "5", "height": "6"} and facts["a.bmp"] == {"width": "7", "height": "8"}
    assert parsed["a.jpg"] == {"width": 100, "height": 50}
    assert facts["a.npy"]["dtype"] == "<f4" and facts["a.npy"]["shape"] == "(2, 3)"
    assert parsed["a.db"] == {"table_count": 1, "tables": {"t": {"columns": ["x", "y"], "rows": 1}}}
    assert parsed["a.zip"] == {"entry_count": 2, "entries": ["one.txt", "two.txt"]} and parsed["a.tar"]["entries"] == ["inner.gif"]
    assert parsed["a.wav"] == {"channels": 2, "sample_rate": 8000, "sample_width": 2, "frames": 8000, "duration": 1.0}
    assert facts["a.pdf"]["version"] == "1.7" and facts["a.pkl"]["protocol"] == "4" and parsed["a.pkl"]["globals"] == ["json.decoder.JSONDecoder"]
    assert parsed["a.toml"] == {"keys": ["tool"]}
    assert {n: facts[n]["text_format"] for n in ("a.json", "a.jsonl", "a.yaml", "a.csv", "a.html", "one")} == {"a.json": "json", "a.jsonl": "jsonl", "a.yaml": "yaml", "a.csv": "csv", "a.html": "html", "one": "json"}
    assert facts["a.txt"]["truncated"] == "true" and facts["latin.txt"]["preview"] == "café"
    assert facts["a.dat"]["first_bytes"] == "0001020362696e61"


def test_directory_and_registry(spark, folder):
    sniffed = S.sniff_files(spark, str(folder))
    tree = S.directory_tree(sniffed, str(folder), max_files=3).collect()
    assert [r["line"] for r in tree][:2] == ["sub/", "  b.txt (text, 4.0 B)"] and [r["relative"] for r in tree][2:] == ["BMnotes.txt", "a.bmp"]
    every = [r["relative"] for r in S.directory_tree(sniffed, str(folder)).collect()]
    assert every[:2] == ["sub", "sub/b.txt"] and every[2:] == sorted(p.name for p in folder.iterdir() if p.is_file())
    assert tuple(S.directory_counts(sniffed, str(folder)).first()) == (len(every) - 1, 1)
    assert S.directory_counts(sniffed).first()["n_dirs"] == 2
    assert S.read_files(spark, str(folder), pattern="*.csv").count() == 1
    names = {r["name"] for r in S.eligible(S.read_files(spark, str(folder))).select("name").collect()}
    assert "a.zip" not in names and "a.csv" in names
    r = S.SnifferRegistry()
    r.register(S.Sniffer("mine", lambda p, h: F.lower(p).endswith(".dat"), S._nothing, 200))
    got = {x["name"]: x["kind"] for x in S.sniff(S.read_files(spark, str(folder)), r).select("name", "kind").collect()}
    assert got["a.dat"] == "mine"
    r.unregister("mine")
    assert [s.name for s in r.sniffers()][-1] == "unknown"


def test_readers(spark, folder, tmp_path):
    assert readers.load(spark, str(folder / "a.csv")).columns == ["x", "y"]
    assert readers.load(spark, str(folder / "a.jsonl")).count() == 2
    t = readers.load(spark, str(folder / "a.txt")).first()
    assert t["truncated"] and t["text"].endswith("(file truncated at 10000 characters)")
    a = readers.load(spark, str(folder / "a.npy")).first()
    assert a["shape"] == [2, 3] and a["values"] == [0.0] * 6
    with pytest.raises(readers.RefusedError):
        readers.load(spark, str(folder / "a.pkl"))
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert readers.load(spark, str(tmp_path / "t.parquet")).count() == 3
    d = spark.createDataFrame([("a", "A text.")], "name string, content string")
    readers.export_descriptions(d, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "a: A text."


def test_pickles_are_never_loaded():
    assert S.pickle_globals(pickle.dumps(print, protocol=2)) == ["builtins.print"] or S.pickle_globals(pickle.dumps(print, protocol=2)) == ["__builtin__.print"]
    assert S.jpeg_size(b"\xff\xd8") is None


def test_describe_path(spark, folder):
    from factlens import describe_path

    assert describe_path(spark, str(folder / "a.png")).content == "'a.png': png file (24.0 B, 64x32)."
    deep = describe_path(spark, str(folder / "a.csv"), deep=True).content
    assert deep.startswith("'a.csv': csv file (12.0 B). A Spark DataFrame with 2 rows and 2 columns.")
    tree = describe_path(spark, str(folder)).content
    assert "files in 1 directories" in tree and "a.png" in tree and "sub/" in tree
    with pytest.raises(readers.RefusedError):
        describe_path(spark, str(folder / "a.pkl"), deep=True)


def test_large_and_odd_files(spark, tmp_path):
    from factlens import describe_path

    with open(tmp_path / "large.txt", "wb") as f:  # over 100 MB
        f.write(b"word " * 20_000)
        f.truncate(101_000_000)
        f.seek(100_999_990)
        f.write(b"the end...")
    (tmp_path / "zeros.log").write_bytes(b"line\n" * 20_200_000)
    found = {r["name"]: r for r in S.sniff_files(spark, str(tmp_path)).collect()}
    assert found["zeros.log"]["kind"] == "text" and found["zeros.log"]["size_bytes"] == 101_000_000
    assert found["large.txt"]["kind"] == "text"
    assert describe_path(spark, str(tmp_path / "zeros.log")).content == "'zeros.log': text file (96.3 MB)."
    assert "(2 files in 0 directories)" in describe_path(spark, str(tmp_path)).content
    t = readers.load(spark, str(tmp_path / "zeros.log")).first()
    assert t["truncated"] and t["text"].startswith("line\nline\n")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        describe_path(spark, str(tmp_path / "none.txt"))


def test_more_endings(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(3), y=np.ones((2, 2)))
    got = {r["name"]: (r["shape"], r["values"]) for r in readers.load(spark, str(tmp_path / "a.npz")).collect()}
    assert got == {"x": ([3], [0.0, 1.0, 2.0]), "y": ([2, 2], [1.0] * 4)}
    spark.range(4).write.parquet(str(tmp_path / "t.pq"))
    assert readers.load(spark, str(tmp_path / "t.pq")).count() == 4
    head = struct.pack("<4sI4s4sI", b"RIFF", 100, b"WAVE", b"LIST", 4) + b"INFO"
    (tmp_path / "odd.wav").write_bytes(head + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16) + struct.pack("<4sI", b"data", 8) + b"\0" * 8)
    assert json.loads(S.sniff_files(spark, str(tmp_path / "odd.wav")).first()["parsed"]) == {"channels": 1, "sample_rate": 8000, "sample_width": 2, "frames": 4, "duration": 0.001}


def test_files_that_only_spark_can_open(spark, folder, monkeypatch):
    monkeypatch.setattr(S, "OPENED", {})
    found = {r["name"]: r for r in S.sniff_files(spark, str(folder)).collect()}
    assert found["a.zip"]["kind"] == "zip" and json.loads(found["a.zip"]["parsed"])["entry_count"] == 2 and found["a.csv"]["kind"] == "structured"
    monkeypatch.setattr(S, "SPARK_LIMIT", 100)
    assert {r["name"]: r["kind"] for r in S.sniff_files(spark, str(folder)).collect()}["a.txt"] == "unread"
