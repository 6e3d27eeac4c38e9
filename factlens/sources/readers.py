"""Files as DataFrames by their ending, and tables as files."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.sources.sniff import HEAD, read_files

TEXT_LIMIT = 10_000


class RefusedError(ValueError):
    """A file that could run code when read."""


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).option("sep", separator).csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.option("multiLine", not lines).json(path)


def read_text(spark: SparkSession, path: str, limit: int = TEXT_LIMIT) -> DataFrame:
    """path, text, truncated: whole files as UTF-8, else Latin-1; cut at `limit` characters with a mark."""
    head = F.col("head")
    utf8 = lambda c: F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
    # a character cut at the end of the head doesn't make the text Latin-1
    cut_off = [F.when(F.length(head) >= HEAD, utf8(F.substring(head, F.lit(1), F.length(head) - k))) for k in range(1, 4)]
    t = read_files(spark, path).select("path", "length", F.coalesce(utf8(head), *cut_off, F.decode(head, "ISO-8859-1")).alias("text"))
    cut = (F.length("text") > limit) | (F.col("length") > HEAD)
    return t.select("path", F.when(cut, F.concat(F.substring("text", 1, limit), F.lit(f"\n... (file truncated at {limit} characters)"))).otherwise(F.col("text")).alias("text"), cut.alias("truncated"))


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole files; one of over 2 GiB is an error of Spark's, never a row less."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_numpy(spark: SparkSession, path: str) -> DataFrame:
    """path, name, dtype, shape, values (as doubles, in C order): the array of a .npy file (without a name), each array of
    a .npz file; object arrays are refused."""

    def arrays(content):
        found = np.load(io.BytesIO(content), allow_pickle=False)
        return [(None, found)] if isinstance(found, np.ndarray) else [(n, found[n]) for n in found.files]

    def load(batches):
        for b in batches:
            rows = [(p, n, str(a.dtype), list(a.shape), a.astype(float).ravel()) for p, c in zip(b["path"], b["content"], strict=True) for n, a in arrays(c)]
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape", "values"])

    return _contents(spark, path).mapInPandas(load, "path string, name string, dtype string, shape array<long>, values array<double>")


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """origin, width, height, nChannels, mode, data by Spark's image source; what its Java readers can't decode (WebP) has
    a width of -1 and no data."""
    return spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.mode", "image.data")


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """name, shape, dtype of the datasets in HDF5 files; needs h5py on the executors."""
    import h5py  # noqa: F401, PLC0415  absent: the error says so here rather than on an executor

    def load(batches):
        import h5py  # noqa: PLC0415

        for b in batches:
            found = []
            for p, c in zip(b["path"], b["content"], strict=True):
                with h5py.File(io.BytesIO(c), "r") as f:
                    f.visititems(lambda n, o, p=p: found.append((p, n, list(o.shape), str(o.dtype))) if isinstance(o, h5py.Dataset) else None)  # noqa: B023
            yield pd.DataFrame(found, columns=["path", "name", "shape", "dtype"])

    return _contents(spark, path).mapInPandas(load, "path string, name string, shape array<long>, dtype string")


def _refuse_pickle(spark: SparkSession, path: str) -> DataFrame:
    raise RefusedError(f"{path}: a pickle runs code when it is loaded; sniff_files lists what it would import")


#: Endings and their readers.
READERS = {
    ".csv": read_csv,
    ".tsv": lambda s, p: read_csv(s, p, "\t"),
    ".json": read_json,
    ".jsonl": lambda s, p: read_json(s, p, lines=True),
    ".ndjson": lambda s, p: read_json(s, p, lines=True),
    ".parquet": lambda s, p: s.read.parquet(p), ".pq": lambda s, p: s.read.parquet(p),
    ".orc": lambda s, p: s.read.orc(p),
    ".txt": read_text, ".md": read_text, ".log": read_text,
    ".npy": read_numpy, ".npz": read_numpy,
    ".png": read_image, ".jpg": read_image, ".jpeg": read_image, ".gif": read_image, ".bmp": read_image,
    ".tiff": read_image, ".tif": read_image, ".webp": read_image,
    ".h5": read_hdf5, ".hdf5": read_hdf5,
    ".pkl": _refuse_pickle, ".pickle": _refuse_pickle,
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """A file or directory of files by the path's ending; unknown endings are read as text."""
    ending = next((e for e in READERS if path.lower().rstrip("/").endswith(e)), ".txt")
    return READERS[ending](spark, path)


def export_descriptions(descriptions: DataFrame, path: str, as_json: bool = False) -> None:
    """(name, content, ...) rows as files: JSON lines, or text lines with the name in front."""
    if as_json:
        descriptions.write.mode("overwrite").json(path)
    else:
        descriptions.select(F.concat_ws(": ", "name", "content").alias("value")).write.mode("overwrite").text(path)
