"""Sources: a folder of markdown files, the chunk table, literal samples."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize_utf8

FILES = "file_path string, path string"
READ = "file_path string, raw binary, error string"


def is_local(root: str) -> bool:
    return urlsplit(root).scheme in ("", "file")


def local_path(root: str) -> str:
    """An absolute path of a local root, which may be relative or a file: URI."""
    return os.path.abspath(root.removeprefix("file://").removeprefix("file:") if root.startswith("file:") else root)


def read(files: DataFrame) -> DataFrame:
    """file_path, raw (null if unreadable), error of file_path, path. Executors open the files one at a time."""

    def bytes_of(path: str) -> bytes:
        if is_local(path):
            with open(local_path(path), "rb") as f:
                return f.read()
        store, inner = pyarrow.fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as f:
            return f.read()

    def run(batches):
        for batch in batches:
            for name, path in zip(batch.column("file_path").to_pylist(), batch.column("path").to_pylist(), strict=True):
                try:
                    row = (name, bytes_of(path), None)
                except OSError as e:
                    row = (name, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.string())], ["file_path", "raw", "error"])

    return files.mapInArrow(run, READ)


def opens(root: str) -> bool:
    """Whether pyarrow can list a root; else it is of a store that only Spark reads."""
    if is_local(root):
        return True
    try:
        pyarrow.fs.FileSystem.from_uri(root)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """file_path, raw (null if unreadable), error of the markdown files below a root that all executors see.

    The same files and paths for every kind of root. Of a store that only Spark reads, the listing is Hadoop's; files that
    Spark's reader leaves out (names that begin with _ or ., or in such folders) come with an error, not silently.
    """
    if opens(root):
        from .folders import files_below

        return read(files_below(spark, root))
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = store.makeQualified(base)
    start = len(top.toString().rstrip("/")) + 1
    names, folders = [], [top]
    while folders:
        for status in store.listStatus(folders.pop()):
            if status.isDirectory():
                folders.append(status.getPath())
            elif status.isFile() and status.getPath().getName().lower().endswith(".md"):
                names.append(status.getPath().toString()[start:])
    hidden = [n for n in names if any(part[0] in "_." for part in n.split("/"))]
    unread = spark.createDataFrame([(n, None, "Spark's reader skips names that begin with _ or .") for n in sorted(hidden)], READ)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top.toString()).where(F.lower("path").endswith(".md"))
    name = F.substring("path", start + 1, 1 << 30)
    return rows.select(name.alias("file_path"), F.col("content").alias("raw"), F.lit(None).cast("string").alias("error")).unionByName(unread)


def sanitized(raw: str) -> Column:
    return sanitize_utf8(raw)


def texts(files: DataFrame) -> DataFrame:
    """file_path, text: sanitized."""
    return files.where("raw is not null").select("file_path", sanitize_utf8("raw").alias("text"))


SAMPLES = [
    "This engine keeps documents as chunks of text with a vector for each.",
    "A search ranks chunks by cosine distance and by the words they share with the query.",
    "Rank fusion adds the reciprocal ranks of all lanes in which a chunk appears.",
    "Only the best chunk of a file is returned, with its neighbours as context.",
    "Indexing can be repeated at any time: what is there already stays as it is.",
    "Answers are written from the sources alone and cite them by number.",
]


def sample_chunks(spark: SparkSession) -> DataFrame:
    """Six sentences that stand in where there is no folder; they are embedded without a title."""
    rows = [("sample", i, s, s) for i, s in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, "file_path string, chunk_index int, content string, embed_text string")
