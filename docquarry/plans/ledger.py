"""A record of what has been written beside a table: numbered entries, each written once, and a lock for writers.

Folders that begin with _ are no part of a Parquet table for Spark, so ledger, lock and indexes can lie in the table's own folder.
"""

from __future__ import annotations

import contextlib
import json
import os
import socket
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.markdown import is_local, local_path


class Conflict(RuntimeError):
    """Another writer has added the entry first."""


class Busy(RuntimeError):
    """Another writer holds the lock."""


class Folder:
    """Small files of a folder on any store that Spark opens."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.store = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self) -> list[str]:
        if not self.store.exists(self.root):
            return []
        return sorted(s.getPath().getName() for s in self.store.listStatus(self.root))

    def read(self, name: str) -> str:
        stream = self.store.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file whole, unless there is one of that name: then False. Safe against others on local disks and on stores whose
        rename refuses an existing name, as HDFS does."""
        part = f".{name}.{uuid.uuid4().hex}"
        out = self.store.create(self._at(part), False)
        out.write(text.encode())
        out.close()
        try:
            if is_local(self.path):
                base = local_path(self.path)
                try:
                    os.link(f"{base}/{part}", f"{base}/{name}")
                except FileExistsError:
                    return False
                except OSError:  # a file system without links
                    with contextlib.suppress(FileExistsError), open(f"{base}/{name}", "x") as f:
                        f.write(text)
                        return True
                    return False
                return True
            return not self.store.exists(self._at(name)) and bool(self.store.rename(self._at(part), self._at(name)))
        finally:
            self.store.delete(self._at(part), False)

    def delete(self, name: str) -> None:
        self.store.delete(self._at(name), True)


class Generations:
    """An index in parts: each addition is a folder of its own, which counts from the moment that its entry is in the ledger.

    What a failed writer leaves is never read. An entry may stand for all before it (`replaces`), after compaction.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Folder(spark, f"{self.path}/_log")
        self._read: tuple | None = None

    def _all(self) -> list[dict]:
        return [json.loads(self.log.read(n)) for n in self.log.names() if n.endswith(".json")]

    def entries(self) -> list[dict]:
        found = self._all()
        first = max((e["number"] for e in found if e.get("replaces")), default=0)
        return [e for e in found if e["number"] >= first]

    def high(self) -> int:
        """The first id that is not covered."""
        return max((e["high"] for e in self._all()), default=0)

    def record(self, **facts) -> None:
        number = len(self._all())
        if not self.log.put_new(f"{number:012d}.json", json.dumps({"number": number, **facts})):
            raise Conflict(f"entry {number} of {self.path} has been added by another writer")

    def add(self, rows: DataFrame, high: int, partition: str, **facts) -> None:
        name = f"g=x{uuid.uuid4().hex}"
        rows.write.partitionBy(partition).parquet(f"{self.path}/{name}")
        self.record(folder=name, high=high, **facts)

    def read(self, schema: str) -> DataFrame | None:
        folders = [f"{self.path}/{e['folder']}" for e in self.entries() if e.get("folder")]
        if self._read is None or self._read[0] != (schema, folders):  # files of an addition never change, so they are listed once
            self._read = (schema, folders), self._open(schema, folders)
        return self._read[1]

    def _open(self, schema: str, folders: list[str]) -> DataFrame | None:
        return self.spark.read.schema(f"{schema}, g string").option("basePath", self.path).parquet(*folders).drop("g") if folders else None

    def forget(self) -> None:
        """Delete the folders that compaction has replaced; for when no search of before is running any more."""
        kept = {e.get("folder") for e in self.entries()}
        own = Folder(self.spark, self.path)
        for name in own.names():
            if name.startswith("g=") and name not in kept:
                own.delete(name)


class Counts:
    """How many chunks and files a table holds, kept in its folder `_stats`: an entry for each append.

    An entry also names how many data files the table has after it. If that is not what the folder holds (a writer ended between
    its append and its entry, or another program wrote), the counts are not used.
    """

    def __init__(self, spark: SparkSession, table: str):
        self.data = Folder(spark, table)
        self.parts = Generations(spark, f"{table.rstrip('/')}/_stats")

    def _files(self) -> int:
        return sum(n.endswith(".parquet") for n in self.data.names())

    def add(self, chunks: int, files: int) -> None:
        self.parts.record(high=0, chunks=chunks, files=files, parts=self._files())

    def reset(self, chunks: int, files: int) -> None:
        self.parts.record(high=0, chunks=chunks, files=files, parts=self._files(), replaces=True)

    def known(self) -> tuple[int, int] | None:
        """Chunks and files, or None if they have to be counted."""
        entries = self.parts.entries()
        if (entries[-1]["parts"] if entries else 0) != self._files():
            return None
        return sum(e["chunks"] for e in entries), sum(e["files"] for e in entries)


@contextlib.contextmanager
def writing(spark: SparkSession, path: str):
    """One writer at a time to the table at path; Busy for a second one, which says whose lock it is.

    A lock that a killed writer left is deleted by hand: the file _writer in the table's folder.
    """
    folder = Folder(spark, path)
    who = {"host": socket.gethostname(), "process": os.getpid(), "since": int(time.time())}
    if not folder.put_new("_writer", json.dumps(who)):
        with contextlib.suppress(Exception):  # it may be gone by now
            who = folder.read("_writer")
        raise Busy(f"another writer holds {path}/_writer: {who}")
    try:
        yield
    finally:
        folder.delete("_writer")
