"""A partitioned source of the markdown files below a folder: executors list it, the driver sees folders only.

A partition is a folder of its own, or a whole subtree, or a share of one: a folder with more than MOST_SEEN entries is not looked
through on the driver but walked by SHARES tasks, each of which takes the names whose checksum is its own. Of a store that pyarrow
opens the same holds, but a store has no cheap listing of the first names only, so there a folder's own names pass the driver once.
"""

from __future__ import annotations

import hashlib
import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .markdown import FILES, is_local, local_path

MOST_SEEN, SHARES = 20_000, 16
ROWS = 10_000  # names in an Arrow batch
SETTLED = 2.0  # seconds after which a folder's time of change tells of every change


@dataclass
class Part(InputPartition):
    """What a task lists: a folder below the root ('' is the root), with or without what is below it; of the names one share."""

    folder: str
    deep: bool
    share: int = 0
    shares: int = 1


def _markdown(name: str) -> bool:
    return name.lower().endswith(".md")


class Tree:
    """Listings of a root, local or of a store that pyarrow opens. Names that begin with _ or . count; errors are raised."""

    def __init__(self, root: str):
        self.local = is_local(root)
        if self.local:
            self.base = local_path(root)
        else:
            self.root = root.rstrip("/")
            self.store, base = pyarrow.fs.FileSystem.from_uri(root)
            self.base = base.rstrip("/")

    def _under(self, folder: str, name: str) -> str:
        return f"{folder}/{name}" if folder else name

    def path(self, name: str) -> str:
        return os.path.join(self.base, name) if self.local else f"{self.root}/{name}"

    def children(self, folder: str) -> Iterator[tuple[str, bool]]:
        """(name below the root, whether it is a folder), one at a time."""
        if self.local:
            with os.scandir(os.path.join(self.base, folder) if folder else self.base) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        yield self._under(folder, e.name), True
                    elif e.is_file():
                        yield self._under(folder, e.name), False
        else:
            for info in self.store.get_file_info(pyarrow.fs.FileSelector(f"{self.base}/{folder}" if folder else self.base)):
                yield self._under(folder, info.base_name), info.type == pyarrow.fs.FileType.Directory

    def files(self, part: Part) -> Iterator[str]:
        work = [part.folder]
        while work:
            for name, folder in self.children(work.pop()):
                if folder:
                    if part.deep:
                        work.append(name)
                elif _markdown(name) and zlib.crc32(name.encode()) % part.shares == part.share:
                    yield name

    def _first(self, folder: str) -> list[str] | None:
        """The folders in a folder; None if it has more entries than the driver looks at."""
        out = []
        for k, (name, inside) in enumerate(self.children(folder)):
            if k >= MOST_SEEN:
                return None
            if inside:
                out.append(name)
        return out

    def parts(self, wanted: int) -> list[Part]:
        """Partitions that cover the tree, about `wanted` of them if it has as many folders near its root."""
        done: list[Part] = []
        work = [""]
        while work and len(done) + len(work) < wanted:
            folder = work.pop(0)
            inside = self._first(folder)
            if inside is None:
                done += [Part(folder, True, k, SHARES) for k in range(SHARES)]
            else:
                done.append(Part(folder, False))
                work += sorted(inside)
        return done + [Part(folder, True) for folder in work]

    def state(self) -> str:
        """A digest that is another one when names have come, gone or changed.

        Local: of the folders' times of change, which every new name moves; one that is too young to be trusted makes the digest new.
        Else: of all names, sizes and times.
        """
        out = hashlib.sha256()
        if not self.local:
            for info in sorted(self.store.get_file_info(pyarrow.fs.FileSelector(self.base, recursive=True)), key=lambda i: i.path):
                if info.is_file and _markdown(info.path):
                    out.update(f"{info.path}\0{info.size}\0{info.mtime_ns}\0".encode())
            return out.hexdigest()
        work, newest = [""], 0
        while work:
            folder = work.pop()
            changed = os.stat(os.path.join(self.base, folder)).st_mtime_ns
            newest = max(newest, changed)
            out.update(f"{folder}\0{changed}\0".encode())
            work += sorted(name for name, inside in self.children(folder) if inside)
        if time.time() - newest / 1e9 < SETTLED:
            out.update(str(time.time_ns()).encode())
        return out.hexdigest()

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for name in self.files(part):
            names.append(name)
            if len(names) == ROWS:
                yield self._batch(names)
                names = []
        if names:
            yield self._batch(names)

    def _batch(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([self.path(n) for n in names])], ["file_path", "path"])


class MarkdownFolder(DataSource):
    """file_path, path of the markdown files below the option `path`; option `tasks`: how many partitions are wanted."""

    @classmethod
    def name(cls) -> str:
        return "markdown_folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("tasks", 64)))

    def streamReader(self, schema):
        return _Arrivals(self.options["path"], int(self.options.get("tasks", 64)))


class _Reader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self):
        return Tree(self.root).parts(self.tasks)

    def read(self, partition):
        return Tree(self.root).batches(partition)


class _Arrivals(DataSourceStreamReader):
    """All files of the folder whenever its state is another one; the table that takes them knows which are new."""

    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks
        self.last = {"state": "", "step": 0}

    def initialOffset(self) -> dict:
        return {"state": "", "step": 0}

    def latestOffset(self) -> dict:
        state = Tree(self.root).state()
        if state != self.last["state"]:
            self.last = {"state": state, "step": self.last["step"] + 1}
        return self.last

    def partitions(self, start: dict, end: dict):
        return Tree(self.root).parts(self.tasks)

    def read(self, partition):
        return Tree(self.root).batches(partition)


def absolute(root: str) -> str:
    """A root that means the same folder in every process."""
    return local_path(root) if is_local(root) else root


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """file_path, path of the markdown files below a root that pyarrow lists; listed by tasks."""
    spark.dataSource.register(MarkdownFolder)
    return spark.read.format("markdown_folder").option("path", absolute(root)).option("tasks", 2 * spark.sparkContext.defaultParallelism).load()
