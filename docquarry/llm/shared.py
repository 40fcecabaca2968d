"""Helpers that the operators share: the cluster's common folder, stored tables, batches, components."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What a Python worker keeps from task to task (all have clear()); an operator that keeps nothing empties it, to leave room.
KEPT: list = []


def make_room() -> None:
    for held in KEPT:
        held.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session of one machine gets one; a cluster's must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/docquarry/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{_own_root(spark)}/{what}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has stored on the way; for when results have been read or written."""
    _delete(spark, _own_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    with contextlib.suppress(Exception):  # a leftover file is no error
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_lock, _storing = threading.Lock(), {}


@contextlib.contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Shuffle files go when their query ends; the session's own setting comes back when no thread of it stores any more."""
    key = id(spark._jsparkSession)
    with _lock:
        users, before = _storing.get(key, (0, None))
        if not users:
            before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _storing[key] = (users + 1, before)
    try:
        yield
    finally:
        with _lock:
            users, before = _storing.pop(key)
            if users > 1:
                _storing[key] = (users - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


def store(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts lineage: executors lost later need not recompute df. Its shuffle files are dropped once it is written.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    with _shuffle_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by store()."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docquarry/" in folder:
            _delete(df.sparkSession, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, typed, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pieces_of(batches, limit: int = 8 << 20):
    """Slices of Arrow batches (column 1: text) of at most about limit bytes each, at least one row."""
    for batch in batches:
        text = batch.column("text")
        start = total = 0
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Edges to a task in the rounds of components: small graphs are written as few files.
EDGES = 100_000


def components(edges: DataFrame, what: str = "links") -> DataFrame:
    """Connected components of an undirected graph by alternating large and small stars.

    edges: a, b (same orderable type). Result: node, component (the least node reachable), one row for each node that
    has an edge to another. Each round is a shuffle of the edges left and is stored, so lost executors cost one round.
    """
    now = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what
    )
    old = _digest(now)
    while True:
        tasks = -(-max(1, old[0]) // EDGES)  # no round has more edges than the one before
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(2 * tasks), what)
        # the large star: what is above u goes to the least of u and its neighbours. Both sides are stored tables, so that a
        # node with very many links is a skewed partition that adaptive execution splits
        large = now.join(least, now["b"] == least["u"]).select("a", F.col("m").alias("b")).distinct()
        # every a > b here; the small star links a node's lower neighbours, and itself, to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = (
            large.join(small, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .union(small.select("a", "m"))
            .distinct()
        )
        after = store(after.coalesce(tasks), what)
        new = _digest(after)
        drop(now)
        drop(least)
        now = after
        if old == new:
            break
        old = new
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)
