"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session of one machine gets one; a cluster's must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()  # the other way to name it
        if not found.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/docquarry/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str) -> DataFrame:
    """Write df once and read it back, so that nothing later plans or runs it again."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by store()."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docquarry/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            with contextlib.suppress(Exception):  # a leftover file is no error
                path.getFileSystem(conf).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has stored on the way; for when results have been read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/docquarry/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
