"""A chunk table bucketed by file and sorted by chunk: windows, one-file reads and the insert's anti-join do not shuffle it.

A file's chunks are in one bucket, in order. Spark keeps the layout in its catalog, under a name made from the path; a new session
declares the table again from the layout that is written beside it. A read of one file opens one bucket; joins and windows by
file take the buckets as they are; a join by file and chunk does too while ALL_KEYS is off, which new_rows() sets for the session.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ledger import Folder
from ..plans.schema import CHUNKS

ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class ClusteredTable:
    """The table at a path. buckets: for a new table; about one for each 128 MB that it will hold."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        layout = Folder(spark, f"{self.path}/_layout")
        if not layout.put_new("buckets.json", json.dumps({"buckets": buckets})):
            buckets = json.loads(layout.read("buckets.json"))["buckets"]
        self.buckets = buckets
        self.name = f"chunks_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        if not spark.catalog.tableExists(self.name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNKS.fields)
            place = self.path.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (file_path) SORTED BY (file_path, chunk_index) INTO {buckets} BUCKETS LOCATION '{place}'")

    def frame(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Write rows as they are; one task for each bucket."""
        columns = [f.name for f in CHUNKS.fields]
        dealt = rows.select(*columns).repartition(self.buckets, "file_path")
        writer = dealt.write.format("parquet").bucketBy(self.buckets, "file_path").sortBy("file_path", "chunk_index").mode("append")
        writer.option("path", self.path).saveAsTable(self.name)

    def new_rows(self, rows: DataFrame) -> DataFrame:
        """The first row of each key that the table does not hold, as indexing.new_rows: only rows are shuffled, by file."""
        self.spark.conf.set(ALL_KEYS, "false")
        keys = ["file_path", "chunk_index"]
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        once = rows.repartition(self.buckets, "file_path").withColumn("n", first).where("n = 1").drop("n")
        return once.join(self.frame().select(*keys), keys, "left_anti").select(*[f.name for f in CHUNKS.fields])

    def insert(self, rows: DataFrame) -> None:
        self.append(self.new_rows(rows))
