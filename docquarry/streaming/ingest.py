"""An extension: files that arrive in a folder are indexed by the batch indexer, micro-batch by micro-batch.

The source lists the folder as the batch scan does, in tasks and hidden names included, and gives the paths of all its files whenever
names have come, gone or changed; the indexer's anti-join leaves the new ones, and only these are read. So a batch that is run again
adds nothing, and stream and batch give a file the same path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import indexing
from ..sources.folders import MarkdownFolder, absolute


def watch(spark: SparkSession, folder: str, table: str, checkpoint: str, provider, language: str | None = "portuguese", **trigger):
    """Start a query that indexes *.md files under folder; trigger: e.g. availableNow=True."""
    spark.dataSource.register(MarkdownFolder)
    source = spark.readStream.format("markdown_folder").option("path", absolute(folder)).load()

    def batch(rows: DataFrame, _: int) -> None:
        indexing.index_files(rows.select("file_path", "path"), table, provider, language=language)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
