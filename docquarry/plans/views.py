"""The relations of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexing
from . import storage
from .schema import CHUNKS


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), (n - 1).cast("int").alias("chunk_index"), F.col("text").alias("content"), "embedding")


_STORED: dict[tuple[str, str], str] = {}


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_chunks with their words, as the chunk table that an index run writes: stored once for a session and a folder of tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        _STORED[key] = storage.new_folder(spark, "chunk-table")
        rows = vector_chunks(spark, sf_dir).withColumn("lexemes", lexing.lexemes(F.col("content")))
        rows.sortWithinPartitions("id").write.parquet(_STORED[key])
    return spark.read.schema(CHUNKS).parquet(_STORED[key])


def ordered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"))


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", "url")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_read(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


V1 = """v1 AS (
  SELECT doc_id AS id, source AS file_path, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chunk_index,
         text AS content, CAST(embedding AS DOUBLE[]) AS e
  FROM documents JOIN embeddings ON doc_id = vec_id
), qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
dist AS (SELECT id, file_path, chunk_index, content, list_cosine_distance(e, q) AS distance FROM v1, qv)"""

V2 = "v2 AS (SELECT CAST(conv_id AS VARCHAR) AS file_path, CAST(turn AS INTEGER) AS chunk_index, text AS content FROM conversations)"
