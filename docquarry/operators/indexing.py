"""Indexing: files to chunks with titles, ids, lexemes and vectors, appended once.

Files are read, cleaned and cut once and stored; ids, vectors and counters come from what is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexing
from ..functions import text as T
from ..plans import ledger, storage
from ..plans.schema import CHUNKS
from ..sources import markdown
from ..sources.providers import ModelError, model_name
from . import retrieval
from .postings import TextIndex, TrigramIndex
from .vector_index import VectorIndex

KEY = ["file_path", "chunk_index"]
CALL = 64  # texts of a call to the model


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table; empty if it is not there yet."""
    if not any(n.endswith(".parquet") for n in ledger.Folder(spark, path).names()):
        return spark.createDataFrame([], CHUNKS)
    return spark.read.schema(CHUNKS).parquet(path)


def not_indexed(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files of which the table holds no chunk."""
    return files.join(existing.select("file_path").distinct(), "file_path", "left_anti")


def cleaned(texts: DataFrame) -> DataFrame:
    """texts with chunks: trimmed, short ones included; none of a blank or missing text."""
    chunks = F.transform(T.chunk_by_headers(T.clean_markdown(F.col("text"))), T.trim)
    return texts.withColumn("chunks", F.when(F.length(T.trim(F.col("text"))) > 0, chunks).otherwise(F.array().cast("array<string>")))


def numbered_chunks(cut: DataFrame) -> DataFrame:
    """file_path, chunk_index, content, embed_text of file_path, chunks; indices run from 0 without gaps."""
    kept = F.filter("chunks", lambda x: F.octet_length(x) >= T.MIN_CHUNK)
    rows = cut.select("file_path", F.posexplode(kept).alias("chunk_index", "content"))
    return rows.withColumn("embed_text", T.embed_text(T.path_to_title(F.col("file_path")), F.col("content")))


def split_chunks(texts: DataFrame) -> DataFrame:
    return numbered_chunks(cleaned(texts))


def with_ids(chunks: DataFrame, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """A stored table, to be dropped when the ids have been read, and chunks numbered from `first` in the order of file_path and chunk_index.

    The range-sorted rows are stored with their partition and place, so that counting and numbering see the same partitions;
    the driver gets one count for each partition.
    """
    rows = storage.store(chunks, "chunks")  # the range sort samples its input, so this is not computed twice
    dealt = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id())
    placed = storage.store(dealt, "placed-chunks")
    storage.drop(rows)
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.pid, r.n) for r in placed.groupBy(part.cast("int").alias("pid")).agg(F.count("*").alias("n")).collect())
    starts, at = [], first
    for pid, n in counts:
        starts.append((pid, at))
        at += n
    offsets = chunks.sparkSession.createDataFrame(starts, "pid int, base long")
    numbered = placed.join(F.broadcast(offsets), part == F.col("pid"))  # one row for each partition
    return placed, numbered.select((F.col("base") + within).alias("id"), *[c for c in chunks.columns if c != "id"])


def embed(chunks: DataFrame, provider, in_flight: int = 4) -> DataFrame:
    """chunks with an embedding of embed_text; null where the model fails on a row's own call too.

    CALL rows go to a call and `in_flight` calls of a task are under way at once; the provider sees to repeating what failed.
    """

    def one(text: str):
        try:
            return provider.embed([text])[0]
        except ModelError:
            return None

    def call(texts: list[str]) -> list:
        try:
            return provider.embed(texts)
        except ModelError:
            return [one(t) for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for rows in batches:
                texts = rows.embed_text.tolist()
                found = pool.map(call, [texts[i : i + CALL] for i in range(0, len(texts), CALL)])
                if len(rows):
                    yield rows.assign(embedding=[v for part in found for v in part])[names]

    names = [c for c in chunks.columns if c != "embed_text"] + ["embedding"]
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in names[:-1])
    return chunks.mapInPandas(run, f"{kinds}, embedding array<float>")


#: The table of vectors by the text that they stand for.
KNOWN = "digest binary, embedding array<float>, model string"


def embed_once(chunks: DataFrame, provider, folder: str, model: str) -> DataFrame:
    """chunks with an embedding, as embed(), from a table of what the model has been asked before.

    Each text that the table in `folder` lacks is asked for once, whatever chunks and runs it is in; failures are not kept. Texts are
    told apart by SHA-256. Vectors join by digest: Spark shuffles the table's rows of the model, not their texts.
    """
    spark = chunks.sparkSession
    parts = ledger.Generations(spark, folder)
    rows = chunks.withColumn("digest", F.unhex(F.sha2("embed_text", 256)))
    read = lambda: (parts.read(KNOWN) if parts.entries() else spark.createDataFrame([], KNOWN)).where(F.col("model") == model).select("digest", "embedding")
    new = rows.select("digest", "embed_text").join(read().select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("embed_text").alias("embed_text"))
    made = storage.store(embed(new, provider), "new-vectors").where(F.col("embedding").isNotNull())
    if not made.isEmpty():
        parts.add(made.select("digest", "embedding", F.lit(model).alias("model")), 0, "model")
    storage.drop(made)
    return rows.join(read(), "digest", "left").drop("digest", "embed_text")


def with_lexemes(chunks: DataFrame, language: str | None, whole: bool = False) -> DataFrame:
    """chunks with what full-text search matches, so that a search neither lexes nor stems them again."""
    return chunks.withColumn("lexemes", lexing.lexemes(F.col("content"), language=language, whole=whole))


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """The first row of each key that the table does not hold; what is there never changes."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    once = rows.withColumn("n", first).where("n = 1").drop("n")
    return once.join(existing.select(*KEY), KEY, "left_anti").select(*[f.name for f in CHUNKS.fields])


def insert(rows: DataFrame, path: str) -> int:
    """Append the new rows and keep the table's counts; how many there were. The caller holds the table's lock."""
    spark = rows.sparkSession
    existing, counts = read_table(spark, path), ledger.Counts(spark, path)
    known = counts.known()
    seen = Observation()
    new = new_rows(rows, existing)
    files = new.select("file_path").distinct().join(existing.select("file_path").distinct(), "file_path", "left_anti").count()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    n = seen.get["n"]
    if known is None:  # somebody else has written: count anew
        counts.reset(*retrieval.stats(read_table(spark, path)).first())
    else:
        counts.add(n, files)
    return n


def stats(spark: SparkSession, path: str) -> dict:
    """total_chunks and total_files of the table at path, from the counts kept with it; only if these do not fit, by a scan."""
    known = ledger.Counts(spark, path).known()
    return dict(zip(("total_chunks", "total_files"), known, strict=True)) if known else retrieval.stats(read_table(spark, path)).first().asDict()


class BadVectors(ValueError):
    """Vectors whose length is not that of the table."""


def _append(chunks: DataFrame, path: str, provider, dims: int | None, language: str | None, whole: bool = False) -> tuple[int, int]:
    """Number, embed and append chunks; (rows appended or there already, rows whose embedding failed)."""
    spark = chunks.sparkSession
    last = read_table(spark, path).agg(F.max("id")).first()[0]
    placed, numbered = with_ids(chunks, 0 if last is None else last + 1)
    vectors = embed_once(numbered, provider, f"{path.rstrip('/')}/_vectors", model_name(provider))
    made = storage.store(with_lexemes(vectors, language, whole), "embedded")
    storage.drop(placed)
    size = F.size("embedding")
    found = made.agg(F.count("embedding").alias("n"), F.count("*").alias("all"), F.min(F.when(F.col("embedding").isNotNull(), size)).alias("low"), F.max(size).alias("high")).first()
    if found.n and not found.low == found.high == (dims or found.high):
        storage.drop(made)
        raise BadVectors(f"vectors of {found.low} to {found.high} numbers, {dims or found.high} are wanted")
    good = made.where(F.col("embedding").isNotNull())
    if found.n < found["all"]:  # a chunk without a vector uses up no index
        good = good.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("file_path").orderBy("chunk_index")) - 1).cast("int"))
    insert(good, path)
    storage.drop(made)
    return found.n, found["all"] - found.n


def index_files(files: DataFrame, path: str, provider, dims: int | None = None, language: str | None = "portuguese", whole: bool = False) -> dict[str, int]:
    """Index the files that the table at path does not know; done again, it adds nothing.

    files: file_path, path (to be read here, if new) or file_path, raw, error. Result: indexed chunks; failed_files that could
    not be read and failed_chunks without a vector, and failed, their sum; skipped_files (known or blank), skipped_chunks (too
    short) and skipped, their sum. One run at a time writes to a table; ledger.Busy for a second one.
    """
    with ledger.writing(files.sparkSession, path):
        return _index_files(files, path, provider, dims, language, whole)


def _index_files(files: DataFrame, path: str, provider, dims: int | None, language: str | None, whole: bool) -> dict[str, int]:
    existing = read_table(files.sparkSession, path)
    fresh = not_indexed(files, existing)
    fresh = fresh if "raw" in files.columns else markdown.read(fresh)
    ready = storage.store(cleaned(fresh.select("file_path", "error", markdown.sanitized("raw").alias("text"))).drop("text"), "prepared-files")
    short = F.size(F.filter("chunks", lambda x: F.octet_length(x) < T.MIN_CHUNK))
    total = ready.agg(F.count("error").alias("failed"), F.coalesce(F.sum((F.size("chunks") > 0).cast("int")), F.lit(0)).alias("used"), F.coalesce(F.sum(short), F.lit(0)).alias("short")).first()
    n_files = files.count()
    indexed, lost = _append(numbered_chunks(ready), path, provider, dims, language, whole)
    storage.drop(ready)
    skipped = n_files - total.failed - total.used
    return {"indexed": indexed, "failed_files": total.failed, "failed_chunks": lost, "failed": total.failed + lost, "skipped_files": skipped, "skipped_chunks": total.short, "skipped": skipped + total.short}


def index_samples(spark: SparkSession, path: str, provider, dims: int | None = None, language: str | None = "portuguese", whole: bool = False) -> dict[str, int]:
    with ledger.writing(spark, path):
        indexed, lost = _append(markdown.sample_chunks(spark), path, provider, dims, language, whole)
    return {"indexed": indexed, "failed_files": 0, "failed_chunks": lost, "failed": lost, "skipped_files": 0, "skipped_chunks": 0, "skipped": 0}


#: Additions to an index after which they are brought together.
MOST_PARTS = 16


class Indexes:
    """The indexes beside a chunk table, in its folder `_index`; update() brings them up to the table."""

    def __init__(self, spark: SparkSession, path: str):
        base = f"{path.rstrip('/')}/_index"
        self.spark, self.path = spark, path
        self.text, self.trigrams, self.vectors = TextIndex(spark, f"{base}/text"), TrigramIndex(spark, f"{base}/trigrams"), VectorIndex(spark, f"{base}/vectors")

    def update(self) -> None:
        chunks = read_table(self.spark, self.path)
        for index in (self.text, self.trigrams, self.vectors):
            index.update(chunks)
            if len(index.parts.entries()) > MOST_PARTS:
                index.compact()

    def forget(self) -> None:
        """Delete the files that compaction has replaced; for when no search of before is running any more."""
        for index in (self.text, self.trigrams, self.vectors):
            index.parts.forget()

    def hybrid_search(self, query, text_query: str, limit: int = 5, language: str | None = None) -> DataFrame:
        """retrieval.hybrid_search through the indexes: the same rows."""
        chunks = read_table(self.spark, self.path)
        if not lexing.fts_terms(text_query):
            return self.vectors.similarity_search(chunks, query, limit).withColumn("score", F.lit(None).cast("double"))
        lanes = [self.vectors.nearest(query), self.text.lane(lexing.query_lexemes(text_query, language))]
        if lexing.tech_term(text_query):
            lanes.append(self.trigrams.lane(chunks, lexing.tech_term(text_query)))
        return retrieval.hybrid_of(chunks, query, lanes, limit)
