"""Search: lanes, rank fusion, best chunk of a file, windows, assembly.

A lane is (id, rk). Lanes carry ids only; contents are joined back for the few rows that win. Global ranks are written as a
row number with a filter, which Spark plans as a distributed top-k before one small window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexing, text, vector

VECTOR_LANE, TEXT_LANE, LITERAL_LANE = 100, 100, 50
FUSION_K = 20
NO_LIMIT_DISTANCE = 2.0


def _top(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    ranked = rows.withColumn("rk", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("rk") <= most)


def with_distance(chunks: DataFrame, query, blocks: bool = False) -> DataFrame:
    """blocks: a numpy kernel over Arrow batches, for many wide vectors; else a fold in the JVM (its last digit may differ)."""
    distance = vector.cosine_distance_blocks(query)(F.col("embedding")) if blocks else vector.cosine_distance_to(F.col("embedding"), query)
    return chunks.withColumn("distance", distance)


def best_per_file(rows: DataFrame, *order: Column, most: int = 1) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("file_path").orderBy(*order))
    return rows.withColumn("rn", rn).where(F.col("rn") <= most)


def check_limit(limit: int) -> int:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return limit


def similarity_search(chunks: DataFrame, query, limit: int = 5, max_distance: float = NO_LIMIT_DISTANCE, blocks: bool = False) -> DataFrame:
    """The nearest chunk of each file, within max_distance, nearest first. Contents are joined for these alone."""
    near = with_distance(chunks, query, blocks).select("id", "file_path", "distance").where("distance is not null")
    best = best_per_file(near, F.col("distance"), F.col("id")).where(F.col("distance") <= max_distance)
    return with_contents(chunks, best.select("id", "distance").orderBy("distance", "id").limit(check_limit(limit)), limit)


#: Rows of a result that are broadcast to fetch their contents; more are joined as Spark sees fit.
MOST_BROADCAST = 10_000


def with_contents(chunks: DataFrame, top: DataFrame, most: int) -> DataFrame:
    """id, file_path, chunk_index, content, distance of (id, distance), at most `most` rows, in their order."""
    few = F.broadcast(top) if most <= MOST_BROADCAST else top
    return chunks.select("id", "file_path", "chunk_index", "content").join(few, "id").select("id", "file_path", "chunk_index", "content", "distance").orderBy("distance", "id")


def vector_lane(dist: DataFrame, most: int = VECTOR_LANE) -> DataFrame:
    return _top(dist.where("distance is not null").select("id", "distance"), most, F.col("distance"), F.col("id"))


def text_lane(chunks: DataFrame, terms: list[str], most: int = TEXT_LANE, language: str | None = None) -> DataFrame:
    """Chunks that hold a term, by the number of places that match (for alternatives, what cover density comes to)."""
    if not terms:
        return chunks.select("id", F.lit(0).alias("hits"), F.lit(0).alias("rk")).limit(0)
    if "lexemes" not in chunks.columns and language is None:  # whole words are counted where they stand
        whole = r"(?<!\p{L})(?:" + "|".join(rf"\Q{t}\E" for t in terms) + r")(?!\p{L})"
        hits = F.regexp_count(F.lower("content"), F.lit(whole))
    else:
        found = F.col("lexemes") if "lexemes" in chunks.columns else lexing.lexemes(F.col("content"), language, terms)
        hits = F.size(F.filter(found, lambda w: w.isin(terms)))
    # chunks without a hit rank last, so they can go after the ranking; a filter before it would count all twice
    return _top(chunks.select("id", hits.alias("hits")), most, F.col("hits").desc(), F.col("id")).where("hits > 0")


def literal_lane(chunks: DataFrame, term: str, most: int = LITERAL_LANE) -> DataFrame:
    """Chunks that hold the identifier in any case (its _ stands for any one character), the lowest ids; all rank 1."""
    found = chunks.where(F.col("content").ilike(f"%{term}%")).select("id").orderBy("id").limit(most)
    return found.withColumn("rk", F.lit(1))


def fuse(*lanes: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """id (or other keys), score: the sum over lanes of 1 / (rank + 20), added in the order of the lanes.

    Equal to full outer joins of the lanes (an id is once in a lane; a missing lane adds 0) with one small shuffle.
    """
    rows = reduce(DataFrame.unionByName, [lane.select(*keys, F.lit(k).alias("lane"), "rk") for k, lane in enumerate(lanes)])
    ranks = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("lane") == k, F.col("rk"))).alias(f"r{k}") for k in range(len(lanes))])
    parts = [F.coalesce(F.lit(1.0) / (F.col(f"r{k}") + F.lit(float(FUSION_K))), F.lit(0.0)) for k in range(len(lanes))]
    return ranks.select(*keys, reduce(lambda a, b: a + b, parts).alias("score"))


def hybrid(chunks: DataFrame, query, terms: list[str], limit: int = 5, literal: str = "", language: str | None = None, blocks: bool = False) -> DataFrame:
    """Fused lanes, best chunk of each file by score; the distance is the winner's own."""
    lanes = [vector_lane(with_distance(chunks, query, blocks)), text_lane(chunks, terms, language=language)]
    if literal:
        lanes.append(literal_lane(chunks, literal))
    return hybrid_of(chunks, query, lanes, limit, blocks)


def hybrid_of(chunks: DataFrame, query, lanes: list[DataFrame], limit: int = 5, blocks: bool = False) -> DataFrame:
    """The same from lanes that are given, by a scan or by an index."""
    fused = fuse(*lanes)  # at most 250 rows by the lanes' limits
    joined = with_distance(chunks.join(F.broadcast(fused), "id"), query, blocks)  # distances of the winners alone
    best = best_per_file(joined, F.col("score").desc(), F.col("distance"), F.col("id"))
    return best.select("id", "file_path", "chunk_index", "content", "distance", "score").orderBy(F.col("score").desc(), "distance", "id").limit(check_limit(limit))


def hybrid_search(chunks: DataFrame, query, text_query: str, limit: int = 5, language: str | None = None, blocks: bool = False) -> DataFrame:
    """Vector search alone where the query has no word of four letters; else two lanes, or three if it names an identifier."""
    if not lexing.fts_terms(text_query):
        return similarity_search(chunks, query, limit, NO_LIMIT_DISTANCE, blocks).withColumn("score", F.lit(None).cast("double"))
    return hybrid(chunks, query, lexing.query_lexemes(text_query, language), limit, lexing.tech_term(text_query), language, blocks)


def chunk_windows(chunks: DataFrame, centres: DataFrame, size: int = 3) -> DataFrame:
    """For each (file_path, centre): `size` chunks from centre - size // 2 (at least 0) on; fewer at the end of a file."""
    at = centres.select(F.col("file_path").alias("c_path"), F.col("centre").alias("centre"))
    hit = (F.col("file_path") == F.col("c_path")) & (F.col("chunk_index") >= F.greatest(F.col("centre") - size // 2, F.lit(0)))
    rows = chunks.join(at, hit)
    n = F.row_number().over(Window.partitionBy("file_path", "centre").orderBy("chunk_index"))
    return rows.withColumn("n", n).where(F.col("n") <= size).select("file_path", "centre", "chunk_index", "content")


def chunk_window(chunks: DataFrame, path: str, centre: int, size: int = 3) -> DataFrame:
    rows = chunks.where((F.col("file_path") == path) & (F.col("chunk_index") >= max(centre - size // 2, 0)))
    return rows.select("file_path", "chunk_index", "content").orderBy("chunk_index").limit(size)


def top_chunks_for_file(chunks: DataFrame, path: str, query, limit: int) -> DataFrame:
    rows = with_distance(chunks.where(F.col("file_path") == path), query)
    return rows.select("id", "file_path", "chunk_index", "content", "distance").orderBy("distance", "id").limit(check_limit(limit))


def top_chunks_per_file(chunks: DataFrame, query, limit: int) -> DataFrame:
    rows = best_per_file(with_distance(chunks, query), F.col("distance"), F.col("id"), most=check_limit(limit))
    return rows.select("id", "file_path", "chunk_index", "distance", F.col("rn").alias("rank"))


def all_chunks_for_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == path).select("file_path", "chunk_index", "content").orderBy("chunk_index")


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("file_path").alias("total_files"))


def joined_windows(windows: DataFrame) -> DataFrame:
    """Each window's text for the answer (blank line between chunks) and its snippet (one line)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    rows = windows.groupBy("file_path", "centre").agg(parts.alias("parts"))
    return rows.select("file_path", "centre", F.array_join("parts", "\n\n").alias("context"), text.snippet(F.array_join("parts", " ")).alias("snippet"))


def context_of(rows: DataFrame) -> DataFrame:
    """One row: the numbered sources of (rank, file_path, context), in order."""
    block = F.struct("rank", text.context_block(F.col("rank"), F.col("file_path"), F.col("context")).alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(block)), lambda x: x["block"])
    return rows.agg(F.array_join(blocks, text.CONTEXT_RULE).alias("context"))


def response(results: DataFrame, query: str, answer: str = "") -> DataFrame:
    """One row of JSON from (rank, file_path, chunk_index, content, distance); no results give an empty array."""
    one = F.struct("rank", F.struct("file_path", "chunk_index", "content", "distance").alias("r"))
    found = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"])
    body = [found.alias("results"), F.lit(query).alias("query"), *([F.lit(answer).alias("answer")] if answer else [])]
    return results.agg(F.to_json(F.struct(*body)).alias("json"))
