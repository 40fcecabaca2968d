"""Many queries in one scan: lanes, fusion and best chunks keyed by query.

The queries of a pass (at most QUERIES, else there are several passes) are a block of vectors that each task holds; chunks come by
in Arrow blocks, a product tells which can be among a query's best, and these are scored again in the order of the JVM's fold, so
distances are bit for bit those of a single search. A task passes on its best of each query, which are merged by query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexing
from . import retrieval

QUERIES = 4096
ROWS = 2048  # chunks in a block
SLACK = 1e-9  # more than the rounding of a product, less than anything that matters


def _matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a length without missing numbers, and their places."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(sizes == dims)
    x = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), dims)
    whole = np.isfinite(x).all(axis=1)
    return x[whole], some[whole]


def _fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products by row, summed from left to right."""
    return np.cumsum(x * y, axis=1)[:, -1]


class _Best:
    """The nearest rows of each query so far: one for each file, or any."""

    def __init__(self, queries: np.ndarray, most: int, by_file: bool):
        self.q, self.most, self.by_file = queries, most, by_file
        self.square = _fold(queries, queries)
        self.rows: list[list[tuple]] = [[] for _ in queries]
        self.least = np.full(len(queries), np.inf)

    def add(self, x: np.ndarray, ids: list, files: list) -> None:
        own = _fold(x, x)
        norms = np.sqrt(own[:, None] * self.square[None])
        with np.errstate(divide="ignore", invalid="ignore"):
            rough = np.where(norms > 0, 1 - x @ self.q.T / norms, np.inf)
        for k in np.flatnonzero((rough <= self.least + SLACK).any(axis=0) & (self.square > 0)).tolist():
            column = rough[:, k]
            limit = self.least[k] + SLACK
            if not self.by_file and len(column) > self.most:
                limit = min(limit, np.partition(column, self.most - 1)[self.most - 1] + SLACK)
            some = np.flatnonzero((column <= limit) & np.isfinite(column))
            dots = _fold(x[some], self.q[k][None])
            exact = 1 - dots / np.sqrt(own[some] * self.square[k])
            found = sorted([*self.rows[k], *((d, ids[i], files[i]) for d, i in zip(exact.tolist(), some.tolist(), strict=True))])
            if self.by_file:
                seen: set = set()
                found = [r for r in found if not (r[2] in seen or seen.add(r[2]))]
            self.rows[k] = found[: self.most]
            if len(self.rows[k]) == self.most:
                self.least[k] = self.rows[k][-1][0]


FOUND = "query_id long, id long, file_path string, distance double"


def _pass(chunks: DataFrame, queries: list[tuple[int, list[float]]], most: int, by_file: bool) -> DataFrame:
    groups: dict[int, list] = {}
    for query_id, vector in queries:
        groups.setdefault(len(vector), []).append((query_id, vector))
    asked = {dims: ([i for i, _ in own], np.array([v for _, v in own], np.float64)) for dims, own in groups.items() if dims}

    def run(batches):
        best = {dims: _Best(q, most, by_file) for dims, (_, q) in asked.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids, files = (rows.column(c).to_pylist() for c in ("id", "file_path"))
                for dims, own in best.items():
                    x, some = _matrix(rows.column("embedding"), dims)
                    if len(x):
                        own.add(x, [ids[i] for i in some], [files[i] for i in some])
        for dims, own in best.items():
            out = [(q, i, f, d) for q, rows in zip(asked[dims][0], own.rows, strict=True) for d, i, f in rows]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["query_id", "id", "file_path", "distance"])

    return chunks.select("id", "file_path", "embedding").mapInArrow(run, FOUND)


def _passes(chunks: DataFrame, queries: DataFrame, most: int, by_file: bool) -> DataFrame:
    rows = [(r.query_id, [float(v) for v in r.vector]) for r in queries.select("query_id", "vector").collect() if r.vector]
    parts = [rows[i : i + QUERIES] for i in range(0, len(rows), QUERIES)] or [[]]
    return reduce(DataFrame.unionByName, [_pass(chunks, p, most, by_file) for p in parts])


def vector_lanes(chunks: DataFrame, queries: DataFrame, most: int = retrieval.VECTOR_LANE) -> DataFrame:
    """query_id, id, distance, rk: each query's vector lane. queries: query_id, vector."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return _passes(chunks, queries, most, False).withColumn("rk", n).where(F.col("rk") <= most).select("query_id", "id", "distance", "rk")


def similarity_searches(chunks: DataFrame, queries: DataFrame, limit: int = 5, max_distance: float = retrieval.NO_LIMIT_DISTANCE) -> DataFrame:
    """query_id, id, file_path, distance, rk: the nearest chunk of each file, the nearest `limit` files of each query.

    A task keeps the best chunks of its nearest `limit` files: no file that is among the nearest of all can be left out by that.
    """
    found = _passes(chunks, queries, retrieval.check_limit(limit), True) if limit else _passes(chunks, queries.limit(0), 1, True)
    first = F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy("distance", "id"))
    near = found.withColumn("n", first).where((F.col("n") == 1) & (F.col("distance") <= max_distance)).drop("n")
    rk = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rk", rk).where(F.col("rk") <= limit)


def text_lanes(chunks: DataFrame, terms: DataFrame, most: int = retrieval.TEXT_LANE) -> DataFrame:
    """query_id, id, hits, rk: each query's text lane. terms: query_id, lexeme (each once); chunks: id, lexemes."""
    wanted = [r.lexeme for r in terms.select("lexeme").distinct().collect()]  # of the queries alone
    held = chunks.select("id", F.explode(F.filter("lexemes", lambda w: w.isin(wanted))).alias("lexeme"))
    hits = held.groupBy("id", "lexeme").agg(F.count("*").alias("n")).join(F.broadcast(terms), "lexeme")  # a few terms a query
    total = hits.groupBy("query_id", "id").agg(F.sum("n").cast("int").alias("hits"))
    rk = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("hits").desc(), "id"))
    return total.withColumn("rk", rk).where(F.col("rk") <= most)


def literal_lanes(chunks: DataFrame, literals: DataFrame, most: int = retrieval.LITERAL_LANE) -> DataFrame:
    """query_id, id, rk: each query's literal lane. literals: query_id, literal."""
    wanted = sorted({r.literal for r in literals.collect()})
    listed = F.array(*[F.when(F.col("content").ilike(f"%{t}%"), F.lit(t)) for t in wanted]) if wanted else F.array().cast("array<string>")
    held = chunks.select("id", F.explode(F.array_compact(listed)).alias("literal")).join(F.broadcast(literals), "literal")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return held.withColumn("n", n).where(F.col("n") <= most).select("query_id", "id", F.lit(1).alias("rk"))


def hybrid_searches(chunks: DataFrame, queries: DataFrame, limit: int = 5, language: str | None = None) -> DataFrame:
    """query_id, rank, id, file_path, chunk_index, content, distance, score: hybrid_search of every query, one scan a lane.

    queries: query_id, vector, text. chunks with lexemes, as the chunk table has them. A query without a word of four letters
    is a vector search alone (score null), one that names an identifier has a third lane.
    """
    spark = chunks.sparkSession
    asked = [(r.query_id, r.text or "") for r in queries.select("query_id", "text").collect()]
    fused_ids = [(q,) for q, t in asked if lexing.fts_terms(t)]
    plain_ids = [(q,) for q, t in asked if not lexing.fts_terms(t)]
    pick = lambda ids: queries.join(F.broadcast(spark.createDataFrame(ids, "query_id long")), "query_id")
    terms = spark.createDataFrame([(q, w) for q, t in asked for w in lexing.query_lexemes(t, language)], "query_id long, lexeme string")
    literals = [(q, lexing.tech_term(t)) for q, t in asked if lexing.fts_terms(t) and lexing.tech_term(t)]
    parts = []
    if fused_ids:
        lanes = [vector_lanes(chunks, pick(fused_ids)), text_lanes(chunks, terms)]
        if literals:
            lanes.append(literal_lanes(chunks, spark.createDataFrame(literals, "query_id long, literal string")))
        fused = retrieval.fuse(*lanes, keys=("query_id", "id"))  # at most 250 rows a query
        vectors = pick(fused_ids).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        won = chunks.select("id", "file_path", "chunk_index", "embedding").join(fused, "id").join(F.broadcast(vectors), "query_id")
        won = won.withColumn("distance", retrieval.vector.cosine_distance(F.col("embedding"), F.col("vector")))
        order = [F.col("score").desc(), F.col("distance"), F.col("id")]
        best = won.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(*order))).where("rn = 1")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= retrieval.check_limit(limit))
        parts.append(best.select("query_id", "rank", "id", "distance", "score"))
    if plain_ids:
        near = similarity_searches(chunks, pick(plain_ids), limit)
        parts.append(near.select("query_id", F.col("rk").alias("rank"), "id", "distance", F.lit(None).cast("double").alias("score")))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, file_path string, chunk_index int, content string, distance double, score double")
    found = reduce(DataFrame.unionByName, parts)
    out = chunks.select("id", "file_path", "chunk_index", "content").join(found, "id")
    return out.select("query_id", "rank", "id", "file_path", "chunk_index", "content", "distance", "score")
