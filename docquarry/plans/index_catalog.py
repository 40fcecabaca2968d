"""Registered queries that go through an index or take many queries at once, and their SQL (that of a scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexing
from ..operators import batch, indexing, retrieval
from ..operators.clustered import ClusteredTable
from ..operators.postings import TextIndex, TrigramIndex
from ..operators.vector_index import VectorIndex
from ..sources import markdown, providers
from . import catalog, ledger, storage, views
from .catalog import TERMS
from .views import V1

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_BUILT: dict[tuple[str, str, str], object] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _built(spark: SparkSession, sf_dir: str, kind, name: str, rows):
    """An index over rows(), built once for a session and a folder of tables."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _BUILT:
        index = kind(spark, storage.new_folder(spark, name))
        index.update(rows())
        _BUILT[key] = index
    return _BUILT[key]


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return _built(spark, sf_dir, TextIndex, "text-index", lambda: views.chunk_table(spark, sf_dir))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return _built(spark, sf_dir, VectorIndex, "vector-index", lambda: views.chunk_table(spark, sf_dir))


@query(catalog.ORACLE_SQL["fts_lane"])
def fts_index_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).lane(TERMS)


@query(catalog.ORACLE_SQL["fts_stemmed"])
def fts_index_stemmed(spark, sf_dir):
    rows = lambda: indexing.with_lexemes(views.chunk_table(spark, sf_dir).drop("lexemes"), "portuguese")
    index = _built(spark, sf_dir, TextIndex, "stem-index", rows)
    return index.lane(lexing.query_lexemes(catalog.STEMMED_QUERY, "portuguese"))


@query(catalog.ORACLE_SQL["keyword_lane"])
def keyword_index_lane(spark, sf_dir):
    rows = views.paths(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("url").alias("content"))
    return _built(spark, sf_dir, TrigramIndex, "trigram-index", lambda: rows).lane(rows, "utm_source")


@query(catalog.ORACLE_SQL["vector_topk"])
def vector_index_topk(spark, sf_dir):
    return vector_index(spark, sf_dir).nearest(views.query_vector(spark, sf_dir))


@query(catalog.ORACLE_SQL["similarity_search"])
def vector_index_search(spark, sf_dir):
    return vector_index(spark, sf_dir).similarity_search(views.chunk_table(spark, sf_dir), views.query_vector(spark, sf_dir), 5, 0.9)


@query(catalog.ORACLE_SQL["hybrid_2lane"])
def hybrid_indexed(spark, sf_dir):
    q = views.query_vector(spark, sf_dir)
    lanes = [vector_index(spark, sf_dir).nearest(q), text_index(spark, sf_dir).lane(TERMS)]
    return retrieval.hybrid_of(views.chunk_table(spark, sf_dir), q, lanes, 5)


def _whole(rows: DataFrame) -> DataFrame:
    """Ordered chunks as rows of the chunk table."""
    number = F.col("file_path").cast("long") * 1000 + F.col("chunk_index")
    return rows.select(number.alias("id"), "file_path", "chunk_index", "content", F.array().cast("array<float>").alias("embedding"), F.array().cast("array<string>").alias("lexemes"))


def clustered(spark: SparkSession, sf_dir: str, name: str, rows) -> ClusteredTable:
    """A table of rows(), bucketed by file; made once for a session and a folder of tables."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _BUILT:
        table = ClusteredTable(spark, storage.new_folder(spark, name), 8)
        table.append(_whole(rows()))
        _BUILT[key] = table
    return _BUILT[key]


def _ordered(spark: SparkSession, sf_dir: str) -> ClusteredTable:
    return clustered(spark, sf_dir, "clustered", lambda: views.ordered_chunks(spark, sf_dir))


@query(catalog.ORACLE_SQL["chunk_window"])
def chunk_window_clustered(spark, sf_dir):
    chunks = _ordered(spark, sf_dir).frame()
    return retrieval.chunk_windows(chunks, catalog._centres(chunks), 3)


@query(catalog.ORACLE_SQL["all_chunks_for_file"])
def all_chunks_clustered(spark, sf_dir):
    return retrieval.all_chunks_for_file(_ordered(spark, sf_dir).frame(), "3")


@query(catalog.ORACLE_SQL["idempotent_insert"])
def insert_clustered(spark, sf_dir):
    chunks = views.ordered_chunks(spark, sf_dir)
    table = clustered(spark, sf_dir, "clustered-half", lambda: chunks.where(F.col("chunk_index") % 2 == 0))
    return table.new_rows(_whole(chunks.union(chunks))).select("file_path", "chunk_index", "content")


@query(catalog.ORACLE_SQL["stats"])
def stats_kept(spark, sf_dir):
    """The counts that two inserts leave beside the table, of which the second repeats what the first has put in."""
    rows, path = _whole(views.ordered_chunks(spark, sf_dir)), storage.new_folder(spark, "counted")
    with ledger.writing(spark, path):
        indexing.insert(rows.where(F.col("chunk_index") % 2 == 0), path)
        indexing.insert(rows, path)
    known = ledger.Counts(spark, path).known()
    return spark.createDataFrame([known], "total_chunks long, total_files long")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as files, of which some are blank and some cannot be read."""
    k = F.col("doc_id") % 50
    text = F.when(k == 1, " \n").when(k != 2, F.col("text")).cast("binary")
    name = F.concat(F.lit("d/doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))
    return views.raw_texts(spark, sf_dir).select(name.alias("file_path"), text.alias("raw"), F.when(k == 2, "gone").alias("error"))


_READ = "g AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN ' ' || chr(10) ELSE text END AS text FROM documents WHERE doc_id % 50 <> 2)"


@query(f"""WITH {_READ}, b AS (SELECT * FROM g WHERE regexp_replace(text, '{catalog._WS}+', '', 'g') <> ''), {catalog._clean_sql('b')},
e AS (SELECT doc_id, {catalog._TRIM} AS text FROM s), {catalog._kept_sql('e', 'doc_id')},
n AS (SELECT f.doc_id, len(f.s.ch) + CASE WHEN len(f.s.cur) > 0 THEN 1 ELSE 0 END AS made, len(c.kept) AS kept FROM f JOIN c USING (doc_id)),
t AS (SELECT coalesce(sum(kept), 0) AS indexed, coalesce(sum(made - kept), 0) AS short, count(*) AS used FROM n),
x AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 50 = 2) AS gone FROM documents)
SELECT CAST(indexed AS BIGINT) AS indexed, gone AS failed_files, CAST(0 AS BIGINT) AS failed_chunks, gone AS failed, n - gone - used AS skipped_files, CAST(short AS BIGINT) AS skipped_chunks, CAST(n - gone - used + short AS BIGINT) AS skipped FROM t, x""")
def index_counters(spark, sf_dir):
    """What an index run over the texts as files counts."""
    got = indexing.index_files(_files(spark, sf_dir), storage.new_folder(spark, "counted-run"), providers.HashingEmbedder(16), 16)
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


@query(f"""WITH {_READ}, {catalog._clean_sql('g')}, e AS (SELECT doc_id, {catalog._TRIM} AS text FROM s), {catalog._kept_sql('e', 'doc_id')},
r AS (SELECT doc_id, CAST(unnest(generate_series(0, len(kept) - 1)) AS INTEGER) AS chunk_index, unnest(kept) AS content FROM c)
SELECT 'd/doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS file_path, chunk_index, 'doc ' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || chr(10) || content AS embed_text FROM r""")
def embed_texts(spark, sf_dir):
    """What stands for each chunk of the readable texts when it is embedded: the file's title and the chunk."""
    return indexing.split_chunks(markdown.texts(_files(spark, sf_dir))).select("file_path", "chunk_index", "embed_text")


@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^#]*)', 1)) AS u FROM pages),
p AS (SELECT page_id, u, regexp_extract(u, '^[^/]+') AS host, regexp_extract(u, '/.*$') AS path FROM u)
SELECT page_id, array_to_string(CASE WHEN path <> '' THEN [u, host, path] ELSE [u] END, ' ') AS lexemes FROM p WHERE host <> ''""")
def url_lexemes(spark, sf_dir):
    """The tokens of addresses: whole, by host and by path."""
    rows = views.paths(spark, sf_dir).select("page_id", F.regexp_extract("url", "^[^#]*", 0).alias("url"))
    return rows.select("page_id", F.array_join(lexing.tokens(F.col("url")), " ").alias("lexemes"))


#: A hundred vectors are searched for.
_ASKED = """v1 AS (
  SELECT doc_id AS id, source AS file_path, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS chunk_index,
         text AS content, CAST(embedding AS DOUBLE[]) AS e
  FROM documents JOIN embeddings ON doc_id = vec_id
), asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 100),
d AS (SELECT query_id, id, file_path, chunk_index, content, list_cosine_distance(e, q) AS distance FROM v1, asked)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_ASKED} SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rk FROM d QUALIFY rk <= 100")
def many_vector_lanes(spark, sf_dir):
    return batch.vector_lanes(views.chunk_table(spark, sf_dir), _asked(spark, sf_dir))


@query(f"""WITH {_ASKED}, b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY distance, id) = 1)
SELECT query_id, id, file_path, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rk FROM b WHERE distance <= 0.9 QUALIFY rk <= 5""")
def many_similarity_searches(spark, sf_dir):
    return batch.similarity_searches(views.chunk_table(spark, sf_dir), _asked(spark, sf_dir), 5, 0.9)


#: What the hundred queries say: by the remainder of their ids, words, words with an identifier, or no word of four letters.
_TEXTS = ["les ouier para", "para ouier les_mo", "um no de", "ouier"]


def _words_sql(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in lexing.query_lexemes(text)) + "]::VARCHAR[]"


_SAID = " UNION ALL ".join(
    f"SELECT {k} AS r, {_words_sql(t)} AS words, '{lexing.tech_term(t)}' AS literal, {'TRUE' if lexing.fts_terms(t) else 'FALSE'} AS fused" for k, t in enumerate(_TEXTS)
)


@query(rf"""WITH {_ASKED}, said AS ({_SAID}), x AS (SELECT d.*, words, literal, fused FROM d JOIN said ON r = query_id % {len(_TEXTS)}),
vec AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM x WHERE fused QUALIFY rk <= 100),
w AS (SELECT id, regexp_extract_all(lower(content), '\p{{L}}+') AS ws FROM v1),
h AS (SELECT query_id, id, len(list_filter(ws, lambda t: list_contains(words, t))) AS hits FROM w, asked JOIN said ON r = query_id % {len(_TEXTS)} WHERE fused),
fts AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rk FROM h WHERE hits > 0 QUALIFY rk <= 100),
kw AS (SELECT query_id, id, 1 AS rk FROM x WHERE fused AND literal <> '' AND content ILIKE '%' || literal || '%' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 50),
a AS (SELECT query_id, id FROM vec UNION SELECT query_id, id FROM fts UNION SELECT query_id, id FROM kw),
s AS (SELECT a.query_id, a.id, coalesce(1.0::DOUBLE / (v.rk + 20), 0) + coalesce(1.0::DOUBLE / (f.rk + 20), 0) + coalesce(1.0::DOUBLE / (k.rk + 20), 0) AS score
      FROM a LEFT JOIN vec v USING (query_id, id) LEFT JOIN fts f USING (query_id, id) LEFT JOIN kw k USING (query_id, id)),
m AS (SELECT query_id, id, file_path, chunk_index, distance, score FROM x JOIN s USING (query_id, id)
      QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, distance, id) = 1),
n AS (SELECT query_id, id, file_path, chunk_index, distance, NULL::DOUBLE AS score FROM x WHERE NOT fused
      QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY distance, id) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, id) AS INTEGER) AS rank, id, file_path, chunk_index, distance, score
FROM (SELECT * FROM m UNION ALL SELECT * FROM n) QUALIFY rank <= 5""")
def many_hybrid_searches(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("query_id") % len(_TEXTS) + 1).cast("int"))
    return batch.hybrid_searches(views.chunk_table(spark, sf_dir), _asked(spark, sf_dir).withColumn("text", said), 5).drop("content")
