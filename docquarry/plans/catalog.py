"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexing
from ..functions import text as T
from ..operators import indexing, retrieval
from ..sources import markdown, providers
from . import views
from .stemming_sql import stemmed
from .views import V1, V2

TERMS = ["les", "ouier", "para"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _v1(spark, sf_dir):
    return views.chunk_table(spark, sf_dir), views.query_vector(spark, sf_dir)


@query(f"""WITH {V1}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY distance, id) AS rn FROM dist)
SELECT id, file_path, chunk_index, content, distance FROM r WHERE rn = 1 AND distance <= 0.9 ORDER BY distance, id LIMIT 5""")
def similarity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, q = _v1(spark, sf_dir)
    return retrieval.similarity_search(chunks, q, 5, 0.9)


@query(f"""WITH {V1} SELECT id, distance, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rk FROM dist QUALIFY rk <= 100""")
def vector_topk(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    return retrieval.vector_lane(retrieval.with_distance(chunks, q))


@query(f"WITH {V1} SELECT id, file_path, chunk_index, content, distance FROM dist WHERE file_path = 'src3' ORDER BY distance, id LIMIT 3")
def top_chunks_for_file(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    return retrieval.top_chunks_for_file(chunks, "src3", q, 3)


@query(f"""WITH {V1}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_path ORDER BY distance, id) AS INTEGER) AS rank FROM dist)
SELECT id, file_path, chunk_index, distance, rank FROM r WHERE rank <= 3""")
def top_chunks_per_file(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    return retrieval.top_chunks_per_file(chunks, q, 3)


def _hits(terms, source="v1"):
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"SELECT id, CAST(len(list_filter(regexp_extract_all(lower(content), '\\p{{L}}+'), lambda t: t IN ({listed}))) AS INTEGER) AS hits FROM {source}"


@query(f"""WITH {V1}, h AS ({_hits(TERMS)})
SELECT id, hits, CAST(row_number() OVER (ORDER BY hits DESC, id) AS INTEGER) AS rk FROM h WHERE hits > 0 QUALIFY rk <= 100""")
def fts_lane(spark, sf_dir):
    return retrieval.text_lane(views.vector_chunks(spark, sf_dir), TERMS)  # counts whole words where they stand


@query(ORACLE_SQL["fts_lane"])
def fts_stored(spark, sf_dir):
    return retrieval.text_lane(views.chunk_table(spark, sf_dir), TERMS)  # by the lexemes that the chunk table keeps


@query("SELECT page_id AS id, CAST(1 AS INTEGER) AS rk FROM pages WHERE url ILIKE '%utm_source%' ORDER BY page_id LIMIT 50")
def keyword_lane(spark, sf_dir):
    rows = views.paths(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("url").alias("content"))
    return retrieval.literal_lane(rows, "utm_source")


def _hybrid_sql(terms, limit, literal, base="dist"):
    third = ", kw AS (SELECT id, 1 AS rk FROM {b} WHERE content ILIKE '%{t}%' ORDER BY id LIMIT 50)".format(b=base, t=literal) if literal else ""
    join = "LEFT JOIN kw k ON k.id = a.id" if literal else ""
    ids = "SELECT id FROM vec UNION SELECT id FROM fts" + (" UNION SELECT id FROM kw" if literal else "")
    more = " + coalesce(1.0::DOUBLE / (k.rk + 20), 0)" if literal else ""
    return f"""h AS ({_hits(terms, base)}),
vec AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rk FROM {base} QUALIFY rk <= 100),
fts AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS rk FROM h WHERE hits > 0 QUALIFY rk <= 100){third},
a AS ({ids}),
rrf AS (SELECT a.id, coalesce(1.0::DOUBLE / (v.rk + 20), 0) + coalesce(1.0::DOUBLE / (f.rk + 20), 0){more} AS score
        FROM a LEFT JOIN vec v ON v.id = a.id LEFT JOIN fts f ON f.id = a.id {join}),
best AS (SELECT d.*, score, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, distance, d.id) AS rn FROM rrf JOIN {base} d ON d.id = rrf.id)
SELECT id, file_path, chunk_index, content, distance, score FROM best WHERE rn = 1 ORDER BY score DESC, distance, id LIMIT {limit}"""


@query(f"WITH {V1}, {_hybrid_sql(TERMS, 5, '')}")
def hybrid_2lane(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    return retrieval.hybrid(chunks, q, TERMS, 5)


@query(f"WITH {V1}, named AS (SELECT id, file_path, chunk_index, content || CASE WHEN id % 7 = 0 THEN ' unit-id' ELSE '' END AS content, distance FROM dist), {_hybrid_sql([*TERMS, 'unit'], 20, 'UNIT_ID', 'named')}")
def hybrid_3lane(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    named = chunks.drop("lexemes").withColumn("content", F.concat("content", F.when(F.col("id") % 7 == 0, " unit-id").otherwise("")))
    return retrieval.hybrid(named, q, [*TERMS, "unit"], 20, "UNIT_ID")


@query(f"""WITH {V1}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY distance, id) AS rn FROM dist)
SELECT id, file_path, chunk_index, content, distance, CAST(NULL AS DOUBLE) AS score FROM r WHERE rn = 1 AND distance <= 2.0 ORDER BY distance, id LIMIT 5""")
def vector_fallback(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    return retrieval.hybrid_search(chunks, q, "um no de", 5)


@query(f"""WITH {V1}, h AS ({_hits(TERMS)}),
vec AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rk FROM dist QUALIFY rk <= 100),
fts AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS rk FROM h WHERE hits > 0 QUALIFY rk <= 100)
SELECT coalesce(v.id, f.id) AS id, coalesce(1.0::DOUBLE / (v.rk + 20), 0) + coalesce(1.0::DOUBLE / (f.rk + 20), 0) AS score FROM vec v FULL JOIN fts f ON v.id = f.id""")
def rrf_scores(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    return retrieval.fuse(retrieval.vector_lane(retrieval.with_distance(chunks, q)), retrieval.text_lane(chunks, TERMS))


_CENTRES = f"""{V2}, c AS (SELECT file_path, 0 AS centre FROM v2 GROUP BY 1 UNION SELECT file_path, max(chunk_index) FROM v2 GROUP BY 1
  UNION SELECT file_path, max(chunk_index) // 2 FROM v2 GROUP BY 1),
w AS (SELECT v2.file_path, CAST(centre AS INTEGER) AS centre, chunk_index, content, row_number() OVER (PARTITION BY v2.file_path, centre ORDER BY chunk_index) AS n
  FROM c JOIN v2 ON v2.file_path = c.file_path AND chunk_index >= greatest(centre - 1, 0) QUALIFY n <= 3)"""


def _centres(chunks: DataFrame) -> DataFrame:
    last = chunks.groupBy("file_path").agg(F.max("chunk_index").alias("last"))
    places = F.array_distinct(F.array(F.lit(0), F.floor(F.col("last") / 2).cast("int"), F.col("last")))
    return last.select("file_path", F.explode(places).alias("centre"))


@query(f"WITH {_CENTRES} SELECT file_path, centre, chunk_index, content FROM w")
def chunk_window(spark, sf_dir):
    chunks = views.ordered_chunks(spark, sf_dir)
    return retrieval.chunk_windows(chunks, _centres(chunks), 3)


@query(f"WITH {V2} SELECT file_path, chunk_index, content FROM v2 WHERE file_path = '3' ORDER BY chunk_index")
def all_chunks_for_file(spark, sf_dir):
    return retrieval.all_chunks_for_file(views.ordered_chunks(spark, sf_dir), "3")


@query(f"WITH {V2} SELECT count(*) AS total_chunks, count(DISTINCT file_path) AS total_files FROM v2")
def stats(spark, sf_dir):
    return retrieval.stats(views.ordered_chunks(spark, sf_dir))


_WS = r"[\s\x0b\x85\p{Z}]"


@query(f"""WITH {_CENTRES},
j AS (SELECT file_path, centre, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS context, string_agg(content, ' ' ORDER BY chunk_index) AS line FROM w GROUP BY ALL),
t AS (SELECT file_path, centre, context, regexp_replace(replace(line, chr(10), ' '), '^{_WS}+|{_WS}+$', '', 'g') AS x FROM j),
k AS (SELECT *, x[:list_max(list_filter(range(0, 201), lambda k: strlen(x[:k]) <= 200))] AS cut FROM t)
SELECT file_path, centre, context, CASE WHEN strlen(x) <= 200 THEN x WHEN strlen(cut) < 200 THEN cut || chr(65533) || '...' ELSE cut || '...' END AS snippet FROM k""")
def snippets(spark, sf_dir):
    chunks = views.ordered_chunks(spark, sf_dir)
    return retrieval.joined_windows(retrieval.chunk_windows(chunks, _centres(chunks), 3))


@query(f"""WITH {V1}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, distance, id) AS rank FROM (WITH {_hybrid_sql(TERMS, 5, '')})),
w AS (SELECT rank, t.file_path, d.chunk_index, d.content, row_number() OVER (PARTITION BY rank ORDER BY d.chunk_index) AS n
  FROM top t JOIN dist d ON d.file_path = t.file_path AND d.chunk_index >= greatest(t.chunk_index - 1, 0) QUALIFY n <= 3),
f AS (SELECT rank, file_path, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS context FROM w GROUP BY ALL)
SELECT string_agg('[Fonte ' || rank || ': ' || file_path || ']' || chr(10) || context, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM f""")
def context_assembly(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    found = retrieval.hybrid(chunks, q, TERMS, 5).select("file_path", "chunk_index").collect()  # five rows, best first
    top = spark.createDataFrame([(k, r.file_path, r.chunk_index) for k, r in enumerate(found, 1)], "rank int, file_path string, centre int")
    windows = retrieval.joined_windows(retrieval.chunk_windows(chunks, F.broadcast(top)))
    return retrieval.context_of(windows.join(F.broadcast(top), ["file_path", "centre"]).select("rank", "file_path", "context"))


_STEP = """list_reduce(list_prepend({'ch': []::VARCHAR[], 'cur': []::VARCHAR[], 'line': '', 'sz': 0::BIGINT},
    list_transform(string_split(text, chr(10)), lambda x: {'ch': []::VARCHAR[], 'cur': []::VARCHAR[], 'line': x, 'sz': strlen(x)::BIGINT})),
  lambda a, x: CASE
    WHEN starts_with(regexp_replace(x.line, '^WS+|WS+$', '', 'g'), '##') AND a.sz > 0 AND a.sz + x.sz > 1500
      THEN {'ch': list_append(a.ch, array_to_string(a.cur, chr(10))), 'cur': [x.line], 'line': '', 'sz': x.sz}
    WHEN a.sz + x.sz + 1 > 1500
      THEN {'ch': list_append(a.ch, array_to_string(list_append(a.cur, x.line), chr(10))), 'cur': []::VARCHAR[], 'line': '', 'sz': 0::BIGINT}
    ELSE {'ch': a.ch, 'cur': list_append(a.cur, x.line), 'line': '', 'sz': a.sz + x.sz + 1} END)""".replace("WS", _WS)


def _kept_sql(source: str, key: str) -> str:
    """CTEs that end in `c`: the key and the kept chunks (a list) of a relation's texts."""
    return f"""f AS (SELECT {key}, {_STEP} AS s FROM {source}),
c AS (SELECT {key}, list_filter(list_transform(CASE WHEN len(s.cur) > 0 THEN list_append(s.ch, array_to_string(s.cur, chr(10))) ELSE s.ch END,
  lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: strlen(x) >= 50) AS kept FROM f)"""


@query(f"""WITH {_kept_sql('documents', 'doc_id')}
SELECT doc_id, CAST(unnest(generate_series(0, len(kept) - 1)) AS INTEGER) AS chunk_index, unnest(kept) AS content FROM c""")
def chunk_by_headers(spark, sf_dir):
    rows = views.raw_texts(spark, sf_dir)
    return rows.select("doc_id", F.posexplode(T.kept_chunks(T.chunk_by_headers(F.col("text")))).alias("chunk_index", "content"))


def _decorated() -> str:
    """A text with metadata, breadcrumbs, headers, images and links around it, in SQL that both engines read."""
    return "concat('---\ntitle: t', doc_id, '\n1. [home](http://h/', doc_id, ')\n# H ![i](p.png)\n2. [keep](u)\nCreated by x\n', text, '\n## S\n[a [b](u) tail')"


_NOISE = " OR ".join([*(f"starts_with(t, '{p}')" for p in (*T.METADATA, *T.NAVIGATION_AT)), *(f"contains(t, '{p}')" for p in T.NAVIGATION_IN)])
_TRIM = f"regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean_sql(source: str) -> str:
    """CTEs that end in `s`: doc_id and x, the cleaned text before it is trimmed, of a relation's doc_id and text."""
    return f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
a AS (SELECT doc_id, x, i, {_TRIM} AS t FROM l),
k AS (SELECT doc_id, x, i, t, min(CASE WHEN starts_with(t, '#') THEN i END) OVER (PARTITION BY doc_id) AS p FROM a WHERE NOT ({_NOISE})),
j AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS x FROM k WHERE NOT ((p IS NULL OR i < p) AND regexp_matches(t, '^[0-9]') AND contains(t, '[') AND contains(t, '](')) GROUP BY 1),
s AS (SELECT doc_id, regexp_replace(regexp_replace(x, '!\\[[^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') AS x FROM j)"""


@query(f"""WITH d AS (SELECT doc_id, {_decorated()} AS text FROM documents), {_clean_sql('d')}
SELECT doc_id, {_TRIM} AS text FROM s""")
def clean_markdown(spark, sf_dir):
    rows = views.raw_texts(spark, sf_dir).select("doc_id", F.expr(_decorated().replace("\n", "\\n")).alias("text"))
    return rows.select("doc_id", T.clean_markdown(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, regexp_replace({_decorated()}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') AS text FROM documents""")
def strip_links(spark, sf_dir):
    rows = views.raw_texts(spark, sf_dir).select("doc_id", F.expr(_decorated().replace("\n", "\\n")).alias("text"))
    return rows.select("doc_id", T.strip_links(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, regexp_replace({_decorated()}, '!\\[[^)]*\\)', '', 'g') AS text FROM documents""")
def strip_images(spark, sf_dir):
    rows = views.raw_texts(spark, sf_dir).select("doc_id", F.expr(_decorated().replace("\n", "\\n")).alias("text"))
    return rows.select("doc_id", T.strip_images(F.col("text")).alias("text"))


@query(rf"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '\.[^.]*$', '') AS stem FROM pages),
b AS (SELECT page_id, url, translate(regexp_replace(url_decode(stem), '_[0-9]{{6,}}$', ''), '-_', '  ') AS x FROM a)
SELECT page_id, {_TRIM} AS title FROM b""")
def path_to_title(spark, sf_dir):
    return views.paths(spark, sf_dir).select("page_id", T.path_to_title(F.col("url")).alias("title"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}{4,}')) AS w, generate_subscripts(regexp_extract_all(text, '\p{L}{4,}'), 1) AS i FROM documents),
f AS (SELECT doc_id, arg_min(w, i) AS w, min(i) AS i FROM w GROUP BY doc_id, lower(w))
SELECT d.doc_id, coalesce(string_agg(w, ' | ' ORDER BY i), '') AS terms FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def fts_terms(spark, sf_dir):
    rows = views.raw_texts(spark, sf_dir)
    return rows.select("doc_id", F.coalesce(lexing.fts_terms_column(F.col("text")), F.lit("")).alias("terms"))


@query(r"SELECT page_id, regexp_extract(url, '\b\w+_\w[\w_]*\b') AS term FROM pages")
def tech_term(spark, sf_dir):
    return views.paths(spark, sf_dir).select("page_id", lexing.tech_term_column(F.col("url")).alias("term"))


@query(f"WITH {V2} SELECT DISTINCT file_path FROM v2 WHERE file_path NOT IN (SELECT file_path FROM v2 WHERE CAST(file_path AS BIGINT) % 3 = 0)")
def resume_filter(spark, sf_dir):
    chunks = views.ordered_chunks(spark, sf_dir)
    return indexing.not_indexed(chunks.select("file_path").distinct(), chunks.where(F.col("file_path").cast("long") % 3 == 0))


@query(f"""WITH {V2}, e AS (SELECT file_path, chunk_index FROM v2 WHERE chunk_index % 2 = 0)
SELECT file_path, chunk_index, content FROM v2 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file_path = v2.file_path AND e.chunk_index = v2.chunk_index)""")
def idempotent_insert(spark, sf_dir):
    chunks = views.ordered_chunks(spark, sf_dir)
    rows = chunks.union(chunks).select(F.xxhash64("file_path", "chunk_index").alias("id"), "*", F.array().cast("array<float>").alias("embedding"), F.array().cast("array<string>").alias("lexemes"))
    return indexing.new_rows(rows, chunks.where(F.col("chunk_index") % 2 == 0)).select("file_path", "chunk_index", "content")


@query(f"""WITH {V1} SELECT id, round(1 - distance, 2) + 0.0 AS relevance, CASE WHEN distance < 0.2 THEN 'good' WHEN distance < 0.3 THEN 'medium' ELSE 'poor' END AS band FROM dist""")
def relevance_band(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    return retrieval.with_distance(chunks, q).select("id", T.relevance(F.col("distance")).alias("relevance"), T.relevance_band(F.col("distance")).alias("band"))


@query("SELECT doc_id, coalesce(text, '') || 'A' || chr(65533) AS text FROM documents")
def sanitize_utf8(spark, sf_dir):
    """Every text's bytes with invalid ones before and after, and a genuine U+FFFD."""
    raw = F.concat(F.unhex(F.lit("FFFE")), F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("E28241EFBFBDC0")))
    return views.raw_texts(spark, sf_dir).select("doc_id", raw.alias("raw")).select("doc_id", T.sanitize_utf8("raw").alias("text"))


#: What is searched, and its stems (no stopword has one of these).
STEMMED_QUERY = "consulta sobre thtiones ederou reatea mentes"
STEMMED = ["consult", "sobr", "thtion", "eder", "reat", "ment"]


@query(rf"""WITH {V1}, t AS (SELECT id, unnest(regexp_extract_all(lower(content), '\p{{L}}+')) AS w FROM v1),
{stemmed('t', 'w')},
h AS (SELECT id, CAST(count(*) AS INTEGER) AS hits FROM t JOIN stems USING (w) WHERE stem IN ({', '.join(f"'{x}'" for x in STEMMED)}) GROUP BY id)
SELECT id, hits, CAST(row_number() OVER (ORDER BY hits DESC, id) AS INTEGER) AS rk FROM h QUALIFY rk <= 100""")
def fts_stemmed(spark, sf_dir):
    return retrieval.text_lane(views.vector_chunks(spark, sf_dir), lexing.query_lexemes(STEMMED_QUERY, "portuguese"), language="portuguese")


@query(f"""WITH {_clean_sql('documents')}, e AS (SELECT doc_id, {_TRIM} AS text FROM s), {_kept_sql('e', 'doc_id')},
r AS (SELECT 'd/doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.md' AS file_path, CAST(unnest(generate_series(0, len(kept) - 1)) AS INTEGER) AS chunk_index, unnest(kept) AS content FROM c)
SELECT row_number() OVER (ORDER BY file_path, chunk_index) - 1 AS id, file_path, chunk_index, content, CAST(64 AS INTEGER) AS dims FROM r""")
def index_pipeline(spark, sf_dir):
    files = views.raw_texts(spark, sf_dir).select(F.concat(F.lit("d/doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("file_path"), F.col("text").cast("binary").alias("raw"), F.lit(None).cast("string").alias("error"))
    _, numbered = indexing.with_ids(indexing.split_chunks(markdown.texts(files)))
    made = indexing.embed(numbered, providers.HashingEmbedder(64))
    return made.select("id", "file_path", "chunk_index", "content", F.size("embedding").alias("dims"))


@query(f"""WITH {V1}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, distance, id) AS rank FROM (WITH {_hybrid_sql(TERMS, 5, '')})),
t AS (SELECT rank, file_path, chunk_index, distance, regexp_replace(replace(content, chr(10), ' '), '^{_WS}+|{_WS}+$', '', 'g') AS x FROM top),
k AS (SELECT *, x[:list_max(list_filter(range(0, 201), lambda k: strlen(x[:k]) <= 200))] AS cut FROM t),
o AS (SELECT rank, file_path, chunk_index, distance, CASE WHEN strlen(x) <= 200 THEN x WHEN strlen(cut) < 200 THEN cut || chr(65533) || '...' ELSE cut || '...' END AS content FROM k)
SELECT CAST(to_json({{'results': list({{'file_path': file_path, 'chunk_index': chunk_index, 'content': content, 'distance': distance}} ORDER BY rank), 'query': '{" ".join(TERMS)}'}}) AS VARCHAR) AS json FROM o""")
def search_response(spark, sf_dir):
    chunks, q = _v1(spark, sf_dir)
    found = retrieval.hybrid(chunks, q, TERMS, 5).drop("id")
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "distance")))  # five rows
    return retrieval.response(ranked.withColumn("content", T.snippet(F.col("content"))), " ".join(TERMS))
