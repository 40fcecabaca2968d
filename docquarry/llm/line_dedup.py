"""Operator 5: drop lines that many documents share. DataFrame functions only.

Lines are normalised and hashed (128 bits); each document adds each of its distinct hashes once; hashes found in at least
`min_docs` documents are common. The lines of a document whose hash is common go, the others are joined again by position.

Plan: a partial count before the only shuffle of hashes (a line that a third of the rows hold arrives as one row a task);
the common hashes are stored; a semi-join finds the lines that have one (a skewed hash is split by AQE, or the
common hashes are broadcast if Spark finds them small) with their places; the places are gathered by document and joined to
the texts, whose other lines are joined again by position. All of this is linear in a text's lines.

Defined cases: every row is a document of its own, equal rows and rows without doc_id included. A null or empty text is
one empty line. Keys shorter than `min_chars` code points never go. Other columns pass through in `row`, whatever their
names. No rows: no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """row (the document as it came), n_lines, n_dropped, kept (its text without common lines)."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), lines.alias("lines"), F.xxhash64("text").alias("mark"))
    keys = F.filter(F.transform("lines", line_key), lambda k: F.length(k) >= min_chars)
    hashes = base.select("id", "mark", F.explode(F.array_distinct(F.transform(keys, _hash))).alias("hash"))
    common = shared.store(hashes.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("hash"), "common-lines")
    placed = F.transform("lines", lambda x: F.when(F.length(line_key(x)) >= min_chars, _hash(line_key(x))))
    found = base.select("id", "mark", F.posexplode(placed).alias("place", "hash")).where(F.col("hash").isNotNull()).join(common, "hash", "left_semi")
    found = found.groupBy("id", "mark").agg(F.collect_set("place").alias("gone"))
    found = found.select(F.col("id").alias("f_id"), F.col("mark").alias("f_mark"), "gone")
    joined = base.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))  # both are linear in the lines
    stays = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.col("lines").getItem(i)))
    return joined.withColumn("stays", stays).select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"),
        F.array_join("stays", "\n").alias("kept"),
    )


def without_common_lines(docs: DataFrame) -> DataFrame:
    """docs with common lines gone from text (a null text stays null) and n_chars, if there is one, made to fit."""
    out = drop_common_lines(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars").cast("long")))
    return out.select(row.alias("row")).select("row.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(shared.table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), f AS (
  SELECT key AS common FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), r AS (SELECT k.*, f.common IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.common)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
