import re

import pytest
from pyspark.sql import functions as F

from docquarry.functions import lexing
from docquarry.operators import postings, retrieval
from docquarry.plans import catalog, ledger, views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chunks(spark, sf_dir):
    rows = views.vector_chunks(spark, sf_dir).select("id", "file_path", "chunk_index", "content", "embedding")
    return rows.withColumn("lexemes", lexing.words(F.col("content"))).cache()


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lexeme_index_equals_the_scan(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FIRST", 2)
    monkeypatch.setattr(postings, "BITS", 4)
    monkeypatch.setattr(postings, "BLOCK", 16)
    index = postings.TextIndex(spark, str(tmp_path / "text"))
    assert index.lane(["les"]).count() == 0
    assert index.update(chunks.where("id < 70")) == 70 and index.update(chunks) == chunks.count() - 70 and index.update(chunks) == 0
    for most in (3, 100):
        for terms in (catalog.TERMS, ["les"], ["nothere"], [], ["les", "nothere"]):
            want = rows_of(retrieval.text_lane(chunks, terms, most), "id", "hits", "rk")
            assert rows_of(index.lane(terms, most), "id", "hits", "rk") == want
    # blocks that cannot reach the lane are not among those read
    bounds = {r.block: r.bound for r in index.bounds(["para"]).collect()}
    assert len(bounds) > 4 and max(bounds.values()) > min(bounds.values())
    assert "PushedFilters: [In(key" in plan(index.of(["para", "les"])) and "PartitionFilters: [bucket#" in plan(index.of(["para", "les"]))
    before = rows_of(index.lane(catalog.TERMS), "id", "hits", "rk")
    index.compact()
    assert rows_of(index.lane(catalog.TERMS), "id", "hits", "rk") == before
    keys = index.of(["para"]).groupBy("block").count()
    assert keys.where("count > 1").count() == 0
    index.parts.forget()
    assert rows_of(index.lane(catalog.TERMS), "id", "hits", "rk") == before


def test_counted_words(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],), (None,)], "w array<string>")
    got = [r.c for r in rows.select(postings.counted(F.col("w")).alias("c")).collect()]
    assert [[tuple(x) for x in c] for c in got] == [[("a", 1), ("b", 2)], [], [("x", 1)], []]


def test_a_key_of_all_chunks_is_many_rows(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.array(F.lit("hot"), F.lit("hot"), F.concat(F.lit("w"), F.col("id"))).alias("lexemes"))
    index = postings.TextIndex(spark, str(tmp_path / "t"))
    index.update(rows)
    hot = index.of(["hot"]).collect()
    assert len(hot) == 5 and max(r.n for r in hot) == postings.BLOCK and sum(r.n for r in hot) == 20_000
    assert rows_of(index.lane(["hot", "w19999"], 3), "id", "hits", "rk") == [(0, 2, 2), (1, 2, 3), (19999, 3, 1)]


def test_trigram_index_equals_ilike(spark, tmp_path, monkeypatch):
    texts = ["nothing", "a UNIT_ID b", "x unit-id", "unitid", "UNITxID ÇÃO_x", "\n\nção_X 💥💥💥", "unit", "ab", None, "Unit_id again", "un\nit_id"] * 30
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(3)
    index = postings.TrigramIndex(spark, str(tmp_path / "tri"))
    index.update(rows.where("id < 100"))
    index.update(rows)
    for term in ("UNIT_ID", "ção_x", "💥💥💥", "_a_b_", "t_", "unit", "zzz_zzz", "it_id aga"):
        for most in (3, 50, 1000):
            assert rows_of(index.lane(rows, term, most), "id", "rk") == rows_of(retrieval.literal_lane(rows, term, most), "id", "rk"), term
    monkeypatch.setattr(postings, "ROUND", 2)
    monkeypatch.setattr(postings, "LISTED", 2)  # from eight candidates on all are joined
    for term in ("UNIT_ID", "unit", "it_id aga"):
        assert rows_of(index.lane(rows, term, 50), "id", "rk") == rows_of(retrieval.literal_lane(rows, term, 50), "id", "rk"), term


def test_trigrams_of_terms():
    assert postings.TrigramIndex.trigrams("UNIT_ID") == ["nit", "uni"]
    assert postings.TrigramIndex.trigrams("a_b") == [] and postings.TrigramIndex.trigrams("ab") == []


def test_ledger_and_lock(spark, tmp_path):
    parts = ledger.Generations(spark, str(tmp_path / "g"))
    assert parts.entries() == [] and parts.high() == 0 and parts.read("id long") is None
    rows = spark.range(3).withColumn("p", F.lit(1))
    parts.add(rows, 3, "p")
    rows.write.parquet(str(tmp_path / "g" / "g=left-by-a-failed-writer"))
    parts.add(spark.range(3, 5).withColumn("p", F.lit(2)), 5, "p")
    assert sorted(r.id for r in parts.read("id long, p int").collect()) == [0, 1, 2, 3, 4] and parts.high() == 5
    assert not parts.log.put_new("000000000001.json", "{}")
    with ledger.writing(spark, str(tmp_path / "g")):
        with pytest.raises(ledger.Busy, match="process"), ledger.writing(spark, str(tmp_path / "g")):
            pass
    with ledger.writing(spark, str(tmp_path / "g")):
        pass
    assert not re.findall("_writer", " ".join(ledger.Folder(spark, str(tmp_path / "g")).names()))
