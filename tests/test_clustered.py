import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators import indexing, retrieval
from docquarry.operators.clustered import ClusteredTable


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def source(spark):
    rows = [(k * 10 + i, f"file{k % 37}-{k}", i, f"text {k} {i}") for k in range(120) for i in range(k % 9 + 1)]
    made = spark.createDataFrame(rows, "id long, file_path string, chunk_index int, content string")
    return made.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")).withColumn("lexemes", F.array(F.lit("text"))).cache()


@pytest.fixture(scope="module")
def table(spark, source, tmp_path_factory):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    made = ClusteredTable(spark, str(tmp_path_factory.mktemp("c") / "t"), 8)
    made.append(source.where("id % 3 = 0"))
    yield made
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_insert_reads_the_table_without_a_shuffle(spark, source, table):
    want = rows_of(indexing.new_rows(source.union(source), table.frame()))
    new = table.new_rows(source.union(source))
    text = plan(new)
    assert rows_of(new) == want
    scan = text.index("Scan parquet spark_catalog")
    side = text[text.rindex("Sort [file_path", 0, scan) :]
    assert "Exchange" not in side[: side.index("Scan parquet spark_catalog")]
    assert len(re.findall(r"\bExchange hashpartitioning", text.split("Initial Plan")[0])) == 1  # of the new rows, by file
    table.insert(source.union(source))
    assert rows_of(table.frame()) == rows_of(source) and table.new_rows(source).count() == 0


def assert_one_bucket(spark, table):
    """Spark prunes buckets with and without a bucketed scan; the plan shows it for the former."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 8" in plan(retrieval.all_chunks_for_file(table.frame(), "file8-8"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_windows_and_single_files(spark, source, table):
    if table.frame().count() < source.count():
        table.insert(source)
    centres = source.groupBy("file_path").agg(F.max("chunk_index").alias("centre"))
    few = spark.createDataFrame(centres.limit(30).collect(), centres.schema)
    got = retrieval.chunk_windows(table.frame(), F.broadcast(few))
    assert rows_of(got) == rows_of(retrieval.chunk_windows(source, few))
    assert "Exchange hashpartitioning" not in plan(got)  # the centres are broadcast, the window takes the buckets as they are
    one = retrieval.all_chunks_for_file(table.frame(), "file8-8")
    assert rows_of(one) == rows_of(retrieval.all_chunks_for_file(source, "file8-8"))
    assert_one_bucket(spark, table)
    files = table.frame().groupBy("file_path").agg(F.count("*").alias("n"))
    assert "Exchange" not in plan(files) and files.count() == 120


def test_a_new_session_knows_the_layout(spark, table, source):
    again = ClusteredTable(spark.newSession(), table.path, 3)
    assert again.buckets == 8
    assert rows_of(again.frame()) == rows_of(table.frame())
    assert_one_bucket(again.spark, again)
