import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docquarry.operators import batch, retrieval, vector_index
from docquarry.plans import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exact(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def chunks(spark, sf_dir):
    return views.vector_chunks(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(30, size=3000)] + 0.2 * rng.normal(size=(3000, 24))
    x[7], x[8], x[9] = 0, x[10], x[10]
    rows = [(k, f"f{k % 40}", k, "t", [float(v) for v in r]) for k, r in enumerate(x.astype(np.float32))]
    rows += [(3000, "f1", 0, "none", None), (3001, "f1", 0, "none", []), (3002, "f1", 0, "short", [1.0])]
    return spark.createDataFrame(rows, "id long, file_path string, chunk_index int, content string, embedding array<float>").cache()


def queries_of(rows, ids):
    return {r.id: list(r.embedding) for r in rows.where(F.col("id").isin(ids)).collect()}


def test_exact_search_equals_the_scan(spark, chunks, clustered, tmp_path):
    for name, rows, cells in (("v1", chunks, 12), ("clustered", clustered, 30)):
        index = vector_index.VectorIndex(spark, str(tmp_path / name))
        assert index.nearest([1.0, 2.0]).count() == 0
        half = rows.where("id < 150")
        assert index.update(half, cells) + index.update(rows, cells) == rows.where("size(embedding) > 1 and exists(embedding, x -> x <> 0)").count()
        assert index.update(rows, cells) == 0
        for q in [*queries_of(rows, [0, 11, 150]).values(), [0.5] * len(queries_of(rows, [0])[0])]:
            for most in (1, 20):
                want = exact(retrieval.vector_lane(retrieval.with_distance(rows.where("size(embedding) > 1"), q), most), "id", "distance", "rk")
                assert exact(index.nearest(q, most), "id", "distance", "rk") == want
            want = exact(retrieval.similarity_search(rows.where("size(embedding) > 1"), q, 5, 0.9), "id", "file_path", "chunk_index", "content", "distance")
            assert exact(index.similarity_search(rows, q, 5, 0.9), "id", "file_path", "chunk_index", "content", "distance") == want
        assert index.nearest([0.0] * len(q)).count() == 0 and index.nearest([1.0]).count() == 0


def test_recall_and_pruning(spark, clustered, tmp_path):
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    index.update(clustered, 30)
    probes = index.fit_probes(0.95)
    assert 1 <= probes < 10
    asked = queries_of(clustered, list(range(100, 140)))
    hit = total = 0
    for i, q in list(asked.items())[:10]:
        want = {r.id for r in retrieval.vector_lane(retrieval.with_distance(clustered.where("size(embedding) > 1"), q), 20).collect()}
        hit += len(want & {r.id for r in index.nearest(q, 20, probes).collect()})
        total += len(want)
    assert hit / total >= 0.9
    rows = index.rows([0, 1])
    assert "PartitionFilters: [cell#" in plan(rows) and rows.count() < 1000
    low = [low for _, low, _, _ in index._reach(q)]
    assert max(low) > 0.1  # some cells can be left out of an exact search


def test_bounds_hold_and_codes_are_small(spark, clustered, tmp_path):
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    index.update(clustered, 8)
    q = queries_of(clustered, [5])[5]
    rows = retrieval.with_distance(index.bounded(index.rows(list(range(8))), q), q)
    assert rows.count() == 2999 and rows.where("distance < low or distance > high").count() == 0
    assert rows.select(F.max(F.col("high") - F.col("low")).alias("w")).first().w < 0.05
    size = {"codes": 0, "embedding": 0}
    for path in (tmp_path / "i").glob("g=*/cell=*/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                name = col.path_in_schema.split(".")[0]
                if name in size:
                    size[name] += col.total_compressed_size
    assert size["codes"] < 0.4 * size["embedding"]
    assert "embedding" not in plan(index.bounded(index.rows([0]), q).select("id", "low", "high")).split("ReadSchema")[1]


def test_large_cells_are_split(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL", 100)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    index.update(clustered, 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = index.rows([0]).inputFiles()
    assert len(files) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_queries_equal_single_searches(spark, chunks, clustered):
    for rows in (chunks.where("id < 400"), clustered):
        asked = queries_of(rows, list(range(0, 120, 11)))
        table = spark.createDataFrame([(i, q) for i, q in asked.items()] + [(-1, [0.0] * len(asked[0])), (-2, [1.0, 0.0]), (-3, None)], "query_id long, vector array<float>")
        got = exact(batch.vector_lanes(rows, table, 20), "query_id", "id", "distance", "rk")
        near = exact(batch.similarity_searches(rows, table, 4, 0.9), "query_id", "id", "distance")
        plain = rows.where(f"size(embedding) = {len(asked[0])}")
        for i, q in asked.items():
            want = exact(retrieval.vector_lane(retrieval.with_distance(plain, q), 20), "id", "distance", "rk")
            assert [r[1:] for r in got if r[0] == i] == want
            assert [r[1:] for r in near if r[0] == i] == exact(retrieval.similarity_search(plain, q, 4, 0.9), "id", "distance")
        assert not [r for r in got if r[0] in (-1, -2, -3)]


def test_many_hybrid_searches_equal_single_ones(spark, chunks):
    named = chunks.withColumn("content", F.concat("content", F.when(F.col("id") % 7 == 0, " unit-id").otherwise("")))
    from docquarry.functions import lexing

    stored = named.withColumn("lexemes", lexing.words(F.col("content"))).cache()
    texts = ["les ouier para", "um no de", "para UNIT_ID unit", "ouier", "zzzz", ""]
    asked = list(zip(queries_of(chunks, [0, 5, 9, 12, 30, 31]).values(), texts, strict=True))
    table = spark.createDataFrame([(k, q, t) for k, (q, t) in enumerate(asked)], "query_id long, vector array<float>, text string")
    got = exact(batch.hybrid_searches(stored, table, 6), "query_id", "id", "file_path", "chunk_index", "distance", "score")
    for k, (q, t) in enumerate(asked):
        want = exact(retrieval.hybrid_search(stored, q, t, 6), "id", "file_path", "chunk_index", "distance", "score")
        assert [r[1:] for r in got if r[0] == k] == want, t
