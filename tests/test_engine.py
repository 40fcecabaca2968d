import io
import json
import os
import re
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from docquarry import service
from docquarry.functions import lexing, vector
from docquarry.operators import indexing, retrieval
from docquarry.plans import catalog, ledger, schema, views
from docquarry.service import BadRequest, Engine, parse_request
from docquarry.sources import markdown, providers
from docquarry.streaming import ingest

LINE = "palavras suficientes para que o trecho tenha mais de cinquenta bytes de texto, com certeza"


@pytest.fixture
def docs(tmp_path):
    root = tmp_path / "docs"
    (root / ".h" / "sub").mkdir(parents=True)
    (root / "a-b_123456.md").write_text(f"# Título\n{LINE} UNIT_ID\ncurto\n")
    (root / "_c.MD").write_text(f"{LINE} dois\n\n" + "\n".join(f"## parte {i}\n" + LINE * 10 for i in range(4)))
    (root / ".h" / "sub" / "d.md").write_bytes(b"\xff\xfe" + LINE.encode())
    (root / "blank.md").write_text(" \n\n")
    (root / "skip.txt").write_text(LINE)
    return root


def test_index_and_search(spark, docs, tmp_path):
    settings = schema.Settings(docs_dir=str(docs), table_path=str(tmp_path / "chunks"), embedding_dims="64")
    engine = Engine(spark, settings, chat=providers.ExtractiveChat())
    files = markdown.scan_markdown(spark, str(docs))
    assert {r.file_path for r in files.collect()} == {"a-b_123456.md", "_c.MD", ".h/sub/d.md", "blank.md"}
    row = engine.index()
    assert (row["failed"], row["skipped_files"]) == (0, 1)
    first = {(r.id, r.file_path, r.chunk_index, r.content) for r in engine.chunks.collect()}
    assert len(first) == row["indexed"] and sorted(x[0] for x in first) == list(range(row["indexed"]))
    assert schema.bad_rows(engine.chunks, 64).count() == 0 and schema.repeated_keys(engine.chunks).count() == 0
    assert engine.index() == {"indexed": 0, "failed_files": 0, "failed_chunks": 0, "failed": 0, "skipped_files": 4, "skipped_chunks": 0, "skipped": 4}
    assert {(r.id, r.file_path, r.chunk_index, r.content) for r in engine.chunks.collect()} == first
    assert all(r.lexemes == [lexing.stem_portuguese(w) for w in re.findall(r"[^\W\d_]+", r.content.lower()) if w not in lexing.stopwords()] for r in engine.chunks.collect())
    assert engine.stats() == {"total_chunks": len(first), "total_files": 3}
    assert engine.health() == {"status": "healthy"}
    out = engine.search("palavras UNIT_ID", 3)
    assert out["results"][0]["file_path"] == "a-b_123456.md" and "[Fonte 1]" in out["answer"]
    settings.distances = "blocks"
    same = engine.search("palavras UNIT_ID", 3)
    assert [r | {"distance": round(r["distance"], 12)} for r in same["results"]] == [r | {"distance": round(r["distance"], 12)} for r in out["results"]]
    assert [list(r) for r in out["results"]] == [["file_path", "chunk_index", "content", "distance"]] * 3


def test_samples(spark, tmp_path):
    engine = Engine(spark, schema.Settings(docs_dir=str(tmp_path / "none"), table_path=str(tmp_path / "t"), embedding_dims="32"))
    engine.index()
    assert engine.stats() == {"total_chunks": 6, "total_files": 1}
    assert engine.search("um no de", 2)["results"][0]["file_path"] == "sample"


def test_stream_indexes_once(spark, docs, tmp_path):
    for _ in range(2):
        q = ingest.watch(spark, str(docs), str(tmp_path / "t"), str(tmp_path / "c"), providers.HashingEmbedder(16), availableNow=True)
        q.awaitTermination()
    rows = indexing.read_table(spark, str(tmp_path / "t"))
    assert rows.count() > 0 and schema.repeated_keys(rows).count() == 0


def test_requests():
    assert parse_request('{"query": "x"}') == ("x", 5) and parse_request('{"query": " ", "limit": 0}') == (" ", 5)
    for body in ("{", '{"query": ""}', "[1]", "{}", '{"query": 5}', '{"query": "x", "limit": "3"}', '{"query": "x", "limit": 2.7}', '{"query": "x", "limit": true}', '{"query": "x", "limit": -1}'):
        with pytest.raises(BadRequest):
            parse_request(body)


def test_settings(spark):
    assert schema.Settings.load({"EMBEDDING_DIMS": "", "DOCS_DIR": "d"}) == schema.Settings(docs_dir="d")
    made = lambda **x: Engine(spark, schema.Settings(**x))
    assert (made(embedding_dims="9").embedder, made().chat) == (providers.HashingEmbedder(9), providers.ExtractiveChat())
    engine = made(embedding_model="m", model_host="http://h", chat_backend=" Remote ", remote_url="http://r", chat_key=" k ", chat_model="c")
    assert (engine.embedder, engine.chat) == (providers.HttpEmbedder("http://h", "m"), providers.RemoteChat("http://r", "k", "c"))
    assert made(chat_backend="ours", chat_model="c").chat == providers.LocalChat("http://localhost:11434", "c") and made(chat_backend="none").chat is None


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_are_dense_and_in_order(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.range(0, 200_000, 1, 8).select(F.concat(F.lit("f"), F.xxhash64(F.col("id") / 7 - F.col("id") % 7 / 7).cast("string")).alias("file_path"), (F.col("id") % 7).cast("int").alias("chunk_index"))
        _, got = indexing.with_ids(rows, 5)
        assert got.count() == 200_000
        ids = got.agg(F.countDistinct("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        assert tuple(ids) == (200_000, 5, 200_004)
        found = [(r.file_path, r.chunk_index) for r in got.orderBy("id").collect()]
        assert found == sorted(found)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


class Failing(providers.HashingEmbedder):
    """Fails whenever a text names the word."""

    def embed(self, texts):
        if any("falha" in t for t in texts):
            raise providers.ModelError("no")
        return super().embed(texts)


def test_failures_are_counted(spark, tmp_path):
    long = "x" * 1501
    rows = [("a.md", f"um {long}\nfalha {long}\ntres {long}\ncurto".encode(), None), ("b.md", None, "gone"), ("c.md", b" \n", None), ("d.md", f"bom {LINE}".encode(), None)]
    files = spark.createDataFrame(rows, "file_path string, raw binary, error string")
    got = indexing.index_files(files, str(tmp_path / "t"), Failing(16), 16)
    assert got == {"indexed": 3, "failed_files": 1, "failed_chunks": 1, "failed": 2, "skipped_files": 1, "skipped_chunks": 1, "skipped": 2}
    table = indexing.read_table(spark, str(tmp_path / "t"))
    assert sorted((r.file_path, r.chunk_index, r.content[:2]) for r in table.collect()) == [("a.md", 0, "um"), ("a.md", 1, "tr"), ("d.md", 0, "bo")]
    with pytest.raises(indexing.BadVectors):
        indexing.index_files(files.withColumn("file_path", F.concat(F.lit("z"), "file_path")), str(tmp_path / "t"), Failing(17), 16)
    assert indexing.read_table(spark, str(tmp_path / "t")).count() == 3


@pytest.fixture
def odd_names(tmp_path):
    root = tmp_path / "it's" / "docs"
    (root / ".h").mkdir(parents=True)
    (root / "docs").mkdir()
    for name in ("_a.md", ".h/b.md", "a b.md", "a%20b.md", "docs/docs.md", "é+x.MD"):
        (root / name).write_text(f"{LINE} em {name}")
    return root, {"_a.md", ".h/b.md", "a b.md", "a%20b.md", "docs/docs.md", "é+x.MD"}


def test_every_root_lists_the_same(spark, odd_names, monkeypatch):
    root, names = odd_names
    monkeypatch.chdir(root.parent)
    for given in ("docs", "./docs", "docs/", str(root), f"file:{root}", f"file://{root}"):
        rows = markdown.scan_markdown(spark, given).collect()
        assert {r.file_path for r in rows} == names and all(r.error is None and LINE in bytes(r.raw).decode() for r in rows)


def test_a_store_that_only_spark_reads(spark, odd_names):
    root, names = odd_names
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./in", f"file://{root}")
    rows = markdown.scan_markdown(spark, "viewfs://tests/in").collect()
    assert {r.file_path for r in rows} == names
    assert {r.file_path for r in rows if r.error} == {"_a.md", ".h/b.md"} and all(r.raw for r in rows if not r.error)


def test_stream_and_batch_give_equal_paths(spark, odd_names, tmp_path):
    root, names = odd_names
    table, marks = str(tmp_path / "t"), str(tmp_path / "c")
    for _ in range(2):
        ingest.watch(spark, str(root), table, marks, providers.HashingEmbedder(16), availableNow=True).awaitTermination()
        assert {r.file_path for r in indexing.read_table(spark, table).collect()} == names
    (root / "_later.md").write_text(f"{LINE} depois")
    ingest.watch(spark, str(root), table, marks, providers.HashingEmbedder(16), availableNow=True).awaitTermination()
    assert {r.file_path for r in indexing.read_table(spark, table).collect()} == names | {"_later.md"}
    assert indexing.index_files(markdown.scan_markdown(spark, str(root)), table, providers.HashingEmbedder(16))["indexed"] == 0


def test_http(spark, docs, tmp_path):
    engine = Engine(spark, schema.Settings(docs_dir=str(docs), table_path=str(tmp_path / "chunks"), embedding_dims="16"))
    engine.index()
    server = service.serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else body.encode(), method=method)
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.status, json.loads(answer.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("GET", "/health") == (200, {"status": "healthy"}) and ask("GET", "/stats")[1]["total_files"] == 3
        status, out = ask("POST", "/search", '{"query": "palavras dois", "limit": 1}')
        assert status == 200 and len(out["results"]) == 1 and out["query"] == "palavras dois"
        assert [ask(*x)[0] for x in (("GET", "/search"), ("POST", "/search", "{"), ("POST", "/search", '{"query": ""}'), ("GET", "/none"))] == [405, 400, 400, 404]
    finally:
        server.shutdown()


def test_fallback_and_thresholds(spark):
    rows = spark.createDataFrame([(1, "a", 0, "um texto", [1.0, 0.0]), (2, "a", 1, "nada", [0.0, 1.0]), (3, "b", 0, "zero", [0.0, 0.0])], "id long, file_path string, chunk_index int, content string, embedding array<float>")
    assert [r.id for r in retrieval.similarity_search(rows, [1.0, 0.0]).collect()] == [1]
    assert retrieval.similarity_search(rows, [0.0, 0.0]).count() == 0
    assert retrieval.hybrid_search(rows, [1.0, 0.0], "S3_x").first().score is None
    assert retrieval.hybrid_search(rows, [1.0, 0.0], "como para", language="portuguese").count() == 1
    block = vector.cosine_distance_blocks([1.0, 0.0])
    assert [r.d for r in rows.select("id", block("embedding").alias("d")).orderBy("id").collect()] == [0.0, 1.0, None]


@pytest.mark.parametrize(("centre", "size", "want"), [(0, 3, [0, 1, 2]), (4, 3, [3, 4, 5]), (7, 3, [6, 7]), (4, 4, [2, 3, 4, 5])])
def test_window(spark, centre, size, want):
    rows = spark.createDataFrame([("f", i, str(i)) for i in range(8)], "file_path string, chunk_index int, content string")
    assert [r.chunk_index for r in retrieval.chunk_window(rows, "f", centre, size).collect()] == want
    centres = spark.createDataFrame([("f", centre)], "file_path string, centre int")
    assert sorted(r.chunk_index for r in retrieval.chunk_windows(rows, centres, size).collect()) == want


def test_response_of_nothing(spark):
    none = spark.createDataFrame([], "rank int, file_path string, chunk_index int, content string, distance double")
    assert json.loads(retrieval.response(none, "q").first().json) == {"results": [], "query": "q"}


def test_providers(monkeypatch):
    sent = []

    class Answer(io.BytesIO):
        status = 200

    def urlopen(request, timeout):
        sent.append(json.loads(request.data))
        return Answer(json.dumps({"embeddings": [[1.0]], "message": {"content": " hi "}, "choices": [{"message": {"content": "yo"}}]}).encode())

    monkeypatch.setattr(providers.urllib.request, "urlopen", urlopen)
    assert providers.HttpEmbedder("http://h", "m").embed(["x"]) == [[1.0]]
    assert providers.query_text(providers.chat_provider("local", "http://h"), "q") == "hi\nq"
    assert providers.chat_provider("remote", "http://h", "k", "m").chat([], 0.0, 5) == "yo" and "temperature" not in sent[-1]
    with pytest.raises(providers.ModelError):
        providers.RemoteChat("http://h", "", "m").chat([], 0.1, 5)
    assert providers.query_text(providers.RemoteChat("http://h", "", ""), "q") == "q"
    assert not providers.wait_for(lambda: False, 0.01, 0.01)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    chunks, q = views.vector_chunks(spark, sf_dir), views.query_vector(spark, sf_dir)
    assert "TakeOrderedAndProject" in plan(retrieval.vector_lane(retrieval.with_distance(chunks, q)))
    assert "WindowGroupLimit" in plan(retrieval.similarity_search(chunks, q))
    assert "BroadcastHashJoin" in plan(retrieval.hybrid(chunks, q, catalog.TERMS))
    pushed = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("source") == "src3").select("doc_id")
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in plan(pushed)


def test_searches_through_indexes_equal_scans(spark, docs, tmp_path, monkeypatch):
    settings = schema.Settings(docs_dir=str(docs), table_path=str(tmp_path / "chunks"), embedding_dims="32", search="index")
    engine = Engine(spark, settings)
    engine.index()
    for round_ in range(2):
        for query in ("palavras UNIT_ID", "parte dois", "um no de", "zzzz", "UNIT_ID"):
            settings.search = "index"
            found = engine.search(query, 3)
            settings.search = "scan"
            assert engine.search(query, 3) == found, query
        settings.search = "index"
        (docs / f"more{round_}.md").write_text("\n".join(f"## mais {i}\n" + LINE * 15 for i in range(3)))
        assert engine.index()["indexed"] > 0
    monkeypatch.setattr(indexing, "MOST_PARTS", 1)
    engine.indexes.update()  # nothing is new; what was added in three runs is brought together
    for index in (engine.indexes.text, engine.indexes.trigrams, engine.indexes.vectors):
        assert len(index.parts.entries()) == 1
    engine.indexes.forget()
    for query in ("palavras UNIT_ID", "um no de"):
        found = engine.search(query, 3)
        settings.search = "scan"
        assert engine.search(query, 3) == found, query
        settings.search = "index"
    chunks = engine.chunks.count()
    assert engine.indexes.text.parts.high() == engine.indexes.vectors.parts.high() == chunks
    assert schema.repeated_keys(engine.chunks).count() == 0


def test_kept_counts(spark, docs, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    count = lambda: retrieval.stats(indexing.read_table(spark, table)).first().asDict()
    assert indexing.stats(spark, table) == {"total_chunks": 0, "total_files": 0}
    for _ in range(2):
        indexing.index_files(markdown.scan_markdown(spark, str(docs)), table, Failing(16))
        assert ledger.Counts(spark, table).known() == tuple(count().values())
        (docs / "z.md").write_text(f"{LINE} z\n" + "x" * 1501 + "\nfalha " + LINE)
    with monkeypatch.context() as m:  # no scan is needed
        m.setattr(indexing, "read_table", None)
        assert indexing.stats(spark, table)["total_files"] == 4
    other = indexing.read_table(spark, table).limit(1).withColumn("file_path", F.lit("other.md"))
    other.write.mode("append").parquet(table)  # by another program
    assert ledger.Counts(spark, table).known() is None and indexing.stats(spark, table) == count()
    indexing.index_samples(spark, table, Failing(16))
    assert ledger.Counts(spark, table).known() == tuple(count().values())


def test_one_writer_at_a_time(spark, docs, tmp_path):
    table = str(tmp_path / "t")
    with ledger.writing(spark, table), pytest.raises(ledger.Busy):
        indexing.index_files(markdown.scan_markdown(spark, str(docs)), table, providers.HashingEmbedder(16))
    assert indexing.index_files(markdown.scan_markdown(spark, str(docs)), table, providers.HashingEmbedder(16))["indexed"] > 0
    left = [p for p in tmp_path.rglob("*") if "placed-chunks" in str(p) or "embedded" in str(p)]
    assert not left and "_writer" not in ledger.Folder(spark, table).names()


class Counting(providers.HashingEmbedder):
    """Writes what it is asked for to a file that executors and driver share."""

    name = "counting"

    def embed(self, texts):
        with open(COUNTED, "a") as f:
            f.write("".join("asked\n" for _ in texts))
        return super().embed(texts)


COUNTED = "/tmp/docquarry-test-asked"


def test_no_text_is_embedded_twice(spark, docs, tmp_path):
    asked = lambda: len(open(COUNTED).readlines()) if os.path.exists(COUNTED) else 0
    if os.path.exists(COUNTED):
        os.remove(COUNTED)
    rows = [(f"a/{k}/same.md", f"{LINE} igual".encode(), None) for k in range(5)] + [("b/x.md", f"{LINE} outro".encode(), None)]
    files = spark.createDataFrame(rows, "file_path string, raw binary, error string")
    table = str(tmp_path / "t")
    assert indexing.index_files(files, table, Counting(16))["indexed"] == 6
    assert asked() == 2  # equal titles and texts
    moved = files.withColumn("file_path", F.concat(F.lit("moved/"), "file_path"))
    assert indexing.index_files(moved, table, Counting(16))["indexed"] == 6
    assert asked() == 2
    got = indexing.read_table(spark, table)
    assert got.count() == 12 and got.select(F.countDistinct("embedding")).first()[0] == 2
    os.remove(COUNTED)


def test_a_failing_service_is_tried_again(monkeypatch):
    tried, slept = [], []

    class Answer(io.BytesIO):
        status = 200

    def urlopen(request, timeout):
        tried.append(1)
        if len(tried) < 3:
            raise urllib.error.HTTPError("http://h", 503, "full", {}, None)
        return Answer(json.dumps({"embeddings": [[1.0]]}).encode())

    monkeypatch.setattr(providers.urllib.request, "urlopen", urlopen)
    monkeypatch.setattr(providers.time, "sleep", slept.append)
    assert providers.HttpEmbedder("http://h", "m").embed(["x"]) == [[1.0]] and slept == [0.5, 1.0]
    tried.clear()
    monkeypatch.setattr(providers.urllib.request, "urlopen", lambda *a, **k: tried.append(1) or (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(providers.ModelError, match="gone"):
        providers.HttpEmbedder("http://h", "m", tries=3).embed(["x"])
    assert len(tried) == 3
    assert providers.model_name(providers.HttpEmbedder("http://h", "m", 1)) == providers.model_name(providers.HttpEmbedder("http://h", "m", 2)) != providers.model_name(providers.HttpEmbedder("http://h", "n"))


def test_env_file(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# settings\nDOCS_DIR=/from/file # where\nexport EMBEDDING_DIMS='9'\nCHAT_MODEL=\"a b\"\nPORT=\nnonsense\n")
    assert schema.Settings.load({"DOCS_DIR": "/from/env", "CHAT_KEY": ""}, str(path)) == schema.Settings(docs_dir="/from/env", embedding_dims="9", chat_model="a b")
    assert schema.Settings.load({}, str(path)).docs_dir == "/from/file" and schema.Settings.load({}, str(tmp_path / "none")) == schema.Settings()
