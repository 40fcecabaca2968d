import os
import time

import pytest

from docquarry.operators import indexing
from docquarry.sources import folders, markdown, providers
from docquarry.streaming import ingest

LINE = "palavras suficientes para que o trecho tenha mais de cinquenta bytes de texto, com certeza"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "it's a tree"
    names = {f"{d}{n}" for d in ("", "a/", "a/b/", "a/b/c/", ".h/", "_u/v/", "é x/") for n in ("one.md", "_two.MD", ".three.md")}
    for n in names | {"a/skip.txt", "z/none.md.bak"}:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"{LINE} {n}")
    (root / "a" / "folder.md").mkdir()
    os.symlink(root / "a" / "one.md", root / "link.md")
    return root, names | {"link.md"}


@pytest.mark.parametrize("wanted", [1, 2, 4, 100])
@pytest.mark.parametrize("seen", [2, 20_000])
def test_partitions_cover_the_tree_once(tree, monkeypatch, wanted, seen):
    monkeypatch.setattr(folders, "MOST_SEEN", seen)
    root, names = tree
    own = folders.Tree(str(root))
    parts = own.parts(wanted)
    assert sorted(n for p in parts for n in own.files(p)) == sorted(names)
    assert all(len(p.folder.split("/")) <= 4 for p in parts) and (len(parts) > 1) == (wanted > 1 or seen == 2 and wanted > 1)


def test_a_store_gives_the_same_names(tree):
    root, names = tree
    store = folders.Tree(str(root))
    store.local, store.root, (store.store, store.base) = False, "mock://x", folders.pyarrow.fs.FileSystem.from_uri(root.as_uri())
    assert sorted(n for p in store.parts(50) for n in store.files(p)) == sorted(names)
    assert store.path("a/one.md") == "mock://x/a/one.md"
    first = store.state()
    assert store.state() == first
    (root / "a" / "one.md").rename(root / "a" / "uno.md")
    (root / "link.md").unlink()
    assert store.state() != first


def test_source_and_scan(spark, tree):
    root, names = tree
    rows = folders.files_below(spark, str(root))
    assert rows.rdd.getNumPartitions() > 1
    got = rows.collect()
    assert {r.file_path for r in got} == names and len(got) == len(names) and all(os.path.isfile(r.path) for r in got)
    assert {r.file_path for r in markdown.scan_markdown(spark, str(root)).collect()} == names


def test_state_tells_of_every_change(tree, monkeypatch):
    monkeypatch.setattr(folders, "SETTLED", 0.0)
    root, _ = tree
    source = folders._Arrivals(str(root), 4)
    first = source.latestOffset()
    assert source.latestOffset() == first != source.initialOffset()
    time.sleep(0.02)
    old = root / "a" / "b" / "one.md"
    old.rename(root / "a" / "b" / "uno.md")  # one gone, one come
    second = source.latestOffset()
    assert second != first and second["step"] == first["step"] + 1
    monkeypatch.setattr(folders, "SETTLED", 3600.0)  # too young to be trusted
    assert source.latestOffset() != source.latestOffset()


def test_stream_takes_what_replaces_a_file(spark, tree, tmp_path):
    root, names = tree
    table, marks = str(tmp_path / "t"), str(tmp_path / "c")
    run = lambda: ingest.watch(spark, str(root), table, marks, providers.HashingEmbedder(8), availableNow=True).awaitTermination()
    paths = lambda: {r.file_path for r in indexing.read_table(spark, table).select("file_path").collect()}
    run()
    assert paths() == names
    (root / "a" / "one.md").unlink()
    os.unlink(root / "link.md")
    new = root / "a" / "novo.md"
    new.write_text(f"{LINE} novo")
    os.utime(new, (1_000_000, 1_000_000))  # older than all that is there
    run()
    assert paths() == names | {"a/novo.md"}
