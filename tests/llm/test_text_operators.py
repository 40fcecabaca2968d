import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.llm import decontaminate, language, line_dedup, near_dedup, shared

from .cases import SCHEMA, awkward, empty


def brute_lines(rows, min_docs=10):
    key = lambda x: re.sub("^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    seen = Counter(k for _, ls in lines for k in {key(x) for x in ls})
    out = Counter()
    for d, ls in lines:
        kept = [x for x in ls if not (key(x) and seen[key(x)] >= min_docs)]
        out[d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_line_dedup(spark, sf_dir):
    many = [f"  Common LINE \t\nown {i}\n\ncommon line\nÀ tail" for i in range(12)] + ["common line"] * 3
    for docs in (shared.table(spark, sf_dir, "documents"), awkward(spark, many), empty(spark)):
        got = line_dedup.drop_common_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
        assert Counter(map(tuple, got)) == brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    kept = line_dedup.without_common_lines(awkward(spark, many))
    assert kept.columns == awkward(spark).columns
    assert {r.text for r in kept.where("doc_id = 20").collect()} == {"own 0\n"}


def brute_fingerprint(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(prints))


def near_copies():
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(900)]
    out = []
    for _ in range(25):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(900)] = "changed"
        out.append(" ".join(words))
    return out + ["only three words", "ONLY three\nwords"]


def test_near_dedup(spark, sf_dir):
    for docs in (shared.table(spark, sf_dir, "documents"), awkward(spark, near_copies()), empty(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = brute_components(rows)
        assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == want
        kept = near_dedup.first_of_each(docs)
        assert kept.columns == docs.columns
        ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
        assert ids == sorted({c for _, _, c in want if c is not None})


@pytest.mark.parametrize("n", [2, 63, 64, 65, 300])
def test_bit_sliced_pairs_equal_popcount(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(n)], np.uint64)
    fps = centre[rng.integers(0, 3, n)] ^ flips
    bucket = np.sort(rng.integers(0, max(1, n // 20), n))
    got = {(int(a), int(b)) for i, j in near_dedup.close_pairs(fps, bucket) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if bucket[i] == bucket[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize("matched", near_dedup.MATCHED)
def test_tables_of_more_blocks_give_the_same_components(spark, monkeypatch, matched):
    monkeypatch.setattr(near_dedup, "blocks_for", lambda count: matched)
    rng = np.random.default_rng(matched)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for k in range(3, 7):  # at the radius and beyond it
            for bit in rng.choice(64, k, replace=False).tolist():
                b ^= 1 << bit
            fps.add(b)
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    root = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= near_dedup.RADIUS:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {f: new if r == old else r for f, r in root.items()}
    rows = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    got = {r.node: r.component for r in shared.components(near_dedup.links(rows, matched)).collect()}
    assert {f: got.get(f, f) for f in fps} == root


def test_number_of_blocks_grows_with_the_fingerprints():
    chosen = [near_dedup.blocks_for(10**k) for k in range(0, 15)]
    assert chosen == sorted(chosen) and chosen[6] == 2 and chosen[-1] > 3


def test_large_buckets_are_dealt_into_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 7)
    docs = awkward(spark, near_copies())
    assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_language_held_out_accuracy(spark):
    rows = language.identify(shared.table(spark, "/root/testdata/sf0.01", "documents")).select("doc_id", "held_out", "lang_pred", "score").collect()
    lang = {r.doc_id: r.lang for r in shared.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_language_awkward(spark):
    rows = language.identify(awkward(spark)).collect()
    by = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == awkward(spark).count()
    assert all(by[d] == "und" for d in (0, 1, 2, 3)) and by[4] == "en"
    assert language.identify(empty(spark)).count() == 0
    untaught = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(untaught).collect()} == {("und", 0.0)}
    kept = language.accepted(awkward(spark))
    assert kept.columns == awkward(spark).columns and not {0, 1, 2, 3} & {r.doc_id for r in kept.collect()}


ITEM = "That and onesen erblest it hein ti inenan eranenes whou therouou thon the Than heoron eratsh therin blees sh in"


def smith_waterman(a, b):
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            grid[i][j] = max(0, grid[i - 1][j - 1] + (1 if x == y else -1), grid[i - 1][j] - 1, grid[i][j - 1] - 1)
            best = max(best, grid[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item = rng.integers(1, 6, rng.integers(1, 12)).astype(np.int32)
        texts = [rng.integers(0, 6, rng.integers(1, 25)).astype(np.int32) for _ in range(5)]
        for t, (score, first, end) in zip(texts, decontaminate.align(item, texts), strict=True):
            assert score == smith_waterman(item.tolist(), t.tolist())
            assert score == smith_waterman(item.tolist(), t[first:end].tolist())


def test_decontamination(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["the", "of", "edre", "thin", "onan", "stre", "blees", "haer"]) for _ in range(n))
    words = ITEM.split()
    edited = [w if i % 6 else "altered" for i, w in enumerate(words)]
    fewer = [w for i, w in enumerate(words) if i % 7 != 3]
    extra = [ITEM, f"{filler(200)} {ITEM.upper()} {filler(90)}", filler(300), f"{filler(40)}\n{' '.join(edited)}, {filler(9)}", " ".join(fewer), " ".join(words[:6]), "tiny"]
    docs = awkward(spark, extra)
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "tiny"), (None, "same text here for ties")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(20, 1), (21, 1), (23, 1), (24, 1), (26, 4), (10, None), (11, None)}
    assert len(rows) == 7
    whole = next(r for r in rows if r.doc_id == 21)
    assert (whole.score, whole.first_word, whole.end_word) == (1.0, 200, 200 + len(words))
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 7 - 2  # seven documents, one of them there three times
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert SCHEMA


def test_decontamination_keeps_passages_of_common_trigrams(spark):
    words = [f"w{i}" for i in range(40)]
    edited, at, run = [], 0, 2
    while at < len(words):
        edited += [*words[at : at + run], f"new{at}"]
        at, run = at + run, 5 - run
    docs = spark.createDataFrame([(d, " ".join(edited[:-1])) for d in range(3)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    want = smith_waterman(words, edited) / len(words)
    assert want == 25 / 40
    assert {(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, bench).collect()} == {(d, 1, want) for d in range(3)}
    assert decontaminate.clean(docs, bench).count() == 0


def exhaustive(docs, items, least=0.5):
    """(document, item, score) by aligning every whole text with every item."""
    number = {}
    of = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in decontaminate.words_of(t)], np.int32)
    texts = [(d, w) for d, w in ((d, of(t)) for d, t in docs) if len(w)]
    out = set()
    for i, t in items:
        own = of(t)
        if len(own):
            for (d, _), (score, *_) in zip(texts, decontaminate.align(own, [w for _, w in texts]), strict=True):
                if score >= least * len(own):
                    out.add((d, i, score / len(own)))
    return out


def edited_copies(items):
    """Copies of items with words inserted, left out, altered and swapped, up to where they no longer count."""
    rng = random.Random(12)
    out = []
    for text in items:
        words = text.split()
        new = lambda: f"n{rng.randrange(999)}"
        out.append(" ".join(x for k, w in enumerate(words) for x in ([w, new()] if k % 2 else [w])))
        out.append(" ".join(x for k, w in enumerate(words) for x in ([w, new()] if k % 3 == 2 else [w])))
        for share in (0.1, 0.2, 0.25, 0.3):
            for edit in ("in", "out", "swap", "all"):
                made = []
                for w in words:
                    how = edit if edit != "all" else rng.choice(["in", "out", "swap"])
                    if rng.random() >= share:
                        made.append(w)
                    elif how != "out":
                        made += [new()] if how == "swap" else [w, new()]
                out.append(" ".join([new(), *made, new(), new()]))
    return out


def test_decontamination_equals_exhaustive_alignment(spark, sf_dir):
    items = [(r.item_id, r.text) for r in shared.table(spark, sf_dir, "benchmark").collect()]
    docs = [(r.doc_id, r.text) for r in shared.table(spark, sf_dir, "documents").collect() if len(r.text or "") < 6000]
    docs += list(enumerate(edited_copies([t for _, t in items[:6]]), 10**6))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(df, bench).collect()}
    want = exhaustive(docs, items)
    assert got == want and sum(d >= 10**6 for d, *_ in want) > 60


@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcdefgxy"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_seeds_lose_no_alignment(items, text):
    block = decontaminate.Items([(k, " ".join(w)) for k, w in enumerate(items)])
    block.rarest(np.random.default_rng(len(text)).integers(0, 9, len(block.keys)))
    words = np.array([block.vocabulary.get(w, 0) for w in text], np.int32)
    got = {i: s for _, i, s, *_ in sorted(decontaminate.aligned(block, [(0, i, s, words[s:e]) for i, s, e in block.passages(words)]), key=lambda x: x[2])}
    best = {k: smith_waterman(w, text) for k, w in enumerate(items) if w}
    assert got == {k: s / len(items[k]) for k, s in best.items() if s >= 0.5 * len(items[k]) and (len(items[k]) != 2 or s == 2)}


def test_many_blocks_of_items_in_two_passes(spark, sf_dir, monkeypatch):
    """Blocks change nothing, and the texts are read twice whatever their number."""
    docs = shared.table(spark, sf_dir, "documents").where("n_chars < 6000")
    bench = shared.table(spark, sf_dir, "benchmark").limit(60)
    want = Counter(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert want
    passes = []
    for name in ("_counted", "_found"):
        monkeypatch.setattr(decontaminate, name, (lambda f: lambda rows, blocks: passes.append(len(blocks)) or f(rows, blocks))(getattr(decontaminate, name)))
    for block in (7, 1):
        passes.clear()
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert Counter(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want
        assert passes == [-(-bench.count() // block)] * 2
