import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docquarry.llm import decontaminate, language, line_dedup, shared, similar
from tests.oracle import compare

from .cases import awkward, empty
from .test_text_operators import brute_lines, edited_copies, exhaustive
from .test_token_operators import crc


def test_line_dedup_equals_sql(spark, sf_dir):
    compare(spark, sf_dir, line_dedup.op5_line_dedup, line_dedup.OP5_SQL)
    assert brute_lines([(1, "a")])


def test_stages_keep_columns_and_rows_follow(spark, sf_dir):
    for docs in (shared.table(spark, sf_dir, "documents"), awkward(spark), empty(spark)):
        columns, before = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = shared.store(stage(spark, docs, sf_dir), name)
            assert docs.columns == columns
            n = docs.count()
            assert n == before if name == "lines" else n <= before
            before = n
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
        assert ids == {r.doc_id for r in docs.select("doc_id").collect()}
        assert pieces.where(F.col("length") < 1).count() == 0


def test_names_of_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "benchmark", "packing"]
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def brute_similar(rows, least=0.8):
    """The first doc_id of each component of texts whose sets of five-word shingles have a Jaccard similarity of least."""
    sets = []
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets.append((d, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            out[find(i)] = min(d, out.get(find(i), d))
    return sorted(out.values())


def graded_copies():
    """Texts at similarities about 0.7 to 1 to a few originals, and a chain whose ends are far apart."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(9000)}"
    out = []
    for n in (30, 120, 400):
        base = [word() for _ in range(n)]
        for share in (0, 0.01, 0.015, 0.02, 0.022, 0.025, 0.03, 0.035, 0.04):
            out.append(" ".join(w if rng.random() >= share else word() for w in base))
    chain = [word() for _ in range(200)]
    for _ in range(8):
        chain = chain[10:] + [word() for _ in range(10)]
        out.append(" ".join(chain))
    return out


def test_near_stage_finds_all_alike(spark, sf_dir, monkeypatch):
    for docs, cell in ((shared.table(spark, sf_dir, "documents"), 4096), (awkward(spark, graded_copies()), 4096), (awkward(spark, graded_copies()), 3), (empty(spark), 4096)):
        monkeypatch.setattr(similar, "CELL", cell)
        kept = corpus_pipeline.near_stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == brute_similar([(r.doc_id, r.text) for r in docs.collect()])


def brute_languages(rows):
    """(score, language) of each (doc_id, text, lang) by adding up trigram vectors one at a time, and the accepted rows."""
    def vector(text):
        low = [c if c.isalpha() else None for c in f" {text.lower()} "]
        letter = lambda c: 0 if c is None else ord(c)
        grams = Counter((letter(a), letter(b), letter(c)) for a, b, c in zip(low, low[1:], low[2:], strict=False) if b)
        total = np.zeros(language.DIMS, np.int64)
        for (a, b, c), n in grams.items():
            total += np.int64(n) * (np.roll(language.letter_vector(a), 2) * np.roll(language.letter_vector(b), 1) * language.letter_vector(c)).astype(np.int64)
        return total / max(1e-9, float(np.sqrt((total**2).sum())))

    held = [zlib.crc32(str(d if d is not None else "").encode()) % 4 == 2 for d, *_ in rows]
    vectors = [vector(t or "") for _, t, _ in rows]
    own = {}
    for (_, t, lang), h, v in zip(rows, held, vectors, strict=True):
        if lang is not None and t is not None and not h and v.any():
            own[lang] = own.get(lang, 0) + v
    own = {k: v / np.sqrt((v**2).sum()) for k, v in sorted(own.items())}
    out = []
    for v in vectors:
        scores = {k: float(v @ p) for k, p in own.items()}
        best = max(scores, key=scores.get) if scores and v.any() else None
        out.append((max(0.0, scores[best]), best) if best else (0.0, "und"))
    right = sorted(s for (s, p), h, (_, t, lang) in zip(out, held, rows, strict=True) if h and t is not None and p == lang)
    least = next((int(s * 1000) / 1000 for k, s in enumerate(right, 1) if k > 0.001 * len(right)), 0.0)
    return out, [p != "und" and s > 0 and s >= least for s, p in out], least


def test_language_stage_equals_plain_sums(spark, sf_dir):
    for docs in (shared.table(spark, sf_dir, "documents").where("n_chars < 9000"), awkward(spark)):
        rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
        out, stay, least = brute_languages(rows)
        got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identify(docs).collect()}
        for (d, t, _), (score, name) in zip(rows, out, strict=True):
            assert abs(got[d, t][1] - score) < 1e-4 and (got[d, t][0] == name or score < 1e-4)
        kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.language_stage(spark, docs, sf_dir).collect())
        sure = [abs(s - least) > 1e-4 for s, _ in out]
        assert all((kept[d, t] > 0) == k for (d, t, _), k, s in zip(rows, stay, sure, strict=True) if s)
    assert not all(stay)


def test_line_stage_equals_brute_force(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    shared_lines = Counter(k for _, t in rows for k in {x.strip(line_dedup.SPACE).translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")})
    common = {k for k, n in shared_lines.items() if n >= 10 and k}
    want = {d: None if t is None else "\n".join(x for x in t.split("\n") if x.strip(line_dedup.SPACE).translate({c: c + 32 for c in range(65, 91)}) not in common) for d, t in rows}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, sf_dir).collect()} == want


def test_benchmark_stage_equals_exhaustive_alignment(spark, sf_dir):
    items = [(r.item_id, r.text) for r in shared.table(spark, sf_dir, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in shared.table(spark, sf_dir, "documents").collect() if len(r.text or "") < 6000]
    rows += list(enumerate(edited_copies([items[7][1]]), 10**6))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bad = {d for d, *_ in exhaustive(rows, items)}
    assert {r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, sf_dir).collect()} == {d for d, _ in rows} - bad
    assert bad and decontaminate.THRESHOLD == 0.5


def test_packing_stage_equals_library(spark, sf_dir):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = shared.table(spark, sf_dir, "documents").where("doc_id < 60")
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    filled, covered = {}, Counter()
    for r in sorted(corpus_pipeline.packing_stage(spark, docs, sf_dir).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0) and r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        filled[r.sequence_id] = r.offset + r.length
        covered.update((r.doc_id, p) for p in range(r.start, r.start + r.length))
    assert covered == Counter((d, p) for d, ids in want.items() for p in range(len(ids)))
    assert all(n <= 1024 and n & (n - 1) == 0 for n in filled.values())
