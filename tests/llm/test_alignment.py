from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docquarry.llm import alignment, tokens

from .cases import awkward

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = ["trailing space ", " leading", "a  b   c", "   ", " ", "<|endoftext|> <s></s> <unk> <0x41>", "💥é x", "x" * 300 + " " + "yz" * 200, "the the the the", "the cat", "the cat"]


def brute(texts):
    """Rows of figures in the order of texts, by the libraries and loops alone."""
    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    back = {chr(c): c for c in range(256)} | {s: c for c, s in tokens._BYTES.items()}
    docs, corpus = [], Counter()
    for text in texts:
        links, groups, ia, ib = Counter(), [], [], []
        if text:
            want = b" " + text.encode()
            ia, ib = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            bytes_a = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in ia]
            names = [b_lib.id_to_piece(i) for i in ib]
            bytes_b = [bytes([int(n[3:5], 16)]) if b_lib.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ib, names, strict=True)]
            if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
                ia, ib = [], []
        if ia:
            i = j = end_a = end_b = 0
            own = ([], [])
            while i < len(ia) or j < len(ib):
                if end_a <= end_b and i < len(ia):
                    begin, end_a = end_a, end_a + len(bytes_a[i])
                    own[0].append(ia[i])
                    spot = 0
                    for y, raw in zip(ib, bytes_b, strict=True):
                        if spot < end_a and spot + len(raw) > begin:
                            links[ia[i], y] += 1
                        spot += len(raw)
                        if spot >= end_a:
                            break
                    i += 1
                else:
                    end_b += len(bytes_b[j])
                    own[1].append(ib[j])
                    j += 1
                if end_a == end_b:
                    groups.append("|".join(",".join(map(str, x)) for x in own))
                    own = ([], [])
        corpus.update(links.keys())
        docs.append((len(ia), len(ib), len(groups), links, sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = defaultdict(int)
    for (a, _), n in corpus.items():
        top[a] = max(top[a], n)
    return [(na, nb, ng, sum(ls.values()), sum(m for p, m in ls.items() if corpus[p] == top[p[0]]), sum(m * corpus[p] for p, m in ls.items()), sha) for na, nb, ng, ls, sha in docs]


def figures(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def cut(texts):
    """Long texts make the loops above slow; a few thousand letters have every case."""
    return [t if t is None else t[:4000] for t in texts]


def test_awkward_texts_equal_loops(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SALT", 5)  # ids of many places go to many tasks
    texts = cut([r.text for r in awkward(spark, EXTRA).collect()])
    docs = spark.createDataFrame([(k, t, "x", b"y") for k, t in enumerate(texts)], "doc_id long, text string, key string, pairs binary").repartition(3)
    got = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    assert figures(got[k] for k in range(len(texts))) == brute(texts)


def test_rounds_of_postings_and_gains(monkeypatch):
    """The same gains whatever the sizes of rounds and of batches, in one process."""
    texts = cut([t for t in EXTRA for _ in range(3)])
    got = {}
    for pairs, docs, gains, rows in ((1 << 20, 1 << 14, 1 << 20, 10_000), (50, 3, 20, 7)):
        for name, value in (("PAIRS", pairs), ("DOCS", docs), ("GAINS", gains)):
            monkeypatch.setattr(alignment, name, value)
        base = alignment.Aligner(A, B).align(pa.array(range(len(texts))), pa.array(texts))
        source = pa.RecordBatch.from_arrays([base.column("doc_id"), base.column("pairs")], ["key", "pairs"])
        count = Counter()
        for batch in alignment.counter((2, 2))([source]):
            for r in batch.to_pylist():
                count[r["a"], r["b"]] += r["n"]
        known = [{"a": a, "salt": 0, "b": b, "n": n, "first": None, "steps": None, "times": None} for (a, b), n in count.items()]
        posts = [r | {"salt": 0, "n": None} for batch in alignment.poster((2, 2))([source]) for r in batch.to_pylist()]
        met = sorted(known + posts, key=lambda r: (r["a"], r["n"] is None, r["b"]))
        kinds = pa.schema([("a", pa.int32()), ("salt", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
        batches = [pa.RecordBatch.from_pylist(met[i : i + rows], kinds) for i in range(0, len(met), rows)]
        sums = defaultdict(lambda: [0, 0])
        for batch in alignment._cogroup(batches):
            for r in batch.to_pylist():
                for place, best, total in zip(r["places"], r["best"], r["total"], strict=True):
                    sums[r["span"] * alignment.SPAN + place][0] += best
                    sums[r["span"] * alignment.SPAN + place][1] += total
        got[rows] = [tuple(sums[k]) for k in range(len(texts))]
    assert got[7] == got[10_000] == [(w[4], w[5]) for w in brute(texts)]


def test_documents_equal_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    short = sorted((r for r in docs if len(r.text or "") <= 12_000), key=lambda r: r.doc_id)
    table = spark.createDataFrame([(r.doc_id, r.text) for r in short], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in alignment.align(table, A, B).collect()}
    assert figures(got[r.doc_id] for r in short) == brute([r.text for r in short])


def test_whole_long_texts_equal_the_libraries(spark):
    own = alignment.Aligner(A, B)
    a_lib, b_lib = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    assert own.b.cut
    for r in awkward(spark, EXTRA).collect():
        if r.text:
            ids, _ = own.a.encode_column(pa.array([" " + r.text]))
            assert ids.tolist() == a_lib.encode(" " + r.text, add_special_tokens=False).ids
            got = own.b.encode([r.text])[0]
            if got is not None:
                assert np.frombuffer(got, own.b.dtype).tolist() == b_lib.encode(r.text)
            else:
                assert "▁" in r.text


def test_rows_without_id_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (7, "same text"), (None, None)], "doc_id long, text string")
    got = alignment.align(docs, A, B).collect()
    assert sorted(figures(got)) == sorted(brute(["same text"] * 3 + [None]))
    assert alignment.align(docs.limit(0), A, B).collect() == []
