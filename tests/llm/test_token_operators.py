import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docquarry.llm import packing, shared, token_counts, token_files, tokens
from docquarry.llm.tokens import Encoder

from .cases import awkward, empty

ODD = st.text(st.sampled_from(list("aAbé ß\n\t'.,!<|>endoftx1₂²   \x1c\x85▁́漢🎉s t")), max_size=60)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    own, lib = Encoder(P.path(name)), Tokenizer.from_file(P.path(name))

    @settings(max_examples=400, deadline=None)
    @given(ODD)
    def same(text):
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids

    same()
    for text in ("don't 'tis x''s", "abcł łabc aÉ", "a=\u0338b e\u0301 ab\u0301c", "x²y ªb µm", "Word### ÉÀ!! end.,;", "a" * 5000 + " b", "A1b2 _x_y_"):
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_encoder_keeps_ids_when_generations_turn(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST", 3)
    own, lib = Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in ["the of and, to", "the in a ### the", "of la de", "the of", "é to the"] * 3:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(own.chunks) + len(own.chunks.before) <= 20


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoded_columns_equal_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "_SLOTS", 64)  # so that the table is renewed again and again
    monkeypatch.setattr(tokens, "_WINDOW", 16)
    own, lib = Encoder(P.path(name)), Tokenizer.from_file(P.path(name))

    def check(texts):
        ids, at = own.encode_column(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]

    plain = st.text(st.sampled_from(list("aAbé ß\n\t\x0b\r'.,!1s \x7fÀ-")), max_size=60)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.none(), plain, ODD), max_size=8))
    def same(texts):
        check(texts)

    same()
    check([])
    check([None, "", "  a", "a  ", "a\n\n b", "\tb", "x<|endoftext|>y", "a\x00b", "a\x1cb", "日本 é", "été ÷ ×", "µm ªº", "e\u0301 x", "z" * 500, "ab " * 5000])
    check(["abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghi", " abcdefg", " " * 16, " " * 17])


def test_renewed_table_keeps_what_was_found_again():
    table, keys = tokens._Table(np.dtype("<u2")), np.array([[k + 1, k % 3] for k in range(5000)], np.uint64)
    number = np.arange(5000) % 4
    table.add(keys, np.repeat(np.arange(5000), number).astype("<u2"), number)
    table.seen[table.find(keys[::7])] = True
    new = table.renewed()
    slot = new.find(keys)
    assert (slot >= 0).tolist() == [k % 7 == 0 for k in range(5000)]
    assert all(new.pool[new.at[s] : new.at[s] + new.number[s]].tolist() == [k] * (k % 4) for k, s in enumerate(slot.tolist()) if s >= 0)


def test_piece_counter_equals_library():
    own = token_counts.PieceCounter(P.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    @settings(max_examples=300, deadline=None)
    @given(ODD)
    def same(text):
        assert own.count([text, text + " x"]) == [len(sp.encode(text)), len(sp.encode(text + " x"))]

    same()
    for text in ("x" * 3000, "abcab" * 900, " " * 500 + "the", "interna" * 50 + "tional"):
        assert own.count([text]) == [len(sp.encode(text))]


@given(st.lists(st.integers(0, 10**6), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(gaps):
    values = np.cumsum([0, *gaps])
    got, _ = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
    assert got.select(0, len(values)).tolist() == values.tolist()
    for i in range(0, len(values), max(1, len(values) // 7)):
        assert got.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.arange(0, 10_000_000, 1000)
    assert len(token_files.EliasFano.of(values).to_bytes()) * 8 < len(values) * 13.5


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in shared.table(spark, sf_dir, "documents").collect()}


def test_token_files_brute_force(spark, sf_dir):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start = 0
    got = {r.doc_id: r for r in token_files.op1_token_files(spark, sf_dir).collect()}
    texts = texts_of(spark, sf_dir)
    assert set(got) == set(texts)
    for d in sorted(texts):
        ids = [*lib.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_awkward(spark):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = awkward(spark)
    folder = shared.new_folder(spark, "t")
    rows = token_files.read_token_files(spark, folder, token_files.write_token_files(docs, folder, P.path("word_bpe_49k.json"), 2)).collect()
    want = Counter((r.doc_id, crc([*lib.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [r.doc_id for r in ordered if r.doc_id is not None] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    folder = shared.new_folder(spark, "t")
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(empty(spark), folder, P.path("word_bpe_49k.json"), 2)).count() == 0


def check_packing(rows, want):
    """want: Counter of (doc_id, ids)."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append(r)
        assert r.length > 0 and r.ids_crc32 == crc(np.frombuffer(r.ids, "<u2"))
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded == 0
    covered = Counter()
    for (doc, _), got in pieces.items():
        for r in got:
            covered.update((doc, r.doc_tokens, p) for p in range(r.start, r.start + r.length))
    expect = Counter()
    for (doc, ids), n in want.items():
        for p in range(len(ids)):
            expect[doc, len(ids), p] += n
    assert covered == expect


def wanted(docs):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return Counter((r.doc_id, (*lib.encode(r.text or "", add_special_tokens=False).ids, 0)) for r in docs.collect())


def test_packing(spark, sf_dir):
    for docs in (shared.table(spark, sf_dir, "documents"), awkward(spark)):
        check_packing(packing.pack_documents(docs, P.path("byte_bpe_50k.json"), 0).collect(), wanted(docs))
    assert packing.pack_documents(empty(spark), P.path("byte_bpe_50k.json"), 0).count() == 0


def test_hilbert_key_walks_neighbours():
    cells = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda c: packing.hilbert_key(c, 3))
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(cells, cells[1:], strict=False))


def test_token_counts(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for docs in (shared.table(spark, sf_dir, "documents"), awkward(spark)):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in docs.collect())
        got = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()
        assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


def test_hashed_vector_equals_sum_of_signs():
    ids = np.random.default_rng(0).integers(0, 500, 130_000).astype("<u2")
    assert packing.hashed_vector(ids, packing.sign_lanes(500)).tolist() == packing.signs(500)[ids].sum(axis=0).tolist()
