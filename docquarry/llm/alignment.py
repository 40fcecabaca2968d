"""Operator 13: two tokenizers' tokens aligned by bytes, with corpus-wide counts of linked ids by a cogroup of postings.

A text's tokens of A and of B cut the same bytes (a space and the text). Where tokens of both end, a group ends; every stretch
between two neighbouring ends lies in one token of each, and that is a link. Each document gives its distinct linked id pairs
with their multiplicities, which are stored once with the document's own figures.

Cogroup: tasks turn the stored pairs into postings (a pair, the keys of documents that hold it, how often each does), so a pair
that very many documents hold arrives as one row for thousands of them. Pair counts are summed by partial aggregation.
Counts and postings are shuffled by A's id to the same tasks, where Spark's external sort puts an id's counts before its
postings; a task takes the highest count of the id, gives each posting its count, and passes on what each document gains, added up
in the task. An id with over SALT places is dealt over several tasks, each of which gets the id's counts (at most one
for each id of B). Last the gains are summed by document. Nothing is held but one id's counts and bounded buffers.

Broadcast: the number of tasks for each id of A, at most as many rows as A has ids.

Defined cases: a text that is null or empty, or whose tokens of A or B do not give its bytes, has no tokens: zeros and ''. Strings
of special tokens are plain text. Every row is a document of its own, repeated rows and rows without doc_id included. Long
texts are encoded chunk by chunk where the vocabularies allow no token across a chunk's end. Other columns are ignored, whatever
their names. No rows: no result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

SALT = 1 << 17  # places of an id in documents' pairs that go to one task
PAIRS = 1 << 19  # of documents that are turned into postings together
DOCS = 1 << 14  # at most so many
GAINS = 1 << 20  # held before they are added up

KNOWN = 300_000  # chunks that a worker remembers
SPAN = 1 << 12  # documents whose gains travel together

BASE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


_LATIN = "A-Za-zÀ-ɏ"
_CHUNK = re.compile(f" *[{_LATIN}]+| *[^{_LATIN} ]+| +")


class Pieces:
    """Ids of a sentencepiece model. encode(texts): for each text its ids as little-endian numbers, or None if they do not give the
    text's bytes.

    Where no piece has a space inside or after other letters, or Latin letters beside anything else, and nothing is normalised,
    texts are cut at such places and each distinct chunk of some texts is encoded once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.dtype = np.dtype("<u2" if len(names) <= 1 << 16 else "<u4")
        probe = "ab cd  eﬁ① é"
        mixed = re.compile(f"[^▁]▁|[{_LATIN}][^{_LATIN}]|[^{_LATIN}▁][{_LATIN}]")
        own = [n for i, n in enumerate(names) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.cut = self._joined(m.encode(probe)) == b" " + probe.encode() and not any(map(mixed.search, own))
        self.after = {mark: len(m.encode(mark)) for mark in "a,"}  # what is encoded before a chunk, to be taken off again
        self.known: dict[str, bytes | None] = {}

    def _joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def clear(self) -> None:
        self.known = {}

    def _learn(self, chunks: list[str]) -> None:
        letter = re.compile(f"[{_LATIN}]")
        marks = ["," if letter.match(c) else "a" for c in chunks]
        for chunk, mark, ids in zip(chunks, marks, self.model.encode([m + c for m, c in zip(marks, chunks, strict=True)], num_threads=1), strict=True):
            own = ids[self.after[mark] :]
            self.known[chunk] = np.array(own, self.dtype).tobytes() if self._joined(own) == chunk.encode() else None

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        if not self.cut:
            found = [self.model.encode(t) if t else [] for t in texts]
            return [np.array(ids, self.dtype).tobytes() if t and self._joined(ids) == b" " + t.encode() else None for t, ids in zip(texts, found, strict=True)]
        if len(self.known) > KNOWN:
            self.clear()
        parts = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        self._learn(list(set().union(*parts) - self.known.keys()))
        out: list[bytes | None] = []
        for own in parts:
            found = [self.known[c] for c in own]
            out.append(None if None in found or not own else b"".join(found))
        return out


class Aligner:
    """Encodes and aligns columns of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a = tokens.Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.b = Pieces(path_b)
        back = {chr(c): c for c in range(256)} | {s: c for c, s in tokens._BYTES.items()}
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.size_a = np.ones(max(vocab.values()) + 1, np.int64)
        for name, i in vocab.items():
            self.size_a[i] = len(name) if all(c in back for c in name) else len(name.encode())
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        # an id as it is written after another of its kind, at the start of a group, and as the first of B in a group
        self.words = [f"{mark}{i}".encode() for i in range(max(len(self.size_a), len(self.size_b))) for mark in ",;|"]

    def clear(self) -> None:
        self.a.clear()
        self.b.clear()

    def align(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """The figures and pairs of each text."""
        n = len(texts)
        raw_a, at_a = self.a.encode_column(pc.binary_join_element_wise(" ", texts, ""))
        own_b = self.b.encode(texts.to_pylist())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        many_a = np.diff(at_a)
        bytes_a = np.diff(np.concatenate([[0], np.cumsum(self.size_a[raw_a])])[at_a])
        good = np.array([x is not None for x in own_b], bool) & (sizes > 0) & (bytes_a == sizes + 1)
        kept = np.flatnonzero(good)
        number_a, number_b = many_a[kept], np.array([len(own_b[i]) // self.b.dtype.itemsize for i in kept.tolist()], np.int64)
        ids_a = raw_a[np.repeat(good, many_a)].astype(np.int64)
        ids_b = np.frombuffer(b"".join([own_b[i] for i in kept.tolist()]), self.b.dtype).astype(np.int64)
        total = int((sizes[kept] + 1).sum())
        ends = np.cumsum(sizes[kept] + 1) - 1  # the last byte of each document
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]) - 1, np.cumsum(self.size_b[ids_b]) - 1
        at_a, at_b, at_doc, at_both = (np.zeros(total, bool) for _ in range(4))
        at_a[ends_a] = at_b[ends_b] = at_doc[ends] = True
        at_both = at_a & at_b
        before = lambda marks: np.cumsum(marks, dtype=np.int32) - marks  # noqa: E731  how many end before each byte
        stretch = np.flatnonzero(at_a | at_b)
        in_a, in_b, doc, group = before(at_a)[stretch], before(at_b)[stretch], before(at_doc)[stretch].astype(np.int64), before(at_both)
        links = np.bincount(doc, minlength=len(kept))
        groups = np.bincount(doc[at_both[stretch]], minlength=len(kept))
        width = len(self.size_b)
        code, times = np.unique((doc * len(self.size_a) + ids_a[in_a]) * width + ids_b[in_b], return_counts=True)
        pair = code % (len(self.size_a) * width)
        columns = (pair // width).astype(self.a.dtype), (pair % width).astype(self.b.dtype), times.astype("<u4")
        bounds = np.searchsorted(code, np.arange(len(kept) + 1) * len(self.size_a) * width)
        digests = self._digests(ids_a, ids_b, group[ends_a], group[ends_b], number_a + number_b)
        whole = np.zeros((4, n), np.int64)
        whole[:, kept] = [number_a, number_b, groups, links]
        sha, pairs = [""] * n, [b""] * n
        for k, i in enumerate(kept.tolist()):
            sha[i], pairs[i] = digests[k], b"".join(c[bounds[k] : bounds[k + 1]].tobytes() for c in columns)
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, whole), pa.array(sha, pa.string()), pa.array(pairs, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    def _digests(self, ids_a, ids_b, group_a, group_b, number) -> list[str]:
        """The hash of each document's groups, written out."""
        first_a = np.diff(group_a, prepend=-1) != 0
        first_b = np.diff(group_b, prepend=-1) != 0
        words = np.concatenate([ids_a * 3 + first_a, ids_b * 3 + 2 * first_b])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        listed = words[order].tolist()
        out, at = [], 0
        for k in number.tolist():
            out.append(hashlib.sha256(b"".join(map(self.words.__getitem__, listed[at : at + k]))[1:]).hexdigest())
            at += k
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files and Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
        shared.KEPT.append(_ALIGNERS[path_a, path_b])
    return _ALIGNERS[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """BASE of each row of docs (doc_id, text); pairs: all ids of A, all of B, all multiplicities."""

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in shared.pieces_of(batches, 1 << 20):
            yield own.align(batch.column("doc_id"), batch.column("text"))

    return docs.mapInArrow(run, BASE)


def _pairs_of(raws: list[bytes], widths: tuple[int, int]) -> list[np.ndarray]:
    """The ids of A and B and the multiplicities of some documents' pairs, end to end, and how many each has."""
    total = sum(widths) + 4
    number = [len(r) // total for r in raws]
    out, at = [], [0] * len(raws)
    for w in (*widths, 4):
        out.append(np.frombuffer(b"".join([r[i : i + n * w] for r, i, n in zip(raws, at, number, strict=True)]), f"<u{w}").astype(np.int64))
        at = [i + n * w for i, n in zip(at, number, strict=True)]
    return [*out, np.array(number)]


def _gathered(batches, widths: tuple[int, int]):
    """Documents' pairs in bounded numbers, of one partition of keys, sorted by pair: keys, a, b, times."""
    held, keys, total = [], [], 0

    def sorted_rows():
        a, b, times, number = _pairs_of(held, widths)
        who = np.repeat(np.array(keys, np.int64), number)
        order = np.lexsort([who, b, a])
        return who[order], a[order], b[order], times[order]

    for batch in batches:
        for key, raw in zip(batch.column("key").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            if raw:
                if held and (total >= PAIRS or len(keys) >= DOCS or key >> 31 != keys[0] >> 31):
                    yield sorted_rows()
                    held, keys, total = [], [], 0
                held.append(raw)
                keys.append(key)
                total += len(raw) // (sum(widths) + 4)
    if held:
        yield sorted_rows()


def _starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)


def counter(widths: tuple[int, int]):
    def count(batches):
        shared.make_room()
        for _, a, b, _ in _gathered(batches, widths):
            at = _starts(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[at].astype(np.int32)), pa.array(b[at].astype(np.int32)), pa.array(np.diff(at, append=len(a)))], ["a", "b", "n"])

    return count


POST = "a int, b int, first long, steps array<int>, times array<int>"


def poster(widths: tuple[int, int]):
    """POST: a pair's documents as the first key and the steps from each to the next (0 for the first)."""

    def post(batches):
        shared.make_room()
        for who, a, b, times in _gathered(batches, widths):
            at = _starts(a, b)
            ends = pa.array(np.append(at, len(a)).astype(np.int32))
            steps = np.diff(who, prepend=0)
            steps[at] = 0
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (steps, times)]
            yield pa.RecordBatch.from_arrays([pa.array(a[at].astype(np.int32)), pa.array(b[at].astype(np.int32)), pa.array(who[at]), *lists], ["a", "b", "first", "steps", "times"])

    return post


def _keys_of(first: np.ndarray, steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The keys of posts, end to end."""
    far = np.cumsum(steps)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return far + np.repeat(first[sizes > 0] - far[starts], sizes[sizes > 0])


GAIN = "span long, places array<smallint>, best array<int>, total array<long>"


def _summed(keys: list, best: list, total: list) -> pa.RecordBatch:
    """GAIN: what documents gain, a row for SPAN neighbouring keys."""
    who, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)]
    for out, part in zip(sums, (best, total), strict=True):
        np.add.at(out, at, np.concatenate(part))
    span = who // SPAN
    cuts = np.flatnonzero(np.diff(span, prepend=-1))
    ends = pa.array(np.append(cuts, len(who)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((who % SPAN).astype(np.int16), sums[0].astype(np.int32), sums[1])]
    return pa.RecordBatch.from_arrays([pa.array(span[cuts]), *lists], ["span", "places", "best", "total"])


def _added(batches):
    """key, n_best, count_sum of gains that come by span."""
    shared.make_room()
    at, sums = None, np.zeros((2, SPAN), np.int64)

    def whole():
        some = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([pa.array(at * SPAN + some), pa.array(sums[0][some]), pa.array(sums[1][some])], ["key", "n_best", "count_sum"])

    for batch in batches:
        spans = batch.column("span").to_pylist()
        for k, span in enumerate(spans):
            if span != at:
                if at is not None:
                    yield whole()
                at, sums = span, np.zeros((2, SPAN), np.int64)
            places = batch.column("places")[k].values.to_numpy()
            for own, name in zip(sums, ("best", "total"), strict=True):
                own[places] += batch.column(name)[k].values.to_numpy()
    if at is not None:
        yield whole()


def _cogroup(batches):
    """What each document gains: rows come by a and salt, counts before postings, counts by b."""
    shared.make_room()
    at, counts, known, top = None, [], None, 0
    keys, best, total, held = [], [], [], 0
    for batch in batches:
        a, salt, b, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt", "b", "n"))
        if not len(a):
            continue
        steps, times = batch.column("steps"), batch.column("times")
        sizes = pc.fill_null(pc.list_value_length(steps), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first_key = pc.fill_null(batch.column("first"), 0).to_numpy(zero_copy_only=False)
        flat, often = _keys_of(first_key, steps.flatten().to_numpy().astype(np.int64), sizes), times.flatten().to_numpy().astype(np.int64)
        places = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])])).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(a)], strict=True):
            if (a[low], salt[low]) != at:
                at, counts, known = (a[low], salt[low]), [], None
            first = low + int(np.searchsorted(sizes[low:high] > 0, True))  # counts have no keys
            if first > low:
                counts.append((b[low:first], n[low:first]))
            if first == high:
                continue
            if known is None:
                known, ns = (np.concatenate(x) for x in zip(*counts, strict=True))
                top = ns.max()
            own = ns[np.searchsorted(known, b[first:high])]
            each = np.repeat(own, sizes[first:high])
            some = slice(places[first], places[high])
            keys.append(flat[some])
            best.append(np.where(each == top, often[some], 0))
            total.append(often[some] * each)
            held += len(keys[-1])
            if held >= GAINS:
                yield _summed(keys, best, total)
                keys, best, total, held = [], [], [], 0
    if held:
        yield _summed(keys, best, total)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    made = aligned(shared.id_text(docs), path_a, path_b).withColumn("key", F.monotonically_increasing_id())
    base = shared.store(made, "aligned")  # keys are fixed by being written
    pairs = base.select("key", "pairs")
    own = aligner(path_a, path_b)
    widths = own.a.dtype.itemsize, own.b.dtype.itemsize
    counts = shared.store(pairs.mapInArrow(counter(widths), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    salts = counts.groupBy("a").agg(F.ceil(F.sum("n") / SALT).cast("int").alias("salts"))  # at most one row for each id of A
    none = F.lit(None)
    known = counts.join(F.broadcast(salts), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "b", "n", none.cast("long").alias("first"), none.cast("array<int>").alias("steps"), none.cast("array<int>").alias("times"))
    posts = pairs.mapInArrow(poster(widths), POST).join(F.broadcast(salts), "a")
    posts = posts.select("a", F.pmod(F.xxhash64("b", "first"), "salts").cast("int").alias("salt"), "b", none.cast("long").alias("n"), "first", "steps", "times")
    met = known.unionByName(posts).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("n").isNull(), "b")
    gains = met.mapInArrow(_cogroup, GAIN).repartition("span").sortWithinPartitions("span").mapInArrow(_added, "key long, n_best long, count_sum long")
    gain = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return base.drop("pairs").join(gains, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", gain("n_best"), gain("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
