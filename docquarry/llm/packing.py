"""Operator 2: packing along a space-filling curve.

A document's ids are summed through a fixed table of random signs (its hashed vector, projected to DIMS dimensions); the
vector's direction is quantised and turned into a Hilbert key. Fragments of documents are range-sorted by that key, so
that a partition holds a stretch of the curve, and each partition fills sequences with neighbouring documents. The last
sequence of a partition is cut into lengths that are powers of two, which need no padding.

Defined cases: a null or empty text is its end id alone. Equal rows are packed side by side, each on its own. Extra
columns are ignored. No rows: no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder

DIMS, BITS = 4, 12
FRAGMENT = 1024


def signs(vocabulary: int, dims: int = DIMS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int16), (vocabulary, dims))


def hilbert_key(point, bits: int = BITS) -> int:
    """Place of an integer point on the Hilbert curve: undo the excess rotations bit by bit, then Gray-decode."""
    x = [int(v) for v in point]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b) & 1
    return key


def sign_lanes(vocabulary: int) -> np.ndarray:
    """signs() with the plus signs of an id as 16-bit lanes of one integer, so that one sum adds up all dimensions."""
    plus = (signs(vocabulary) > 0).astype(np.uint64)
    return (plus << (16 * np.arange(DIMS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def hashed_vector(ids: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    plus = np.zeros(DIMS, np.int64)
    for k in range(0, len(ids), 60_000):  # a lane holds 16 bits
        total = int(lanes[ids[k : k + 60_000]].sum(dtype=np.uint64))
        plus += [total >> 16 * d & 0xFFFF for d in range(DIMS)]
    return (2 * plus - len(ids)).astype(np.float64)


def curve_key(ids: np.ndarray, lanes: np.ndarray) -> int:
    vector = hashed_vector(ids, lanes)
    unit = vector / max(1.0, float(np.sqrt((vector**2).sum())))
    cell = np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_key(cell)


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (2 or 4 bytes each, little-endian).

    The tokens are made once and stored; the range sort moves fragments of at most FRAGMENT ids, so rows are of like
    size and copies of one document spread over partitions by a hash.
    """

    def cut(batches):
        enc = encoder(tokenizer)
        lanes = sign_lanes(enc.tokenizer.get_vocab_size(with_added_tokens=True))
        tail = np.array([end_id], enc.dtype).tobytes()
        for batch in shared.pieces_of(batches, 2 << 20):
            cols: list[list] = [[], [], [], [], [], []]
            for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode_rows(batch.column("text")), strict=True):
                raw += tail
                ids = np.frombuffer(raw, enc.dtype)
                key, salt = curve_key(ids, lanes), zlib.crc32(raw, zlib.crc32(str(doc).encode()))
                for at in range(0, len(ids), FRAGMENT):
                    for c, v in zip(cols, (key, salt, doc, at, len(ids), raw[at * enc.width : (at + FRAGMENT) * enc.width]), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "salt", "doc_id", "at", "total", "raw"])

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def fill(batches):
        width = encoder(tokenizer).width
        kind = f"<u{width}"
        base = TaskContext.get().partitionId() << 40
        open_rows: list[tuple] = []  # fragments of the sequence being filled: doc, start, total, bytes
        used, sequence = 0, 0

        def row(doc, start, total, raw, seq, offset):
            ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
            return doc, start, len(raw) // width, zlib.crc32(ids), total, base + seq, offset, raw

        def emit(parts, sizes):
            """Lay the fragments end to end over sequences of these sizes."""
            nonlocal sequence
            room, offset, sizes = sizes[0], 0, sizes[1:]
            for doc, start, total, raw in parts:
                while raw:
                    n = min(room - offset, len(raw) // width)
                    yield row(doc, start, total, raw[: n * width], sequence, offset)
                    raw, start, offset = raw[n * width :], start + n, offset + n
                    if offset == room:
                        sequence, offset = sequence + 1, 0
                        room, sizes = (sizes[0], sizes[1:]) if sizes else (0, [])

        def batched(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

        done: list[tuple] = []
        for batch in batches:
            for doc, at, total, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "total", "raw")), strict=True):
                while raw:
                    n = min(length - used, len(raw) // width)
                    last = open_rows[-1] if open_rows else None
                    if last and at and last[0] == doc and last[2] == total and last[1] + len(last[3]) // width == at:
                        open_rows[-1] = (doc, last[1], total, last[3] + raw[: n * width])
                    else:
                        open_rows.append((doc, at, total, raw[: n * width]))
                    raw, at, used = raw[n * width :], at + n, used + n
                    if used == length:
                        done.extend(emit(open_rows, [length]))
                        open_rows, used = [], 0
            if len(done) >= 4096:
                yield batched(done)
                done = []
        if used:
            done.extend(emit(open_rows, powers(used)))
        if done:
            yield batched(done)

    fragments = shared.store(shared.id_text(docs).mapInArrow(cut, "key long, salt long, doc_id long, at long, total long, raw binary"), "fragments")
    order = ["key", "salt", "doc_id", "at"]
    along = fragments.repartitionByRange(*order).sortWithinPartitions(*order, "total", F.xxhash64("raw"))
    return along.select("doc_id", "at", "total", "raw").mapInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def packed_pieces(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(docs, P.path("byte_bpe_50k.json"), end_id=0).drop("ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(shared.table(spark, sf_dir, "documents"))
