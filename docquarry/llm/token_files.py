"""Operator 1: token ids in binary files whose document boundaries are Elias-Fano coded.

A shard is two files. `shard-N.ids` holds the ids of its documents one after another (little-endian, 2 or 4 bytes).
`shard-N.idx` holds two Elias-Fano sequences: the boundaries (n + 1 offsets into the ids) and the document ids, which
ascend. An offset is found by select on the upper bits, helped by one 32-bit sample for every 256 ones, so there is no
table of 64-bit offsets: a boundary costs about 2 + log2(ids / documents) bits.

Defined cases: a null or empty text is a document of the end id alone. Rows are in ascending doc_id order, nulls first;
rows that share a doc_id are in order of a hash of their text. Extra columns are ignored. No rows: no shard, no result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder

MAGIC = b"EFT1"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits, np.uint8)
        for b in range(bits):
            low[b::bits] = (v >> np.uint64(b)) & np.uint64(1)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda x: np.packbits(x, bitorder="little")
        return cls(n, bits, pack(low), pack(high), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int, j: int | None = None):
        """Value i, or values i to j - 1. Reads only the words between two samples."""
        a, b = i, i + 1 if j is None else j
        if b <= a:
            return np.zeros(0, np.int64)
        start = int(self.samples[a // SAMPLE]) >> 3
        last = b // SAMPLE + 1
        end = (int(self.samples[last]) >> 3) + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + start * 8
        skip = a % SAMPLE + int(np.searchsorted(ones, self.samples[a // SAMPLE]))
        upper = ones[skip : skip + b - a] - np.arange(a, b)
        out = upper.astype(np.int64) << self.low_bits
        if self.low_bits:
            first, stop = a * self.low_bits, b * self.low_bits
            bits = np.unpackbits(self.low[first >> 3 : (stop + 7) >> 3], bitorder="little")[first & 7 :][: stop - first]
            for k in range(self.low_bits):
                out |= bits[k :: self.low_bits].astype(np.int64) << k
        return out if j is not None else int(out[0])

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + b"".join(
            x.tobytes() for x in (self.low, self.high, self.samples)
        )

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, bits, low, high, samples = struct.unpack_from("<QBQQQ", raw, at)
        at += struct.calcsize("<QBQQQ")
        parts = []
        for size, kind in ((low, "u1"), (high, "u1"), (samples, "<u4")):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(n, bits, *parts), at


def index_bytes(width: int, lengths: np.ndarray, ids: list[int | None]) -> bytes:
    known = np.array([x for x in ids if x is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    head = MAGIC + struct.pack("<BQQq", width, len(ids), len(ids) - len(known), base)
    return head + EliasFano.of(bounds).to_bytes() + EliasFano.of((known - base).astype(np.uint64)).to_bytes()


class Shard:
    """Random access to one shard."""

    def __init__(self, fs, path: str):
        self.fs, self.path = fs, path
        with fs.open_input_stream(path + ".idx") as f:
            raw = f.read()
        if raw[:4] != MAGIC:
            raise ValueError(f"{path}.idx is not an index of this format")
        self.width, self.n_docs, self.n_null, self.base = struct.unpack_from("<BQQq", raw, 4)
        self.bounds, at = EliasFano.from_bytes(raw, 4 + struct.calcsize("<BQQq"))
        self.known, _ = EliasFano.from_bytes(raw, at)

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        cut = max(a, min(b, self.n_null))
        got = self.known.select(cut - self.n_null, b - self.n_null) + self.base if b > cut else []
        return [None] * (cut - a) + [int(x) for x in got]

    def documents(self, window: int = 4 << 20):
        """(doc_id, start in the shard, ids) of each document, reading about `window` ids at a time."""
        with self.fs.open_input_file(self.path + ".ids") as f:
            a = 0
            while a < self.n_docs:
                b = min(self.n_docs, a + 4096)
                bounds = self.bounds.select(a, b + 1)
                b = a + max(1, int(np.searchsorted(bounds, bounds[0] + window, "right")) - 1)
                b, bounds = min(b, a + len(bounds) - 1), bounds
                f.seek(int(bounds[0]) * self.width)
                raw = f.read(int(bounds[b - a] - bounds[0]) * self.width)
                ids = np.frombuffer(raw, f"<u{self.width}")
                for k, doc in enumerate(self.doc_ids(a, b)):
                    s, e = int(bounds[k] - bounds[0]), int(bounds[k + 1] - bounds[0])
                    yield doc, int(bounds[k]), ids[s:e]
                a = b


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None) -> list[dict]:
    """Write docs as shards under folder and return a row for each shard, in order, with `start`: ids before it.

    A range partition of doc_id is a shard. A task writes to a name of its own and then renames, so a task that is run
    again replaces its shard by the same bytes. The driver gets one small row for each shard.
    """

    def write(batches):
        ctx = TaskContext.get()
        enc, shard = encoder(tokenizer), ctx.partitionId()
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        fs, root = _open(folder)
        path, mine = f"{root}/shard-{shard:06d}", f"{root}/.try-{shard:06d}-{ctx.taskAttemptId()}"
        lengths, ids, out = [], [], None
        for batch in shared.pieces_of(batches, 2 << 20):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(mine + ".ids", compression=None)
            for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode_rows(batch.column("text")), strict=True):
                raw += tail
                out.write(raw)
                ids.append(doc)
                lengths.append(len(raw) // enc.width)
        if out is None:
            return
        out.close()
        with fs.open_output_stream(mine + ".idx", compression=None) as f:
            f.write(index_bytes(enc.width, np.array(lengths, np.int64), ids))
        for kind in (".ids", ".idx"):
            fs.move(mine + kind, path + kind)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"shard-{shard:06d}", "n_docs": len(ids), "n_ids": sum(lengths)}], MANIFEST)

    hashed = shared.id_text(docs).withColumn("h", F.xxhash64("text"))
    dealt = hashed.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    rows = sorted(dealt.select("doc_id", "text").mapInArrow(write, "shard int, path string, n_docs long, n_ids long").collect())
    out, start = [], 0
    for r in rows:
        out.append(r.asDict() | {"start": start})
        start += r.n_ids
    return out


def read_token_files(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """doc_id, start (over all shards), n_tokens, ids_crc32 (of the ids as 32-bit integers), shard; one task a shard."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def read(batches):
        fs, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[tuple] = []
                for doc, at, ids in Shard(fs, f"{root}/{row['path']}").documents():
                    rows.append((doc, row["start"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"]))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    listed = spark.createDataFrame([(s["shard"], s["path"], s["start"]) for s in shards], "shard int, path string, start long")
    if shards:
        listed = listed.repartitionByRange(min(len(shards), 10_000), "shard")
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    folder = shared.new_folder(spark, "tokens")
    shards = write_token_files(shared.table(spark, sf_dir, "documents"), folder, P.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder, shards)
