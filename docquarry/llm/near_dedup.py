"""Operator 4: near duplicates by 64-bit SimHash and bit-sliced comparison.

Fingerprints are compared once for each distinct value. Of RADIUS + m blocks of bits, every m make a table that is keyed by them: two
fingerprints that differ in at most RADIUS bits agree in m whole blocks, so they meet in a table. m is two (fifteen tables, keys of
20 to 22 bits) until there are so many fingerprints that longer keys in more tables are less work (`blocks_for`); the links
are the same with any m. Within a table's bucket
the bit planes are stored vertically, 64 fingerprints to a word; shifting the planes compares every fingerprint with
those a fixed number of places on, carry-save counters add up differing bits for many words at once, and words in which
all exceed the radius are dropped as soon as they do.

A bucket of over CELL fingerprints is dealt into cells (pairs of salts) that cover all its pairs, so no task holds an
unbounded bucket. A task reports a forest of the links it found, not all pairs. Components come from rounds of stars.

Defined cases: no words (null, empty, blank): fingerprint zero, linked like any other. Equal rows and ties share a
fingerprint and so a component. Rows without doc_id have a component too; its id is the smallest doc_id there is in it,
null if there is none. Extra columns are ignored. No rows: no result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

RADIUS = 4
MATCHED = (2, 3, 4, 5)
SENT = 1000  # comparisons that cost as much as sending a fingerprint to a table
CELL = 4096
SHINGLE = 4


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = 42) -> bytes:
    """XXH64 (8 bytes, big-endian) of every word shingle in turn."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII alone
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return digest(b" ".join(words), seed) if words else b""
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)])


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        raw = np.frombuffer(shingle_hashes(t), np.uint8).reshape(-1, 8)
        if len(raw):
            set_bits = np.zeros(64, np.int64)
            for k in range(0, len(raw), 1 << 15):
                set_bits += np.unpackbits(raw[k : k + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(set_bits * 2 > len(raw)).view(">u8")[0]
    return out


def add_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash that tells texts of one doc_id apart), fp (64 bits as a long)."""

    def make(batches):
        shared.make_room()
        for batch in shared.pieces_of(batches):
            fps = fingerprints(batch.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(fps)], ["doc_id", "mark", "fp"])

    return shared.id_text(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(make, "doc_id long, mark long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """fps: (rows, k) words. Bit i of word w of row b of the result is bit b of fingerprint 64 w + i."""
    n = -(-len(fps) // 64) * 64
    raw = np.zeros((n, fps.shape[1]), "<u8")
    raw[: len(fps)] = fps
    bits = np.unpackbits(raw.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: the sum and the carry of three bit planes."""
    either = a ^ b
    return either ^ c, a & b | either & c


class _Counters:
    """Vertical counters of the lanes' differing bits; over: lanes that have left the counters' range."""

    def __init__(self, words: int, radius: int):
        self.radius = radius
        self.planes = [np.zeros(words, np.uint64) for _ in range(max(3, radius.bit_length()))]
        self.over = np.zeros(words, np.uint64)

    def add8(self, x: list[np.ndarray]) -> None:
        ones, twos, fours = self.planes[:3]
        pairs = []
        for k in range(0, 8, 4):
            ones, a = _add(ones, x[k], x[k + 1])
            ones, b = _add(ones, x[k + 2], x[k + 3])
            twos, c = _add(twos, a, b)
            pairs.append(c)
        fours, carry = _add(fours, *pairs)
        self.planes[:3] = ones, twos, fours
        for k in range(3, len(self.planes)):
            self.planes[k], carry = self.planes[k] ^ carry, self.planes[k] & carry
        self.over |= carry

    def exceeding(self) -> np.ndarray:
        more, equal = self.over.copy(), ~self.over
        for k in reversed(range(len(self.planes))):
            if self.radius >> k & 1:
                equal &= self.planes[k]
            else:
                more |= equal & self.planes[k]
                equal &= ~self.planes[k]
        return more

    def keep(self, stay: np.ndarray) -> None:
        self.planes, self.over = [p[stay] for p in self.planes], self.over[stay]


#: Pairs of words that are compared at once.
_AT_ONCE = 1 << 14


def close_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS):
    """Yields arrays (i, j) of places, i < j, that share a bucket and differ in at most radius bits; each pair once.

    fps: (rows,) or (rows, k) words. Rows of a bucket stand together. For each of 64 shifts the planes are moved once; a word
    of 64 fingerprints is then compared with every word at or after it that its bucket reaches.
    """
    fps = fps.reshape(len(fps), -1)
    n = len(fps)
    if n < 2:
        return
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    last = np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n))) - 1  # the last place of each row's bucket
    ahead = last - np.arange(n)
    words = -(-n // 64)
    lanes = np.zeros(words * 64, np.int64)
    lanes[:n] = ahead
    lanes = lanes.reshape(words, 64)
    reach = lanes.max(axis=1)  # how far any lane of a word must look
    planes = planes_of(fps)
    spare = np.zeros((len(planes), 1), np.uint64)
    for r in range(min(64, int(ahead.max()) + 1)):
        moved = planes if not r else planes >> np.uint64(r) | np.concatenate([planes[:, 1:], spare], axis=1) << np.uint64(64 - r)
        steps = np.maximum(0, (reach - r) // 64 + 1)  # distances 64 q + r with q below this
        col = np.repeat(np.arange(words), steps)
        q = np.arange(len(col)) - np.repeat(np.cumsum(steps) - steps, steps)
        if not r:
            col, q = col[q > 0], q[q > 0]
        for k in range(0, len(col), _AT_ONCE):
            c, o = col[k : k + _AT_ONCE], q[k : k + _AT_ONCE]
            wanted = lanes[c] >= (64 * o + r)[:, None]
            alive = np.packbits(wanted, axis=1, bitorder="little").view("<u8")[:, 0]
            stay = (alive != 0) & (c + o < words)
            c, o, alive = c[stay], o[stay], alive[stay]
            counters = _Counters(len(c), radius)
            for b in range(0, len(planes), 8):
                if not len(c):
                    break
                counters.add8([planes[x][c] ^ moved[x][c + o] for x in range(b, b + 8)])
                if b + 8 == len(planes) or b * 8 >= radius:
                    alive = alive & ~counters.exceeding()
                    stay = alive != 0
                    if not stay.all():  # abandon the words in which every distance exceeds the radius
                        c, o, alive = c[stay], o[stay], alive[stay]
                        counters.keep(stay)
            if len(c):
                bits = np.unpackbits(alive.view(np.uint8).reshape(len(c), 8), axis=1, bitorder="little")
                w, lane = np.nonzero(bits)
                i = c[w] * 64 + lane
                yield i, i + 64 * o[w] + r


def forest(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Close pairs that connect what all close pairs connect."""
    root, out = np.arange(len(fps)), []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in close_pairs(fps, bucket, radius):
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def blocks_for(count: int) -> int:
    """How many blocks to match, for the least work on `count` distinct fingerprints."""
    return min(MATCHED, key=lambda m: math.comb(RADIUS + m, m) * (SENT + count / 2 ** (64 * m // (RADIUS + m))))


def _buckets(matched: int) -> Column:
    """The (table, key) of a fingerprint for each choice of `matched` blocks, each as one long."""
    total = RADIUS + matched
    borders = [64 * k // total for k in range(total + 1)]
    blocks = [F.shiftrightunsigned(F.col("fp"), a).bitwiseAND(F.lit((1 << b - a) - 1).cast("long")) for a, b in zip(borders, borders[1:], strict=False)]
    width = max(b - a for a, b in zip(borders, borders[1:], strict=False))
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(total), matched)):
        key = F.lit(t).cast("long")
        for k in chosen:
            key = F.shiftleft(key, width).bitwiseOR(blocks[k])
        keys.append(key)
    return F.array(*keys)


def links(distinct: DataFrame, matched: int = MATCHED[0]) -> DataFrame:
    """a, b: fingerprints that are linked, enough of them to connect all that are. distinct: column fp without repeats."""

    def compare(batches):
        shared.make_room()
        fps, cell = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        held = 0

        def flush(f, c):
            bucket = np.zeros(len(f), np.int64)
            if len(f):
                bucket[1:] = np.cumsum((c[1:] != c[:-1]).any(axis=1))
            found = forest(f.view(np.uint64), bucket)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for i, _ in found], pa.int64()), pa.array([f[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            fps.append(batch.column("fp").to_numpy())
            cell.append(np.stack([batch.column("bucket").to_numpy(), batch.column("cell").to_numpy()], axis=1))
            held += batch.num_rows
            if held >= 1 << 16:
                f, c = np.concatenate(fps), np.concatenate(cell)
                cut = len(f) - int((c == c[-1]).all(axis=1)[::-1].argmin() or len(f))
                yield flush(f[:cut], c[:cut])
                fps, cell, held = [f[cut:]], [c[cut:]], len(f) - cut
        yield flush(np.concatenate(fps), np.concatenate(cell))

    rows = distinct.select("fp", F.explode(_buckets(matched)).alias("bucket"))
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    large = large.select("bucket", F.ceil(F.col("n") / CELL).cast("long").alias("salts"))
    dealt = rows.join(large, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1), lambda k: F.least(k, F.col("own")) * F.coalesce("salts", F.lit(1)) + F.greatest(k, F.col("own")))
    dealt = dealt.select("fp", "bucket", F.explode(cells).alias("cell"))
    return dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "fp").mapInArrow(compare, "a long, b long")


def near_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, fp) of every row, and fp -> node (a name of its component) for all fingerprints."""
    prints = shared.store(add_fingerprints(docs), "fingerprints")
    distinct = prints.select("fp").distinct()
    count = prints.agg(F.approx_count_distinct("fp")).first()[0]  # it decides how, not what
    linked = shared.components(links(distinct, blocks_for(count)), "near")
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    return prints, named.select("fp", F.coalesce("component", "fp").alias("node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each document."""
    prints, named = near_components(docs)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp")
    heads = least.groupBy("node").agg(F.min("least").alias("component_id"))
    by = least.select("fp", "node").join(heads, "node").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the smallest doc_id (rows without one last, then the smallest mark)."""
    prints, named = near_components(docs)
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    least = prints.groupBy("fp").agg(F.min(key).alias("key")).join(named, "fp")
    winners = least.groupBy("node").agg(F.min("key").alias("key")).select(F.col("key.doc_id").alias("w_id"), F.col("key.mark").alias("w_mark"))
    return kept_rows(docs, winners)


def kept_rows(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of docs named by w_id and w_mark, one of each."""
    winners = shared.store(winners, "winners")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    kept = rows.join(winners, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")), "left_semi")
    return kept.dropDuplicates(["id", "mark"]).select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"))
