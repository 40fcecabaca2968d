"""Operator 4 for whole word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts to compare share one of BANDS bands of ROWS least hashes (a pair at 0.8 shares none with probability 3e-8). In a band's
bucket SimHash fingerprints of BITS bits over the shingle sets are compared bit-sliced. A first round links each bucket's
fingerprints that differ in at most NEAR bits by a forest and confirms its links on the whole sets. A second round looks at
what is left between components: rows that have a partner within FAR bits in another component, in the first band that the
two share, meet again with their whole shingle sets, and links between components are found by counting shared shingles. No
pairs are sent: a task reports a forest. A pair at 0.8 differs in 39 bits on average, with a deviation of 6.

Buckets of over CELL texts or CELL_WORDS shingles are dealt into cells (pairs of salts) that cover all pairs, so no task holds
an unbounded bucket. Texts of one shingle set are one node and are never compared.

Defined cases: a text without words has one shingle of its own, so all such texts are alike. Rows without doc_id come last in
the choice of the document that stays. Extra columns pass through. No rows: no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dedup, shared

ALIKE, WORDS = 0.8, 5
BANDS, ROWS = 24, 3
BITS, NEAR, FAR = 256, 44, 80
CELL, CELL_WORDS = 512, 1 << 21
_rng = np.random.default_rng(29)
_FLIPS, _FACTORS = _rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _rng.integers(0, 1 << 63, (BITS // 64, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of WORDS words, sorted; a text without words has one of its own."""
    return np.unique(np.frombuffer(near_dedup.shingle_hashes(text, WORDS) or bytes(8), ">u8").astype(np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of BANDS * ROWS hash functions."""
    out = np.full(len(_FLIPS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        out = np.minimum(out, ((shingles[k : k + 4096] ^ _FLIPS) * _FACTORS).min(axis=1))
    return out


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """SimHash of BITS bits: a bit is 1 if it is set in over half the hashes of the set's shingles."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), 4096):
        hashes = (shingles[k : k + 4096] ^ _SPREAD) * _SPREAD
        hashes = ((hashes ^ hashes >> np.uint64(32)) * _SPREAD).T.copy()
        total += np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, BITS // 8), axis=1), axis=0, dtype=np.uint16)
    return np.packbits(total * 2 > len(shingles)).tobytes()


def add_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark, node (a hash of the shingle set), n (its size), bands (a long each), fp (BITS bits)."""
    names = ["doc_id", "mark", "node", "n", "bands", "fp"]

    def make(batches):
        shared.make_room()
        for batch in shared.pieces_of(batches):
            node, size, bands, fps = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text)
                least = least_hashes(own).reshape(BANDS, ROWS)
                node.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                size.append(len(own))
                bands.append([xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)])
                fps.append(wide_fingerprint(own))
            cols = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *cols], names)

    return shared.id_text(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(make, "doc_id long, mark long, node long, n long, bands array<long>, fp binary")


def by_cell(answer, names: list[str], out: list[str], least: int = 1):
    """mapInArrow function over rows sorted by bucket and cell: answer(number of each row's cell, columns) gives tuples of longs.

    It is given whole cells, as many as make up `least` rows.
    """

    def run(batches):
        shared.make_room()
        at, cell, held, found = None, -1, [], []

        def batched():
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(len(out))], out)

        def close():
            if len(held) > 1:
                number, *cols = zip(*held, strict=True)
                found.extend(answer(np.array(number), *cols))

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("bucket", "cell", *names))
            for bucket, part, *row in zip(*cols, strict=True):
                if (bucket, part) != at:
                    at, cell = (bucket, part), cell + 1
                    if len(held) >= least:
                        close()
                        held = []
                        if len(found) >= 1 << 14:
                            yield batched()
                            found = []
                held.append((cell, *row))
        close()
        yield batched()

    return run


#: Rows whose fingerprints are compared in one go, where cells are small.
TOGETHER = 1 << 15


def _words(fps) -> np.ndarray:
    return np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), BITS // 64)


def likely_links(cell, node, fp):
    """A forest of the cells' pairs within NEAR bits."""
    for i, j in near_dedup.forest(_words(fp), cell, NEAR):
        yield min(node[i], node[j]), max(node[i], node[j])


def open_rows(number, bucket, cell, node, n, label, band, bands, fp):
    """(bucket, cell, node, label, n) of the rows with a partner within FAR bits in another component, first met in this band."""
    label, size, band = np.array(label), np.array(n), np.array(band)
    own = np.frombuffer(b"".join(bands), "<u4").reshape(len(bands), BANDS)
    wanted = np.zeros(len(node), bool)
    start = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    mixed = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)  # cells of one component have nothing open
    some = np.flatnonzero(np.repeat(mixed, np.diff(np.append(start, len(number)))))
    for i, j in near_dedup.close_pairs(_words([fp[r] for r in some]), number[some], FAR):
        i, j = some[i], some[j]
        fits = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= ALIKE * np.maximum(size[i], size[j]))
        i, j = i[fits], j[fits]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            new = (own[a] == own[b]).argmax(axis=1) >= band[a]
            wanted[a[new]] = wanted[b[new]] = True
    for r in np.flatnonzero(wanted).tolist():
        yield bucket[r], cell[r], node[r], int(label[r]), n[r]


def alike_links(cell, node, label, n, shingles):
    """A forest of the links between components that whole shingle sets show."""
    sizes = np.array([len(s) // 8 for s in shingles])
    starts = np.cumsum(sizes) - sizes
    kinds, which = np.unique(np.frombuffer(b"".join(shingles), "<u8"), return_inverse=True)
    _, root = np.unique(np.array(label), return_inverse=True)
    held = np.zeros(len(kinds), bool)
    for i in range(len(node) - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        own = which[starts[i] : starts[i] + sizes[i]]
        held[own] = True
        at = starts[i + 1]
        both = np.add.reduceat(held[which[at:]].astype(np.int64), starts[i + 1 :] - at)
        held[own] = False
        alike = both >= ALIKE * (sizes[i] + sizes[i + 1 :] - both)
        for j in (i + 1 + np.flatnonzero(alike)).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield min(node[i], node[j]), max(node[i], node[j])


def _in_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text for each node of wanted."""
    marks = wanted.select("node").distinct().join(nodes.select("node", F.col("key.mark").alias("mark")), "node")
    texts = shared.id_text(docs).withColumn("mark", F.xxhash64("text")).join(marks, "mark")
    return texts.groupBy("node").agg(F.min("text").alias("text"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose whole shingle sets are alike."""
    texts = shared.store(_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs), "near-texts")

    def confirm(batches):
        shared.make_room()
        kept: dict[int, np.ndarray] = {}

        def of(node, text):
            if node not in kept:
                if len(kept) >= 16:
                    kept.pop(next(iter(kept)))
                kept[node] = shingle_set(text)
            return kept[node]

        for batch in batches:
            good = [False] * batch.num_rows
            for i in range(batch.num_rows):
                a, x, b, y = (batch.column(c)[i].as_py() for c in ("a", "x", "b", "y"))
                good[i] = jaccard(of(a, x), of(b, y)) >= ALIKE
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "x", "b", "y")
    found = shared.store(both.mapInArrow(confirm, "a long, b long"), "alike")
    shared.drop(texts)
    return found


def _between(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links between components. members: bucket, cell, band, node, n, bands, fp, label."""
    names = ["node", "n", "label", "band", "bands", "fp"]
    rows = _in_cells(members).mapInArrow(by_cell(open_rows, ["bucket", "cell", *names], ["bucket", "cell", "node", "label", "n"], TOGETHER), "bucket long, cell long, node long, label long, n long")
    wanted = shared.store(rows, "near-open")

    def sets(batches):
        shared.make_room()
        for batch in shared.pieces_of(batches):
            own = [shingle_set(t).astype("<u8").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], ["node", "shingles"])

    whole = shared.store(_texts(wanted, nodes, docs).mapInArrow(sets, "node long, shingles binary"), "near-sets")
    met = _in_cells(wanted.join(whole, "node").select("bucket", "cell", "node", "label", "n", "shingles"))
    found = shared.store(met.mapInArrow(by_cell(alike_links, ["node", "label", "n", "shingles"], ["a", "b"]), "a long, b long"), "alike")
    shared.drop(whole)
    shared.drop(wanted)
    return found


def similar_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, key) of every distinct shingle set, key its first row, and (node, component) of those alike to another."""
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    nodes = shared.store(add_signatures(docs).groupBy("node").agg(F.min(key).alias("key"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "nodes")
    rows = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("words")).where("size > 1")
    shares = sizes.select("bucket", F.greatest(F.ceil(F.col("size") / CELL), F.ceil(F.col("words") / CELL_WORDS)).cast("long").alias("salts"))
    own = F.pmod(F.xxhash64("node"), "salts")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1), lambda k: F.least(k, F.col("own")) * F.col("salts") + F.greatest(k, F.col("own")))
    dealt = rows.join(shares, "bucket").withColumn("own", own).select("node", "band", "bucket", F.explode(cells).alias("cell"))
    dealt = shared.store(dealt, "near-cells")

    likely = _in_cells(dealt.join(nodes.select("node", "fp"), "node").select("bucket", "cell", "node", "fp"))
    first = shared.store(likely.mapInArrow(by_cell(likely_links, ["node", "fp"], ["a", "b"], TOGETHER), "a long, b long").distinct(), "near-pairs")
    links = _confirmed(first, nodes, docs)
    named = shared.store(shared.components(links, "near"), "near-names")
    low = F.transform("bands", lambda b: F.unhex(F.lpad(F.hex(b.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")))  # 4 bytes tell bands apart
    short = nodes.select("node", "n", "fp", F.aggregate(low, F.lit(b""), lambda a, b: F.concat(a, b)).alias("bands"))
    labelled = dealt.join(short, "node").join(named, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    more = _between(labelled, nodes, docs)
    if not more.isEmpty():
        named = shared.components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "near")
    shared.drop(dealt)
    return nodes.select("node", "key"), named


def first_of_similar(docs: DataFrame) -> DataFrame:
    """docs with one document of each component of similar texts: the smallest doc_id (rows without one last)."""
    nodes, named = similar_components(docs)
    least = nodes.join(named, "node", "left").groupBy(F.coalesce("component", "node").alias("name")).agg(F.min("key").alias("key"))
    return near_dedup.kept_rows(docs, least.select(F.col("key.doc_id").alias("w_id"), F.col("key.mark").alias("w_mark")))
