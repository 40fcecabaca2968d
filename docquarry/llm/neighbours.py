"""Operator 10: nearest neighbours by multiprobe p-stable hashing, reranked exactly.

Entries are taken in at most BANDS bands of norms (a factor of sqrt 2 each); in a band one more component makes all norms
equal, so that the largest inner product is the least distance, and a query visits every band. A table hashes a vector by
Gaussian (2-stable) projections, as many as give buckets of about OCCUPANCY entries at the table's row count, or a few more. A
query visits, in each of TABLES tables, the buckets of its likeliest perturbations in order of estimated success (the squared
distances to the slots' borders; a slot is shifted by REACH at most). How many it visits, and how many projections there are, is fitted
on SAMPLE queries that are searched exactly, and SAMPLE_ENTRIES entries: the least work at which TARGET of the sample's neighbours are
met, with at most MOST_PROBES visits. Fewer projections are tried down to two, whose shifts are few enough to be visited all, so on
any vectors there is a number that meets the target; without clusters it comes to large buckets, which are dealt into cells. Each visited bucket gives its best by exact inner products; a task merges the
candidates of a query from all buckets and tables that it holds, then the tasks' lists are merged and ranked.

A query that has met fewer than k others though there are more is searched exactly: groups of such queries meet cells of all
entries in tasks, as buckets do. So no list is shorter than it must be.

Equal vectors are one entry that carries the smallest vec_ids (all that a top list could need), and equal queries are
searched once. Buckets are dealt into cells of about CELL entries by VISITS queries, so no task holds an unbounded bucket or
its unbounded visitors, nothing is cut off, and only the best of each cell is moved on.

On vectors without clusters in many dimensions no hashing scheme prunes much (see the README for the share that is looked
at, with and without clusters); the fit then visits nearly all buckets.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part. Only vectors of the
same length are compared. Rows that repeat vec_id and vector count once; rows that share a vec_id are never each other's
neighbours, and as a query one of their vectors (the least by bytes) counts. Ties go to the smaller vec_id, among equal and
among different vectors; rows without vec_id come last and are no queries. Extra columns are ignored. No rows: no result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import shared

TABLES, WIDTH = 3, 1.6
OCCUPANCY, BITS_EACH, MOST_FUNCTIONS = 256, 1.9, 16  # a function of this width tells about 1.9 bits
FINER = 6  # so many more functions are tried too
SAMPLE, SAMPLE_ENTRIES, TARGET, MOST_PROBES = 48, 4096, 0.96, 400
VISIT_COST = 128
CELL, VISITS, BLOCK = 1024, 256, 512
BANDS = 16
REACH = 3  # slots a perturbation may move a function by
HELD = 1 << 14  # queries whose lists a task holds before it passes them on


def family(dims: int, scale: float, table: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections and offsets of a table, in units of a slot."""
    rng = np.random.default_rng([97, dims, table])
    return rng.normal(size=(functions, dims + 1)).T / (WIDTH * scale), rng.uniform(0, 1, functions)


def functions_for(entries: int) -> int:
    return max(2, min(MOST_FUNCTIONS, round(math.log2(max(1, entries) / OCCUPANCY) / BITS_EACH) if entries > OCCUPANCY else 2))


def perturbations(place: np.ndarray, count: int) -> list[tuple[int, ...]]:
    """The `count` likeliest slot shifts of a query, best first; place: where it lies in its slots (0 to 1)."""
    steps = []
    for f in place.tolist():
        own = [(0.0, 0)]
        for s in range(1, REACH + 1):
            own += [((s - f) ** 2, s), ((s - 1 + f) ** 2, -s)]
        steps.append(sorted(own))
    start = (0,) * len(steps)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < count:
        cost, at = heapq.heappop(heap)
        out.append(tuple(steps[i][k][1] for i, k in enumerate(at)))
        for i, k in enumerate(at):
            if k + 1 < len(steps[i]):
                after = (*at[:i], k + 1, *at[i + 1 :])
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (cost - steps[i][k][0] + steps[i][k + 1][0], after))
    return out


def bucket_of(dims: int, band: int, table: int, slots: np.ndarray) -> np.ndarray:
    """One number for the length of a vector, its band, the table and its slots."""
    out = np.full(len(slots), (dims * BANDS + band) * TABLES + table, np.uint64)
    for k in range(slots.shape[1]):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + slots[:, k].astype(np.int64).view(np.uint64)
    return (out ^ out >> np.uint64(32)).view(np.int64)


class Index:
    """The hashing of a table of vectors: largest norm, number of functions, bands that are in use."""

    def __init__(self, norm: float, functions: int, bands: list[int]):
        self.norm, self.functions, self.bands = norm, functions, bands

    def band_of(self, x: np.ndarray) -> np.ndarray:
        lengths = np.sqrt((x**2).sum(axis=1))
        return np.clip(np.floor(-2 * np.log2(np.maximum(lengths / self.norm, 1e-300))), 0, BANDS - 1).astype(np.int64)

    def places(self, x: np.ndarray, band: int, table: int, query: bool) -> np.ndarray:
        """Where vectors of one length lie, in slots. Entries get the component that makes up the band's norm; queries are scaled to it."""
        top = self.norm * 2.0 ** (-band / 2)
        a, b = family(x.shape[1], top, table, self.functions)
        lengths = np.sqrt((x**2).sum(axis=1))
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top**2 - lengths**2, 0))
        return np.concatenate([x / lengths[:, None] * top if query else x, extra[:, None]], axis=1) @ a + b

    def buckets(self, x: np.ndarray, band: int, table: int) -> np.ndarray:
        return bucket_of(x.shape[1], band, table, np.floor(self.places(x, band, table, False)).astype(np.int64))

    def visits(self, x: np.ndarray, band: int, table: int, probes: int) -> list[np.ndarray]:
        """For each query its buckets, likeliest first."""
        at = self.places(x, band, table, True)
        slots = np.floor(at).astype(np.int64)
        return [bucket_of(x.shape[1], band, table, s + np.array(perturbations(p, probes))) for s, p in zip(slots, at - slots, strict=True)]


def by_length(vectors: list[bytes], kind: str):
    """(places, array of doubles) of the vectors of each length."""
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        groups.setdefault(len(v), []).append(i)
    for own in groups.values():
        x = np.frombuffer(b"".join([vectors[i] for i in own]), kind).reshape(len(own), -1)
        yield np.array(own), x.astype(np.float64)


def packed(rows: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, vector (bytes), norm of the rows that take part, and the vectors' numpy type."""
    single = isinstance(rows.schema["embedding"].dataType, T.ArrayType) and isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType)
    kind, real = ("<f4", T.FloatType()) if single else ("<f8", T.DoubleType())
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(real)).alias("vector"))

    def pack(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("vector")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.nan_to_num(batch.column("vector").flatten().to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=np.inf).astype(kind)
            ends = np.cumsum(sizes)
            wide = flat.astype(np.float64)
            total = np.concatenate([[0], np.cumsum(~np.isfinite(wide))])
            square = np.zeros(len(sizes))
            some = np.flatnonzero(sizes)
            if len(some):
                square[some] = np.add.reduceat(np.where(np.isfinite(wide), wide, 0) ** 2, (ends - sizes)[some])
            used = (sizes > 0) & (total[ends] == total[ends - sizes]) & (square > 0)
            kept = np.flatnonzero(used)
            vectors = [flat[ends[i] - sizes[i] : ends[i]].tobytes() for i in kept]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.array(vectors, pa.binary()), pa.array(np.sqrt(square[kept]))], ["vec_id", "vector", "norm"])

    return typed.mapInArrow(pack, "vec_id long, vector binary, norm double"), kind


def merged(a: list[tuple], b: list[tuple], most: int) -> list[tuple]:
    """The best `most` of two lists of (-score, no id, id), each id once."""
    out, seen = [], set()
    for x in heapq.merge(a, b):
        if x[1:] not in seen:
            seen.add(x[1:])
            out.append(x)
            if len(out) == most:
                break
    return out


def best_of(block: np.ndarray, ids: list, queries: np.ndarray, most: int) -> list[list[tuple]]:
    """For each query its best `most` (-score, no id, id), by scores summed in one way; ties go to the smaller id.

    The product only tells which entries can be among the best: all within rounding of the last of them are scored again.
    """
    rough = queries @ block.T
    want = min(most, rough.shape[1])
    last = -np.partition(-rough, want - 1, axis=1)[:, want - 1]
    slack = 1e-12 * np.sqrt((queries**2).sum(axis=1)) * math.sqrt((block**2).sum(axis=1).max()) * block.shape[1]
    out = []
    for q, row, least in zip(queries, rough, last - slack, strict=True):
        some = np.flatnonzero(row >= least)
        exact = (block[some] * q).sum(axis=1).tolist()
        found = sorted((-s, i is None, i or 0) for s, e in zip(exact, some.tolist(), strict=True) for i in ids[e])
        out.append(merged(found, [], most))
    return out


def _lists(found: dict) -> pa.RecordBatch:
    cols = (list(found), [[None if x[1] else x[2] for x in f] for f in found.values()], [[-x[0] for x in f] for f in found.values()])
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.float64()))], ["key", "ids", "scores"])


LISTS = "key long, ids array<long>, scores array<double>"


def searcher(most: int, kind: str):
    """Scores queries against the entries of their cell; rows come by cell, entries first. Gives a list for each query."""

    def search(batches):
        shared.make_room()
        cell, vectors, ids, keys, asked, block = None, [], [], [], [], None
        found: dict[int, list] = {}

        def answer():
            nonlocal block
            if block is None:
                block = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
            queries = np.frombuffer(b"".join(asked), kind).reshape(len(asked), -1).astype(np.float64)
            for key, best in zip(keys, best_of(block, ids, queries, most), strict=True):
                found[key] = merged(found[key], best, most) if key in found else best

        for batch in batches:
            names = ("bucket", "cell", "group", "query", "key", "vector", "ids")
            for bucket, part, group, query, key, vector, own in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (bucket, part, group, len(vector)) != cell:
                    if asked:
                        answer()
                    if len(found) >= HELD:
                        yield _lists(found)
                        found = {}
                    cell, vectors, ids, keys, asked, block = (bucket, part, group, len(vector)), [], [], [], [], None
                if not query:
                    vectors.append(vector)
                    ids.append(own)
                elif vectors:
                    keys.append(key)
                    asked.append(vector)
                    if len(asked) == BLOCK:
                        answer()
                        keys, asked = [], []
        if asked:
            answer()
        yield _lists(found)

    return search


def scan(entries: DataFrame, queries: list[tuple[int, bytes]], most: int, kind: str) -> DataFrame:
    """key, vec_id, score, vector: the exact search of at most BLOCK queries; each task passes on its best for each of them."""
    asked = [(np.array([queries[i][0] for i in own]), x) for own, x in by_length([v for _, v in queries], kind)]
    names = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("vector", pa.binary())])

    def search(batches):
        shared.make_room()
        found: dict[int, list] = {}
        kept: dict[int, bytes] = {}
        for batch in batches:
            vectors, ids = batch.column("vector").to_pylist(), batch.column("ids").to_pylist()
            for own, block in by_length(vectors, kind):
                for keys, x in asked:
                    if x.shape[1] != block.shape[1]:
                        continue
                    for at in range(0, len(block), CELL):
                        for key, best in zip(keys.tolist(), best_of(block[at : at + CELL], [ids[i] for i in own[at : at + CELL]], x, most), strict=True):
                            found[key] = merged(found.get(key, []), best, most)
            named = {x[2] for f in found.values() for x in f}
            kept = {i: v for i, v in kept.items() if i in named} | {i: v for v, o in zip(vectors, ids, strict=True) for i in o if i in named}
        rows = [{"key": k, "vec_id": x[2], "score": -x[0], "vector": kept[x[2]]} for k, f in found.items() for x in f if not x[1]]
        yield pa.RecordBatch.from_pylist(rows, names)

    return entries.select("vector", "ids").mapInArrow(search, "key long, vec_id long, score double, vector binary")


def fitted(norm: float, bands: list[int], count: int, entries: DataFrame, firsts: DataFrame, k: int, kind: str) -> tuple[Index, int]:
    """The hashing, and the fewest visits a table at which TARGET of the neighbours of SAMPLE queries are met.

    Of the numbers of functions tried, the one with the least work on the samples: entries scored, by their share of a sample
    of entries, and visits, each of which costs as much as VISIT_COST entries. The samples are bounded, the driver sees k + 1
    neighbours for each sample query; no other query or entry is looked at here.
    """
    finest = min(MOST_FUNCTIONS, functions_for(count) + FINER)
    tries = [Index(norm, f, bands) for f in sorted({*range(finest, 2, -2), 2})]
    sample = [(r.key, bytes(r.vector)) for r in firsts.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("key", "vector").collect()]
    if not sample:
        return tries[0], 1
    near: dict[int, list] = {}
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id"))
    for r in scan(entries, sample, k + 1, kind).withColumn("n", n).where(F.col("n") <= k + 1).collect():
        near.setdefault(r.key, []).append((-r.score, r.vec_id, bytes(r.vector)))
    some = list(by_length([bytes(r.vector) for r in entries.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE_ENTRIES).collect()], kind))
    share = min(1.0, SAMPLE_ENTRIES / count)
    best = None
    for index in tries:
        held: dict[int, int] = {}  # entries of the sample in each bucket
        for _, x in some:
            in_band = index.band_of(x)
            for band in set(in_band.tolist()):
                for table in range(TABLES):
                    for bucket in index.buckets(x[in_band == band], band, table).tolist():
                        held[bucket] = held.get(bucket, 0) + 1
        ranks, seen = [], []
        for key, vector in sample:
            q = np.frombuffer(vector, kind).astype(np.float64)[None]
            others = [v for *_, v in sorted(near[key])[: k + 1] if v != vector]
            x = np.array([np.frombuffer(v, kind).astype(np.float64) for v in others]).reshape(len(others), q.shape[1])
            own, least = index.band_of(x), np.full(len(x), MOST_PROBES)
            for band in bands:
                for table in range(TABLES):
                    visited = index.visits(q, band, table, MOST_PROBES)[0].tolist()
                    seen.append(np.cumsum([held.get(b, 0) for b in visited]))
                    rank = {b: r for r, b in reversed(list(enumerate(visited)))}
                    mine = np.flatnonzero(own == band)
                    if len(mine):
                        least[mine] = np.minimum(least[mine], [rank.get(b, MOST_PROBES) for b in index.buckets(x[mine], band, table).tolist()])
            ranks += least.tolist()
        need = sorted(ranks)[math.ceil(TARGET * len(ranks)) - 1] if ranks else 0
        if need < MOST_PROBES:
            scored = sum(int(c[min(need, len(c) - 1)]) for c in seen) / share / len(sample)
            work = scored + VISIT_COST * TABLES * len(bands) * (need + 1)
            if best is None or work < best[0]:
                best = work, index, need + 1
    return (best[1], best[2]) if best else (tries[0], MOST_PROBES)


def _dealt(index: Index, entries: DataFrame, asked: DataFrame, probes: int, kind: str) -> tuple[DataFrame, list[DataFrame]]:
    """Entries and queries in their cells: bucket, cell, group, query, key, vector, ids; and the tables stored for it."""

    def place(batches):
        shared.make_room()
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            for own, x in by_length(vectors, kind):
                bands = index.band_of(x)
                for band in set(bands.tolist()):
                    some = np.flatnonzero(bands == band)
                    rows = batch.take(pa.array(own[some]))
                    for table in range(TABLES):
                        yield pa.RecordBatch.from_arrays([pa.array(index.buckets(x[some], band, table)), rows.column("vector"), rows.column("ids")], ["bucket", "vector", "ids"])

    def visit(batches):
        shared.make_room()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for own, x in by_length(batch.column("vector").to_pylist(), kind):
                for at in range(0, len(own), 256):
                    for band in index.bands:
                        for table in range(TABLES):
                            got = [np.unique(b) for b in index.visits(x[at : at + 256], band, table, probes)]
                            who = np.repeat(keys[own[at : at + 256]], [len(b) for b in got])
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), pa.array(who)], ["bucket", "key"])

    held = shared.store(entries.select("vector", "ids").mapInArrow(place, "bucket long, vector binary, ids array<long>"), "index")
    visits = shared.store(asked.select("key", "vector").mapInArrow(visit, "bucket long, key long"), "visits")
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n")).join(visits.groupBy("bucket").agg(F.count("*").alias("v")), "bucket")
    sizes = shared.store(sizes.select("bucket", F.ceil(F.col("n") / CELL).cast("long").alias("cells"), F.ceil(F.col("v") / VISITS).cast("long").alias("groups")), "buckets")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = F.lit(None)
    own = held.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("vector"), "cells").alias("cell"), every("groups").alias("group"), F.lit(False).alias("query"), none.cast("long").alias("key"), "vector", "ids")
    seen = visits.join(sizes, "bucket").select("bucket", every("cells").alias("cell"), F.pmod(F.xxhash64("key"), "groups").alias("group"), F.lit(True).alias("query"), "key")
    seen = seen.join(asked.select("key", "vector"), "key").select("bucket", "cell", "group", "query", "key", "vector", none.cast("array<long>").alias("ids"))
    met = own.unionByName(seen).repartition("bucket", "cell", "group")
    return met.sortWithinPartitions("bucket", "cell", "group", F.octet_length("vector"), "query"), [held, visits, sizes]


def nearest(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds, the k nearest others that were found."""
    used, kind = packed(rows)
    used = shared.store(used.distinct(), "vectors")
    # of equal vectors the k + 1 smallest ids: a list of k without the query's own needs no more
    ranked = used.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("n") <= k + 1)
    entries = ranked.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id"))).alias("held"))
    entries = shared.store(entries.select("vector", F.transform("held", lambda x: x["vec_id"]).alias("ids")), "entries")
    asked = shared.store(used.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    firsts = shared.store(asked.groupBy("vector").agg(F.min("vec_id").alias("key")), "query-vectors")

    most = used.agg(F.max("norm").alias("norm"), F.min("norm").alias("least")).first()
    norm = most.norm or 1.0
    lowest = min(BANDS - 1, math.floor(-2 * math.log2(max((most.least or norm) / norm, 1e-300))))
    index, probes = fitted(norm, list(range(lowest + 1)), entries.count(), entries, firsts, k, kind)
    dealt, made = _dealt(index, entries, firsts, probes, kind)
    pairs = shared.store(_pairs(dealt.mapInArrow(searcher(k + 1, kind), LISTS), k), "candidates")
    for table in made:
        shared.drop(table)
    # queries that met fewer than k others though there are more: searched exactly
    there = used.select(F.octet_length("vector").alias("size"), "vec_id").distinct().groupBy("size").agg(F.count("*").alias("others"))
    counted = firsts.join(pairs.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    short = counted.join(F.broadcast(there), F.octet_length("vector") == F.col("size")).where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k + 1), F.col("others")))  # one row for each length of vectors
    short = shared.store(short.select("key", "vector"), "short")
    if not short.isEmpty():
        pairs = pairs.join(short.select("key"), "key", "left_anti").unionByName(_pairs(_exact(entries, short, k, kind), k))

    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    who = asked.select(F.col("vec_id").alias("query_id"), "vector").join(firsts, "vector").select("query_id", "key")
    mine = who.join(pairs, "key").where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    ranks = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _exact(entries: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """The exact lists of all rows of asked: groups of queries meet cells of entries, every group every cell, in tasks."""
    cells, groups = max(1, -(-entries.count() // (8 * CELL))), max(1, -(-asked.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none, one = F.lit(None), F.lit(0).cast("long").alias("bucket")
    own = entries.select(one, F.pmod(F.xxhash64("vector"), F.lit(cells)).cast("long").alias("cell"), every(groups).alias("group"), F.lit(False).alias("query"), none.cast("long").alias("key"), "vector", "ids")
    seen = asked.select(one, every(cells).alias("cell"), F.pmod(F.xxhash64("key"), F.lit(groups)).cast("long").alias("group"), F.lit(True).alias("query"), "key", "vector", none.cast("array<long>").alias("ids"))
    met = own.unionByName(seen).repartition("cell", "group").sortWithinPartitions("cell", "group", F.octet_length("vector"), "query")
    return met.mapInArrow(searcher(k + 1, kind), LISTS)


def _pairs(lists: DataFrame, k: int) -> DataFrame:
    """key, vec_id, score: the best k + 1 of each query's lists, of which each task that met the query sent one."""

    def merge(batches):
        shared.make_room()
        at, best = None, []
        found: dict[int, list] = {}
        for batch in batches:
            for key, ids, scores in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "scores")), strict=True):
                if key != at:
                    if at is not None:
                        found[at] = best
                    if len(found) >= HELD:
                        yield _lists(found)
                        found = {}
                    at, best = key, []
                best = merged(best, [(-s, i is None, i or 0) for i, s in zip(ids, scores, strict=True)], k + 1)
        if at is not None:
            found[at] = best
        yield _lists(found)

    whole = lists.repartition("key").sortWithinPartitions("key").mapInArrow(merge, LISTS)
    pairs = whole.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    return pairs.select("key", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
