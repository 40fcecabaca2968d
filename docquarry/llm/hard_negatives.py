"""Operator 11: hard negatives by branch and bound over ball trees, one tree to a partition.

Components become whole numbers (floor of 256 x), so scores are exact. Rows are range-partitioned along a random projection and
each partition is written as a ball tree of leaves (centre, radius, labels, members). Of a node with centre c and radius r all
inner products with q lie in q.c - |q| r to q.c + |q| r. A search goes down from the root; it leaves out nodes without a
wanted label, nodes whose interval misses all the score windows asked for, and nodes whose upper bound is strictly beneath the
current k-th of each of them; leaves are scored from the highest bound down, so the k-th soon rises.

Two searches: the best of the anchor's own label (one window without ends), then the best of other labels in the window that each
of these positives opens. Both start from a k-th taken from a sample of SEEDS rows, a true lower bound. A directory with one
ball for each tree tells which trees an anchor has to visit; a tree's anchors are dealt in slices of VISITS. Lists come back a
row for each anchor and tree, and are ranked by anchor.

Rows of equal label and vector are one entry that carries the smallest ids, all that a list could need, so that a vector that very
many rows hold is small work. There are at most MOST_TREES trees, so the directory is bounded; trees grow beyond
MOST_TREES * TREE_ROWS entries.

Defined cases: rows without vec_id, label or vector, with an empty vector, or with a null or non-finite component take no part, nor
do rows whose whole-number vector has a squared length of 2^61 or more (its scores would not fit a long). Of rows that share a
vec_id the least by label, then vector, takes part. Vectors of different lengths are not compared. Ties go to the smaller vec_id.
A window that a negative positive score opens is empty. Fewer rows than asked for: all there are. Other columns are ignored,
whatever their names. No rows: no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

TREE_ROWS, MOST_TREES, LEAF = 8192, 8192, 64
SEEDS, SEED_BYTES = 4096, 8 << 20
VISITS, BLOCK, FIRST = 8192, 256, 4  # anchors to a slice, anchors searched together, leaves of an anchor in the first round
LOWEST = -(1 << 62)
SQUARE = 2.0**61

PACKED = "vec_id long, label long, vector binary, dims int"
LEAVES = "tree int, leaf int, dims int, centre binary, radius double, labels array<long>, counts array<int>, ids array<long>, vectors binary"
VISIT = "tree int, dims int, anchor long, label long, vector binary, lows array<long>, highs array<long>, seeds array<long>"
LISTS = "anchor long, place array<int>, ids array<long>, scores array<long>"


def packed(rows: DataFrame) -> DataFrame:
    """PACKED of the rows of (vec_id, label, embedding) that take part, one for each vec_id; vector: 32-bit whole numbers."""

    def pack(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf, posinf=np.inf, neginf=np.inf)
            with np.errstate(over="ignore"):
                whole = np.floor(flat * 256)
                square = np.concatenate([[0], np.cumsum(np.minimum(whole * whole, 2.0**62))])
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat) | (np.abs(whole) >= 2.0**31))])
            used = (sizes > 0) & (bad[ends] == bad[ends - sizes]) & (square[ends] - square[ends - sizes] < SQUARE)
            kept = np.flatnonzero(used)
            data = [whole[ends[i] - sizes[i] : ends[i]].astype("<i4").tobytes() for i in kept]
            some = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(data, pa.binary()), pa.array(sizes[kept].astype(np.int32))], ["vec_id", "label", "vector", "dims"])

    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    made = typed.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(pack, PACKED)
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "dims")).alias("x")).select("vec_id", "x.*")


def entries_of(used: DataFrame, keep: int) -> DataFrame:
    """label, vector, dims, ids: equal rows as one, with their `keep` smallest ids."""
    n = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    rows = used.withColumn("n", n).where(F.col("n") <= keep)
    return rows.groupBy("label", "vector").agg(F.first("dims").alias("dims"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def projected(entries: DataFrame) -> DataFrame:
    """entries with lead: the vector along a random direction that is the same for all vectors of a length."""

    def lead(batches):
        ways: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for raw in batch.column("vector").to_pylist():
                x = np.frombuffer(raw, "<i4")
                if len(x) not in ways:
                    ways[len(x)] = np.random.default_rng([11, len(x)]).normal(size=len(x))
                out.append(float(x @ ways[len(x)]))
            yield batch.append_column("lead", pa.array(out, pa.float64()))

    return entries.mapInArrow(lead, "label long, vector binary, dims int, ids array<long>, lead double")


def parted(x: np.ndarray) -> list[np.ndarray]:
    """Places of the rows of x in leaves of at most LEAF: halved along the component that varies most, again and again."""
    work, out = [np.arange(len(x))], []
    while work:
        own = work.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        some = x[own]
        axis = int(np.argmax(some.var(axis=0)))
        half = np.argpartition(some[:, axis], len(own) // 2)
        work += [own[half[len(own) // 2 :]], own[half[: len(own) // 2]]]
    return out


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(axis=0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-12)


def leaf_rows(rows: list[tuple], dims: int) -> list[tuple]:
    """leaf, centre, radius, labels, counts, ids, vectors of the leaves of (label, vector, ids)."""
    whole = np.frombuffer(b"".join(v for _, v, _ in rows), "<i4").reshape(-1, dims)
    out = []
    for k, own in enumerate(parted(whole.astype(np.float64))):
        centre, radius = _ball(whole[own])
        out.append((k, centre.tobytes(), radius, [rows[i][0] for i in own], [len(rows[i][2]) for i in own], [j for i in own for j in rows[i][2]], whole[own].tobytes()))
    return out


def build(batches):
    """The leaves of a partition's trees, one tree for each length of vectors, and a row (leaf -1) for the ball around each."""
    shared.make_room()
    groups: dict[int, list] = {}
    for batch in batches:
        for label, vector, dims, ids in zip(*(batch.column(c).to_pylist() for c in ("label", "vector", "dims", "ids")), strict=True):
            groups.setdefault(dims, []).append((label, vector, ids))
    tree = TaskContext.get().partitionId() if TaskContext.get() else 0
    for dims, rows in groups.items():
        whole = np.frombuffer(b"".join(v for _, v, _ in rows), "<i4").reshape(-1, dims)
        found = [(tree, k, dims, *rest) for k, *rest in leaf_rows(rows, dims)]
        centre, radius = _ball(whole)
        labels = sorted({label for label, _, _ in rows})
        found.append((tree, -1, dims, centre.tobytes(), radius, labels[:2], [len(labels)], [], b""))
        for at in range(0, len(found), 256):
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + 256], strict=True), kinds, strict=True)], [c.split()[0] for c in LEAVES.split(", ")])


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=-1))


def _bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each q with each ball, a little wider for rounding."""
    own = _lengths(q)[:, None]
    middle, reach = q @ centres.T, own * radii[None] + 1e-9 * (1 + own * (_lengths(centres) + radii)[None])
    return middle - reach, middle + reach


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors, by doubles where no sum can exceed 2^53."""
    if len(x) and len(q) and _lengths(q).max() * _lengths(x).max() < 2.0**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Tree:
    """A tree from its leaf rows: balls around pairs of nodes, level by level, up to one root."""

    def __init__(self, leaves: list[tuple], dims: int):
        leaves.sort(key=lambda r: r[0])
        _, centres, radii, labels, counts, ids, vectors = zip(*leaves, strict=True)
        self.vectors = [np.frombuffer(v, "<i4").reshape(-1, dims) for v in vectors]
        self.labels = [np.array(x, np.int64) for x in labels]
        self.ids = [np.array(x, np.int64) for x in ids]
        self.counts = [np.array(x, np.int64) for x in counts]
        self.kinds = np.unique(np.concatenate(self.labels))
        has = np.zeros((len(leaves), len(self.kinds)), bool)
        for k, x in enumerate(self.labels):
            has[k, np.searchsorted(self.kinds, x)] = True
        centre, radius = np.array([np.frombuffer(c) for c in centres]), np.array(radii)
        self.levels = [(centre, radius, has)]
        while len(centre) > 1:
            left, right = np.arange(0, len(centre), 2), np.minimum(np.arange(0, len(centre), 2) + 1, len(centre) - 1)
            middle = (centre[left] + centre[right]) / 2
            reach = [_lengths(centre[side] - middle) + radius[side] for side in (left, right)]
            centre, radius, has = middle, np.maximum(*reach) * (1 + 1e-12), has[left] | has[right]
            self.levels.append((centre, radius, has))


class Search:
    """The lists of a block of anchors in one tree: for each window the best `most` rows, of the anchor's label or of others."""

    def __init__(self, tree: Tree, anchors, labels, q, lows, highs, seeds, same: bool, most: int):
        self.tree, self.q, self.same, self.most = tree, q, same, most
        self.anchors, self.labels = np.array(anchors, np.int64), np.array(labels, np.int64)
        self.lows, self.highs = np.array(lows, np.int64), np.array(highs, np.int64)
        self.least = np.array(seeds, np.int64)  # the current k-th of each window
        self.windows = self.lows.shape[1]
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.scored = 0

    def _open(self, low: np.ndarray, high: np.ndarray, some) -> np.ndarray:
        """Whether an interval of scores can still give an anchor something, in any of its windows."""
        out = np.zeros(low.shape, bool)
        for w in range(self.windows):
            own = [x[some, w].reshape(low.shape[0], *[1] * (low.ndim - 1)) for x in (self.lows, self.highs, self.least)]
            out |= (own[0] <= own[1]) & (high >= own[0]) & (low <= own[1]) & (high >= own[2])
        return out

    def _alive(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the root down to the leaves: which leaves each anchor may need, with their bounds."""
        tree, q = self.tree, self.q.astype(np.float64)
        mine = np.minimum(np.searchsorted(tree.kinds, self.labels), len(tree.kinds) - 1)
        there = tree.kinds[mine] == self.labels
        alive = np.ones((len(q), 1), bool)
        for centre, radius, has in reversed(tree.levels):
            if alive.shape[1] != len(centre):
                alive = np.repeat(alive, 2, axis=1)[:, : len(centre)]
            cols = np.flatnonzero(alive.any(axis=0))
            low, high = np.full(alive.shape, np.inf), np.full(alive.shape, -np.inf)
            low[:, cols], high[:, cols] = _bounds(q, centre[cols], radius[cols])
            own = has[:, mine].T & there[:, None]
            alive &= own if self.same else has.sum(axis=1)[None] > own
            alive &= self._open(low, high, slice(None))
        return alive, low, high

    def _take(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Add (group, score, id), keep the best of each group, and raise its least."""
        group, score, ids = (np.concatenate([own, *new]) for own, new in zip((self.group, self.score, self.id), zip(*found, strict=True), strict=True))
        order = np.lexsort([ids, -score, group])
        group, score, ids = group[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        kept = rank < self.most
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        last = rank[kept] == self.most - 1
        flat = self.least.reshape(-1)
        flat[self.group[last]] = np.maximum(flat[self.group[last]], self.score[last])

    def _leaf(self, leaf: int, some: np.ndarray) -> list:
        """What the anchors `some` find among a leaf's members."""
        tree, out = self.tree, []
        score = scores_of(self.q[some], tree.vectors[leaf])
        self.scored += score.size
        label = (tree.labels[leaf][None] == self.labels[some][:, None]) == self.same
        starts = np.cumsum(tree.counts[leaf]) - tree.counts[leaf]
        for w in range(self.windows):
            own = [x[some, w][:, None] for x in (self.lows, self.highs, self.least)]
            who, what = np.nonzero(label & (score >= own[0]) & (score <= own[1]) & (score >= own[2]))
            each = tree.counts[leaf][what]
            at = np.repeat(starts[what] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            ids, anchor = tree.ids[leaf][at], np.repeat(some[who], each)
            other = ids != self.anchors[anchor]
            out.append(((anchor * self.windows + w)[other], np.repeat(score[who, what], each)[other], ids[other]))
        return out

    def run(self) -> Search:
        alive, low, high = self._alive()
        order = np.argsort(np.where(alive, -high, np.inf), axis=1)  # best bound first, what is left out last
        number, at, step = alive.sum(axis=1), 0, FIRST
        while at < number.max(initial=0):
            who = np.flatnonzero(number > at)
            leaves = order[who, at : at + step]
            rows = np.repeat(who, leaves.shape[1])
            leaves = leaves.reshape(-1)
            still = alive[rows, leaves] & self._open(low[rows, leaves], high[rows, leaves], rows)
            rows, leaves = rows[still], leaves[still]
            turn = np.argsort(leaves, kind="stable")
            rows, leaves = rows[turn], leaves[turn]
            cuts = np.flatnonzero(np.diff(leaves, prepend=-1))
            if len(cuts):
                self._take([x for a, b in zip(cuts, [*cuts[1:], len(leaves)], strict=True) for x in self._leaf(int(leaves[a]), rows[a:b])])
            at, step = at + step, step * 2
        return self

    def lists(self) -> pa.RecordBatch:
        """LISTS of the anchors that found something."""
        who = self.group // self.windows
        cuts = np.flatnonzero(np.diff(who, prepend=-1))
        ends = pa.array(np.append(cuts, len(who)).astype(np.int32))
        cols = [pa.ListArray.from_arrays(ends, x) for x in (pa.array((self.group % self.windows).astype(np.int32)), pa.array(self.id), pa.array(self.score))]
        return pa.RecordBatch.from_arrays([pa.array(self.anchors[who[cuts]]), *cols], ["anchor", "place", "ids", "scores"])


def searcher(same: bool, most: int):
    """Rows come by tree, slice and length of vectors, leaves before anchors."""

    def search(batches):
        shared.make_room()
        at, leaves, tree, asked = None, [], None, []

        def answer():
            nonlocal tree, asked
            if tree is None:
                tree = Tree(leaves, at[2])
            ids, labels, vectors, lows, highs, seeds = zip(*asked, strict=True)
            asked = []
            q = np.frombuffer(b"".join(vectors), "<i4").reshape(len(ids), -1)
            return Search(tree, ids, labels, q, lows, highs, seeds, same, most).run().lists()

        for batch in batches:
            names = ("tree", "slice", "dims", "leaf", "centre", "radius", "labels", "counts", "ids", "vectors", "anchor", "label", "vector", "lows", "highs", "seeds")
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:3] != at:
                    if asked and leaves:
                        yield answer()
                    at, leaves, tree, asked = row[:3], [], None, []
                if row[3] is not None:
                    leaves.append(row[3:10])
                elif leaves:
                    asked.append(row[10:])
                    if len(asked) == BLOCK:
                        yield answer()
        if asked and leaves:
            yield answer()

    return search


def visits(asked: DataFrame, balls: list, sample: list, same: bool, most: int) -> DataFrame:
    """VISIT of (anchor, label, vector, dims, lows, highs): which trees each has to visit, with the sample's k-th of each window."""
    by_dims = {}
    for r in balls:
        own = by_dims.setdefault(r.dims, ([], [], [], []))
        for held, x in zip(own, (r.tree, bytes(r.centre), r.radius, set(r.labels) if r["counts"][0] <= 2 else None), strict=True):
            held.append(x)
    known: dict[int, list] = {}
    for row in sample:
        known.setdefault(len(row[1]) // 4, []).append(row)

    def run(batches):
        shared.make_room()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                for dims in set(rows.column("dims").to_pylist()):
                    own = rows.filter(pc.equal(rows.column("dims"), dims))
                    if dims in by_dims and own.num_rows:
                        yield send(own, dims)

    def send(rows, dims):
        anchors, labels, vectors, lows, highs = (rows.column(c).to_pylist() for c in ("anchor", "label", "vector", "lows", "highs"))
        q = np.frombuffer(b"".join(vectors), "<i4").reshape(len(anchors), dims)
        seeds = np.full(np.array(lows).shape, LOWEST)
        if dims in known:
            tree = Tree(leaf_rows(known[dims], dims), dims)
            seeds = Search(tree, anchors, labels, q, lows, highs, seeds, same, most).run().least
        trees, centres, radii, held = by_dims[dims]
        ask = Search(None, anchors, labels, q, lows, highs, seeds, same, most)
        open_ = ask._open(*_bounds(q.astype(np.float64), np.array([np.frombuffer(c) for c in centres]), np.array(radii)), slice(None))
        for j, some in enumerate(held):
            if some is not None:
                inside = np.array([label in some for label in labels])
                open_[:, j] &= inside if same else np.array([some != {label} for label in labels])
        who, where = np.nonzero(open_)
        cols = rows.take(pa.array(who))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, seeds.size + 1, seeds.shape[1]).astype(np.int32)), pa.array(seeds.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(np.array(trees, np.int32)[where]), *[cols.column(c) for c in ("dims", "anchor", "label", "vector", "lows", "highs")], listed.take(pa.array(who))], [c.split()[0] for c in VISIT.split(", ")])

    return asked.mapInArrow(run, VISIT)


def searched(asked: DataFrame, leaves: DataFrame, balls: list, sample: list, same: bool, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """anchor, place (of the window), vec_id, score, n (rank) of the best `most`; and the tables stored for it."""
    seen = shared.store(visits(asked, balls, sample, same, most), "visits")
    slices = seen.groupBy("tree").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("slices"))  # one row for each tree
    none = F.lit(None)
    own = leaves.join(F.broadcast(slices), "tree").select("tree", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *[c for c in leaves.columns if c != "tree"], none.cast("long").alias("anchor"), none.cast("long").alias("label"), none.cast("binary").alias("vector"), *[none.cast("array<long>").alias(c) for c in ("lows", "highs", "seeds")])
    mine = seen.join(F.broadcast(slices), "tree").withColumn("slice", F.pmod(F.xxhash64("anchor"), "slices").cast("int")).drop("slices")
    met = own.unionByName(mine, allowMissingColumns=True).repartition("tree", "slice").sortWithinPartitions("tree", "slice", "dims", F.col("leaf").isNull())
    lists = shared.store(met.mapInArrow(searcher(same, most), LISTS), "lists")
    each = lists.select("anchor", F.explode(F.arrays_zip("place", "ids", "scores")).alias("x"))
    rows = each.select("anchor", F.col("x.place").alias("place"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    n = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("n", n).where(F.col("n") <= most), [seen, lists]


def _part(score: Column, share: int, up: bool) -> Column:
    """share per cent of a whole number, rounded up or down to a whole number, exactly."""
    rest = F.pmod(score, F.lit(100))
    whole = F.call_function("div", score - rest, F.lit(100))  # in whole numbers, as / would go through doubles
    return whole * share + (F.ceil(rest * share / 100) if up else F.floor(rest * share / 100))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding. Each anchor's best `positives` rows of its own label each open a window, from `low` to `high`
    per cent of their score; the best `negatives` rows of other labels in it are returned.
    """
    used = shared.store(packed(rows), "used")
    entries = shared.store(projected(entries_of(used, max(positives + 1, negatives))), "entries")
    size = entries.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    trees = max(1, min(MOST_TREES, -(-size.n // TREE_ROWS)))
    ranged = entries.repartitionByRange(trees, "dims", "lead", F.xxhash64("vector", "label"))
    built = shared.store(ranged.mapInArrow(build, LEAVES), "trees")
    leaves, balls = built.where("leaf >= 0"), built.where("leaf < 0").select("tree", "dims", "centre", "radius", "labels", "counts").collect()
    few = max(1, min(SEEDS, SEED_BYTES // (4 * (size.dims or 1))))
    first = entries.select("label", "vector", "ids").orderBy(F.xxhash64("vector", "label"), "vector", "label").limit(few)
    sample = [(r.label, bytes(r.vector), list(r.ids)) for r in first.collect()]

    asked = used.where(is_anchor).select(F.col("vec_id").alias("anchor"), "label", "vector", "dims")
    ends = asked.withColumn("lows", F.array(F.lit(LOWEST))).withColumn("highs", F.array(F.lit(-LOWEST)))
    best, made = searched(ends, leaves, balls, sample, True, positives)
    best = shared.store(best, "positives")
    for table in made:
        shared.drop(table)

    opened = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("held"))
    part = lambda share, up: F.transform("held", lambda x: _part(x["score"], share, up).cast("long"))
    windows = asked.join(opened, "anchor").select(*asked.columns, part(low, True).alias("lows"), part(high, False).alias("highs"), "held")
    windows = shared.store(windows, "windows")
    wide = windows.drop("held")
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("long"), F.lit(positives) - F.size(c)))
    wide = wide.withColumn("lows", pad("lows", 1)).withColumn("highs", pad("highs", 0))  # an empty window for each that is missing
    found, _ = searched(wide, leaves, balls, sample, False, negatives)
    named = windows.select(F.col("anchor").alias("anchor_id"), F.posexplode("held").alias("at", "x")).select("anchor_id", "at", F.col("x.vec_id").alias("positive_id"), F.col("x.score").alias("positive_score"))
    out = found.join(named, (found["anchor"] == named["anchor_id"]) & (found["place"] == named["at"]))
    return out.select("anchor_id", "positive_id", F.col("n").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
