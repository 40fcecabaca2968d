"""Vector index of a chunk table: cells around centroids, and small codes with error bounds.

Centroids are fitted by spherical k-means on a sample of at most SAMPLE vectors; every chunk with a direction is stored below the
folder of its nearest centroid's cell. The ledger keeps for each cell how many chunks it has and how far (by angle) the farthest is, so
by the triangle inequality no chunk of a cell is nearer to a query than the angle to the centroid less that radius. A cell of more than
CELL chunks is written by several tasks as several files.

Beside each vector stand its components as whole numbers of -127 to 127, their scale, its length and the length of what rounding
left. From these a search knows the distance to within a bound, in the JVM and without the vector; the vectors are read of
those chunks only that the bounds cannot exclude.

nearest() and similarity_search() are exact (`probes=None`): the cells that hold enough chunks give a distance that the last result cannot
exceed, then all cells that could hold something nearer are read. With `probes`, the nearest cells alone are read; fit_probes() finds how
many it takes for a wanted recall. Only the layout is approximate: distances are those of a scan, bit for bit.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..plans import storage
from ..plans.ledger import Folder, Generations
from . import batch as many
from . import retrieval

SAMPLE, ROUNDS, CELLS = 20_000, 8, 100
CELL = 1 << 17
LISTED = 1024  # ids that are named in a filter; more are joined
SLACK = 1e-9  # for the rounding of bounds
ENTRY = "id long, file_path string, embedding array<float>, codes array<tinyint>, scale double, error double, norm double, cell int"
ASSIGNED = "id long, file_path string, embedding array<float>, codes array<tinyint>, scale double, error double, norm double, near double, cell int"


def fit_cells(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; a cell that is left without a vector takes the one that fits worst."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(x))
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        near = x @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 1e-12, sums / np.where(lengths > 1e-12, lengths, 1), centres)
    return centres


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, lengths of what rounding leaves (a little more than that), and lengths of vectors."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return codes.astype(np.int8), scale, error, np.sqrt((x**2).sum(axis=1))


class VectorIndex:
    """The index in a folder. chunks: id, file_path, embedding. Chunks without a direction (no, empty or zero vector) are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.parts = Generations(spark, path)

    def centres(self) -> np.ndarray | None:
        folder = Folder(self.spark, f"{self.path}/_centres")
        return np.array(json.loads(folder.read("centres.json"))) if "centres.json" in folder.names() else None

    def fit(self, chunks: DataFrame, cells: int = CELLS) -> None:
        """Fit the centroids, once for an index."""
        rows = chunks.where(F.size("embedding") > 0).select("id", "embedding").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
        sizes = [len(r.embedding) for r in rows]
        dims = max(set(sizes), key=sizes.count, default=0)
        x = np.array([r.embedding for r in rows if len(r.embedding) == dims], np.float64).reshape(-1, dims)
        lengths = np.linalg.norm(x, axis=1)
        x = x[np.isfinite(lengths) & (lengths > 0)]
        if not len(x):
            raise ValueError("no vector to fit cells to")
        centres = fit_cells(x / np.linalg.norm(x, axis=1, keepdims=True), cells)
        Folder(self.spark, f"{self.path}/_centres").put_new("centres.json", json.dumps(centres.tolist()))

    def update(self, chunks: DataFrame, cells: int = CELLS) -> int:
        """Index the chunks from the first id that is not covered on; how many. The first call fits the cells."""
        new = chunks.where(F.col("id") >= self.parts.high())
        last = new.agg(F.max("id")).first()[0]
        if last is None:
            return 0
        if self.centres() is None:
            self.fit(new, cells)
        made = storage.store(self._assigned(new), "assigned")
        facts = made.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()  # a row for each cell
        size = {r.cell: (r.n, r.near) for r in facts}
        self.parts.add(self._dealt(made, size), last + 1, "cell", cells=size)
        storage.drop(made)
        return sum(n for n, _ in size.values())

    def _dealt(self, rows: DataFrame, size: dict[int, tuple[int, float]]) -> DataFrame:
        """Entries by cell and id, a large cell's in several tasks."""
        splits = self.spark.createDataFrame([(c, -(-n // CELL)) for c, (n, _) in size.items()], "cell int, splits int")
        dealt = rows.join(F.broadcast(splits), "cell").withColumn("split", F.pmod(F.xxhash64("id"), "splits"))
        return dealt.repartition("cell", "split").sortWithinPartitions("cell", "id").select(*[c.split()[0] for c in ENTRY.split(", ")])

    def compact(self) -> None:
        """Bring what has been added at different times together, cell by cell."""
        rows = self.parts.read(ENTRY)
        if rows is not None and len(self.parts.entries()) > 1:
            size = {cell: (n, near) for cell, n, near in self.cells()}
            self.parts.add(self._dealt(rows, size), self.parts.high(), "cell", cells=size, replaces=True)

    def _assigned(self, chunks: DataFrame) -> DataFrame:
        centres = self.centres()

        def run(batches):
            for rows in batches:
                x, some = many._matrix(rows.column("embedding"), centres.shape[1])
                kept = np.flatnonzero((x != 0).any(axis=1))
                x, some = x[kept], some[kept]
                if not len(x):
                    continue
                codes, scale, error, norm = coded(x)
                near = (x / norm[:, None]) @ centres.T
                cell = near.argmax(axis=1)
                own = rows.take(pa.array(some))
                ends = pa.array(np.arange(0, codes.size + 1, codes.shape[1]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(codes.reshape(-1)))
                cols = [own.column("id"), own.column("file_path"), own.column("embedding"), lists, pa.array(scale), pa.array(error), pa.array(norm), pa.array(near[np.arange(len(x)), cell]), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in ASSIGNED.split(", ")])

        return chunks.select("id", "file_path", "embedding").mapInArrow(run, ASSIGNED)

    def cells(self) -> list[tuple[int, int, float]]:
        """Cell, chunks, least cosine to the centroid."""
        out: dict[int, tuple[int, float]] = {}
        for entry in self.parts.entries():
            for cell, (n, near) in entry["cells"].items():
                before = out.get(int(cell), (0, 1.0))
                out[int(cell)] = before[0] + n, min(before[1], near)
        return [(cell, n, near) for cell, (n, near) in sorted(out.items())]

    def _reach(self, query) -> list[tuple[float, float, int, int]]:
        """Distance of the centroid, least distance of a chunk in the cell, cell, chunks; nearest centroid first."""
        q = np.asarray(query, np.float64)
        length = np.linalg.norm(q)
        centres = self.centres()
        if centres is None or len(q) != centres.shape[1] or not np.isfinite(length) or length == 0:
            return []
        out = []
        for cell, n, near in self.cells():
            away = math.acos(max(-1.0, min(1.0, float(centres[cell] @ q) / length)))
            radius = math.acos(max(-1.0, min(1.0, near))) + 1e-6  # acos is steep near 1
            out.append((1 - math.cos(away), 1 - math.cos(max(0.0, away - radius)) - SLACK, cell, n))
        return sorted(out)

    def rows(self, cells: list[int]) -> DataFrame:
        """The entries of some cells: no other folder is read."""
        found = self.parts.read(ENTRY)
        return found.where(F.col("cell").isin(cells)) if found is not None else self.spark.createDataFrame([], ENTRY)

    @staticmethod
    def bounded(rows: DataFrame, query) -> DataFrame:
        """rows with low and high: bounds of the distance, from the codes alone."""
        length = float(np.linalg.norm(np.asarray(query, np.float64)))
        rough = vector.dot(F.col("codes").cast("array<double>"), vector.vector_literal(query)) * F.col("scale")
        span = F.lit(length) * F.col("norm")
        middle, reach = 1 - rough / span, F.lit(length) * F.col("error") / span + SLACK
        return rows.withColumn("low", middle - reach).withColumn("high", middle + reach)

    def _within(self, rows: DataFrame, query, most: int, by_file: bool) -> DataFrame:
        """id, file_path, distance of the entries among which the best `most` are."""
        bounds = self.bounded(rows, query).select("id", "file_path", "low", "high")
        kept = bounds if not by_file else bounds.groupBy("file_path").agg(F.min("high").alias("high"))
        last = kept.orderBy("high").limit(most).agg(F.count("*").alias("n"), F.max("high").alias("high")).first()
        near = bounds.where(F.col("low") <= (last.high if last.n == most else 3.0)).select("id")
        few = [r.id for r in near.limit(LISTED + 1).collect()]
        named = rows.where(F.col("id").isin(few)) if len(few) <= LISTED else rows.join(near, "id", "left_semi")
        return retrieval.with_distance(named, query).select("id", "file_path", "distance").where("distance is not null")

    def _found(self, query, most: int, probes: int | None, by_file: bool) -> DataFrame:
        reach = self._reach(query)
        if not reach or most <= 0:
            return self.spark.createDataFrame([], "id long, file_path string, distance double")
        if probes is not None:
            return self._within(self.rows([c for *_, c, _ in reach[:probes]]), query, most, by_file)
        first, held = [], 0
        for *_, cell, n in reach:
            first.append(cell)
            held += n
            if held >= 4 * most:
                break
        tops = self._within(self.rows(first), query, most, by_file)
        tops = tops.groupBy("file_path").agg(F.min("distance").alias("distance")) if by_file else tops
        last = tops.orderBy("distance").limit(most).agg(F.count("*").alias("n"), F.max("distance").alias("distance")).first()
        least = last.distance if last.n == most else 3.0
        return self._within(self.rows([c for _, low, c, _ in reach if low <= least]), query, most, by_file)

    def nearest(self, query, most: int = retrieval.VECTOR_LANE, probes: int | None = None) -> DataFrame:
        """id, distance, rk: what retrieval.vector_lane gives."""
        return retrieval.vector_lane(self._found(query, most, probes, False), most)

    def similarity_search(self, chunks: DataFrame, query, limit: int = 5, max_distance: float = retrieval.NO_LIMIT_DISTANCE, probes: int | None = None) -> DataFrame:
        """What retrieval.similarity_search gives: the nearest chunk of each file, contents joined for the winners alone."""
        found = self._found(query, retrieval.check_limit(limit), probes, True)
        best = retrieval.best_per_file(found, F.col("distance"), F.col("id")).where(F.col("distance") <= max_distance)
        return retrieval.with_contents(chunks, best.select("id", "distance").orderBy("distance", "id").limit(limit), limit)

    def fit_probes(self, target: float = 0.95, k: int = 20, queries: int = 64) -> int:
        """How many cells hold `target` of the k nearest of a sample of indexed chunks, searched exactly."""
        rows = self.parts.read(ENTRY)
        sample = rows.orderBy(F.xxhash64("id")).limit(queries).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
        asked = {r.query_id: r.vector for r in sample.collect()}
        own = self.spark.createDataFrame([(i, [float(v) for v in x]) for i, x in asked.items()], "query_id long, vector array<double>")
        lanes = many.vector_lanes(rows.select("id", "file_path", "embedding"), own, k + 1).where("id <> query_id")
        where = lanes.join(rows.select("id", "cell"), "id").select("query_id", "cell").collect()  # k rows for each sample query
        place = {i: {cell: p for p, (*_, cell, _) in enumerate(self._reach(x))} for i, x in asked.items()}
        ranks = sorted(place[r.query_id][r.cell] for r in where)
        return ranks[max(0, math.ceil(target * len(ranks)) - 1)] + 1 if ranks else 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact results (query_id, id) that are among those found."""
    total = exact.select("query_id", "id").distinct()
    n = total.count()
    return total.join(found.select("query_id", "id").distinct(), ["query_id", "id"]).count() / n if n else 1.0
