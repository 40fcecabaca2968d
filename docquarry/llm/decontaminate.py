"""Operator 8: documents that hold benchmark items, exact or edited.

A document holds an item of m words if a Smith-Waterman alignment (match 1, other word -1, gap -1) of the two scores at least
threshold x m. Such an alignment leaves at least h = ceil(threshold x m) - 1 of the item's word pairs whole (the runs of
matches are one more than the penalties at most), so one of them is among all but the h - 1 commonest pairs. These rare pairs
are the seeds: the pairs of all items are counted over the whole corpus first, then each seed that is met gives the passage in
which such an alignment through it must lie (it has at most (1 - threshold) x m words that are not the item's). Passages with
fewer than h of the item's pairs are left out, the others are aligned. So nothing that reaches the threshold is lost.

Items are the stated query set; they are taken in blocks of at most BLOCK items and about BLOCK_CHARS letters, of which a task holds
one at a time. Two passes over the texts serve all blocks, one that counts and one that finds: a task reads a few megabytes of
texts and takes the blocks in turn. Blocks are broadcast variables, which executors keep on disk where memory is short.

Defined cases: words are runs of letters and digits, without case. A null or empty text holds nothing; so does an item
without words. An item of one word is its own seed, one of two counts only whole. Rows that share doc_id and text give one result; rows without doc_id are
told apart by their text. Equal items are reported each. Extra columns are ignored. No rows or no items: no result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

THRESHOLD = 0.5
BLOCK, BLOCK_CHARS = 20_000, 8_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Items:
    """A block of items as word numbers, the numbers of their word pairs, and the seeds among these."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int32) for _, t in items]
        self.base = len(self.vocabulary) + 1
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.shortest = int(self.sizes[self.sizes > 0].min()) if self.sizes.any() else 0
        sizes = np.array([len(self._keys(w)) for w in self.words], np.int64)
        self.first = np.cumsum(sizes) - sizes  # of each item's pairs in self.gram
        self.keys, self.gram = np.unique(np.concatenate([np.zeros(0, np.int64), *map(self._keys, self.words)]), return_inverse=True)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.place = np.arange(len(self.gram)) - np.repeat(self.first, sizes)
        self.rarest(np.zeros(len(self.keys), np.int64))

    def _keys(self, words: np.ndarray) -> np.ndarray:
        """Its pairs as numbers; a single word is paired with nothing."""
        wide = words.astype(np.int64)
        return wide[:-1] * self.base + wide[1:] if len(words) != 1 else wide * self.base

    def least(self, item: int) -> int:
        """How many pairs an alignment that reaches the threshold leaves whole, at least."""
        return max(1, math.ceil(self.threshold * len(self.words[item]) - 1e-9) - 1)

    def rarest(self, counts: np.ndarray) -> None:
        """Take as seeds all but the h - 1 commonest pairs of each item, by the corpus counts of pairs."""
        order = np.lexsort((self.place, counts[self.gram], self.item))
        rank = np.zeros(len(order), np.int64)
        rank[order] = np.arange(len(order)) - self.first[self.item[order]]
        sizes = np.bincount(self.item, minlength=len(self.words))
        keep = sizes - np.array([self.least(k) - 1 for k in range(len(self.words))], np.int64)
        seeds = np.flatnonzero(rank < keep[self.item])
        seeds = seeds[np.argsort(self.gram[seeds], kind="stable")]
        self.seed_item, self.seed_place = self.item[seeds], self.place[seeds]
        self.seed_number = np.bincount(self.gram[seeds], minlength=len(self.keys))
        self.seed_first = np.cumsum(self.seed_number) - self.seed_number

    def _look_up(self, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(known & (self.keys[at] == keys), at, -1) if len(self.keys) else np.full(len(keys), -1)

    def grams(self, words: np.ndarray) -> np.ndarray:
        """The number of the pair that begins at each word of a document, -1 if no item has it."""
        wide = words.astype(np.int64)
        both = np.append(wide[:-1] * self.base + wide[1:], 0)
        return self._look_up(both, np.append((words[:-1] > 0) & (words[1:] > 0), False)) if len(words) else np.zeros(0, np.int64)

    def singles(self, words: np.ndarray) -> np.ndarray:
        """The same for items of one word."""
        return self._look_up(words.astype(np.int64) * self.base, words > 0)

    def passages(self, words: np.ndarray):
        """(item, start, end) of the stretches in which an alignment that reaches the threshold may lie."""
        grams = self.grams(words)
        for numbers in (grams, self.singles(words)) if self.shortest == 1 else (grams,):
            at = np.flatnonzero(numbers >= 0)
            at = at[self.seed_number[numbers[at]] > 0]
            if not len(at):
                continue
            many = self.seed_number[numbers[at]]
            seed = np.arange(many.sum()) + np.repeat(self.seed_first[numbers[at]] - np.cumsum(many) + many, many)
            item, begin = self.seed_item[seed], np.repeat(at, many) - self.seed_place[seed]
            sizes = self.sizes[item]
            pad = np.floor(sizes * (1 - self.threshold) + 1e-9).astype(np.int64)
            start, end = np.maximum(0, begin - pad), np.minimum(len(words), begin + sizes + pad)
            order = np.lexsort((start, item))
            item, start, end = item[order].tolist(), start[order].tolist(), end[order].tolist()
            k = 0
            while k < len(item):  # stretches that overlap are one
                i, s, e = item[k], start[k], end[k]
                while k < len(item) and item[k] == i and start[k] <= e:
                    e, k = max(e, end[k]), k + 1
                if self.sizes[i] == 1 or self._enough(grams[s:e], i):
                    yield i, s, e

    def _enough(self, grams: np.ndarray, item: int) -> bool:
        """Whether a passage has as many of the item's pairs as an alignment that reaches the threshold."""
        least = self.least(item)
        there = grams[grams >= 0]
        if len(there) < least:
            return False
        own = self.gram[self.first[item] : self.first[item] + self.sizes[item] - 1]
        return int(np.isin(there, own).sum()) >= least and int(np.isin(own, there).sum()) >= least


def align(item: np.ndarray, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(best score, first word, word after the last) of the local alignment of item with each text, all at once."""
    n, width = len(texts), max(len(t) for t in texts)
    grid = np.zeros((n, width), np.int32)
    for r, t in enumerate(texts):
        grid[r, : len(t)] = t
    steps = np.arange(width + 1, dtype=np.int32)
    score = np.zeros((n, width + 1), np.int32)
    begin = np.broadcast_to(steps, (n, width + 1)).copy()  # where the alignment that ends here began
    best = np.zeros(n, np.int32)
    span = np.zeros((n, 2), np.int32)
    rows = np.arange(n)
    for w in item.tolist():
        diagonal = score[:, :-1] + np.where(grid == w, 1, -1)
        up = score[:, 1:] - 1
        now = np.zeros((n, width + 1), np.int32)
        now[:, 1:] = np.maximum(np.maximum(diagonal, up), 0)
        start = np.broadcast_to(steps, (n, width + 1)).copy()
        start[:, 1:] = np.where(now[:, 1:] == 0, steps[1:], np.where(diagonal >= up, begin[:, :-1], begin[:, 1:]))
        lifted = now + steps  # gaps in the item: a running maximum
        reach = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == reach, steps, 0), axis=1)
        score = reach - steps
        begin = np.take_along_axis(start, source, axis=1)
        top = score.argmax(axis=1)
        better = score[rows, top] > best
        best = np.where(better, score[rows, top], best)
        span[better, 0], span[better, 1] = begin[rows, top][better], top[better]
    return [(int(b), int(s), int(e)) for b, (s, e) in zip(best, span, strict=True)]


def aligned(items: Items, rows: list[tuple[int, int, int, np.ndarray]]):
    """(document, item, score, first word, word after the last) of the passages (document, item, place, words) that reach the threshold."""
    by: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for doc, item, at, words in rows:
        by.setdefault(item, []).append((doc, at, words))
    for item, some in by.items():
        some.sort(key=lambda x: len(x[2]))
        k, m = 0, len(items.words[item])
        while k < len(some):
            n = max(1, min(256, (1 << 18) // len(some[min(k + 255, len(some) - 1)][2])))
            part = some[k : k + n]
            k += n
            for (doc, at, _), (score, first, end) in zip(part, align(items.words[item], [w for *_, w in part]), strict=True):
                if score >= items.threshold * m:
                    yield doc, item, score / m, at + first, at + end


FOUND = "doc_id long, mark long, item_id long, score double, first_word long, end_word long"


def _each(blocks: list):
    """The number and items of each block; of several only one is held."""
    for k, sent in enumerate(blocks):
        yield k, sent.value
        if len(blocks) > 1:
            del sent._value


def _counted(rows: DataFrame, blocks: list) -> DataFrame:
    """block, gram, n: how often each pair of a block's items occurs in the corpus."""

    def count(batches):
        shared.make_room()
        totals: dict[int, np.ndarray] = {}

        def given():
            for k, total in totals.items():
                there = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), k, np.int32)), pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["block", "gram", "n"])
            totals.clear()

        for batch in shared.pieces_of(batches):
            texts = batch.column("text").to_pylist()
            for k, items in _each(blocks):
                number, total = items.vocabulary.get, totals.setdefault(k, np.zeros(len(items.keys), np.int64))
                for text in texts:
                    grams = items.grams(np.array([number(w, 0) for w in words_of(text)], np.int32))
                    np.add.at(total, grams[grams >= 0], 1)
                if len(blocks) > 1:
                    yield from given()
        yield from given()

    return rows.select("text").mapInArrow(count, "block int, gram long, n long").groupBy("block", "gram").agg(F.sum("n").alias("n"))


def _found(rows: DataFrame, blocks: list) -> DataFrame:
    """FOUND of the passages that reach the threshold, by blocks whose seeds are chosen."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def find(batches):
        shared.make_room()
        for batch in shared.pieces_of(batches):
            texts = batch.column("text").to_pylist()
            for _, items in _each(blocks):
                number, passages = items.vocabulary.get, []
                for doc, text in enumerate(texts):
                    words = np.array([number(w, 0) for w in words_of(text)], np.int32)
                    passages += [(doc, item, s, words[s:e]) for item, s, e in items.passages(words)]
                got = list(aligned(items, passages))
                where = pa.array([d for d, *_ in got], pa.int64())
                cols = [[items.ids[i] for _, i, *_ in got], [x[2] for x in got], [x[3] for x in got], [x[4] for x in got]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("mark").take(where), *(pa.array(c, k) for c, k in zip(cols, kinds[2:], strict=True))], ["doc_id", "mark", "item_id", "score", "first_word", "end_word"])

    return rows.mapInArrow(find, FOUND)


def _blocks(benchmark: DataFrame, threshold: float) -> list:
    """The items in order, as broadcast blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    blocks, block, size = [], [], 0
    for r in items.toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text or "")
        if len(block) == BLOCK or size > BLOCK_CHARS:
            blocks.append(spark.sparkContext.broadcast(Items(block, threshold)))
            block, size = [], 0
    if block or not blocks:
        blocks.append(spark.sparkContext.broadcast(Items(block, threshold)))
    return blocks


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, mark (hash of the text), item_id, score, first_word, end_word: the best place of each item in a document."""
    spark = docs.sparkSession
    rows = shared.id_text(docs).withColumn("mark", F.xxhash64("text"))
    unsorted = _blocks(benchmark, threshold)
    counts = shared.store(_counted(rows, unsorted), "item-pairs")
    blocks = []
    for k, old in enumerate(unsorted):  # a block at a time is on the driver
        own, items = counts.where(F.col("block") == k).select("gram", "n").toArrow(), old.value
        number = np.zeros(len(items.keys), np.int64)
        number[own["gram"].to_numpy()] = own["n"].to_numpy()
        items.rarest(number)
        blocks.append(spark.sparkContext.broadcast(items))
        old.destroy()
    shared.drop(counts)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("a"), "end_word")).alias("best")
    return _found(rows, blocks).groupBy("doc_id", "mark", "item_id").agg(best).select(
        "doc_id", "mark", "item_id", "best.score", (-F.col("best.a")).alias("first_word"), F.col("best.end_word").alias("end_word")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("b_id"), F.col("mark").alias("b_mark")).distinct()
    bad = shared.store(bad, "contaminated")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("mark") == F.col("b_mark")), "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark")).drop("mark")
