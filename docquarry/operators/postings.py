"""Inverted indexes of a chunk table: of lexemes for full-text search, of trigrams for substrings.

Postings are rows of (key, block): ids come in blocks of BLOCK, a row holds the places of its ids in the block (differences from
the block's start), how often the key occurs at each, and the most of these. So a key that all chunks hold is many rows of bounded
size. Rows are range-sorted by key and block below folders by a checksum of the key; a search reads the folders and row groups
of the keys it asks for. New chunks add rows; compact() brings rows of one key and block together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ledger import Generations

BITS = 12
BLOCK = 1 << BITS
BUCKETS = 64
POSTINGS = "key string, block long, n int, most int, places array<smallint>, hits array<int>, bucket int"
FIRST = 16  # blocks that are scored first
LISTED = 1024  # blocks or ids that are named in a filter; more are joined
ROUND = 200  # candidates that are looked at first


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f).getItem(0)


def counted(words: Column) -> Column:
    """key, hits of each distinct word of an array: its sorted runs."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 1)
        starts = F.filter(at, lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return _let(starts, lambda s: F.transform(s, lambda x, k: F.struct(F.get(w, x).alias("key"), (F.coalesce(F.get(s, k + 1), F.size(w)) - x).alias("hits"))))

    none = F.array().cast("array<struct<key:string,hits:int>>")
    return F.when(F.size(words) > 0, _let(F.sort_array(words), runs)).otherwise(none)


def blocks_of(rows: DataFrame) -> DataFrame:
    """POSTINGS of (key, id, hits), each id once for a key."""
    placed = rows.select("key", F.shiftright("id", BITS).alias("block"), F.struct(F.col("id").bitwiseAND(F.lit(BLOCK - 1).cast("long")).cast("smallint").alias("place"), F.col("hits").cast("int").alias("hits")).alias("x"))
    made = placed.groupBy("key", "block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    out = made.select("key", "block", F.size("x").alias("n"), F.array_max(F.col("x.hits")).alias("most"), F.col("x.place").alias("places"), F.col("x.hits").alias("hits"), F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"))
    return out.repartitionByRange("bucket", "key", "block").sortWithinPartitions("bucket", "key", "block")


class Postings:
    """The index in a folder; update() takes in what a table has beyond the ids covered."""

    def __init__(self, spark: SparkSession, path: str):
        self.parts = Generations(spark, path)
        self.spark = spark

    def keyed(self, chunks: DataFrame) -> DataFrame:
        """key, id, hits of chunks."""
        raise NotImplementedError

    def update(self, chunks: DataFrame) -> int:
        """Index the chunks with an id from the first that is not covered on; how many there were."""
        new = chunks.where(F.col("id") >= self.parts.high())
        found = new.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
        if found.n:
            self.parts.add(blocks_of(self.keyed(new)), found.last + 1, "bucket", chunks=found.n)
        return found.n

    def compact(self) -> None:
        rows = self.parts.read(POSTINGS)
        if rows is not None and len(self.parts.entries()) > 1:
            each = rows.select("key", "block", F.explode(F.arrays_zip("places", "hits")).alias("x"))
            each = each.select("key", (F.shiftleft("block", BITS) + F.col("x.places")).alias("id"), F.col("x.hits").alias("hits"))
            self.parts.add(blocks_of(each), self.parts.high(), "bucket", replaces=True)

    def of(self, keys: Iterable[str]) -> DataFrame:
        """The postings of some keys: no other folder or row group is read."""
        keys = sorted(set(keys))
        rows = self.parts.read(POSTINGS)
        if rows is None or not keys:
            return self.spark.createDataFrame([], POSTINGS)
        return rows.where(F.col("bucket").isin(sorted({_bucket(k) for k in keys})) & F.col("key").isin(keys))

    @staticmethod
    def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """rows of the blocks: named in the scan's filter if they are few, else joined."""
        few = [r.block for r in blocks.select("block").limit(LISTED + 1).collect()]
        return rows.where(F.col("block").isin(few)) if len(few) <= LISTED else rows.join(blocks.select("block"), "block", "left_semi")


class TextIndex(Postings):
    """Lexemes. chunks: id and lexemes (words may repeat)."""

    def keyed(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("id", F.explode(counted(F.col("lexemes"))).alias("x")).select("x.key", "id", "x.hits")

    @staticmethod
    def _scored(rows: DataFrame) -> DataFrame:
        each = rows.select("block", F.explode(F.arrays_zip("places", "hits")).alias("x"))
        return each.groupBy((F.shiftleft("block", BITS) + F.col("x.places")).alias("id")).agg(F.sum("x.hits").cast("int").alias("hits"))

    def bounds(self, terms: list[str]) -> DataFrame:
        """block, bound: no chunk of the block has more hits."""
        most = self.of(terms).groupBy("block", "key").agg(F.max("most").alias("most"))
        return most.groupBy("block").agg(F.sum("most").alias("bound"))

    def lane(self, terms: list[str], most: int = 100) -> DataFrame:
        """id, hits, rk: the chunks with most hits, ties to the smaller id; what retrieval.text_lane gives without a scan of chunks.

        The FIRST blocks by their bound are scored; blocks whose bound is below the hits of the last of them that would be
        returned are not read.
        """
        rows, bounds = self.of(terms), self.bounds(terms)
        first = [r.block for r in bounds.orderBy(F.col("bound").desc(), "block").limit(FIRST + 1).collect()]
        if len(first) > FIRST:
            tops = self._scored(rows.where(F.col("block").isin(first[:FIRST]))).orderBy(F.col("hits").desc(), "id").limit(most)
            least = tops.agg(F.count("*").alias("n"), F.min("hits").alias("hits")).first()
            if least.n == most:
                rows = self._in_blocks(rows, bounds.where(F.col("bound") >= least.hits))
        ranked = self._scored(rows).withColumn("rk", F.row_number().over(Window.orderBy(F.col("hits").desc(), "id")))
        return ranked.where(F.col("rk") <= most)


class TrigramIndex(Postings):
    """Trigrams of the lower-cased contents. chunks: id and content."""

    def keyed(self, chunks: DataFrame) -> DataFrame:
        held = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("(?s)(?=(...))"), 1))
        return chunks.select("id", F.explode(held).alias("key"), F.lit(1).alias("hits"))

    @staticmethod
    def trigrams(term: str) -> list[str]:
        """What a text needs to match the term, in which _ and % stand for other letters."""
        term = term.lower()
        return sorted({t for i in range(len(term) - 2) if not set(t := term[i : i + 3]) & set("_%\\")})

    def candidates(self, term: str) -> DataFrame | None:
        """id of the chunks that hold all trigrams of the term; None if it has none. Lists are intersected block by block."""
        keys = self.trigrams(term)
        if not keys:
            return None
        lists = self.of(keys).groupBy("block", "key").agg(F.flatten(F.collect_list("places")).alias("places"))
        blocks = lists.groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(keys))
        both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
        return blocks.select("block", F.explode(both).alias("place")).select((F.shiftleft("block", BITS) + F.col("place")).alias("id"))

    def lane(self, chunks: DataFrame, term: str, most: int = 50) -> DataFrame:
        """id, rk: the lowest ids of chunks that hold the term (as ILIKE has it); retrieval.literal_lane without a scan of chunks.

        Candidates are verified in order of their ids, ROUND at first and four times as many each time, until enough hold.
        """
        held = lambda rows: rows.where(F.col("content").ilike(f"%{term}%")).select("id")
        found = self.candidates(term)
        if found is None:
            rows = held(chunks)
        else:
            rows, after, size = held(chunks.join(found, "id", "left_semi")), -1, ROUND
            good: list[int] = []
            while size <= LISTED * 4:
                some = [r.id for r in found.where(F.col("id") > after).orderBy("id").limit(size).collect()]
                good += sorted(r.id for r in held(chunks.where(F.col("id").isin(some))).collect()) if some else []
                if len(good) >= most or len(some) < size:
                    rows = self.spark.createDataFrame([(i,) for i in good[:most]], "id long")
                    break
                after, size = some[-1], size * 4
        return rows.orderBy("id").limit(most).withColumn("rk", F.lit(1))
