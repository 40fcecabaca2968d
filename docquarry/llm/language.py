"""Operator 7: language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram binds its letters: the product of the first letter's vector
rotated twice, the second's rotated once and the third's. A document bundles (adds) its trigrams; a language's prototype
bundles the unit vectors of its training documents. The prediction is the prototype of the largest cosine.

Training adds integers (unit vectors scaled and rounded), so sums do not depend on the order of tasks. Each task sends one
vector for each language; the driver holds languages x DIMS numbers.

Defined cases: `und` with score 0 where the text is null or has no letter, or where nothing could be learned. Rows without
doc_id count as crc32 of the empty string. Rows without lang do not train. Ties go to the language first in order. Equal
rows get equal results. Extra columns are ignored. No rows: no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

DIMS = 512
SCALE = 1 << 20
LOSE, STEPS = 0.001, 1000

_letters: dict[int, np.ndarray] = {}
_is_letter: list[np.ndarray] = []


def letter_vector(code: int) -> np.ndarray:
    got = _letters.get(code)
    if got is None:
        got = _letters[code] = np.random.default_rng([20_011, code]).choice(np.array([-1, 1], np.int8), DIMS)
    return got


def letter_table() -> np.ndarray:
    if not _is_letter:
        _is_letter.append(np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)]))
    return _is_letter[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams as letter triples (0: no letter), the number of each occurrence, and where documents start in it.

    A trigram has a letter in its middle; what is not a letter counts as one blank.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
    letter = letter_table()[codes]
    codes = np.where(letter, codes, 0)
    used = np.zeros(0x110000, bool)
    used[codes] = True
    present = np.flatnonzero(used)
    number = np.zeros(0x110000, np.int64)
    number[present] = np.arange(len(present))
    small, n = number[codes], len(present)
    middle = np.flatnonzero(letter)
    gram = (small[middle - 1] * n + small[middle]) * n + small[middle + 1]
    if n**3 <= 1 << 24:
        seen = np.zeros(n**3, bool)
        seen[gram] = True
        kinds = np.flatnonzero(seen)
        place = np.zeros(n**3, np.int32)
        place[kinds] = np.arange(len(kinds))
        which = place[gram]
    else:
        kinds, which = np.unique(gram, return_inverse=True)
    triples = present[np.stack([kinds // (n * n), kinds // n % n, kinds % n], axis=1)]
    starts = np.searchsorted(middle, np.cumsum([1, *(len(t) + 1 for t in low)]))
    return triples, which, starts


def bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts (zero where there is no letter), and whether there is a letter."""
    triples, which, starts = trigrams(texts)
    out = np.zeros((len(texts), DIMS), np.float32)
    codes = np.unique(triples)
    table = np.stack([letter_vector(int(c)) for c in codes]) if len(codes) else np.zeros((0, DIMS), np.int8)
    a, b, c = (np.searchsorted(codes, triples[:, k]) for k in range(3))
    bound = (np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]).astype(np.float32) if len(triples) else None
    for i in range(len(texts)):
        own = which[starts[i] : starts[i + 1]]
        if len(own):
            kinds, counts = np.unique(own, return_counts=True)
            out[i] = counts.astype(np.float32) @ bound[kinds]
    norms = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
    return (out / np.maximum(norms, 1e-9)[:, None]).astype(np.float32), np.diff(starts) > 0


def learn(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes (unit rows) of the languages in training's columns text and lang."""

    def sums(batches):
        shared.make_room()
        total: dict[str, np.ndarray] = {}
        for batch in shared.pieces_of(batches, 2 << 20):
            langs = batch.column("lang").to_pylist()
            vectors, found = bundle(batch.column("text").to_pylist())
            whole = np.rint(vectors * SCALE).astype(np.int64)
            for lang in set(langs):
                rows = np.array([x == lang for x in langs]) & found
                if rows.any():
                    total[lang] = total.get(lang, 0) + whole[rows].sum(axis=0)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.tolist()], pa.list_(pa.int64()))], ["lang", "vector"])

    got = training.select("lang", "text").mapInArrow(sums, "lang string, vector array<long>")
    rows = got.select("lang", F.posexplode("vector").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    rows = rows.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("vector")).collect()
    langs = sorted(r.lang for r in rows)
    by = {r.lang: np.array(r.vector, np.float64) for r in rows}
    matrix = np.stack([by[x] / max(1.0, float(np.linalg.norm(by[x]))) for x in langs]) if langs else np.zeros((0, DIMS))
    return langs, matrix


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs with two more columns: lang_pred and score. docs must have a column text; a batch is read at a time."""

    def label(batches):
        shared.make_room()
        for batch in shared.pieces_of(batches, 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            vectors, found = bundle(texts)
            if langs:
                cosines = vectors.astype(np.float64) @ prototypes.T
                best, score = cosines.argmax(axis=1), np.clip(cosines.max(axis=1), 0.0, 1.0)
            else:
                best, score, found = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [langs[b] if f else "und" for b, f in zip(best, found, strict=True)]
            scores = np.where(found, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(label, T.StructType([*docs.schema.fields, *more]))


def held_out(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text, lang_pred, score, with prototypes learned from the rows that are not held out."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(docs).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, prototypes = learn(typed.where("not held_out and lang is not null and text is not null"))
    return predict(typed.select("doc_id", "held_out", "text"), langs, prototypes)


def least_score(typed: DataFrame, langs: list[str], prototypes: np.ndarray, lose: float) -> float:
    """The score, in steps of 1/STEPS, that at most `lose` of the held-out rows whose language is predicted right lie under."""
    rows = typed.where("held_out and lang is not null and text is not null").select("lang", "text")
    right = predict(rows, langs, prototypes).where(F.col("lang_pred") == F.col("lang"))
    counts = sorted((r.step, r.n) for r in right.groupBy(F.floor(F.col("score") * STEPS).cast("int").alias("step")).agg(F.count("*").alias("n")).collect())
    under, most = 0, lose * sum(n for _, n in counts)
    for step, n in counts:
        under += n
        if under > most:
            return step / STEPS
    return 0.0


def accepted(docs: DataFrame, lose: float = LOSE) -> DataFrame:
    """docs without those that have no letter, or are like no language.

    A document is like a language if its score is positive and not under least_score(): the threshold is learned from the
    held-out documents, of which it may refuse LOSE.
    """
    typed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), held_out(docs).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, prototypes = learn(typed.where("not held_out and lang is not null and text is not null"))
    least = least_score(typed, langs, prototypes, lose)
    return predict(typed.select("row", "text"), langs, prototypes).where((F.col("lang_pred") != "und") & (F.col("score") > 0) & (F.col("score") >= least)).select("row.*")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(shared.table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
