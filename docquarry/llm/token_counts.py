"""Operator 3: exact token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch are held as one flat array of symbols with an owner for each. In every round each
pre-token applies its lowest-rank pair (leftmost on ties), all pre-tokens at once, until none can merge; the symbols that
survive are counted. Pre-tokens are cut where no piece of the vocabulary could span, so no merge crosses a cut. Pre-tokens
of over LONG symbols, for which a round per merge is slow, merge through a heap in the same order.

Defined cases: null is an empty text with 0 tokens and 0 bytes; special strings in a text are ordinary text, as is the
library's default. Equal rows give equal counts. Extra columns are ignored. No rows: no result.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import shared

LONG = 48
_MOST = 2_000_000
_NONE = np.int32(2**31 - 1)


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if sp.encode("ﬁ  x", out_type=str) != ["▁" + "ﬁ", "▁", "▁x"] and "".join(sp.encode("ﬁ  x", out_type=str)) != "▁ﬁ▁▁x":
            raise ValueError("only models that keep white space and do not normalise are supported")
        if not any(sp.is_byte(i) for i in range(n)):
            raise ValueError("only models with byte fallback are supported")
        known = [sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        score = [sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        order = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
        number = {p: k for k, p in enumerate(known)}
        for p in known:  # letters that are only parts of pieces are symbols too
            for c in p:
                number.setdefault(c, len(number))
        self.size, vocabulary = len(number), len(known)
        pairs = {}
        for p, s in zip(known, score, strict=True):
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (order[s], number[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs
        # a letter that is not a piece falls back to its bytes: negative symbols tell how many
        self.letter = np.full(0x110000, -4, np.int32)
        self.letter[:0x10000], self.letter[:0x800], self.letter[:0x80] = -3, -2, -1
        self.cost = np.ones(self.size, np.int64)
        for p, k in number.items():
            if len(p) == 1:
                self.letter[ord(p)] = k
            if k >= vocabulary:
                self.cost[k] = len(p.encode())
        self.spans = {p[k : k + 2] for p in known for k in range(len(p) - 1)}
        newline = any("\n" in p for p in known)
        space = any(re.search("[^▁]▁", p) for p in known)
        if newline or space:
            self.cut = re.compile("(?s).+")
        else:
            self.cut = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
        self.counts: dict[str, int] = {}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE: no such pair) and what it becomes."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def _cost(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < 0, -symbols.astype(np.int64), self.cost[np.maximum(symbols, 0)])

    def _batch(self, words: list[str]) -> np.ndarray:
        """Counts of non-empty pre-tokens of at most LONG letters."""
        total = np.zeros(len(words), np.int64)
        symbols = self.letter[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        while len(symbols):
            ranks = np.full(len(symbols), _NONE, np.int32)
            into = np.zeros(len(symbols), np.int32)
            inside = owner[:-1] == owner[1:]
            ranks[:-1], into[:-1] = self._look(symbols[:-1], symbols[1:])
            ranks[:-1][~inside] = _NONE
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(owner)))
            best = np.repeat(np.minimum.reduceat(ranks, first), sizes)
            over = best == _NONE
            if over.any():  # those pre-tokens are final
                np.add.at(total, owner[over], self._cost(symbols[over]))
            hits = np.flatnonzero((ranks == best) & ~over)
            if not len(hits):
                break
            hits = hits[np.concatenate([[True], owner[hits][1:] != owner[hits][:-1]])]
            symbols = symbols.copy()
            symbols[hits] = into[hits]
            keep = ~over
            keep[hits + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return total

    def _long(self, word: str) -> int:
        symbols = self.letter[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def push(i):
            j = after[i]
            if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
                found = self.pairs.get(symbols[i] * self.size + symbols[j])
                if found:
                    heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        gone = bytearray(n)
        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if gone[i] or symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], gone[j] = c, 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        left = np.array([s for s, g in zip(symbols, gone, strict=True) if not g], np.int32)
        return int(self._cost(left).sum())

    def _parts(self, word: str) -> list[str]:
        """A long pre-token cut between letters that no piece holds side by side."""
        cuts = [0, *(i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.spans), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words) -> None:
        if len(self.counts) + len(words) > _MOST:
            self.counts.clear()
        short = [w for w in words if len(w) <= LONG]
        for k in range(0, len(short), 50_000):
            some = short[k : k + 50_000]
            self.counts.update(zip(some, self._batch(some).tolist(), strict=True))
        for w in words:
            if len(w) > LONG:
                parts = self._parts(w)
                small = [p for p in parts if len(p) <= LONG]
                got = int(self._batch(small).sum()) if small else 0
                self.counts[w] = got + sum(self._long(p) for p in parts if len(p) > LONG)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.cut.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        new = {w for words in cut for w in words}.difference(self.counts)
        if new:
            if len(self.counts) + len(new) > _MOST:
                new = {w for words in cut for w in words}
            self.learn(sorted(new))
        counts = self.counts
        return [sum([counts[w] for w in words]) for words in cut]


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. One pass over the texts, without a shuffle."""

    def count(batches):
        own = counter(model)
        for batch in shared.pieces_of(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = np.array(own.count(texts), np.int64)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return shared.id_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(shared.table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"))
