"""Exact token ids through the tokenizers library, with a store of chunks already encoded.

A text is cut at white space and where runs of letters end into chunks that the tokenizer treats independently; a Python
worker encodes each distinct chunk once and keeps the chunks used of late. Texts for which that independence does not hold
(special strings, unusual white space) are encoded whole. Texts of ASCII and Latin-1 letters are cut and looked up a column
at a time: a chunk of up to 16 bytes is its own key, two integers, in a table of arrays.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import shared

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]++"
_RUN = _LETTERS + r"(?=[\x00-@\[-`{-\x7f]|\Z)"  # ends where a run of letters surely ends
_CHUNK = re.compile(rf"\s+(?!\S)| ?{_RUN}| ?\S+|\s", re.ASCII)
_BARE_CHUNK = re.compile(rf"{_RUN}|\S+", re.ASCII)
_WORD = re.compile(" ?" + _LETTERS)
_MOST = 200_000  # chunks in a generation of those that are not in the table; a worker keeps two
_KEEP = 64  # letters of a chunk that is kept
_RARE = "[^\x01-\x7fÀ-ÖØ-öø-ÿ]"  # texts that hold such a letter are not encoded by columns
_SLOTS = 1 << 20  # of the table of short chunks, which is renewed when it is three quarters full
_WINDOW = 1 << 17  # chunks that are looked up together

# The steps of the normalizer and of the cutter that kind "word" stands for.
_WORD_STEPS = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
_WORD_CUTS = [
    ("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True, None, None),
    ("ByteLevel", None, None, None, False, False),
]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True  # in a text without _RARE, bytes from 128 on are of letters
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_letters() -> dict[int, str]:
    """How byte-level alphabets write the bytes that are not printable letters: from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_letters()


class _Chunks(dict):
    """Encodes a chunk the first time that it is asked for, unless the generation before knows it."""

    def __init__(self, make, before: dict | None = None):
        super().__init__()
        self.make, self.before = make, before or {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.before.get(chunk)
        if got is None:
            got = self.make(chunk)
        if len(chunk) <= _KEEP:
            self[chunk] = got
        return got


class _Table:
    """Ids of short chunks by open addressing: two key words, and the place and number of the ids in a pool."""

    def __init__(self, dtype: np.dtype):
        self.keys = np.zeros((_SLOTS, 2), np.uint64)
        self.at = np.zeros(_SLOTS, np.uint32)
        self.number = np.zeros(_SLOTS, np.uint8)
        self.seen = np.zeros(_SLOTS, bool)  # found since the table was made
        self.pool = np.zeros(1 << 16, dtype)
        self.used = self.held = 0

    @staticmethod
    def _home(keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] ^ keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(65 - _SLOTS.bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1. No key has a first word of 0."""
        slot, out, left = self._home(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(left):
            there = self.keys[slot[left]]
            same = (there == keys[left]).all(axis=1)
            out[left[same]] = slot[left[same]]
            left = left[~same & (there[:, 0] != 0)]
            slot[left] = (slot[left] + 1) % _SLOTS
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, number: np.ndarray) -> None:
        """New keys, all different, and their ids end to end."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left], 0] == 0]
            self.keys[slot[free]] = keys[free]  # of several keys for one slot one stays, the others go on
            left = left[(self.keys[slot[left]] != keys[left]).any(axis=1)]
            slot[left] = (slot[left] + 1) % _SLOTS
        self.at[slot], self.number[slot] = self.used + np.cumsum(number) - number, number
        self.used += len(ids)
        self.held += len(keys)

    def renewed(self) -> _Table:
        """A table of the chunks that were found again, if they are less than half."""
        out, kept = _Table(self.pool.dtype), np.flatnonzero(self.seen)
        if len(kept) < self.held // 2:
            number = self.number[kept].astype(np.int64)
            before = np.cumsum(number) - number
            ids = self.pool[np.repeat(self.at[kept] - before, number) + np.arange(int(number.sum()))]
            out.add(self.keys[kept], ids, number)
        return out


class Encoder:
    """encode(text) gives the ids as little-endian bytes of width .width."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.kind = self._kind(spec)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.odd = re.compile("|".join([_ODD_SPACE, *special]))
        self.rare = "|".join([_RARE, "[\x1c-\x1f]", *special])
        self.table: _Table | None = None
        self.chunks = _Chunks(self._chunk)
        self.model = self.tokenizer.model
        self.code = "H" if self.width == 2 else "I"

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec["pre_tokenizer"] or {}, json.dumps(spec["normalizer"])
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm == "null":
            return "byte"
        steps = [(x.get("type"), x.get("pattern"), x.get("content")) for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [(x.get("type"), x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space")) for x in pre.get("pretokenizers", [])]
        return "word" if (steps, cuts) == (_WORD_STEPS, _WORD_CUTS) else "whole"

    def _raw(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        return self._raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        if not _WORD.fullmatch(chunk):
            return self.whole(chunk)
        if self.kind == "word":
            chunk = chunk.lower()
        letters = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTES)
        return self._raw([t.id for t in self.model.tokenize("Ġ" + letters[1:] if chunk[0] == " " else letters)])

    def clear(self) -> None:
        self.chunks, self.table = _Chunks(self._chunk), None

    def encode(self, text: str) -> bytes:
        if self.kind == "whole" or self.odd.search(text):
            return self.whole(text)
        if len(self.chunks) > _MOST:
            self.chunks.before = {}
            self.chunks = _Chunks(self._chunk, self.chunks)
        parts = (_BARE_CHUNK if self.kind == "word" else _CHUNK).findall(text)
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column, end to end, and where each row's begin (one more than rows). Null: no ids."""
        if self.kind == "whole":
            plain = np.zeros(len(column), bool)
        else:
            plain = ~pc.fill_null(pc.match_substring_regex(column, self.rare), False).to_numpy(zero_copy_only=False)
        ids, sizes = self._plain(pc.fill_null(column.filter(pa.array(plain)), ""))
        number = np.zeros(len(column), np.int64)
        number[plain] = sizes
        if not plain.all():
            rest = {int(i): np.frombuffer(self.encode(column[int(i)].as_py()), self.dtype) for i in np.flatnonzero(~plain)}
            number[list(rest)] = [len(x) for x in rest.values()]
            own, done, at = np.concatenate([[0], np.cumsum(sizes)]), 0, []
            for i, x in rest.items():
                before = int(plain[:i].sum())
                at += [ids[own[done] : own[before]], x]
                done = before
            ids = np.concatenate([*at, ids[own[done] :]])
        return ids, np.concatenate([[0], np.cumsum(number)])

    def encode_rows(self, column: pa.Array):
        """encode() of each row of a string column; null: nothing."""
        ids, at = self.encode_column(column)
        raw, at = ids.tobytes(), (at * self.width).tolist()
        for a, b in zip(at, at[1:], strict=False):
            yield raw[a:b]

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without rare letters, and how many each has."""
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = b"".join(column.cast(pa.large_binary()).to_pylist()) + bytes(16)
        raw = np.frombuffer(data, np.uint8)[: bounds[-1]]
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(column), np.int64)
        space, letter = _SPACE[raw], _LETTER[raw]
        cut = np.zeros(len(raw), bool)
        cut[1:] = letter[:-1] & ~letter[1:]  # a run of letters ends
        if self.kind == "word":
            cut[1:] |= space[1:] != space[:-1]
        else:
            cut[1:] |= space[1:] & ~space[:-1]
            shown = np.append(~space[1:], False)  # what follows in the same text is no space
            shown[bounds[1:][sizes > 0] - 1] = False
            cut[1:] |= space[1:] & space[:-1] & shown[1:]  # the last of several spaces
            cut[1:] |= ~space[1:] & space[:-1] & (raw[:-1] != 32)
        cut[bounds[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        if self.kind == "word":
            keep = ~space[starts]
            starts, ends = starts[keep], ends[keep]
        found, numbers = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for k in range(0, len(starts), _WINDOW):
            ids, n = self._window(data, starts[k : k + _WINDOW], ends[k : k + _WINDOW])
            found.append(ids)
            numbers.append(n)
        total = np.cumsum(np.concatenate(numbers))[np.searchsorted(starts, bounds)]
        return np.concatenate(found), np.diff(total)

    def _window(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, and how many each has."""
        if self.table is None:
            self.table = _Table(self.dtype)
        if self.table.held + _WINDOW > _SLOTS * 3 // 4:
            self.table = self.table.renewed()
        if len(self.chunks) > _MOST:
            self.chunks.before = {}
            self.chunks = _Chunks(self._chunk, self.chunks)
        table, size = self.table, ends - starts
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        head = np.minimum(size, 8)
        keys = np.stack([words[starts] & _MASK[head], words[starts + head] & _MASK[np.clip(size - 8, 0, 8)]], axis=1)
        short = size <= 16
        slot = np.full(len(starts), -1, np.int64)
        slot[short] = table.find(keys[short])
        table.seen[slot[slot >= 0]] = True
        new = np.flatnonzero(short & (slot < 0))
        if len(new):
            new = new[np.lexsort([keys[new, 1], keys[new, 0]])]
            differ = np.concatenate([[True], (keys[new][1:] != keys[new][:-1]).any(axis=1)])
            once = new[differ]
            raw = [self._chunk(data[s:e].decode()) for s, e in zip(starts[once].tolist(), ends[once].tolist(), strict=True)]
            table.add(keys[once], np.frombuffer(b"".join(raw), self.dtype), np.array([len(x) // self.width for x in raw]))
            slot[new] = table.find(keys[once])[np.cumsum(differ) - 1]
        at, number = table.at[slot].astype(np.int64), table.number[slot].astype(np.int64)
        pool, long = table.pool, np.flatnonzero(~short)
        if len(long):
            raw = [self.chunks[data[s:e].decode()] for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            number[long] = [len(x) // self.width for x in raw]
            at[long] = len(pool) + np.cumsum(number[long]) - number[long]
            pool = np.concatenate([pool, np.frombuffer(b"".join(raw), self.dtype)])
        before = np.cumsum(number) - number
        return pool[np.repeat(at - before, number) + np.arange(int(number.sum()))], number


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        shared.KEPT.append(_ENCODERS[path])
    return _ENCODERS[path]
