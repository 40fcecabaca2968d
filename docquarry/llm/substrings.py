"""Operator 6: remove byte strings that occur elsewhere, by a sampled suffix order.

A string is LENGTH bytes; it has one anchor: its leftmost LEAD-byte gram of least hash. Strings in a row that share an anchor
travel as one stretch of text, and equal strings have equal anchors, so only the suffixes that begin at anchors need to be
ordered. They are range-partitioned by their leading bytes with sampled splitters; a splitter never parts suffixes that agree
in 8 bytes, so suffixes on two sides of a boundary agree in less than the LEAD bytes that a match needs: across boundaries
there is nothing left to compare. In a bucket the suffixes are sorted by a multikey sort (a symbol of 8 bytes at a time, ties
alone going on), and so are the reversed texts before the anchors. Neighbours in the two orders give common lengths to the
right and to the left. The string that begins x bytes before an anchor occurs twice if another stretch of the same class of
LENGTH - x bytes to the right is of its class of x bytes to the left; classes are runs of the orders, cut where neighbours have
less in common. All comparisons are of the bytes themselves.

A lead that very many stretches share would be one group without bound. A match that begins x bytes before its anchor has the x
bytes to the left and LENGTH - x to the right in common; so for x from lo to hi all matches agree in lo bytes to the left and
LENGTH - hi to the right, and a group is dealt by these bytes: every stretch goes, trimmed to what the range can match, to the
two halves of the range (`halved`). Leads that a sample finds frequent are halved where they are cut; any other group is as soon as a
task meets more than GROUP stretches of it, and is compared in a further round of the same shuffle. A range of a single x is one
string, and is reported as it comes. So a task holds GROUP stretches of a group at most, and after eight halvings nothing is left.

Equal stretches of a slice of input are collapsed before the shuffle (of one place, at most two mentions are kept: more
say nothing new), so copies and frequent passages arrive about once a slice. A row is known by two hashes of its text, as
equal texts lose equal bytes.

Defined cases: null is an empty text; texts under LENGTH bytes lose nothing; equal rows lose all that is in a string.
Rows without doc_id are treated alike. Extra columns are ignored. No rows: no result.
"""

from __future__ import annotations

import bisect
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LENGTH, LEAD = 200, 16
PART = 1 << 23  # bytes of a text that are looked at together
SAMPLE_ROWS = 2000
GROUP = 4096  # stretches of a group that are compared together
RANGE = 1 << 26  # bytes of text to a range of leads, at most
LOW, HIGH = 0, LENGTH - LEAD  # how far before its anchor a string can begin
_PLACE = np.uint64((1 << 26) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
REF = np.dtype([("h", "<i8"), ("c", "<u4"), ("at", "<u4")])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial digest of the `size` bytes from every place on (the last size - 1 places are not valid)."""
    n = len(data)
    part, done, total = data.astype(np.uint64) + np.uint64(1), 0, np.zeros(n, np.uint64)
    width = 1
    while width <= size:  # digests of 1, 2, 4, ... bytes; those that make up size are joined
        if size & width:
            moved = np.zeros(n, np.uint64)
            if done < n:
                moved[: n - done] = part[done:]
            total = total * _power(width) + moved
            done += width
        longer = part * _power(width)
        if width < n:
            longer[: n - width] += part[width:]
        part, width = longer, width * 2
    return total


def least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of `size` values from every place on (valid where there are as many)."""
    width, out = 1, values
    while width * 2 <= size:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(data: bytes):
    """(start, end of the last string, anchor) of the runs of strings that share an anchor."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return np.zeros((0, 3), np.int64)
    raw = np.frombuffer(data, np.uint8)
    digest = rolling(raw, LEAD)[: len(data) - LEAD + 1]
    digest = (digest ^ digest >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    digest ^= digest >> np.uint64(32)
    marked = digest & ~_PLACE | np.arange(len(digest), dtype=np.uint64)
    anchor = (least(marked, LENGTH - LEAD + 1)[:n] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], n) - 1
    return np.stack([first, last + LENGTH, anchor[first]], axis=1)


def texts_of(batches):
    """(h, c, text as bytes) of each row."""
    for batch in batches:
        for h, c, text in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "text")), strict=True):
            yield h, c, (text or "").encode()


def found_in(raw: bytes):
    for base in range(0, max(1, len(raw) - LENGTH + 1), PART):
        data = raw[base : base + PART + LENGTH - 1]
        for s, e, a in stretches(data).tolist():
            yield base + s, data[s:e], data[a : a + LEAD], a - s


def lead_number(lead: bytes) -> int:
    """The first 8 bytes as a signed integer, in their order."""
    return int.from_bytes(lead[:8], "big") - (1 << 63)


#: lo, hi: the range of x that a row stands for; off: where the anchor is in the stretch.
STRETCH = "part int, lo int, hi int, off int, stretch binary, refs binary"


def halved(lo: int, hi: int, off: int, data: bytes):
    """(lo, hi, off, stretch, bytes cut off in front) of the halves of a range in which a stretch has a string."""
    middle = (lo + hi) // 2
    for a, b in ((lo, middle), (middle + 1, hi)):
        left, right = min(off, b), min(len(data) - off, LENGTH - a)
        if left + right >= LENGTH and a <= b:
            yield a, b, left, data[off - left : off + right], off - left


def key_of(lo: int, hi: int, off: int, data: bytes) -> bytes:
    """What all matches of the range have in common."""
    return data[off - lo : off + LENGTH - hi]


class Held:
    """Stretches of a slice of input, equal ones once with all their places (two mentions of one place say all)."""

    def __init__(self):
        self.rows: dict[tuple, dict] = {}

    def add(self, lo: int, hi: int, off: int, data: bytes, places) -> None:
        own = self.rows.setdefault((lo, hi, off, data), {})
        for place in places:
            own[place] = min(2, own.get(place, 0) + 1)

    def batches(self, part):
        rows = list(self.rows.items())
        for k in range(0, len(rows), 20_000):
            some = rows[k : k + 20_000]
            refs = [np.array([r for r, n in found.items() for _ in range(n)], REF).tobytes() for _, found in some]
            cols = [pa.array([part(*key) for key, _ in some], pa.int32()), *(pa.array([key[i] for key, _ in some], pa.int32()) for i in range(3))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([key[3] for key, _ in some], pa.binary()), pa.array(refs, pa.binary())], [c.split()[0] for c in STRETCH.split(", ")])


def cut_up(splitters: np.ndarray, hot: frozenset[int], parts: int):
    borders = splitters.tolist()

    def part(lo: int, hi: int, off: int, data: bytes) -> int:
        if (lo, hi) == (LOW, HIGH):
            return bisect.bisect_right(borders, lead_number(data[off : off + LEAD]))
        return zlib.crc32(key_of(lo, hi, off, data)) % parts

    def cut(batches):
        for piece in shared.pieces_of(batches):
            held = Held()
            for h, c, raw in texts_of([piece]):
                for at, data, lead, off in found_in(raw):
                    if hot and lead_number(lead) in hot:
                        for a, b, left, own, gone in halved(LOW, HIGH, off, data):
                            held.add(a, b, left, own, [(h, c, at + gone)])
                    else:
                        held.add(LOW, HIGH, off, data, [(h, c, at)])
            yield from held.batches(part)

    return cut


def symbols_of(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, step: int, most: int) -> np.ndarray:
    """Rows of 8-byte symbols that keep the order of bytes: up to `most` bytes from each place on, forwards or backwards."""
    along = np.arange(-(-most // 8) * 8)
    at = first[:, None] + step * along
    inside = along < sizes[:, None]
    raw = np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8)
    return raw.view(">u8").astype(np.uint64)


def multikey_order(symbols: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows by group, then symbol after symbol; of rows that are alike so far the shorter come first."""
    order = np.lexsort((sizes, symbols[:, 0], group))
    tied = (group[order][1:] == group[order][:-1]) & (symbols[order, 0][1:] == symbols[order, 0][:-1])
    for k in range(1, symbols.shape[1]):
        if not tied.any():
            break
        at = np.flatnonzero(np.append(False, tied) | np.append(tied, False))
        run = np.cumsum(np.append(True, ~tied))[at]
        rows = order[at]
        order[at] = rows[np.lexsort((sizes[rows], symbols[rows, k], run))]
        tied &= symbols[order[1:], k] == symbols[order[:-1], k]
    return order


def common_lengths(symbols: np.ndarray, sizes: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each row in the order shares with the one before it; -1 for the first of a group."""
    differ = symbols[order[1:]] ^ symbols[order[:-1]]
    column = (differ != 0).argmax(axis=1)
    word = differ[np.arange(len(differ)), column]
    byte = (word.astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
    shared_bytes = np.where(word == 0, 8 * symbols.shape[1], 8 * column + byte)
    shared_bytes = np.minimum(shared_bytes, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return np.append(-1, np.where(group[order[1:]] == group[order[:-1]], shared_bytes, -1))


def _most(lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The longest that each row shares with a neighbour."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lengths, np.append(lengths[1:], -1))
    return out


def repeated(data: np.ndarray, start: np.ndarray, size: np.ndarray, off: np.ndarray, group: np.ndarray, twice: np.ndarray):
    """(stretch, first, last) of the runs of strings that occur in another place; twice: stretches that have two places.

    A stretch is data[start : start + size] with its anchor at off; group: stretches that share their leading bytes.
    """
    to_right, low = np.minimum(size - off, LENGTH), off - (size - LENGTH)  # a string begins x bytes before its anchor, low <= x <= off
    sides = []
    for first, sizes, step, most in ((start + off, to_right, 1, LENGTH), (start + off - 1, off, -1, LENGTH - LEAD)):
        symbols = symbols_of(data, first, sizes, step, most)
        order = multikey_order(symbols, sizes, group)
        sides.append((symbols, sizes, order, _most(common_lengths(symbols, sizes, group, order), order)))
    a, b = np.maximum(low, LENGTH - sides[0][3]), np.minimum(off, sides[1][3])
    found = [(np.flatnonzero(twice), low[twice], off[twice])] if twice.any() else []
    some = np.flatnonzero(a <= b)
    if len(some):
        place = np.full(len(start), -1)
        place[some] = np.arange(len(some))
        kept = []
        for symbols, sizes, order, _ in sides:  # the orders of the stretches that can have a match
            own = place[order]
            own = own[own >= 0]
            kept.append((own, common_lengths(symbols[some], sizes[some], group[some], own)))
        (right, right_lengths), (left, left_lengths) = kept
        a, b = a[some], b[some]
        of_right, of_left = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        for x in range(int(a.min()), int(b.max()) + 1):
            member = np.flatnonzero((a <= x) & (x <= b))
            if len(member) < 2:
                continue
            of_right[right] = np.cumsum(right_lengths < LENGTH - x)
            of_left[left] = np.cumsum(left_lengths < x)
            key = of_right[member] * (len(some) + 1) + of_left[member]
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            hit = member[order[np.append(False, same) | np.append(same, False)]]
            found.append((some[hit], np.full(len(hit), x), np.full(len(hit), x)))
    if not found:
        return np.zeros((0, 3), np.int64)
    k, low_x, high_x = (np.concatenate(c) for c in zip(*found, strict=True))
    first, last = off[k] - high_x, off[k] - low_x
    order = np.lexsort((first, k))
    k, first, last = k[order], first[order], last[order]
    # runs of one stretch that touch or overlap are one
    reach = np.maximum.accumulate(k * (1 << 32) + last) - k * (1 << 32)
    fresh = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (first[1:] > reach[:-1] + 1)))
    return np.stack([k[fresh], first[fresh], reach[np.append(fresh[1:], len(k)) - 1]], axis=1)


SPANS = ["h", "c", "start", "end"]
#: What a round gives: spans, and stretches for the next round.
ROUND = "h long, c long, start long, end long, lo int, hi int, off int, stretch binary, refs binary"
_KINDS = dict(zip([c.split()[0] for c in ROUND.split(", ")], [*[pa.int64()] * 4, *[pa.int32()] * 3, pa.binary(), pa.binary()], strict=True))


def _row_batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in _KINDS.items()], list(_KINDS))


def _bytes_of(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column end to end, and where each row begins (and the last ends)."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), ends


def _mentions(rows: pa.RecordBatch, some: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """The spans from first to the end of the string at last of some rows, at all their places."""
    refs, ref_at = _bytes_of(rows.column("refs"))
    number = (np.diff(ref_at) // REF.itemsize)[some]
    each = np.repeat(ref_at[some] // REF.itemsize - np.cumsum(number) + number, number) + np.arange(number.sum())
    ref = refs[: ref_at[-1]].view(REF)[each]
    place = ref["at"].astype(np.int64)
    cols = (ref["h"], ref["c"].astype(np.int64), place + np.repeat(first, number), place + np.repeat(last, number) + LENGTH)
    return _row_batch({k: pa.array(np.ascontiguousarray(c)) for k, c in zip(SPANS, cols, strict=True)}, len(place))


def spans_in(rows: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch | None:
    """Spans of whole groups of stretches; group: the number of each row's group."""
    data, at = _bytes_of(rows.column("stretch"))
    start, size, off = at[:-1], np.diff(at), rows.column("off").to_numpy().astype(np.int64)
    count = np.diff(_bytes_of(rows.column("refs"))[1]) // REF.itemsize
    keep = np.flatnonzero((np.bincount(group)[group] > 1) | (count > 1))
    if not len(keep):
        return None
    found = repeated(data, start[keep], size[keep], off[keep], group[keep], count[keep] > 1)
    return _mentions(rows, keep[found[:, 0]], found[:, 1], found[:, 2]) if len(found) else None


def _groups(rows: pa.RecordBatch) -> np.ndarray:
    """The number of each row's group: rows with one range and one key are neighbours."""
    data, at = _bytes_of(rows.column("stretch"))
    lo, hi, off = (rows.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "off"))
    start, size = at[:-1] + off - lo, lo + LENGTH - hi
    fresh = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    for width in np.unique(size).tolist():
        some = np.flatnonzero(~fresh & (size == width))
        for at_once in np.array_split(some, max(1, len(some) * width >> 24)):
            own = start[at_once][:, None] + np.arange(width)
            before = start[at_once - 1][:, None] + np.arange(width)
            fresh[at_once] = (data[own] != data[before]).any(axis=1)
    return np.cumsum(fresh) - 1


def refined(rows: pa.RecordBatch):
    """Rows of a group that is too large: halved for the next round; those of a single string are spans."""
    held, whole = Held(), []
    columns = [rows.column(c).to_pylist() for c in ("lo", "hi", "off", "stretch", "refs")]
    for k, (lo, hi, off, data, refs) in enumerate(zip(*columns, strict=True)):
        if lo == hi:
            whole.append(k)
            continue
        places = np.frombuffer(refs, REF).tolist()
        for a, b, left, own, gone in halved(lo, hi, off, data):
            held.add(a, b, left, own, [(h, c, at + gone) for h, c, at in places])
    if whole:
        some = np.array(whole)
        yield _mentions(rows, some, np.zeros(len(some), np.int64), np.zeros(len(some), np.int64))
    for batch in held.batches(lambda *_: 0):
        yield _row_batch({c: batch.column(c) for c in ("lo", "hi", "off", "stretch", "refs")}, batch.num_rows)


def compare(batches):
    """ROUND of rows that come by range and key. The last group of a batch waits for the next, unless it is too large already."""
    shared.make_room()
    held: list[pa.RecordBatch] = []
    over = None  # a row of the group before, if that is too large
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([*([over] if over is not None else held), batch])
        group = _groups(rows)
        if over is not None:  # its first row has been dealt with
            rows, group, goes_on = rows.slice(1), group[1:], group[1] == 0
        else:
            goes_on = False
        group = group - group[0]
        sizes = np.bincount(group)
        large = sizes > GROUP
        large[0] |= goes_on
        last = group[-1]
        some = np.flatnonzero(large[group])
        for k in range(0, len(some), GROUP):
            yield from refined(rows.take(pa.array(some[k : k + GROUP])))
        done = np.flatnonzero(~large[group] & (group != last))
        if len(done):
            out = spans_in(rows.take(pa.array(done)), group[done])
            if out is not None:
                yield out
        if large[last]:
            over, held = rows.slice(rows.num_rows - 1), []
        else:
            over, held = None, [rows.slice(int(np.flatnonzero(group == last)[0]))]
    if held:
        out = spans_in(held[0], np.zeros(held[0].num_rows, np.int64))
        if out is not None:
            yield out


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the spans, and how many runs the spans form."""
    kept, at, runs, end = [], 0, 0, -1
    for s, e in sorted(spans):
        if s > end:
            runs += 1
            kept.append(raw[at:s])
        end = max(end, e)
        at = end
    kept.append(raw[at:])
    return b"".join(kept), runs


def splitters_of(rows: DataFrame, n: int, parts: int) -> tuple[np.ndarray, frozenset[int]]:
    """Borders of parts - 1 ranges of leading bytes, and the leads that are frequent, from a sample of about SAMPLE_ROWS of n rows.

    They decide only where a stretch goes. A lead is frequent that makes up a quarter of a range: there are 4 * parts at most.
    """

    def leads(batches):
        for piece in shared.pieces_of(batches):
            got = [lead_number(lead) for _, _, raw in texts_of([piece]) for _, _, lead, _ in found_in(raw)]
            kept = sorted(got)[:: max(1, len(got) // 4000)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], ["lead"])

    some = rows.sample(min(1.0, SAMPLE_ROWS / n), seed=11) if n else rows
    sample = np.sort(np.array([r.lead for r in some.mapInArrow(leads, "lead long").collect()], np.int64))
    if not len(sample):
        return np.zeros(0, np.int64), frozenset()
    names, number = np.unique(sample, return_counts=True)
    hot = names[number >= max(32, len(sample) / (4 * parts))]
    return np.unique(sample[np.linspace(0, len(sample) - 1, parts + 1).astype(int)[1:-1]]), frozenset(hot.tolist())


def repeated_spans(docs: DataFrame) -> DataFrame:
    """h, c (hashes of a text), spans: array of (start, end) in bytes, of the texts that hold a repeated string."""
    spark = docs.sparkSession
    rows = shared.id_text(docs).select("text", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c")).where(F.octet_length("text") >= LENGTH)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(shared.partitions(spark), (size.bytes or 0) // RANGE + 1)
    splitters, hot = splitters_of(rows, size.n, parts)
    moved = rows.mapInArrow(cut_up(splitters, hot, parts), STRETCH).repartitionById(parts, F.col("part"))
    key = F.expr(f"substring(stretch, off - lo + 1, lo + {LENGTH} - hi)").alias("key")  # made here, so that it is not moved
    names = ("lo", "hi", "off", "stretch", "refs")
    found = []
    while True:
        ordered = moved.select(key, *names).sortWithinPartitions("lo", "hi", "key").select(*names)
        found.append(shared.store(ordered.mapInArrow(compare, ROUND), "spans"))
        left = found[-1].where("stretch is not null")
        if left.isEmpty():  # each round halves the ranges: there are nine at most
            break
        moved = left.select(*names).repartition("lo", "hi", F.expr(f"substring(stretch, off - lo + 1, lo + {LENGTH} - hi)"))
    spans = reduce(DataFrame.unionByName, [f.where("h is not null").select(*SPANS) for f in found])
    # stored, so that the rows of one text that many documents have are a skewed partition that adaptive execution splits
    out = shared.store(spans.groupBy("h", "c").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "text-spans")
    for table in found:
        shared.drop(table)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left need not be UTF-8)."""

    def remove(batches):
        for piece in shared.pieces_of(batches):
            out = []
            for doc, text, spans in zip(*(piece.column(k).to_pylist() for k in ("doc_id", "text", "spans")), strict=True):
                raw = (text or "").encode()
                kept, runs = remove_spans(raw, [(s["start"], s["end"]) for s in spans or []])
                out.append((doc, len(raw), len(raw) - len(kept), runs, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    found = repeated_spans(docs)
    rows = shared.id_text(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"))
    joined = rows.join(found, ["h", "c"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


