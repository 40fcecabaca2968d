"""Operator 6 where very many stretches share their leading bytes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.llm import substrings as S


@pytest.fixture(scope="module")
def gram():
    """Of many grams the one of least hash: the anchor of nearly all strings that hold it."""
    rng = random.Random(3)
    made = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(300_000))
    digest = S.rolling(np.frombuffer(made, np.uint8), S.LEAD)[: len(made) - S.LEAD]
    digest = (digest ^ digest >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    at = int((digest ^ digest >> np.uint64(32)).argmin())
    return made[at : at + S.LEAD].decode()


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def texts_around(gram, count, seed):
    """Texts with the gram in them: all different, with a common left or right side, with a common passage, and copies."""
    rng = random.Random(seed)
    left, right, passage = letters(rng, 190), letters(rng, 190), letters(rng, 70) + gram + letters(rng, 90)
    out = []
    for k in range(count):
        kind = k % 6
        if kind < 2:
            out.append(letters(rng, 190) + gram + letters(rng, 190))
        elif kind == 2:
            out.append(letters(rng, 10) + left + gram + letters(rng, 190))
        elif kind == 3:
            out.append(letters(rng, 190) + gram + right + letters(rng, 10))
        elif kind == 4:
            out.append(letters(rng, 150) + passage + letters(rng, 150))
        else:
            x = rng.randrange(20, 170)
            out.append(letters(rng, 40) + left[-x:] + gram + right[: 184 - x + rng.randrange(0, 3)] + letters(rng, 40))
    out += [out[0], out[4][:300], "x" + out[1][100:310]]
    return out


def brute(texts):
    """For each text the places that a string found twice covers."""
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - S.LENGTH + 1):
            seen.setdefault(t[i : i + S.LENGTH], []).append((d, i))
    out = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d].update(range(i, i + S.LENGTH))
    return out


def in_rounds(texts, hot, rows_in_batch):
    """All rounds in one process; also the largest number of rounds' rows."""
    source = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["h", "c", "text"])
    rows = [r for b in S.cut_up(np.zeros(0, np.int64), frozenset(hot), 4)([source]) for r in b.to_pylist()]
    names, covered, rounds = ("lo", "hi", "off", "stretch", "refs"), [set() for _ in texts], []
    schema = pa.schema([(n, S._KINDS[n]) for n in names])
    while rows:
        rounds.append(len(rows))
        rows.sort(key=lambda r: (r["lo"], r["hi"], S.key_of(r["lo"], r["hi"], r["off"], r["stretch"])))
        batches = [pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows[i : i + rows_in_batch]], schema) for i in range(0, len(rows), rows_in_batch)]
        rows = []
        for out in S.compare(batches):
            for r in out.to_pylist():
                if r["stretch"] is None:
                    covered[r["h"]].update(range(r["start"], r["end"]))
                else:
                    rows.append(r)
    return covered, rounds


@pytest.mark.parametrize(("group", "rows_in_batch"), [(1, 7), (4, 5), (16, 1000), (4096, 10_000)])
def test_rounds_equal_brute_force(gram, monkeypatch, group, rows_in_batch):
    monkeypatch.setattr(S, "GROUP", group)
    texts = texts_around(gram, 90, 1)
    want = brute(texts)
    assert any(want) and not all(want)
    for hot in ([], [S.lead_number(gram.encode())]):
        got, rounds = in_rounds(texts, hot, rows_in_batch)
        assert got == want
        assert len(rounds) <= 9 and (len(rounds) > 1) == (group < 4096)


def test_halves_lose_no_string(gram):
    """Every x of a stretch is in one half, at the same bytes."""
    rng = random.Random(4)
    for _ in range(50):
        off, after = rng.randrange(0, 185), rng.randrange(16, 201)
        data = letters(rng, off).encode() + gram.encode() + letters(rng, after - 16).encode()
        if len(data) < S.LENGTH:
            continue
        work, single = [(S.LOW, S.HIGH, off, data, 0)], {}
        while work:
            lo, hi, o, d, gone = work.pop()
            if lo == hi:
                single[lo] = (d, gone)
            else:
                work += [(a, b, left, own, gone + g) for a, b, left, own, g in S.halved(lo, hi, o, d)]
        want = {x: (data[off - x : off - x + S.LENGTH], off - x) for x in range(off - (len(data) - S.LENGTH), off + 1)}
        assert single == want


def test_very_many_stretches_of_one_lead(spark, gram):
    """Far more than GROUP, all different but for a few: found in rounds, nothing else is."""
    n = 6 * S.GROUP
    part = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 512)
    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), F.concat(part("a"), F.substring(part("b"), 1, 60), F.lit(gram), part("c"), F.substring(part("d"), 1, 60)).alias("text"))
    twice = rows.where("doc_id < 5").select((F.col("doc_id") + n).alias("doc_id"), F.concat(F.lit("x"), F.substring("text", 60, 250)).alias("text"))
    got = S.remove_repeats(rows.union(twice)).where("n_removed > 0").select("doc_id", "n_removed", "n_spans").collect()
    assert sorted(tuple(r) for r in got) == [(k, 250, 1) for k in [*range(5), *range(n, n + 5)]]
