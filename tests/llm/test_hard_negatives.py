import math

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import hard_negatives as H
from tests.oracle import compare

SCHEMA = "vec_id long, label int, embedding array<float>, ids string, tree string, lead string"


def brute(rows, is_anchor, positives=5, negatives=10):
    """By comparing each anchor with all rows, in Python's own whole numbers."""
    used = {}
    for vec_id, label, x in rows:
        if vec_id is None or label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        whole = tuple(math.floor(256 * v) for v in x)
        if sum(v * v for v in whole) >= H.SQUARE:
            continue
        key = (label, np.array(whole, "<i4").tobytes(), whole)
        if vec_id not in used or key[:2] < used[vec_id][:2]:
            used[vec_id] = key
    out = []
    for a, (label, _, q) in used.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(map(lambda u, v: u * v, q, x)), i, own) for i, (own, _, x) in used.items() if i != a and len(x) == len(q))
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            found = [(i, -m) for m, i, own in scored if own != label and 30 * -minus <= 100 * -m <= 90 * -minus][:negatives]
            out += [(a, p, k, i, -minus, s) for k, (i, s) in enumerate(found, 1)]
    return sorted(out)


def got(spark, rows, parts=3, **sizes):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in H.mine(table, F.col("vec_id") % 10 == 0, **sizes).collect())


def made(count, dims=8, seed=3, labels=4, clusters=None):
    rng = np.random.default_rng(seed)
    if clusters:
        centres = rng.normal(size=(clusters, dims))
        x = centres[rng.integers(clusters, size=count)] + 0.1 * rng.normal(size=(count, dims))
    else:
        x = rng.normal(size=(count, dims))
    return [(k, int(rng.integers(labels)), [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]


def test_equals_brute_force_over_many_trees(spark, monkeypatch):
    monkeypatch.setattr(H, "TREE_ROWS", 90)
    monkeypatch.setattr(H, "SEEDS", 50)
    for rows in (made(700), made(900, clusters=12, seed=5)):
        want = brute(rows, lambda i: i % 10 == 0)
        assert want and got(spark, rows) == want
    assert got(spark, rows, positives=2, negatives=3) == brute(rows, lambda i: i % 10 == 0, 2, 3)


def test_a_vector_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "TREE_ROWS", 64)
    monkeypatch.setattr(H, "VISITS", 7)  # trees are met by several slices of anchors
    rows = [(k, k % 3, [1.0, 0.5] if k % 2 else x) for k, _, x in made(600, dims=2)]
    assert got(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(60, dims=3, labels=2) + [
        (100, None, [1.0, 2.0, 3.0]), (110, 1, None), (120, 1, []), (130, 1, [1.0, None, 2.0]), (140, 0, [nan, 1.0, 1.0]), (150, 0, [inf, 1.0, 1.0]),
        (None, 1, [1.0, 1.0, 1.0]), (160, 1, [0.0, 0.0, 0.0]), (170, 1, [1e30, 0.0, 0.0]), (180, 0, [1.0, 2.0]), (190, 0, [1.0, 1.5]), (191, 1, [0.5, 1.0]),
        (200, 1, [3e6, 3e6, 1.0]), (201, 0, [1e6, 1e6, 0.5]), (202, 1, [2e6, 2e6, 0.5]), (210, 9, [1.0, 1.0, 1.0]),
        (220, 1, [1.0, 0.0, 0.5]), (220, 0, [1.0, 0.0, 0.25]), (30, 0, [0.5, 0.5, 0.5]),
    ]
    rows += [rows[10], rows[10]]
    assert got(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert got(spark, []) == []
    assert got(spark, [(10, 1, [1.0, 2.0])]) == []
    assert got(spark, [(10, 1, [-1.0]), (11, 1, [1.0]), (12, 0, [-0.5])]) == []  # a negative positive opens no window


def test_bounds_hold_and_prune():
    """Every score lies within the bounds of its leaf's ball, and with clusters most leaves are left out."""
    rows = [(label, np.floor(256 * np.array(x)).astype("<i4").tobytes(), [k]) for k, label, x in made(4000, clusters=40, seed=8)]
    tree = H.Tree(H.leaf_rows(rows, 8), 8)
    q = np.concatenate([np.frombuffer(r[1], "<i4") for r in rows[:50]]).reshape(50, 8)
    for centre, radius, _ in tree.levels:
        low, high = H._bounds(q.astype(float), centre, radius)
        share = len(tree.levels[0][0]) / len(centre)
        for k, x in enumerate(tree.vectors):
            node = int(k // 2 ** round(math.log2(share))) if len(centre) > 1 else 0
            s = H.scores_of(q, x)
            assert (s >= low[:, node : node + 1]).all() and (s <= high[:, node : node + 1]).all()
    ends = np.full((50, 1), H.LOWEST)
    search = H.Search(tree, range(50), [r[0] for r in rows[:50]], q, ends, -ends, ends, True, 5).run()
    assert search.scored < 0.5 * 50 * 4000


def test_exact_beyond_doubles():
    q = np.array([[(1 << 29) + 1, 3]], "<i4")
    x = np.array([[(1 << 29) - 1, 7], [1, 1]], "<i4")
    assert H.scores_of(q, x).tolist() == [[((1 << 29) + 1) * ((1 << 29) - 1) + 21, (1 << 29) + 4]]


def test_query_equals_sql(spark, sf_dir):
    compare(spark, sf_dir, H.op11_hard_negatives, H.OP11_SQL)
