"""Clusters against plain Lloyd rounds in Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from millrace.llm import kdmeans as M

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=8, rounds=10, dims=64):
    rows = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])) + sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
    cents = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(rows, own) if o == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(v) for _, v in rows]
    of = {c: sum(d for d, o in last if o == c) for c in range(len(cents))}
    hexes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, o, d, of[o], sum(of.values()), hexes[o]) for (i, _), (d, o) in zip(rows, last)), key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def cases(n=300, spread=0.3, seed=13):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, 64))
    rows = [(i, [float(x) for x in np.float32(middles[i % 9] + spread * rng.normal(size=64))]) for i in range(n)]
    rows += [(i, rows[5][1]) for i in range(1000, 1020)] + [rows[3], (3, rows[4][1]), (None, rows[7][1]), (None, rows[8][1])]
    bad = [(1, None), (2, []), (4, [1.0] * 63), (5, [1.0] * 65), (6, [None] + [1.0] * 63), (7, [float("nan")] + [1.0] * 63), (8, [float("inf")] + [1.0] * 63)]
    return rows + bad + [(9, [0.0] * 64), (10, [-0.00049] * 64)]


@pytest.mark.parametrize("spread", [0.01, 0.3, 3.0])
def test_clusters_equal_brute_force(spark, spread):
    rows = cases(spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as cluster", "'x' as v", "2 as sums")
    assert result(M.clustered(df)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 8])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)] + [(99, None)]
    assert result(M.clustered(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ties_and_empty_centroids(spark):
    """Equal starting centroids: the smaller number takes all, the others stay as they are."""
    rows = [(i, [1.0] * 64) for i in range(20)] + [(i, [1.0 + (i % 2)] * 64) for i in range(20, 30)]
    assert result(M.clustered(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_too_large_components(spark):
    with pytest.raises(Exception, match="64 bits"):
        M.clustered(spark.createDataFrame([(1, [1e9] * 64)], SCHEMA)).collect()


def test_trees():
    rng = np.random.default_rng(2)
    for n in (1, 2, 31, 32, 33, 64, 65, 1000):
        points = rng.integers(-1024, 1024, (n, 4)) // (1 if n != 64 else 512)
        tree, order = M.Tree.built(points)
        assert (tree.points == points[order]).all() and sorted(order) == list(range(n))
        for level in range(tree.depth + 1):
            cuts = M.bounds(n, level)
            for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                i, own = (1 << level) - 1 + j, tree.points[a:b]
                assert b > a and (tree.sums[i] == own.sum(0)).all() and (tree.low[i] == own.min(0)).all() and (tree.high[i] == own.max(0)).all()
        assert b - a <= M.LEAF


@pytest.mark.parametrize("size", [1000, 1 << 26])
def test_filtering_equals_comparing_all(size):
    rng = np.random.default_rng(3)
    for spread in (size // 500, size // 2):
        middles = rng.integers(-size // 2, size // 2, (8, 5))
        points = middles[rng.integers(0, 8, 700)] + rng.integers(-spread, spread + 1, (700, 5))
        points[:20] = (middles[0] + middles[1]) // 2
        tree, _ = M.Tree.built(points)
        every = ((tree.points[:, None].astype(object) - middles[None].astype(object)) ** 2).sum(2)
        owners, distances = tree.assigned(middles)
        assert (owners == every.argmin(1)).all() and (distances == every.min(1)).all()
        counts, sums = tree.summed(middles)
        assert counts.tolist() == np.bincount(owners, minlength=8).tolist() and all((sums[c] == tree.points[owners == c].sum(0)).all() for c in range(8))


def test_nodes_are_assigned_as_a_whole_where_clusters_are_apart():
    rng = np.random.default_rng(4)
    middles = rng.integers(-1000, 1000, (8, 6))
    tree, _ = M.Tree.built(np.repeat(middles, 200, axis=0) + rng.integers(-2, 3, (1600, 6)))
    whole = sum(int(one.sum()) * (1 << (tree.depth - level)) for level, _, _, one in tree.walk(middles))
    assert whole > 0.5 * (1 << tree.depth)


def test_equal_distance_prunes_nothing():
    """A centroid as near as the nearest one everywhere isn't strictly dominated: the smaller number decides at the leaf."""
    box = np.zeros((1, 2), np.int64)
    assert not M.dominated(box, box, np.array([[1, 0], [0, 1]]), np.ones((1, 2), bool)).any()
    assert M.dominated(box, box, np.array([[1, 0], [0, 2]]), np.ones((1, 2), bool)).tolist() == [[False, True]]
