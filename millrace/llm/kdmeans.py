"""Centroid clustering by kd-tree filtering, in integers.

Blocks of vectors become balanced kd-trees, once, inside the tasks that read them: a node knows how many vectors it holds, their
integer sum and the box around them. A tree is one row of a written table. In each round a task walks its trees from the root
with the candidate centroids of a node: the one nearest to the middle of the box strictly dominates another if that one is
farther from every point of the box. A node with one candidate left is assigned as a whole, by its count and sum; at the leaves
the vectors are compared one by one. The driver holds only the centroids; each task gives their sums, which Spark adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, doc_columns, mapped, written

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3:"
#: Vectors in a tree, and in one of its leaves at most.
BLOCK, LEAF = 4096, 32
#: Largest component, so that squared distances of up to 64 components fit into 64 bits; below EXACT products are exact as doubles.
LARGEST, EXACT = 1 << 26, 1 << 22

_TREE = "ids array<long>, points binary, sums binary, low binary, high binary"


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among a tree's n vectors; node j has the children 2 j and 2 j + 1."""
    return (n * np.arange((1 << level) + 1)) >> level


def depth(n: int, leaf: int) -> int:
    return max(0, (-(-n // leaf) - 1).bit_length())


class Tree:
    """A balanced kd-tree: vectors in the order of the leaves, sums and boxes of all nodes, level after level."""

    def __init__(self, points: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.sums, self.low, self.high = points, sums, low, high
        self.depth = depth(len(points), leaf)

    @classmethod
    def built(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree, and which of the given vectors stands at each of its places."""
        order, last = np.arange(len(points)), depth(len(points), leaf)
        for level in range(last):
            cuts = bounds(len(points), level + 1).tolist()
            for lo, mid, hi in zip(cuts[:-1:2], cuts[1::2], cuts[2::2], strict=True):
                own = points[order[lo:hi]]
                widest = int(np.argmax(own.max(0) - own.min(0)))
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, widest], mid - lo)]
        points = points[order]
        starts = bounds(len(points), last)[:-1]
        levels = [(np.add.reduceat(points, starts), np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts))]
        for _ in range(last):
            pair = [x.reshape(-1, 2, x.shape[1]) for x in levels[0]]
            levels.insert(0, (pair[0].sum(1), pair[1].min(1), pair[2].max(1)))
        return cls(points, *(np.concatenate(x) for x in zip(*levels, strict=True)), leaf=leaf), order

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, nodes, their candidates, which of them have one only) from the root down, below nodes that have several."""
        nodes, candidates = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        for level in range(self.depth + 1):
            at = (1 << level) - 1 + nodes
            candidates = candidates & ~dominated(self.low[at], self.high[at], centroids, candidates)
            one = candidates.sum(1) == 1
            yield level, nodes, candidates, one
            nodes, candidates = (2 * nodes[~one, None] + np.arange(2)).reshape(-1), np.repeat(candidates[~one], 2, axis=0)

    def spans(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all vectors of these nodes, and how many each has."""
        cuts = bounds(len(self.points), level)
        sizes = cuts[nodes + 1] - cuts[nodes]
        return np.repeat(cuts[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), sizes

    def summed(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of vectors and their sum for each centroid."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for level, nodes, candidates, one in self.walk(centroids):
            whole = nodes[one]
            owner = candidates[one].argmax(1)
            cuts = bounds(len(self.points), level)
            np.add.at(counts, owner, cuts[whole + 1] - cuts[whole])
            np.add.at(sums, owner, self.sums[(1 << level) - 1 + whole])
            if level == self.depth:
                at, sizes = self.spans(level, nodes[~one])
                owner, _ = nearest(self.points[at], centroids, np.repeat(candidates[~one], sizes, axis=0))
                np.add.at(counts, owner, 1)
                np.add.at(sums, owner, self.points[at])
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each vector, and its squared distance."""
        owners, distances = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        for level, nodes, candidates, one in self.walk(centroids):
            done = one | (level == self.depth)
            at, sizes = self.spans(level, nodes[done])
            owners[at], distances[at] = nearest(self.points[at], centroids, np.repeat(candidates[done], sizes, axis=0))
        return owners, distances


def dominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Which candidates of each box are farther than the one nearest to its middle, from every point of the box."""
    to_middle = ((2 * centroids[None] - (low + high)[:, None]) ** 2).sum(2)
    best = np.where(candidates, to_middle, np.iinfo(np.int64).max).argmin(1)
    star = centroids[best][:, None]
    # the difference of the squared distances is smallest at the corner that lies farthest towards the other centroid
    corner = np.where(centroids[None] > star, high[:, None], low[:, None])
    return candidates & (((centroids[None] - star) * (centroids[None] + star - 2 * corner)).sum(2) > 0)


def nearest(points: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest candidate of each vector, of equal ones the first, and its squared distance."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = np.float64 if max(np.abs(points).max(), np.abs(centroids).max()) < EXACT else np.int64
    products = (points.astype(exact) @ centroids.T.astype(exact)).astype(np.int64)
    distances = (points**2).sum(1)[:, None] - 2 * products + (centroids**2).sum(1)
    owner = np.where(candidates, distances, np.iinfo(np.int64).max).argmin(1)
    return owner, distances[np.arange(len(points)), owner]


# --- on tables -----------------------------------------------------------------------------------

def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: vectors of `dims` components, all of them finite, as integers floor(scale x)."""
    x = F.col("embedding")
    sound = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return doc_columns(vectors, "vec_id", "embedding").filter(sound).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """A row for each block of a task's vectors."""
    ids, points = [], []

    def row() -> pa.RecordBatch:
        tree, order = Tree.built(np.concatenate(points))
        own = pa.concat_arrays(ids).take(pa.array(order))
        raw = (tree.points.astype("<i4"), tree.sums.astype("<i8"), tree.low.astype("<i4"), tree.high.astype("<i4"))
        ids.clear()
        points.clear()
        return pa.RecordBatch.from_arrays([pa.array([own.to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], [c.split()[0] for c in _TREE.split(", ")])

    for batch in batches:
        every = batch.column("v").flatten().to_numpy().reshape(-1, dims)
        if np.abs(every).max(initial=0) > LARGEST:
            raise ValueError(f"components beyond {LARGEST} can't be compared in 64 bits")
        at = 0
        while at < len(every):
            n = min(BLOCK - sum(map(len, points)), len(every) - at)
            ids.append(batch.column("vec_id").slice(at, n))
            points.append(every[at : at + n])
            at += n
            if sum(map(len, points)) == BLOCK:
                yield row()
    if points:
        yield row()


def _read(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            arrays = [np.frombuffer(batch.column(c)[k].as_buffer(), t).reshape(-1, dims).astype(np.int64) for c, t in (("points", "<i4"), ("sums", "<i8"), ("low", "<i4"), ("high", "<i4"))]
            yield batch.column("ids")[k].values, Tree(*arrays)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cluster, n, sums): what a task's trees give to each centroid."""
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for _, tree in _read(batches, centroids.shape[1]):
        n, s = tree.summed(centroids)
        counts, sums = counts + n, sums + s
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, tree in _read(batches, centroids.shape[1]):
        owners, distances = tree.assigned(centroids)
        yield pa.RecordBatch.from_arrays([ids, pa.array(owners.astype(np.int32)), pa.array(distances)], ["vec_id", "cluster", "distance"])


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that `kept` keeps.

    Centroids start as the k vectors with the smallest SHA-256 of seed and id; each round assigns all vectors to the nearest
    centroid (squared distance; of equal ones the smaller number) and moves each centroid to the floor of its vectors' mean. One
    without vectors stays where it is. Repeated ids are vectors of their own; of equal hashes the smaller vector comes first.
    Vectors of null ids are clustered too, but are starting centroids only if there are fewer than k others. Fewer than k vectors
    make fewer centroids, none give an empty result. Null vectors, and those with null or infinite components or of another
    length, are left out. Other columns are not looked at. Integers beyond LARGEST, and sums of distances beyond 64 bits, are errors.
    """
    rows = kept(vectors, dims, scale)
    trees = written(mapped(rows, lambda b: _trees(b, dims), _TREE), "kdmeans-trees", free=False)
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(first) else 0):
        parts = mapped(trees, lambda b, c=centroids: _sums(b, c), "cluster long, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        centroids = centroids.copy()
        for r in parts.groupBy("cluster", "i").agg(exact("n"), exact("x")).collect():  # k x dims rows at most
            centroids[r.cluster, r.i] = int(r.x) // int(r.n)
    found = written(mapped(trees, lambda b, c=centroids: _assigned(b, c), "vec_id long, cluster int, distance long"), "kdmeans-assigned", free=False)
    discard(trees)
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def by_cluster(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1) if values else F.lit(None)

    own = by_cluster([inertia.get(c, 0) for c in range(len(digests))]).cast("long")
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digests).cast("string").alias("centroid_sha256"))
