"""A vector index with inverted lists: cells of a k-means, product codes, exact ranking of what they let through.

An index is a table partitioned by cell, so a search reads the cells that are nearest to what is asked and no others. In these it
scans the codes (a byte a part of the vector) against a table of products, keeps the best of each question, and reads only
those rows' vectors for the exact cosine. Cells and code words are fitted on a bounded sample, on which the numbers of cells and
of candidates are measured too that reach the wanted recall; every row is indexed. Searching all cells without codes is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.vectors import cosine, present
from .retrieval import DIGITS, asked_blocks, tiles, unit_rows

#: Vectors that cells and code words are fitted on at most, and those of them that recall is measured with.
SAMPLE, MEASURED = 10_000, 200
#: Parts of a vector that have a byte of their own, and words that it may name.
PARTS, WORDS = 16, 64
#: Share of the nearest rows that cells, and codes, are to let through on the sample.
TARGET = 0.97


@dataclass
class CellIndex:
    """Where an index is, and what a search needs of it."""

    path: str
    id_column: str
    centroids: np.ndarray  # cells by dimensions
    words: np.ndarray  # parts by words by dimensions of a part
    probes: int
    candidates: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def _lloyd(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k means of points, which come in an order that has nothing to do with where they lie."""
    means = points[:k].copy()
    for _ in range(rounds):
        own = (points @ means.T - (means**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(means))
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return means


def _codes(vectors: np.ndarray, words: np.ndarray) -> np.ndarray:
    parts, _, size = words.shape
    split = np.pad(vectors, ((0, 0), (0, parts * size - vectors.shape[1]))).reshape(-1, parts, size)
    return np.stack([(split[:, p] @ words[p].T - (words[p] ** 2).sum(1) / 2).argmax(1) for p in range(parts)], axis=1).astype(np.uint8)


def _products(asked: np.ndarray, words: np.ndarray) -> np.ndarray:
    """asked by parts by words: what each code word adds to the similarity."""
    parts, _, size = words.shape
    split = np.pad(asked, ((0, 0), (0, parts * size - asked.shape[1]))).reshape(-1, parts, size)
    return np.einsum("aps,pws->apw", split, words)


def _by_codes(products: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """asked by rows: similarities by the codes."""
    out = np.zeros((len(products), len(codes)))
    for p in range(codes.shape[1]):
        out += products[:, p, codes[:, p]]
    return out


def built(rows: DataFrame, path: str, id_column: str, vector: str = "embedding", cells: int | None = None, parts: int = PARTS, words: int = WORDS, sample: int = SAMPLE, k: int = 10, target: float = TARGET) -> CellIndex:
    """Writes the index of all rows whose vectors are as long as the first ones' of the sample; null and empty vectors have no
    place in it. cells: the root of the number of rows, a 32nd of the sample at most, if not given."""
    spark = rows.sparkSession
    own = rows.select(F.col(id_column), F.col(vector).cast("array<double>").alias("v")).filter(present(F.col("v")))
    some = own.orderBy(F.xxhash64(id_column), id_column).limit(sample).select("v").toArrow().column("v").combine_chunks()  # SAMPLE vectors
    if not len(some):
        raise InvalidInput("no vectors to index")
    dims = len(some[0])
    points = unit_rows(some)[1][dims][1]
    n = own.count()
    centroids = _lloyd(points, max(1, min(cells or round(math.sqrt(n)), len(points) // 32 or 1)))
    size = -(-dims // parts)
    split = np.pad(points, ((0, 0), (0, parts * size - dims))).reshape(-1, parts, size)
    book = np.stack([_lloyd(split[:, p], min(words, len(points))) for p in range(parts)])
    probes, candidates = _tuned(points, centroids, book, k, target)
    sent = spark.sparkContext.broadcast((centroids, book))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, book = sent.value
        for batch in batches:
            found = unit_rows(batch.column("v"))[1].get(dims)
            if found is not None:
                at, unit = found
                cell = (unit @ centroids.T).argmax(1).astype(np.int32)
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([c.tobytes() for c in _codes(unit, book)], pa.binary()), pa.array(cell)], [*some.schema.names, "code", "cell"])

    kind = own.schema[id_column].dataType.simpleString()
    every = own.mapInArrow(placed, f"`{id_column}` {kind}, v array<double>, code binary, cell int")
    # ranges of (cell, id), so that a cell of most rows is several files
    every.repartitionByRange("cell", id_column).sortWithinPartitions("cell", id_column).write.partitionBy("cell").parquet(f"{path}/rows")
    index = CellIndex(path, id_column, centroids, book, probes, math.ceil(candidates * max(1.0, n / len(points))))
    _save(spark, index)
    return index


def _tuned(points: np.ndarray, centroids: np.ndarray, book: np.ndarray, k: int, target: float) -> tuple[int, int]:
    """Cells to search, and candidates to keep, that let `target` of the sample's nearest rows through."""
    asked = points[:MEASURED]
    exact = asked @ points.T
    exact[np.arange(len(asked)), np.arange(len(asked))] = -2  # itself is found anyway
    near = np.argsort(-exact, axis=1)[:, : min(k, len(points) - 1)]
    if not near.size:
        return len(centroids), k
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    cell = (points @ centroids.T).argmax(1)
    behind = np.sort(np.take_along_axis(rank, cell[near], 1).ravel())
    by_code = _by_codes(_products(asked, book), _codes(points, book))
    places = np.argsort(np.argsort(-by_code, axis=1), axis=1)
    last = np.sort(np.take_along_axis(places, near, 1).ravel())
    at = min(len(behind) - 1, math.ceil(target * len(behind)) - 1)
    return int(behind[at]) + 1, max(4 * k, int(last[at]) + 1)


def _save(spark: SparkSession, index: CellIndex) -> None:
    rows = [("cell", i, 0, c) for i, c in enumerate(index.centroids.tolist())] + [("word", p, w, c) for p, part in enumerate(index.words.tolist()) for w, c in enumerate(part)]
    rows += [("limits", index.probes, index.candidates, []), (index.id_column, 0, 0, [])]
    spark.createDataFrame(rows, "kind string, i int, j int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/model")


def opened(spark: SparkSession, path: str) -> CellIndex:
    """An index that `built` has written."""
    rows = sorted((r.kind, r.i, r.j, r.v) for r in spark.read.parquet(f"{path}/model").collect())  # cells and code words
    cells = [v for kind, _, _, v in rows if kind == "cell"]
    words = [v for kind, _, _, v in rows if kind == "word"]
    parts = 1 + max(i for kind, i, _, _ in rows if kind == "word")
    probes, candidates = next((i, j) for kind, i, j, _ in rows if kind == "limits")
    name = next(kind for kind, *_ in rows if kind not in ("cell", "word", "limits"))
    return CellIndex(path, name, np.array(cells), np.array(words).reshape(parts, len(words) // parts, -1), probes, candidates)


def nearest(spark: SparkSession, index: CellIndex, asked: DataFrame, k: int, asked_id: str = "qid", probes: int | None = None, candidates: int | None = None, exact: bool = False) -> DataFrame:
    """(asked_id, id, score, rank): for each asked vector (q) the k best rows of its `probes` nearest cells, by exact cosine; ties
    by id. exact: all rows of these cells are scored, not only the `candidates` of the codes. Questions go in blocks; missing
    and zero vectors, and those of another length, find nothing."""
    probes, candidates = min(probes or index.probes, len(index.centroids)), candidates or index.candidates
    kinds = f"{asked_id} {asked.schema[asked_id].dataType.simpleString()}, cell int, `{index.id_column}` {index.table(spark).schema[index.id_column].dataType.simpleString()}, score double"
    parts = []
    for names, block in asked_blocks(asked, asked_id):
        which, m = block.get(index.centroids.shape[1], (np.zeros(0, np.int64), np.zeros((0, index.centroids.shape[1]))))
        there = np.abs(m).sum(1) > 0
        which, m = which[there], m[there]
        near = np.argsort(-(m @ index.centroids.T), axis=1, kind="stable")[:, :probes]
        cells = np.unique(near).tolist()
        rows = index.table(spark).filter(F.col("cell").isin(cells))
        sent = spark.sparkContext.broadcast(([names[w] for w in which.tolist()], m, near, index.words))
        most = k if exact else candidates
        found = rows.select("cell", F.col(index.id_column).alias("id"), F.col("v" if exact else "code").alias("x")).mapInArrow(lambda b, sent=sent, most=most: _scanned(b, sent, most, exact, [asked_id, "cell", index.id_column, "score"]), kinds)
        order = Window.partitionBy(asked_id).orderBy(F.col("score").desc(), index.id_column)
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        if not exact:
            vectors = rows.select("cell", index.id_column, "v")
            own = asked.select(asked_id, F.col("q").cast("array<double>").alias("q"))
            best = best.drop("score", "rank").join(vectors, ["cell", index.id_column]).join(own, asked_id)
            best = best.withColumn("score", F.round(cosine(F.col("v"), F.col("q")), DIGITS)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        parts.append(best.select(asked_id, index.id_column, "score", "rank"))
    return reduce(DataFrame.unionByName, parts)


def _scanned(batches: Iterator[pa.RecordBatch], sent, most: int, exact: bool, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each batch and cell the best rows of each question that searches the cell; questions in tiles."""
    names, m, near, words = sent.value
    products = None if exact else _products(m, words)
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        for cell in np.unique(cells).tolist():
            asked = np.flatnonzero((near == cell).any(1))
            if not len(asked):
                continue
            some = batch.filter(pa.array(cells == cell))
            some = some.sort_by("id") if hasattr(some, "sort_by") else some
            if exact:
                at, unit = unit_rows(some.column("x"))[1][m.shape[1]]
            else:
                codes = np.frombuffer(b"".join(some.column("x").to_pylist()), np.uint8).reshape(some.num_rows, -1)
            for i, j in tiles(len(asked), some.num_rows):
                part = asked[i:j]
                if exact:
                    scores = np.zeros((len(part), some.num_rows))
                    scores[:, at] = (m[part] @ unit.T).round(DIGITS)
                else:
                    scores = _by_codes(products[part], codes)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                own = [names[a] for a in np.repeat(part, best.shape[1]).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(best.size, cell, np.int32)), some.column("id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(scores, best, 1).ravel())], columns)


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """(wanted, got, recall): how many of the exact pairs were found."""
    both = exact.select(*keys).join(found.select(*keys).withColumn("_hit", F.lit(1)), keys, "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("got")).withColumn("recall", F.col("got") / F.col("wanted"))
