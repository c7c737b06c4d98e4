"""Products of many questions with a batch are made in tiles: what a task holds doesn't follow questions times rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import cells as C
from millrace.operators import many as M
from millrace.operators import retrieval as R

MB = 1 << 20
QUESTIONS, ROWS = 2_000, 10_000  # 160 MB of similarities


def vectors(n, dims=4, seed=0):
    flat = np.random.default_rng(seed).normal(size=n * dims)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dims + 1, dims, dtype=np.int32)), pa.array(flat))


def asked(spark, key="qid", name="q", n=QUESTIONS):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors(n).to_pylist())], f"{key} long, {name} array<double>")


@pytest.fixture
def functions(spark, monkeypatch):
    """What is given to mapInArrow, in order."""
    kind, got = type(spark.range(1)), []
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *rest, **more: (got.append(f), real(self, f, *rest, **more))[1])
    return got


def most_held(f, names, batches=2):
    some = [pa.RecordBatch.from_arrays([pa.array(np.arange(ROWS) + k * ROWS) if x in ("id", "tag") else vectors(ROWS, seed=k + 1) for x in names], names) for k in range(batches)]
    tracemalloc.start()
    rows = sum(b.num_rows for b in f(iter(some)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / MB, rows


def test_many_questions_over_a_batch(spark, functions):
    index = spark.createDataFrame([(0, [1.0] * 4)], "vec_id long, embedding array<double>")
    R.top_many(index, asked(spark), 3, "vec_id")
    held, rows = most_held(functions[-1], ["id", "v"])
    assert held < 60 and rows == 3 * QUESTIONS  # of the task, not of each batch


def test_structured_questions_over_a_batch(spark, functions):
    records = spark.createDataFrame([(0, [1.0] * 4)], "vec_id long, patterns_vector array<double>")
    tags = asked(spark, "tag")
    M.searched(records, asked(spark, name="patterns_vector"), "vec_id", 5, {"patterns_vector": 1.0}, tags)
    held, rows = most_held(functions[-1], ["id", "patterns_vector"])
    assert held < 60 and rows == (5 + 2) * QUESTIONS


@pytest.mark.parametrize("exact", [False, True])
def test_cells_scanned_by_many_questions(exact):
    class Sent:
        m = R.unit_rows(vectors(QUESTIONS))[1][4][1]
        value = (list(range(QUESTIONS)), m, np.zeros((QUESTIONS, 1), np.int64), np.random.default_rng(1).normal(size=(2, 8, 2)))

    x = vectors(ROWS) if exact else pa.array([bytes([i % 8, i // 8 % 8]) for i in range(ROWS)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(ROWS, np.int32)), pa.array(np.arange(ROWS)), x], ["cell", "id", "x"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in C._scanned(iter([batch]), Sent, 10, exact, ["qid", "cell", "vec_id", "score"]))
    peak = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    assert peak < 60 and rows == 10 * QUESTIONS


@pytest.mark.parametrize("keys", [1, QUESTIONS])
def test_tags_of_questions_over_a_batch(spark, functions, keys):
    from pyspark.sql import functions as F

    tags = spark.createDataFrame([(0, [1.0] * 4)], "tag long, embedding array<double>")
    M.similar_tags(tags, asked(spark).withColumn("qid", F.col("qid") % keys), 15, 0.2)
    held, rows = most_held(functions[-1], ["tag", "embedding"])
    assert held < 90 and rows == 15 * keys


def test_tags_in_tiles_equal_a_full_product(spark, monkeypatch):
    rng = np.random.default_rng(2)
    tags = [(k % 30, rng.integers(-2, 3, 4 if k % 5 else 3).astype(float).tolist()) for k in range(60)] + [(99, None)]  # a tag has two vectors
    own = [(k % 7, rng.integers(-2, 3, 4 if k % 3 else 3).astype(float).tolist()) for k in range(40)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if a and len(a) == len(b) and np.any(a) and np.any(b) else 0.0
    t, q = spark.createDataFrame(tags, "tag long, embedding array<double>").repartition(3), spark.createDataFrame(own, "qid long, q array<double>")
    for most, least in ((8, 0.3), (40, 0.0)):
        want = {}
        for k in range(7):
            best = {}
            for tag, e in tags:
                best[tag] = max([best.get(tag, 0.0), *(round(cos(e, v), 12) for i, v in own if i == k)])
            ranked = sorted((-s, tag) for tag, s in best.items() if s >= least)[:most]
            want |= {(k, i + 1): (tag, round(-s, 9)) for i, (s, tag) in enumerate(ranked)}
        got = {(r.qid, r.tag_rank): (r.tag, round(r.similarity, 9)) for r in M.similar_tags(t, q, most, least).collect()}
        assert got == want


def test_similar_tags_over_a_batch(spark, functions):
    tags = spark.createDataFrame([(0, [1.0] * 4)], "tag long, embedding array<double>")
    R.similar_tags(tags, asked(spark).select("q"), 10, 0.2)
    held, rows = most_held(functions[-1], ["tag", "embedding"])
    assert held < 60 and rows == 2 * ROWS


def test_best_takes_ids_of_any_kind_and_ties_by_id():
    for ids in ([3, 1, 2, 1], ["c", "a", "b", "a"], [None, "b", "a", "b"]):
        best, twice = R.Best(2, 2), R.Best(1, 2, once=True)
        order = sorted(ids, key=lambda x: (x is not None, x))
        for i in ids:
            best.add(0, np.array([[1.0], [-np.inf]]), pa.array([i], pa.int64() if isinstance(i, int) else pa.string()))
            twice.add(0, np.array([[0.5]]), pa.array([i], pa.int64() if isinstance(i, int) else pa.string()))
        q, got, scores = best.rows()
        assert q.tolist() == [0, 0] and got.to_pylist() == order[:2] and scores.to_pylist() == [1.0, 1.0]
        assert twice.rows()[1].to_pylist() == list(dict.fromkeys(order))[:2]
