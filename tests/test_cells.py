"""The index of cells: recall, pruning, exactness, edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cells as C
from millrace.operators import ordering
from millrace.operators import retrieval as R

SCHEMA = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module")
def planted():
    """Vectors around 40 middles, with copies, ties, a zero vector and some that can't be indexed."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 12))
    rows = [(i, (middles[i % 40] + 0.15 * rng.normal(size=12)).tolist()) for i in range(3000)]
    return rows + [(5000, rows[7][1]), (5001, rows[7][1]), (5002, [0.0] * 12), (5003, None), (5004, []), (5005, [1.0] * 5)]


@pytest.fixture(scope="module")
def made(spark, planted):
    df = spark.createDataFrame(planted, SCHEMA).repartition(3)
    return df, C.built(df, ordering.folder(spark, "cells"), "vec_id")


def asked(df):
    return df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def test_recall_and_few_cells(spark, made):
    df, index = made
    exact = R.top_many(df.filter("size(embedding) = 12"), asked(df.filter("vec_id < 3000")), 10, "vec_id")
    found = C.nearest(spark, index, asked(df.filter("vec_id < 3000")), 10)
    assert C.recall(found, exact, ["qid", "vec_id"]).first().recall >= 0.9
    assert index.probes < len(index.centroids) / 2
    scores = {(r.qid, r.vec_id): r.score for r in exact.collect()}
    assert all(abs(r.score - scores[r.qid, r.vec_id]) < 1e-9 for r in found.collect() if (r.qid, r.vec_id) in scores)


def test_all_cells_are_exact(spark, made):
    df, index = made
    own = asked(df.filter("vec_id < 3000"))
    want = {tuple(r) for r in R.top_many(df.filter("size(embedding) = 12"), own, 7, "vec_id").collect()}
    assert {tuple(r) for r in C.nearest(spark, index, own, 7, probes=len(index.centroids), exact=True).collect()} == want


def test_only_probed_cells_are_read(spark, made):
    df, index = made
    one = C.nearest(spark, index, asked(df.filter("vec_id = 100")), 5, probes=2, exact=True)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan
    assert index.table(spark).select("cell").distinct().count() > 10
    assert one.select(F.input_file_name()).limit(0).count() == 0 and one.count() == 5


def test_every_row_is_indexed_once(spark, made, planted):
    _, index = made
    ids = [r.vec_id for r in index.table(spark).select("vec_id").collect()]
    assert sorted(ids) == sorted(i for i, v in planted if v and len(v) == 12)


def test_an_index_can_be_opened_again(spark, made):
    df, index = made
    again = C.opened(spark, index.path)
    own = asked(df.filter("vec_id < 500"))
    assert sorted(map(tuple, C.nearest(spark, again, own, 5).collect())) == sorted(map(tuple, C.nearest(spark, index, own, 5).collect()))


def test_questions_that_find_nothing(spark, made):
    _, index = made
    own = spark.createDataFrame([(1, None), (2, []), (3, [0.0] * 12), (4, [1.0] * 5)], "qid long, q array<double>")
    assert C.nearest(spark, index, own, 5).collect() == []
    with pytest.raises(ValueError, match="no vectors"):
        C.built(spark.createDataFrame([(1, None)], SCHEMA), ordering.folder(spark, "cells"), "vec_id")


def test_small_indexes(spark):
    for n in (1, 2, 9):
        df = spark.createDataFrame([(i, [float(i + 1), 1.0, 0.5]) for i in range(n)], SCHEMA)
        index = C.built(df, ordering.folder(spark, "cells"), "vec_id")
        assert C.nearest(spark, index, asked(df), 20).count() == n
