"""Many structured questions in one pass give what each gives alone."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import many as M
from millrace.operators import retrieval as R
from millrace.operators import serving as S

VECTORS = list(R.WEIGHTS)


def rows(n=60):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        own = [rng.normal(size=6).tolist() for _ in VECTORS]
        for k in range(5):
            if (i + k) % 6 == 0:
                own[k] = None if i % 2 else []
        out.append((i, f"b{i % 2}", i % 7, i % 3, *own))
    out.append((90, "b0", 1, 1, *[None] * 5))  # no vector at all
    out.append((91, "b1", 1, 1, *out[10][4:]))  # the same as another
    return out


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(rows(), "vec_id long, book_id string, chapter_index long, section_index long, " + ", ".join(f"{v} array<double>" for v in VECTORS)).repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    rng = np.random.default_rng(4)
    some = [(q, *[rng.normal(size=6).tolist() if (q + k) % 4 else None for k in range(5)]) for q in range(7)] + [(7, *[None] * 5)]
    return spark.createDataFrame(some, "qid long, " + ", ".join(f"{v} array<double>" for v in VECTORS))


def test_hits_and_tags_equal_single_questions(spark, records, questions):
    rng = np.random.default_rng(5)
    tags = spark.createDataFrame([(f"t{k:02}", rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for k in range(25)], "tag string, embedding array<double>, q array<double>")
    asked = spark.createDataFrame([(q, rng.normal(size=6).tolist()) for q in range(7) for _ in range(3)], "qid long, q array<double>")
    got = M.answered(records, questions, tag_vectors=tags, tags_asked=asked, threshold=0.3).collect()
    for q in range(8):
        order, near = S.searched_by(records, questions.filter(F.col("qid") == q).drop("qid"), tag_vectors=tags, threshold=0.3, asked=asked.filter(F.col("qid") == q).select("q"))
        beside = {}
        for r in sorted(near.filter("dist <> 0").collect(), key=lambda r: r.dist):
            beside.setdefault(r.hit, []).append(r.adjacent)
        want = sorted((r.rank, r.vec_id, r.source, None if r.score is None else round(r.score, 9), beside.get(r.vec_id) if r.source == "search" else None) for r in order.collect())
        assert sorted((r.rank, r.vec_id, r.source, None if r.score is None else round(r.score, 9), r.near) for r in got if r.qid == q) == want


def test_one_scan_of_the_records(spark, records, questions):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    watched = records.mapInArrow(count, records.schema)
    hits, _ = M.searched(watched, questions, "vec_id", tag_queries=spark.createDataFrame([("a", [1.0] * 6)], "tag string, q array<double>"))
    hits.collect()
    assert seen.value == records.count()


def test_blocks_of_questions(spark, records, questions, monkeypatch):
    want = sorted(map(tuple, M.searched(records, questions, "vec_id")[0].collect()))
    monkeypatch.setattr(M, "MOST_QUERIES", 3)
    assert sorted(map(tuple, M.searched(records, questions, "vec_id")[0].collect())) == want


def test_nothing_asked_and_no_records(spark, records, questions):
    assert M.searched(records, questions.limit(0), "vec_id")[0].count() == 0
    assert M.answered(records.limit(0), questions).count() == 0
