"""As-of join against looking at every row."""

from __future__ import annotations

import random

import pytest

from millrace.operators.asof import as_of


def brute(rows, others):
    out = []
    for k, at, tag in rows:
        before = [(p, v) for key, p, v in others if key == k and p <= at]
        out.append((k, at, tag, max(before)[1] if before else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, seed, parts):
    """One key has most rows, so several ranges are its own, some of them without any other row."""
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "hos", "hou", "z"])
    rows = [(key(), rng.randint(0, 500), i) for i in range(300)]
    others = [(k, p, f"{k}{p}") for k, p in {(key(), rng.randint(0, 90)) for _ in range(25)} | {("only", 3)}]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = as_of(spark.createDataFrame(rows, "k string, at int, tag int"), spark.createDataFrame(others, "k string, at int, v string"), "k", "at", ["v"])
        assert found.columns == ["k", "at", "tag", "v"]
        assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, others)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_on_one_side(spark):
    rows, none = spark.createDataFrame([("a", 1, 2)], "k string, at int, tag int"), spark.createDataFrame([], "k string, at int, v string")
    assert [tuple(r) for r in as_of(rows, none, "k", "at", ["v"]).collect()] == [("a", 1, 2, None)]
    assert as_of(rows.limit(0), none, "k", "at", ["v"]).collect() == []
