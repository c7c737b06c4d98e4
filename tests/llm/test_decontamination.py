"""Items without an id, long items, and benchmarks of many blocks."""

from __future__ import annotations

import collections

import pytest
from conftest import oracle_rows, rows_of

from millrace.llm import decontam, sql

ITEMS = [(None, "lost item of four words"), (1, "two words"), (None, "two words"), (2, " ".join(f"w{i}" for i in range(95))), (3, None)]
TEXTS = [(1, "A lost item, of four words is here"), (2, "two words of it"), (3, " ".join(f"W{i}" for i in range(20, 80))), (4, "clean"), (None, "lost item of four words"), (5, "lost item of four words"), (5, "lost item of four words"), (6, None)]


def tables(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 24, 30])
@pytest.mark.parametrize("piece", [10_000, 7])
def test_equals_the_sql(spark, monkeypatch, block, piece):
    """Windows of items without an id hit, though there is no name to report, however items are cut and dealt."""
    import duckdb

    monkeypatch.setattr(decontam, "PIECE", piece)
    docs, items = tables(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", items.toPandas().astype({"item_id": "Int64"}))
    _, want = oracle_rows(con, sql.oracle_sql()["op7_decontamination"])
    assert rows_of(decontam.report(docs, items, block_bytes=block)) == want
    left = collections.Counter(r.doc_id for r in decontam.clean(docs, items, block_bytes=block).collect())
    assert left == {4: 1, 6: 1}


@pytest.mark.parametrize("block, nodes", [(1 << 24, 1), (30, 0)])
def test_one_worker_a_stage(spark, block, nodes):
    """However many blocks the benchmark has, the plan of a result holds one Python node at most."""
    plan = decontam.report(*tables(spark), block_bytes=block)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == nodes


def counted(spark, docs):
    """docs, and a count of all rows that anything reads of them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return docs.mapInArrow(count, docs.schema), seen


@pytest.mark.parametrize("megabytes", [0.2, 8])
def test_two_scans_whatever_the_size_of_the_benchmark(spark, megabytes):
    """Rows are read twice, and hits equal the search with all strings in one table."""
    import random

    rng = random.Random(int(megabytes))
    vocabulary = [f"word{i}" for i in range(5000)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.choice([3, 9, 40, 4000]))) for k in range(int(megabytes * 110))]
    rows = [(k, line(20) + " " + (" ".join(items[k % len(items)][1].split()[:30]) if k % 3 else "") + ", " + line(700)) for k in range(200)]
    docs, seen = counted(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    got = rows_of(decontam.report(docs, benchmark, block_bytes=1000))
    assert seen.value <= 2 * len(rows)
    if megabytes < 1:
        assert got == rows_of(decontam.report(docs, benchmark, block_bytes=1 << 30))
    else:
        table = decontam.WuManber([(str(i), decontam.words_of(t)) for i, t in items if k_words(t) < 4000] + [(str(i), decontam.words_of(t)[:60]) for i, t in items if k_words(t) == 4000], 10)
        for d, t in rows[:60]:
            hit = {n for a, b in zip(*table.search(decontam.words_of(t))[:2]) for n in range(a, b)}
            assert next(r for r in got if r[1] == d)[3] == len(hit) and (bool(hit) == (d % 3 > 0))


def k_words(text):
    return len(text.split())


def test_cursors_equal_looking_everywhere():
    import numpy as np

    rng = np.random.default_rng(5)
    for m in (1, 2, 5, 10):
        slots, of_text = rng.integers(0, 50, 4000), np.array([0, 0, 3, 1500, 1509, 4000])
        ends = [i for a, b in zip(of_text, of_text[1:]) for i in range(a + m - 1, b)]
        none = m - min(2, m) + 1
        shifts = np.full(50, none, np.uint8)
        # a table that tells the truth: where a string ends, the blocks before it have its distance at most
        true = rng.choice(ends, 40)
        for e in true:
            for back in range(none):
                shifts[slots[e - back]] = min(shifts[slots[e - back]], back)
        got = set(decontam.string_ends(slots, of_text, m, shifts).tolist())
        assert set(true.tolist()) <= got == {i for i in ends if shifts[slots[i]] == 0}
