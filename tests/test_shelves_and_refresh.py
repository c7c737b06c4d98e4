"""Neighbours from shelves; an index that is brought up to date; table functions and sketches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.operators import refresh
from millrace.operators import retrieval as R
from millrace.operators import shelves as B
from millrace.operators import sketches as K
from millrace.sources.commits import CommitTable


def records(spark, books=5, n=300):
    rows = [(1000 * b + i, f"b{b}", i // 40, i // 3, ) for b in range(books) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, book_id string, chapter_index int, section_index int")


def test_shelves(spark, tmp_path):
    r = records(spark)
    s = B.shelved(r, "shelves_test", f"{tmp_path}/s", "vec_id", 16)
    hits = spark.createDataFrame([(0,), (63,), (2065,), (4299,)], "vec_id long")
    found = B.adjacent(spark, s, B.places_of(spark, s, hits), 3)
    want = R.adjacent(r, hits, "vec_id", 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: " in plan
    read = int(plan.split("SelectedBucketsCount: ")[1].split(" ")[0])
    assert read <= 7  # shelves of the hits and beside them, of 16 buckets
    below = plan.split("BroadcastHashJoin")[-1]
    assert "Exchange hashpartitioning(shelf" not in plan and "Exchange hashpartitioning(book_id" not in below
    spark.sql("drop table shelves_test")


def sections(spark, texts):
    rows = [("book", k // 3, k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book_id string, chapter_index int, section_index int, content string")


def test_refresh(spark, tmp_path):
    built = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def cost(text):
        built.add(1)
        return float(len(text or ""))

    build = lambda rows: rows.withColumn("vector", F.array(cost("content")))
    texts = [f"section {k}" for k in range(12)] + ["same", "same", None]
    go = lambda some: refresh.refreshed(spark, f"{tmp_path}/i", sections(spark, some), build)
    full = lambda some: {(r.chapter_index, r.section_index, r.content, tuple(r.vector)) for r in build(sections(spark, some)).collect()}
    index = CommitTable(spark, f"{tmp_path}/i/records")
    now = lambda: {(r.chapter_index, r.section_index, r.content, tuple(r.vector)) for r in index.read().collect()}

    assert go(texts) == {"built": 15, "moved": 0, "kept": 0, "removed": 0} and now() == full(texts)
    ids = {r.section_index: r.vec_id for r in index.read().collect()}
    assert sorted(ids.values()) == list(range(15))
    before = built.value
    changed = [*texts[:4], "new text", *texts[5:]]
    assert go(changed) == {"built": 1, "moved": 0, "kept": 14, "removed": 1}
    assert built.value == before + 1  # one section was embedded
    after = {r.section_index: r.vec_id for r in index.read().collect()}
    assert now() == full(changed) and after == {**ids, 4: 15}
    assert [r.vec_id for r in CommitTable(spark, f"{tmp_path}/i/tombstones").read().collect()] == [ids[4]]
    shifted = ["ahead", *changed]
    assert go(shifted) == {"built": 1, "moved": 15, "kept": 0, "removed": 0} and now() == full(shifted)
    assert {r.content: r.vec_id for r in index.read().collect() if r.content not in ("ahead", "same")}["section 7"] == ids[7]
    assert go(shifted) == {"built": 0, "moved": 0, "kept": 16, "removed": 0}
    assert go(shifted[1:3])["removed"] == 14 and now() == full(shifted[1:3])
    assert index.read(0).count() == 15  # an older version is still there


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "a. " * 400), (2, None), (3, " ")], "doc_id long, text string").createOrReplaceTempView("tf_docs")
    rows = spark.sql("select d.doc_id, c.* from tf_docs d, lateral chunks(d.text, 'regular', 300, 20) c order by 1, 2").collect()
    assert {r.doc_id for r in rows} == {1} and [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].n_chars <= 300
    for bad in ("chunks(text, 'no')", "chunks(doc_id, 'regular')", "chunks(text, text)", "chunks(text, 'regular', 10, 10)"):
        with pytest.raises(Exception, match="chunks: "):
            spark.sql(f"select * from tf_docs, lateral {bad}").collect()
    with pytest.raises(Exception, match="sections: "):
        spark.sql("select * from sections(table(tf_docs) partition by doc_id)").collect()


def test_sketches_of_days_merge(spark):
    rows = [(["a", "b"][i % 2], f"2024-01-{1 + i % 9:02} 10:00:00", i % 3000, float(i % 1000)) for i in range(40_000)] + [("a", "2024-01-03 00:00:00", None, None)]
    events = spark.createDataFrame(rows, "kind string, ts string, who long, value double")
    days = K.sketched(events, ["kind"], F.col("ts").cast("timestamp"), F.col("who"), F.col("value"))
    assert days.count() == 18
    for some in (F.lit(True), F.col("day") >= "2024-01-05"):
        got = {r.kind: r for r in K.estimated(K.merged(days.filter(some), ["kind"]), ["kind"]).collect()}
        own = events.withColumn("day", F.col("ts").cast("date")).filter(some)
        once = {r.kind: r for r in K.estimated(own.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("who", F.lit(K.BITS)).alias("who"), F.kll_sketch_agg_double("value", F.lit(K.K)).alias("value")), ["kind"]).collect()}
        for kind in "ab":
            exact = own.filter(F.col("kind") == kind)
            distinct, values = exact.agg(F.countDistinct("who")).first()[0], sorted(r.value for r in exact.collect() if r.value is not None)
            assert got[kind].n == once[kind].n == exact.count()
            assert abs(got[kind].distinct - distinct) <= K.DISTINCT_ERROR * distinct and abs(got[kind].distinct - once[kind].distinct) <= 0.01 * distinct
            for share, q in zip((0.25, 0.5, 0.75), got[kind].quantiles):
                below, upto = (sum(op(v, q) for v in values) / len(values) for op in (float.__lt__, float.__le__))
                assert below - K.RANK_ERROR <= share <= upto + K.RANK_ERROR
