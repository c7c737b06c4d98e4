"""Orders and summaries of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import listings as L
from millrace.operators import retrieval as R


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_orders(spark):
    rows = spark.createDataFrame([(1, "request-10", "b", None), (2, "request-9", "a", "2025-01-02"), (3, "odd", None, "2025-01-03"), (4, "request-9", "B", "2025-01-03")], "id int, custom_id string, name string, at string")
    assert ids(L.by_custom_id(rows))[2:] == [1, 3] and set(ids(L.by_custom_id(rows))[:2]) == {2, 4}
    assert ids(L.newest_first(rows, "at", "id")) == [4, 3, 2, 1]
    assert ids(L.by_name(rows)) == [4, 2, 1, 3]
    ratings = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "id int, prompt_number int")
    assert ids(L.ratings_in_order(ratings)) == [2, 3, 1] and ids(L.of_prompt(ratings, 2)) == [1]
    jobs = spark.createDataFrame([(k, "completed" if k % 2 else "failed", k // 4) for k in range(20)], "id int, status string, at int")
    assert ids(L.finished(jobs, "at", "id")) == [19, 17, 15, 13, 11]


def test_reranked(spark):
    rows = spark.createDataFrame([(1, "cough fever", 0.5), (2, "cold", 0.55), (3, "cough", 0.5)], "id int, text string, score double")
    assert ids(R.reranked(rows, ["cough", "fever"], "id")) == [1, 2, 3]


def test_groups(spark):
    rows = spark.createDataFrame([("a", k, float(k)) for k in range(4)] + [("b", 0, None)], "g string, k int, v double")
    assert sorted((r.g, r.k) for r in L.first_of_each(rows, ["g"], ["k"], 2).collect()) == [("a", 0), ("a", 1), ("b", 0)]
    assert sorted((r.g, r.progress) for r in L.progress(rows, ["g"], ["k"]).collect()) == [("a", 0.25), ("a", 0.5), ("a", 0.75), ("a", 1.0), ("b", 1.0)]
    assert sorted((r.k, r.t) for r in L.running_total(rows.filter("g = 'a'"), ["g"], ["k"], "v", "t").collect()) == [(0, 0.0), (1, 1.0), (2, 3.0), (3, 6.0)]
    assert {r.g: (r.n, r.over, r.avg_used) for r in L.usage(rows, "g", "v", 1).collect()} == {"a": (4, 2, 1.5), "b": (1, 0, 0.0)}


def test_summaries_of_nothing(spark):
    chunks = spark.createDataFrame([], "n int, type string")
    assert tuple(L.chunk_sizes(chunks, "n", kind="type").first()) == (0, 0, 0.0, None, None, 0, 0.0)
    some = spark.createDataFrame([(10, "semantic_section"), (2000, "regular")], "n int, type string")
    assert tuple(L.chunk_sizes(some, "n", kind="type").first()) == (2, 1, 50.0, 1005.0, 2000, 1, 50.0)


def test_tags(spark):
    kind = "k int, tag_zh string, tag_en string"
    tags = spark.createDataFrame([(k, "" if k == 1 else f"t{k}", "e") for k in range(120)], kind)
    assert len(ids(L.shown_tags(tags, "k"), "k")) == 100 and 1 not in ids(L.shown_tags(tags, "k"), "k")
    chunks = spark.createDataFrame([([("a", "x"), ("", "y")],), ([("a", "z")],), ([],)], "tags array<struct<tag_zh:string,tag_en:string>>")
    assert ids(L.tag_names(chunks), "tag_zh") == ["a"]


def test_ids_and_lists(spark):
    row = spark.range(1).select(X.short_id(F.lit("a"), F.lit("b")).alias("a"), X.short_id(F.lit("ab")).alias("b"), X.short_id().alias("c"), X.comma_list(F.lit(" 头痛, ,眩暈 ,")).alias("d")).first()
    assert len({row.a, row.b, row.c}) == 3 and all(len(x) == 8 for x in (row.a, row.b, row.c)) and row.d == ["头痛", "眩暈"]
