from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, queries, toxicity


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert held.n > 200 and held.right >= 0.99 and 0 <= held.lo <= held.hi <= 1


def lang_rows():
    rows = [(k, f"the cat sat on the mat {k} with hats", "en") for k in range(40)] + [(100 + k, f"der hund und die katze {k} schlafen", "de") for k in range(40)]
    return [*rows, (None, "the mat", None), (1, "the cat", "en"), (900, None, "en"), (901, "", "en"), (902, "12 34 !!", "de"), (903, "世界", "zh"), (904, "die katze " * 20_000, None)]


def test_language_edges(spark):
    docs = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string").selectExpr("*", "1 as score", "true as held_out", "'q' as read")
    got = {r.doc_id: r for r in langid.identify(docs, F.col("doc_id") % 4 == 2).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "de" and got[None].lang_pred == "en"
    assert got[None].held_out is False and got[2].held_out and got[2].lang_pred == "en"
    assert langid.identify(docs.limit(0), F.lit(False)).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_held_out_labels_are_not_used(spark):
    docs = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string")
    held = F.col("doc_id") % 4 == 2
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert sorted(map(str, langid.identify(docs, held).collect())) == sorted(map(str, langid.identify(other, held).collect()))


def test_toxicity_of_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out")
    r = got.agg(F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)).alias("tp"), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1)).alias("fp"), F.sum("toxic").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.tp / r.n >= 0.8 and r.tp / (r.tp + r.fp) >= 0.95 and 0 <= r.lo <= r.hi <= 1


def tox_tables(spark):
    rows = [(k, ("you idiot, " if k % 4 == 0 else "kind words ") + f"and more text {k % 7}") for k in range(200)]
    rows += [(900, None), (901, ""), (None, "you idiot"), (3, rows[3][1]), (902, "you idiot " * 30_000)]
    labels = [(k, 1 if k % 4 == 0 else 0) for k in range(200)] + [(900, None), (None, 1), (3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as predicted", "'z' as row", "0 as toxic")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'no' as text")


def test_toxicity_edges(spark):
    docs, labels = tox_tables(spark)
    held = F.col("doc_id") % 3 == 1
    got = toxicity.report(docs, labels, held)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].predicted == 1 and by[4].held_out and by[None].predicted == 1 and by[902].predicted == 1
    assert all(by[k].predicted == 0 for k in (3, 7, 900, 901))
    kept = toxicity.accepted(docs, labels, held)
    assert kept.columns == docs.columns and kept.count() == got.filter("predicted = 0").count()
    assert toxicity.report(docs.limit(0), labels, held).count() == 0
    assert {r.score for r in toxicity.report(docs, labels.limit(0), held).collect()} == {0.0}
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, toxicity.report(docs, flipped, held).collect())) == sorted(map(str, got.collect()))


def test_isotonic_is_monotone():
    steps, chance = toxicity.isotonic(np.array([1, 2, 3, 4, 4, 5.0]), np.array([0, 1, 0, 1, 1, 1.0]))
    assert steps.tolist() == [1, 3, 5] and chance.tolist() == [0, 0.5, 1]


def test_trees_learn_a_threshold():
    x = np.random.default_rng(0).random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((toxicity.boosted(x, y).raw(x) > 0) == y).mean() > 0.95


@pytest.mark.parametrize("raw", [b"", b" ", "é".encode(), b"YOU IDIOT!!! 1d10t", b"a" * 100_000])
def test_features_are_finite(raw):
    assert len(toxicity.features(raw, frozenset(), frozenset())) == len(toxicity.FEATURES)
    assert np.isfinite(toxicity.features(raw, frozenset(), frozenset())).all()
