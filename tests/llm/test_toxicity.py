"""Held-out recall, brute-force features, and rows that are repeated without end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import queries, toxicity


def test_recall_of_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out")
    r = got.agg(F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)).alias("tp"), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1)).alias("fp"), F.sum("toxic").alias("n")).first()
    assert r.tp / r.n >= 0.9 and r.tp / (r.tp + r.fp) >= 0.95


def test_weights_of_words():
    w = toxicity.Weights({b"bad": 2.0, b"badword ": 3.0, b"abcdef": 1.5})
    assert [w[x] for x in (b"bad", b"badly", b"badword", b"badwords", b"abcdef", b"abcdefg")] == [0.0, 2.0, 3.0, 2.0, 0.0, 1.5]
    x = dict(zip(toxicity.FEATURES, toxicity.features(b"badword ok badly badly", frozenset(), frozenset(), w)))
    assert (x["weight"], x["weight_rate"], x["first_weight"], x["second_weight"], x["third_weight"]) == (5.0, 7 / 4, 3.0, 2.0, 0.0)


def test_insults_near_you_count_without_labels():
    x = dict(zip(toxicity.FEATURES, toxicity.features(b"you are an idiot " + b"word " * 20 + b"moron", frozenset(), frozenset())))
    assert x["near_you"] == 1
    many = dict(zip(toxicity.FEATURES, toxicity.features(b"you idiot " * 300 + b"word " * 20 + b"moron", frozenset(), frozenset())))
    assert many["near_you"] == 300


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k % 6}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, F.lit(False)).count() == 3


def test_lexicons_equal_a_count_by_hand(spark):
    rows = [(k, f"insulting{k % 3} word" if k % 2 else f"word kind{k % 5}", k % 2, k % 4 // 2) for k in range(60)]
    got = toxicity.learned(spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int"))
    for fold, folds in enumerate([(0,), (1,), (0, 1)]):
        texts = [({t for w in text.encode().split() for t in toxicity.tokens_of(w)}, y) for _, text, y, f in rows if f in folds]
        n = [sum(y == k for _, y in texts) for k in (0, 1)]
        want = {}
        for t in set().union(*(s for s, _ in texts)):
            good, bad = (sum(t in s and y == k for s, y in texts) for k in (0, 1))
            if bad >= 5 and (w := np.log((bad + 0.5) / (n[1] + 1)) - np.log((good + 0.5) / (n[0] + 1))) >= 1.5:
                want[t] = w
        assert got.weights[fold].of_token.keys() == want.keys() and all(abs(got.weights[fold].of_token[t] - w) < 1e-9 for t, w in want.items())
        assert got.words[fold] == {t[:-1] for t in want if t.endswith(b" ")} and got.stems[fold] == {t for t in want if len(t) == 5 and not t.endswith(b" ")}
