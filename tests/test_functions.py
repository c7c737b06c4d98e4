from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [("　x　", "x"), ("\x1c a b\x85\n", "a b"), ("", ""), (" \t", "")])
def test_strip(spark, text, want):
    assert value(spark, X.strip(F.lit(text))) == want == text.strip()


@pytest.mark.parametrize(("zh", "en", "want"), [(" 咳 ", "cough", "咳 / cough"), ("咳", "", "咳"), (None, "cough", "cough"), ("", None, "")])
def test_bilingual(spark, zh, en, want):
    assert value(spark, X.bilingual(F.lit(zh).cast("string"), F.lit(en).cast("string"))) == want


def test_name_keys(spark):
    assert value(spark, X.name_keys(F.lit("咳嗽（ Cough ）/ x"), F.lit("咳嗽"), F.lit(" COUGH"))) == ["咳嗽（ cough ）/ x", "咳嗽", "cough", "x"]


@pytest.mark.parametrize(("text", "sub"), [("a.b.c", "."), ("abc", "."), ("x\n\ny\n\nz", "\n\n"), ("", ".")])
def test_rfind(spark, text, sub):
    got = value(spark, X.rfind(F.lit(text), sub))
    assert (-1 if got is None else got) == text.rfind(sub)


def test_halves_lose_the_middle(spark):
    zh, en = X.halves(F.lit("a / b / c"))
    assert (value(spark, zh), value(spark, en)) == ("a", "c")


@pytest.mark.parametrize(("text", "want"), [('{"a":1}', 1), ('text {"a":2} text', 2), ("no json", None), ("{broken", None)])
def test_lenient_json(spark, text, want):
    assert value(spark, X.lenient_json(F.lit(text), "struct<a:int>")["a"]) == want


@pytest.mark.parametrize(("path", "stem", "suffix"), [("in/a.b.TXT", "a.b", ".txt"), ("plain", "plain", ""), ("d/.hidden", ".hidden", "")])
def test_paths(spark, path, stem, suffix):
    assert (value(spark, X.stem(F.lit(path))), value(spark, X.suffix(F.lit(path)))) == (stem, suffix)


def test_ids(spark):
    assert value(spark, X.numbered_id("symp", F.lit(7))) == "symp-0007"
    assert value(spark, X.id_number(F.lit("symp-0007"))) == 7
    assert value(spark, X.id_number(F.lit("symp-x"))) is None


@pytest.mark.parametrize(("a", "b", "want"), [([], [1.0], 0.0), (None, [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 2.0], 0.0), ([1.0, 0.0], [2.0, 0.0], 1.0)])
def test_cosine_guards(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b")).alias("v")).first().v == want


def test_weighted_divides_by_all_positive_weights(spark):
    there, gone = (F.lit(0.8), F.lit(True)), (F.lit(0.9), F.lit(False))
    assert value(spark, V.weighted({"a": there, "b": gone}, {"a": 0.5, "b": 0.5, "c": 0.0})) == pytest.approx(0.4)
    assert value(spark, V.weighted({"a": gone}, {"a": 1.0})) is None
