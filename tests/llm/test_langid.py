"""Language ID against a kernel by sets of n-grams, and its training sample."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid

MARKS = ["the cat sat", "der hund und é", "世界 the", "ааб ба"]
SCHEMA = "doc_id long, text string, lang string"


def grams(symbols):
    return {symbols[i : i + n] for n in (1, 2, 3) for i in range(len(symbols) - n + 1)}


@pytest.mark.parametrize("dense", [langid.DENSE, 0])
@pytest.mark.parametrize("table", [langid.TABLE, 0])
def test_kernel_equals_sets_of_grams(monkeypatch, table, dense):
    monkeypatch.setattr(langid, "TABLE", table)
    monkeypatch.setattr(langid, "DENSE", dense)
    blank = lambda t: "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
    model = langid.from_landmarks(["x"], [np.unique(langid.grams_of(langid.letters_of(t), langid.POINTS)) for t in MARKS])
    known, letters = set().union(*(grams(blank(t)) for t in MARKS)), {c for t in MARKS for c in blank(t)}
    for text in [*MARKS, "The hund 世 xyz zz", "q", "12", "a\U00010330b"]:
        own = grams("".join(c if c in letters else "\1" for c in blank(text))) & known
        want = [len(own & grams(blank(t))) / np.sqrt(max(len(own), 1) * len(grams(blank(t)))) for t in MARKS]
        assert np.allclose(langid.kernel(model, [text])[0], want, atol=1e-6)


def marks_of(texts):
    return [np.unique(langid.grams_of(langid.letters_of(t), langid.POINTS)) for t in texts]


def test_regression_equals_an_exact_solve():
    """Nystroem features and ridge regression, from kernels by sets of grams and the dual form, give the same scores."""
    rng = np.random.default_rng(6)
    word = lambda abc: "".join(rng.choice(list(abc), rng.integers(2, 6)))
    texts = [" ".join(word(abc) for _ in range(12)) for abc in ("abcde", "defgh", "xyzab") for _ in range(15)]
    labels = [lang for lang in "pqr" for _ in range(15)]
    marks, new = texts[::4], [texts[3][:20], texts[20][5:], "abc xyz"]
    model = langid.from_landmarks(["p", "q", "r"], marks_of(marks))
    model = langid.fitted(model, labels, langid.kernel(model, texts))
    known = set().union(*(grams(f" {t} ") for t in marks))

    def exact(a, b):
        return np.array([[len((x := grams(f" {s} ") & known) & (y := grams(f" {t} ") & known)) / np.sqrt(len(x) * len(y)) for t in b] for s in a])

    values, vectors = np.linalg.eigh(exact(marks, marks))
    x, z = (exact(t, marks) @ vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()]) for t in (texts, new))
    y = np.where(np.array(labels)[:, None] == np.array(list("pqr")), 1.0, -1.0)
    middle = x.mean(0)
    dual = np.linalg.solve((x - middle) @ (x - middle).T + langid.RIDGE * len(x) * np.eye(len(x)), y - y.mean(0))
    assert np.allclose(langid.score(model, new), (z - middle) @ (x - middle).T @ dual + y.mean(0), atol=1e-3)


def test_landmarks_fit_into_memory():
    """2,048 landmarks of 20,000 Chinese letters each: what is chosen of them, and the model made of it, stay within 1 GB."""
    import tracemalloc

    sizes = {("zh", k): 40_000 + k for k in range(2048)}
    few = langid.within(sizes, langid.GRAMS)
    assert sum(sizes[k] for k in few) <= langid.GRAMS < sum(sizes.values()) and few == sorted(few)
    assert langid.within({("a", 1): 10**9, ("b", 2): 5, ("b", 3): 7}, 24) == [("a", 1), ("b", 2), ("b", 3)]
    rng = np.random.default_rng(8)
    marks = []
    while sum(map(len, marks)) < langid.GRAMS // 8:  # an eighth of what is chosen
        marks.append(np.unique(langid.grams_of(rng.integers(0x4E00, 0x9FFF, 20_000), langid.POINTS)))
    tracemalloc.start()
    model = langid.from_landmarks(["zh"], marks)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert 8 * peak < 1 << 30 and 8 * held < 1 << 29
    assert np.allclose(np.diag(model.own), 1, atol=1e-5)


def test_long_texts_are_learned_from(spark):
    """A language that has only long texts is learned as others are, and rare scripts keep their letters."""
    rows = [(k, f"der hund und die katze {k} schlafen " * 800, "de") for k in range(20)] + [(100 + k, f"the cat sat on the mat {k}", "en") for k in range(20)]
    rows += [(200 + k, "".join(chr(0x4E00 + (37 * k + 11 * i) % 400) for i in range(60)), "zh") for k in range(40)] + [(300 + k, "".join(chr(0xAC00 + (41 * k + 13 * i) % 400) for i in range(60)), "ko") for k in range(40)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect()
    want = {d: lang for d, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got)


def test_copies_are_one_training_text(spark):
    rows = [(k % 3, "the cat sat on the mat", "en") for k in range(500)] + [(600 + k, f"a cat {k}", "en") for k in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).select("lang", F.xxhash64("text").alias("sig"), "doc_id", F.length("text").cast("long").alias("bytes"))
    got = langid.training_rows(df, 5)
    assert len(got) == 5 == len({sig for _, sig, _, _ in got})
    assert got == sorted(set(langid.training_rows(df.repartition(3), 5)))
    assert len(langid.training_rows(df, 100)) == 11


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLES", 6)
    monkeypatch.setattr(langid, "ALL_LANDMARKS", 3)
    rows = [(10 * k + j, f"{word} {word}{j}", word) for k, word in enumerate(["abc", "def", "ghi"]) for j in range(4)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA), F.lit(False)).collect()
    assert [r.lang_pred for r in sorted(got)] == [w for w in ("abc", "def", "ghi") for _ in range(4)]
