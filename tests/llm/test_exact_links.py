"""Links are decided by words, whatever the hashes say."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from test_pairs import components

from millrace.llm import _common as C
from millrace.llm import jaccard

SCHEMA = "doc_id long, text string"


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def report(spark, rows):
    return collections.Counter(map(tuple, jaccard.report(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_words_that_collide_under_polynomial_hashes(spark):
    rows = [(k, thue_morse(1024, *pair)) for k, pair in enumerate(["ab", "ba"], 1)] + [(k, f"x y {thue_morse(2048, *p)} z u v w") for k, p in enumerate(["ab", "ba"], 3)]
    assert report(spark, rows) == components(rows)
    assert len({root for _, _, root in report(spark, rows)}) == 4


def test_word_hashes():
    words = [b"a" * k for k in range(1, 140)] + [b"a" * k + b"b" for k in range(0, 140)] + [bytes([k]) for k in range(33, 97)] + [b"\xc3\xa9" * 40, b"\xc3\xa9" * 41]
    data = np.frombuffer(b" ".join(words + words[::-1]), np.uint8)
    starts, ends, _ = C.words(data, np.array([0, len(data)]), C.IS_WHITE)
    h = C.word_hashes(data, starts, ends).tolist()
    assert h[: len(words)] == h[len(words) :][::-1] and len(set(h)) == len(set(words))


def test_words_decide_when_hashes_collide():
    """Where hashes make two different texts look similar, the words still keep them apart."""
    s, t = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    assert jaccard.similar(np.arange(26, dtype=np.uint64), np.arange(26, dtype=np.uint64), 80)
    assert not jaccard.really_similar(s, t, 5, 80) and jaccard.really_similar(s, s.upper(), 5, 80) and not jaccard.really_similar("", "", 5, 80)


@pytest.mark.parametrize("one, other", [("licenseddocument", "txpkwjlv){`%$j-["), ("licenseddocument and more words here", "txpkwjlv){`%$j-[ and more words here")])
def test_words_of_one_hash(spark, one, other):
    """Two words whose unkeyed hashes are equal: the texts share nothing, or too little, and stay apart."""
    raw = np.frombuffer(f"{one.split()[0]} {other.split()[0]}".encode(), np.uint8)
    starts, ends, _ = C.words(raw, np.array([0, len(raw)]), C.IS_WHITE)
    assert len(set(C.word_hashes(raw, starts, ends).tolist())) == 1
    assert len(set(C.word_hashes(raw, starts, ends, 12345).tolist())) == 2
    rows = [(1, one), (2, other), (3, f"{one} {other}")]
    assert report(spark, rows) == components(rows)
    assert {r[2] for r in report(spark, rows)} == {1, 2, 3}


def test_sets_fold_by_words(spark):
    """Equal sets of other word orders aren't folded, but linked as any similar texts."""
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(1, base), (2, f"  {base.upper()} "), (3, f"{base} {base}"), (4, f"{base} {base} {base}"), (5, " ".join(f"w{i}" for i in range(29, -1, -1)))]
    assert report(spark, rows) == components(rows)


def test_one_id_with_many_texts(spark):
    """An id joins the components of all its texts, not only of two."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(20))
    rows = [(k, text(k)) for k in (1, 2, 3, 4)] + [(9, text(k)) for k in (1, 2, 3, 4)] + [(9, text(8)), (10, text(8)), (11, text(7))]
    assert {r[2] for r in report(spark, rows) if r[0] != 11} == {1}
    assert {r[2] for r in report(spark, rows) if r[0] == 11} == {11}


def test_very_long_and_empty(spark):
    long = " ".join(f"w{i % 9973}x{i}" for i in range(120_000))
    rows = [(1, long), (2, long + " more"), (3, "é" * 500_000), (4, "é" * 500_000 + " b"), (5, None)]
    assert report(spark, rows) == components(rows)
    assert jaccard.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tokens_of_many_components(spark):
    """Unlike texts that share frequent shingles, some of them near copies."""
    import random

    rng = random.Random(1)
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(25)]
    rows = [(k, " ".join(rng.sample(lines, 6))) for k in range(120)]
    rows += [(1000 + k, t + (" tail" if k % 2 else "")) for k, t in rows[:30]]
    assert report(spark, rows) == components(rows)


def test_nothing_is_left_behind(spark):
    from millrace.llm import _common

    before = len(_common._written)
    text = " ".join(f"w{i}" for i in range(60))
    jaccard.report(spark.createDataFrame([(1, text), (2, text + " x"), (3, "other")], SCHEMA)).collect()
    assert len(_common._written) - before == 1  # what the result reads
