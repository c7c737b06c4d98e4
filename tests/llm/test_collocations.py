"""Phrases against counting every window in plain Python."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from millrace.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang if lang is not None else "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        cand = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in cand.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def cases():
    rng = random.Random(11)
    words = ["New", "york", "city", "é", "É", "of", "the", "a-b", "x" * 300, "\x00", "世界"]
    line = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(k))
    rows = [(k, line(rng.randint(1, 60)), rng.choice(["en", "de", None, "", "und"])) for k in range(150)]
    rows += [(1, None, "en"), (2, "", None), (3, "...", "en"), (4, "of the of the of the of the of the", "zz"), (None, "the end", "en"), (7, line(4000), "en")]
    return rows + rows[:30]


@pytest.mark.parametrize("shard", [C.SHARD, 500])
@pytest.mark.parametrize("least, longest, top", [(3, 5, 2000), (2, 3, 7), (40, 5, 50)])
def test_phrases_equal_brute_force(spark, shard, least, longest, top):
    docs = spark.createDataFrame(cases(), SCHEMA).selectExpr("*", "1 as n", "2 as phrase", "'z' as rank", "0 as c", "1 as pair")
    assert sorted(map(tuple, C.mined(docs, least, longest, top, shard).collect())) == brute(cases(), least, longest, top)


def test_empty_tables(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, " ,.", "en")], [(1, "one two three", "en")]):
        assert C.mined(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_pairs_that_are_let_through_by_mistake_change_nothing(spark, monkeypatch):
    """The filter of pairs only saves work: with all bits set the result is the same."""
    docs = spark.createDataFrame(cases(), SCHEMA)
    monkeypatch.setattr(C, "_filter", lambda pairs: np.full(1 << 10, 255, np.uint8))
    assert sorted(map(tuple, C.mined(docs, 4).collect())) == brute(cases(), 4, 5, 2000)


def test_products_beyond_64_bits(spark):
    """1000 a n and l r pass 64 bits, and the division is exact."""
    big = 3_000_000_007
    rows = [("en", 0, "", 10**13 + 7), ("en", 1, "x", big), ("en", 1, "y", big + 4), ("en", 2, "x y", big - 1)]
    got = C.scored(spark.createDataFrame(rows, "lang string, n int, phrase string, f long")).collect()
    assert [r.score for r in got] == [1000 * (big - 1) * (10**13 + 7) // (big * (big + 4))]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    ids, new = rng.integers(0, 3, 500), rng.random(500) < 0.1
    new[0] = True
    left = C.left_of(new)
    order, lcp = C.suffix_array(ids, left, 5)
    heads = [tuple(ids[i : i + min(5, left[i])]) for i in order]
    assert heads == sorted(heads) and sorted(order) == list(range(500))
    common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(heads, heads[1:])]
    assert lcp.tolist() == [0, *common]
