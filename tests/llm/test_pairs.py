from __future__ import annotations

import collections
import hashlib
import re

import pytest
from conftest import oracle_rows, rows_of

from millrace.llm import decontam, jaccard, queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    names, want = oracle_rows(duck, sql.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    key = lambda d: (d is not None, d)
    root = {key(d): key(d) for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(key(rows[i][0])), find(key(rows[j][0]))))
                root[y] = x
    return collections.Counter((d, len(s), find(key(d))[1]) for (d, _), s in zip(rows, sets))


def pair_cases():
    base = [f"w{i % 41}{i}" for i in range(80)]
    rows = [(1, " ".join(base)), (1, " ".join(base)), (5, " ".join(base)), (None, " ".join([*base, "x"])), (2, None), (3, ""), (4, "a b"), (6, "A b"), (7, " ".join(base[:40])), (7, "a b"), (9, "é b"), (8, " \n")]
    rows += [(20 + k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 80, 3)]
    rows += [(100 + k, " ".join(base[k:] + [f"t{j}" for j in range(k)])) for k in range(0, 40, 2)]  # a chain of similar ones
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(pair_cases(), "doc_id long, text string").selectExpr("*", "1 as did", "'s' as sig", "2 as t", "3 as n", "4 as root")


def test_components(docs):
    assert collections.Counter(map(tuple, jaccard.report(docs).collect())) == components(pair_cases())


def test_one_of_each_component_is_kept(docs):
    """Each distinct id and text is a document of its own, so two unlike texts of one id both stay."""
    kept = jaccard.kept(docs)
    assert kept.columns == docs.columns
    own = list(dict.fromkeys((d, t or "") for d, t in pair_cases()))
    order = sorted(range(len(own)), key=lambda i: (own[i][0] is not None, own[i][0] or 0))
    groups = collections.defaultdict(list)
    for i, _, root in components([(k, own[i][1]) for k, i in enumerate(order)]):
        groups[root].append(own[order[i]])
    got = collections.Counter((r.doc_id, r.text or "") for r in kept.collect())
    assert sum(got.values()) == len(groups) == len(got)
    assert collections.Counter(d for d, _ in got) == collections.Counter(g[0][0] for g in map(lambda g: sorted(g, key=lambda x: (x[0] is not None, x[0] or 0)), groups.values()))
    assert {t for d, t in got if d == 7} == {t for d, t in own if d == 7 and t != "a b"}  # "a b" is like the text of id 4
    assert all(sum(x in g for x in got) == 1 for g in groups.values())


def test_unlike_texts_of_one_id_are_kept(spark):
    text = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(2)), (1, text(1) + " more"), (2, text(2) + " more"), (2, text(3)), (2, text(3)), (2, None)]
    got = collections.Counter((r.doc_id, (r.text or "").split("x")[0]) for r in jaccard.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, "1"): 1, (1, "2"): 1, (2, "3"): 1, (2, ""): 1}


def test_texts_of_null_ids_are_kept(spark):
    text = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0)), (None, text(1) + " more"), (3, text(2)), (4, text(3) + " more"), (5, text(9)), (None, None), (None, "a b")]
    got = jaccard.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    short = collections.Counter((r.text or "").split("x")[0] for r in got)
    assert short == collections.Counter({**{str(k): 1 for k in range(6)}, "9": 1, "": 1, "a b": 1})
    assert [r.doc_id for r in got if r.doc_id is not None] == [5]


def test_verification_uses_exact_counts():
    import numpy as np

    x = np.arange(100, dtype=np.uint64)
    assert jaccard.similar(x, x[:80], 80) and not jaccard.similar(x, x[:79], 80)
    assert not jaccard.similar(x[:0], x[:0], 80)


def windows(rows, items, n=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    found = collections.defaultdict(set)
    for item, t in items:
        w = split(t)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m and item is not None else 0):
            found[tuple(w[i : i + m])].add(str(item))
    out = []
    for d, t in rows:
        w = split(t)
        hit, names = [0] * len(w), set()
        for m in {len(k) for k in found}:
            for i in range(len(w) - m + 1):
                if own := found.get(tuple(w[i : i + m])):
                    names |= own
                    hit[i : i + m] = [1] * m
        out.append((d, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(names)))
    return collections.Counter(out)


ITEMS = [(1, " ".join(f"q{i}" for i in range(14))), (2, "One"), (3, "two words"), (10, "q3 q4 q5 Q6 q7 q8 q9 q10 q11 q12"), (4, None), (5, ""), (None, "lost item of four words"), (1, "again q0"), (6, "a a a a a a a a a a a")]
TEXTS = [(1, " ".join(f"Q{i}," for i in range(30))), (2, "one ONE two  words"), (None, "a " * 25), (3, None), (4, ""), (4, ""), (5, "clean text of seven good words here"), (6, "a-b " * 3000 + "one")]


@pytest.mark.parametrize("block", [1 << 24, 20])
def test_decontamination(spark, block):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as row", "2 as items", "'y' as starts", "0 as n_words")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = collections.Counter(map(tuple, decontam.report(docs, items, block_bytes=block).collect()))
    assert got == windows(TEXTS, ITEMS)
    kept = decontam.clean(docs, items, block_bytes=block)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w, n in windows(TEXTS, ITEMS).items() for _ in range(n) if not w[5]), key=str)
    assert decontam.report(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(docs.limit(0), items).count() == 0
