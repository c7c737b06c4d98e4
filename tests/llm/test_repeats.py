from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from millrace.llm import _common as C
from millrace.llm import suffixdedup, superkmer


def brute_bytes(rows, n=100):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen.setdefault(b[i : i + n], (d, i)) != (d, i):
                covered[i : i + n] = b"\1" * n
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((d, len(b), sum(covered), len([x for x in bytes(covered).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def brute_words(rows, n=35):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    counts = collections.Counter(tuple(w[i : i + n]) for _, w in split for i in range(len(w) - n + 1))
    out = []
    for d, w in split:
        covered = [0] * len(w)
        for i in range(len(w) - n + 1):
            if counts[tuple(w[i : i + n])] > 1:
                covered[i : i + n] = [1] * n
        out.append((d, len(w), sum(covered), hashlib.sha256(b" ".join(x for x, c in zip(w, covered) if not c)).hexdigest()))
    return collections.Counter(out)


def cases():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    base = " ".join(word() for _ in range(150))
    rows = [(None, base), (None, None), (1, ""), (2, base), (3, base), (4, passage), (5, "ab " * 300), (6, "ab " * 200 + "x"), (7, "a" * 700), (8, "é" * 400)]
    for k in range(9, 60):
        words = base.split()
        words[rng.randrange(len(words))] = word()
        own = " ".join(word() for _ in range(rng.randint(0, 80)))
        rows.append((k, rng.choice([" ".join(words), f"{own} {passage}\n{own[::-1]}", own, f"{passage} {passage}"])))
    rows.append((60, " ".join(word() for _ in range(20_000))))
    rows.append((61, rows[-1][1][500:90_000]))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), "doc_id long, text string").selectExpr("*", "'x' as did", "1 as h", "2 as sig", "3 as spans", "length(text) as n_chars")


@pytest.mark.parametrize("hot", [None, 2])
def test_bytes(docs, hot):
    got = collections.Counter(map(tuple, suffixdedup.removed_spans(docs, hot=hot).drop("kept").collect()))
    assert got == brute_bytes(cases())


@pytest.mark.parametrize("hot", [None, 2])
def test_words(docs, hot):
    assert collections.Counter(map(tuple, superkmer.digested(docs, hot=hot).collect())) == brute_words(cases())


def test_applied_changes_texts_only_where_words_go(docs):
    before = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    kept = superkmer.applied(docs)
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    removed = {d for d, _, n, _ in brute_words(cases()) if n}
    for r in kept.collect():
        assert r.doc_id in removed or (r.doc_id, r.text) in before
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.n_removed for r in superkmer.digested(df).collect()] == [50, 50]
    assert [r.n_removed for r in suffixdedup.removed_spans(df).collect()] == [0, 0]  # one document by its id


def test_empty(docs):
    assert superkmer.digested(docs.limit(0)).count() == 0 == suffixdedup.removed_spans(docs.limit(0)).count()


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(200):
        raw = bytes(rng.choice(b"aab\xff") for _ in range(rng.randint(0, 80)))
        data = np.frombuffer(raw, np.uint8)
        order = suffixdedup.suffix_array(data, 80)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        common = suffixdedup.common_prefixes(data, order, 30)
        for k in range(1, len(raw)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y or i == 30), min(len(a), len(b), 30))


def test_word_hashes_don_t_depend_on_place():
    data = np.frombuffer(b"ab cd ab\ncd  ab", np.uint8)
    starts, ends, of_text = C.words(data, np.array([0, 8, 15]), C.IS_WHITE)
    h = C.word_hashes(data, starts, ends)
    assert of_text.tolist() == [0, 3, 5] and h[0] == h[2] == h[4] != h[1] == h[3]


def periodic():
    rng = random.Random(5)
    rows = [(1, "ab" * 30_000), (2, "ab" * 20_000 + "x" + "ab" * 9_000), (3, "na " * 9_000), (4, "na " * 5_000 + "q " + "na " * 100), (5, "".join(rng.choice("xyz ") for _ in range(20_000)))]
    return [*rows, (6, rows[4][1][:9_000] + "ab" * 400), (7, "na na na " * 40)]


@pytest.mark.parametrize("hot", [None, 2])
def test_periodic_texts(spark, hot):
    df = spark.createDataFrame(periodic(), "doc_id long, text string")
    assert collections.Counter(map(tuple, suffixdedup.removed_spans(df, hot=hot).drop("kept").collect())) == brute_bytes(periodic())
    assert collections.Counter(map(tuple, superkmer.digested(df, hot=hot).collect())) == brute_words(periodic())


def test_super_kmers_have_a_longest():
    from millrace.llm import _repeats

    raw = np.frombuffer(b"ab" * 500_000, np.uint8)
    runs = [r for part in suffixdedup.byte_windows().anchors(raw, np.array([0, len(raw)])) for r in zip(part[1].tolist(), part[2].tolist(), part[5].tolist())]
    assert max(n for _, n, _ in runs) <= _repeats.LONGEST and max(b for _, _, b in runs) <= _repeats.LONGEST + 99
    assert sorted(k for s, n, _ in runs for k in (s, s + n)) == sorted([0, len(raw) - 99, *[k for s, _, _ in runs for k in (s, s) if s]])


def test_minimisers_of_parts(monkeypatch):
    from millrace.llm import _repeats

    h = C.mixed(np.arange(500, dtype=np.uint64) % np.uint64(37))
    want = [i + int((h[i : i + 9] >> np.uint64(24)).argmin()) for i in range(492)]
    assert _repeats.minimisers(h, 9).tolist() == want
    monkeypatch.setattr(_repeats, "PLACES", 64)
    assert _repeats.minimisers(h, 9).tolist() == want


def test_texts_of_one_signature_are_compared():
    import pyarrow as pa

    from millrace.llm import _repeats

    batch = pa.RecordBatch.from_pydict({"did": [3, 1, 2, 0], "sig": [7, 7, 7, 7], "text": ["a", "a", "b", "a"]})
    left = _repeats.without_copies(batch).to_pydict()
    assert set(zip(left["did"], left["text"])) >= {(0, "a"), (2, "b")} and len(left["did"]) < 4


@pytest.mark.parametrize("most", [0, 1 << 16])
def test_hot_windows_are_joined_or_looked_up(spark, monkeypatch, most):
    from millrace.llm import _repeats

    monkeypatch.setattr(_repeats, "MOST_SEEN", most)
    df = spark.createDataFrame(cases()[:45], "doc_id long, text string")
    assert collections.Counter(map(tuple, suffixdedup.removed_spans(df, hot=1).drop("kept").collect())) == brute_bytes(cases()[:45])
    assert collections.Counter(map(tuple, superkmer.digested(df, hot=1).collect())) == brute_words(cases()[:45])


def in_one_line(n=300):
    """A line that all texts have, between words of their own; some texts have more in common."""
    rng = random.Random(5)
    own = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line = own(80)
    rows = [(k, f"{own(150)}{line}{own(150)}") for k in range(n)]
    return [*rows, *[(n + k, own(40) + rows[k][1][60 + k % 40 : 300 - k % 30] + own(60)) for k in range(0, n, 10)]]


def test_strings_of_one_minimiser_are_cut_again_before_their_windows(spark, monkeypatch):
    from millrace.llm import _repeats

    digested, pieces = [], []
    real, kind = _repeats.map_batches, suffixdedup.byte_windows()
    monkeypatch.setattr(_repeats, "map_batches", lambda df, f, schema, *more: ((digested if schema.startswith("w binary") else pieces if "s binary" in schema else []).append(df), real(df, f, schema, *more))[1])
    df = spark.createDataFrame(in_one_line(), "doc_id long, text string")
    assert collections.Counter(map(tuple, suffixdedup.removed_spans(df, hot=50).drop("kept").collect())) == brute_bytes(in_one_line())
    assert len(pieces) >= 2 and not digested  # before: a row for each window of each string
    data = b"".join(t.encode() for _, t in in_one_line()[:2])
    offsets = np.array([0, len(in_one_line()[0][1]), len(data)])
    want = {(t, k) for t in (0, 1) for k in range(offsets[t + 1] - offsets[t] - 99)}
    for anchors in (kind.anchors, *kind.finer):
        got = [(t, k) for part in anchors(data=np.frombuffer(data, np.uint8), offsets=offsets) for t, s, n in zip(*(x.tolist() for x in part[:3])) for k in range(s, s + n)]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("gram", [32, 66, 83])
def test_hashes_of_grams_of_any_length(gram):
    rng = np.random.default_rng(1)
    data = np.tile(rng.integers(0, 4, 120).astype(np.uint8), 3)
    h = suffixdedup.gram_hashes(data, gram)
    assert len(h) == len(data) - gram + 1 and h[:120].tolist() == h[120:240].tolist() and len(set(h[:120].tolist())) == 120
