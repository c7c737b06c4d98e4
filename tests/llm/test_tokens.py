from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from millrace.llm import bytebpe, tokencount

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
ODD = list("ab c\n  ▁\tÉ<s>0x世é\r　😀.'t") + ["\x00", " ", "\x85", "<0x0A>", "</s>", "word ", "Ａ"]


def texts(n=4000):
    rng = random.Random(5)
    return [None, "", " ", "\n", "x" * 5000, " ".join(["long"] * 30000)] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k else None, t) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[7]], "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as ids", "3 as n_tokens")


def test_counts_equal_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = tokencount.count_tokens(docs, MODEL, 100).collect()
    assert len(got) == docs.count()
    want = {k if k else None: len(sp.encode(t or "")) for k, t in enumerate(texts())}
    assert all((r.n_tokens, r.over_limit) == (want[r.doc_id], want[r.doc_id] > 100) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {k if k else None: len((t or "").encode()) for k, t in enumerate(texts())}


def test_whole_tokens_are_proved():
    c = tokencount.counter(MODEL)
    assert c.cuts and len(c.whole) > 10_000
    assert all(len(c.sp.encode(s)) == 1 for s in list(c.whole)[1:500])


def test_round_trip_equals_tiktoken(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bytebpe.round_trip(docs, RANKS, P.PATTERN).collect():
        t = TEXTS[r.doc_id or 0] or ""
        ids = e.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


TEXTS = texts()


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "a 世😀 b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bytebpe.encode(df, RANKS, P.PATTERN).collect()}
    assert rows[2].ids == [] and rows[1].starts[0] == 0 and max(rows[1].ends) == 6
    back = {r.doc_id: r.text for r in bytebpe.decode(spark.createDataFrame([(1, rows[1].ids), (3, None)], "doc_id long, ids array<int>"), RANKS, P.PATTERN).collect()}
    assert back == {1: "a 世😀 b", 3: ""}
    half = next(i for i, b in enumerate(bytebpe.tokenizer(RANKS, P.PATTERN).bytes_of) if b == b"\xe4")
    assert bytebpe.decode(spark.createDataFrame([(1, [half])], "doc_id long, ids array<int>"), RANKS, P.PATTERN).first().text == "�"


def test_empty(docs):
    assert tokencount.count_tokens(docs.limit(0), MODEL).count() == 0 == bytebpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count()
