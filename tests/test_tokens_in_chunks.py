"""Chunkers with a real tokeniser: oversize chapters and sections are found by its counts."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from millrace.functions import tokens
from millrace.operators import chunking

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
BOOK = "#CHAPTER\nOne\n#SECTION\nA\n" + "word " * 30 + "\n#SECTION\nB\n" + "ééé世界 " * 30 + "\n#CHAPTER\nTwo\nshort\n#SECTION\nC\nlast"


def counted_by_hand(texts):
    e = tokens._encoding(RANKS, tokens.CHAT_PATTERN)
    return [len(e.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("method", ["semantic_chapter", "semantic_section", "hybrid"])
@pytest.mark.parametrize("most", [20, 60, 120, 10_000])
def test_counts_are_those_of_the_tokeniser(spark, method, most):
    docs = spark.createDataFrame([(1, BOOK), (2, None), (3, ""), (4, "no marker")], "doc_id long, text string")
    rows = chunking.chunked(docs, ["doc_id"], method, tokenizer=tokens.by_ranks(RANKS), max_tokens=most).collect()
    whole = [r for r in rows if r.preserved_complete]
    assert [r.token_count for r in whole] == counted_by_hand([r.text for r in whole])
    assert all(r.token_count <= most for r in whole) and all(r.token_count is None for r in rows if not r.preserved_complete)
    assert {r.doc_id for r in rows} == {1, 4} and any(r.doc_id == 1 for r in rows)
    assert (most == 10_000) == (not any("Part" in r.title for r in rows if r.doc_id == 1)) or most == 120


def test_methods_can_be_added(spark, monkeypatch):
    monkeypatch.setitem(chunking.METHODS, "whole", chunking.METHODS["regular"])
    chunking.register("whole", lambda text, size, **_: F.array(chunking._chunk(F.left(text, F.lit(size)), F.lit("whole"), F.lit("t"), F.lit(""), F.lit(""), F.lit(0), F.lit(True))), 3)
    docs = spark.createDataFrame([("abcdef",)], "text string")
    assert [r.text for r in chunking.texts_of(docs, "whole").collect()] == ["abc"]
    with pytest.raises(ValueError):
        chunking.texts_of(docs, "none")


def test_texts_alone(spark):
    docs = spark.createDataFrame([(BOOK,)], "text string")
    assert [r.text[:12] for r in chunking.by_chapters(docs).collect()] == ["#CHAPTER\nOne", "#CHAPTER\nTwo"]
    assert len(chunking.by_sections(docs).collect()) == 3
