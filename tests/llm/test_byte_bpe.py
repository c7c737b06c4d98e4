"""Cuts at spaces: where the pattern allows them, and that ids don't depend on them."""

from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest

from millrace.llm import bytebpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("pattern, cuts", [(P.PATTERN, True), (r" ?\p{L}+| ?\p{N}+|\s+", False), (r"\s+| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+", False), (P.PATTERN + r"|\p{L}+ \p{L}+", False), (r"[^ ]+ ?", False)])
def test_cuts_follow_from_the_pattern(pattern, cuts):
    assert bytebpe.cuts_at_spaces(pattern) is cuts


@pytest.mark.parametrize("cuts", [True, False])
@pytest.mark.parametrize("cache", [bytebpe.CACHE, 3])
def test_ids_equal_tiktoken(monkeypatch, cuts, cache):
    import tiktoken

    monkeypatch.setattr(bytebpe, "CACHE", cache)
    table = bytebpe.ByteBpe(RANKS, P.PATTERN)
    table.cuts = cuts
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    pieces = ["word", "don't", "é", "世界", "😀", "1234", "\n", " ", "  ", "\t", "\x85", " ", " ", "\x1c", "...", "a" * 200, "x,", "'s", "Ａ", "é", "<|endoftext|>", "᠎", "\x00"]
    texts = ["", " ", "a", " a", "a ", *(" ".join(rng.choice(pieces) + rng.choice(["", "", rng.choice(pieces)]) for _ in range(rng.randint(1, 12))) for _ in range(1500))]
    for some in (texts[:700], texts[700:]):
        for text, raw in zip(some, table.packed(some), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == want.encode_ordinary(text)
            assert table.decode(np.frombuffer(raw, "<u4")) == text.encode()
    assert all(len(u) <= 64 for u in table.units)
