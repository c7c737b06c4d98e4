"""Token counts by a real tokeniser. Chunkers are expressions, which a tokeniser can't be part of: the texts that they may ask
about are counted before, in Arrow batches, and looked up by a hash of the text."""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Counter = Callable[[Sequence[str]], Sequence[int]]

#: How the tokeniser of common chat models parts a text before it merges (fixed value).
CHAT_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def by_ranks(rank_path: str, pattern: str = CHAT_PATTERN) -> Counter:
    """A counter made from a rank file, which executors must be able to read; special tokens inside texts are text."""
    return lambda texts: [len(ids) for ids in _encoding(rank_path, pattern).encode_ordinary_batch(list(texts), num_threads=1)]


def counted(texts: Column, count: Counter) -> Column:
    """Map from the hash of each of the texts (an array of distinct ones) to its tokens."""

    @F.pandas_udf("array<int>")
    def run(lists: pd.Series) -> pd.Series:
        flat = [t for own in lists for t in (own if own is not None else ())]
        found = iter(list(count(flat)) if flat else [])
        return pd.Series([[int(next(found)) for _ in (own if own is not None else ())] for own in lists])

    return F.map_from_arrays(F.transform(texts, lambda t: F.xxhash64(t)), run(texts))


def looked_up(counts: Column) -> Callable[[Column], Column]:
    return lambda text: F.try_element_at(counts, F.xxhash64(text))
