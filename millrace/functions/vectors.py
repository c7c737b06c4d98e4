"""Vector functions over ARRAY<DOUBLE>. A null or empty vector is a missing one."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def present(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)) > 0


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for missing vectors, unequal lengths and zero norms. Norms may be given, if stored."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    usable = present(a) & present(b) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(usable, F.try_divide(dot(a, b), length)), F.lit(0.0))


def weighted(scores: Mapping[str, tuple[Column, Column]], weights: Mapping[str, float]) -> Column:
    """Sum of score x weight over vectors that are there, by the sum of all positive weights; null without any.

    scores: name -> (similarity, whether the row has the vector). Only names of positive weight are evaluated.
    """
    used = {k: w for k, w in weights.items() if w > 0}
    named = [k for k in used if k in scores]
    if not named:
        return F.lit(None).cast("double")
    total = reduce(lambda x, y: x + y, [F.when(scores[k][1], scores[k][0] * F.lit(float(used[k]))).otherwise(F.lit(0.0)) for k in named])
    return F.when(reduce(lambda x, y: x | y, [scores[k][1] for k in named]), total / F.lit(float(sum(used.values()))))
