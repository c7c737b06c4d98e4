"""Stored sketches of groups and days: distinct counts and quantiles of any range of days without the rows.

A sketch table has a row for each group and day, with a HyperLogLog sketch of a column's values and a KLL sketch of a number's
distribution as binary columns of bounded size. Sketches of days are merged for a range, which gives what one sketch of
all its rows gives, within the same error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a HyperLogLog sketch (error about 1.04 / sqrt(2^bits)) and the k of a KLL sketch (error of a rank about 1.7 / k).
BITS, K = 14, 800
#: Errors that results stay within, with high probability: of a distinct count, relative; of a quantile's rank.
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.01


def sketched(rows: DataFrame, groups: list[str], stamp: Column, who: Column, value: Column) -> DataFrame:
    """groups, day, n, who (distinct values) and value (distribution) of all rows. Partial sketches are made before the shuffle;
    nulls are in n alone."""
    keyed = rows.select(*groups, stamp.cast("date").alias("day"), who.alias("_who"), value.cast("double").alias("_value"))
    return keyed.groupBy(*groups, "day").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_who", F.lit(BITS)).alias("who"), F.kll_sketch_agg_double("_value", F.lit(K)).alias("value"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """groups with n and the sketches of all their days together: such as those that a filter of `day` leaves, which reads no
    other days. More days can be appended and merged at any time."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("value").alias("value"))


def estimated(sketches: DataFrame, groups: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """groups, n, distinct and quantiles (an array) of sketches."""
    some = F.array(*[F.lit(float(s)) for s in shares])
    return sketches.select(*groups, "n", F.hll_sketch_estimate("who").alias("distinct"), F.kll_sketch_get_quantile_double("value", some).alias("quantiles"))
