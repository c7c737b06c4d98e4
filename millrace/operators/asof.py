"""As-of join: each row with the last row of another table at or before it, within a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import written


def as_of(rows: DataFrame, others: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """rows with `columns` of the last of others(key, at, columns) whose `at` is not after theirs; nulls where there is none.
    others: one row for each key and place. Columns are taken from others under their own names.

    Rows of both tables are dealt in ranges of (key, place), so a key of most rows is many tasks; within a range the last other
    row goes along by a window, and what a range has in hand at its end is carried into the next ones of its key: a row a range.
    """
    one = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    two = others.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*columns).alias("_other"))
    both = one.unionByName(two, allowMissingColumns=True)
    dealt = written(both.repartitionByRange("_key", "_at", "_side").withColumn("_range", F.spark_partition_id()), "as-of")
    inside = Window.partitionBy("_range", "_key").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_last", F.last("_other", ignorenulls=True).over(inside))
    # only the last key of a range can go on in the next one
    ends = dealt.groupBy("_range").agg(
        F.min("_key").alias("_first_key"), F.max("_key").alias("_last_key"),
        F.max_by(F.struct("_key", "_other"), F.when(F.col("_other").isNotNull(), F.struct("_key", "_at"))).alias("_tail"),
    )
    heads = ends.select("_range", F.lit(0).alias("_part"), F.col("_first_key").alias("_key"), F.lit(None).cast(dealt.schema["_other"].dataType).alias("_hand"))
    tails = ends.select("_range", F.lit(1).alias("_part"), F.col("_last_key").alias("_key"), F.when(F.col("_tail._key") == F.col("_last_key"), F.col("_tail._other")).alias("_hand"))
    so_far = Window.partitionBy("_key").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, 0)
    carried = heads.unionByName(tails).withColumn("_carry", F.last("_hand", ignorenulls=True).over(so_far)).filter("_part = 0").select("_range", "_key", "_carry")
    out = found.filter("_side = 1").join(F.broadcast(carried), ["_range", "_key"], "left")  # a row for each task
    given = F.coalesce("_last", "_carry")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns], *[given.getField(c).alias(c) for c in columns])
