"""Positions over whole tables, without gathering the rows in one task."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder


_folders: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it is deleted when the session's process ends, if `discard` hasn't done so."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_clean)
    _folders.append((spark, path))
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read again: the same whenever they are read, and with a plan of one scan."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` wrote, once all that was made from it is written too; other frames are left alone."""
    for df in tables:
        if (path := getattr(df, "written_to", None)) and (df.sparkSession, path) in _folders:
            _folders.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _folders:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def consecutive(rows: DataFrame, order: Sequence[str], name: str = "vec_id") -> DataFrame:
    """rows with consecutive numbers from 0 in an order of unique keys.

    Ranges of the order are dealt to tasks and written to the shared folder, so that they are the same whenever they are
    read; each range then adds the number of rows in those before it, of which there are as many as tasks.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))  # a row for each task
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", inside).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_in") - 1).cast("long")).drop("_range", "_start", "_in")


def placed(rows: DataFrame, within: str, groups: Sequence[str], last: str, name: str = "pos") -> DataFrame:
    """rows numbered from 1 within each value of `within`, in order of the groups and then of `last`.

    Only the counts of the groups are put in order over a whole value; rows are, within their group.
    """
    keys = [within, *groups]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(within).orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(last))
    return rows.withColumn("_in", inside).join(starts, keys).withColumn(name, (F.col("_start") + F.col("_in")).cast("int")).drop("_start", "_in")
