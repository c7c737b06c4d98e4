"""Orders, firsts, running figures and summaries that reports and screens are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import ratio

#: Size from which a chunk counts as large (fixed value).
LARGE = 1500


# --- orders --------------------------------------------------------------------------------------

def prompt_number(column: str = "prompt_number") -> Column:
    """The number of a rating's prompt; a missing one counts as 0."""
    return F.coalesce(F.col(column), F.lit(0))


def ratings_in_order(ratings: DataFrame) -> DataFrame:
    return ratings.orderBy(prompt_number(), *[c for c in ("run_id", "timestamp") if c in ratings.columns])


def newest_first(rows: DataFrame, stamp: str, tie: str) -> DataFrame:
    """Rows by time, the newest first; those without a time last, ties by another column."""
    return rows.orderBy(F.col(stamp).desc_nulls_last(), F.col(tie).desc())


def by_custom_id(results: DataFrame, column: str = "custom_id") -> DataFrame:
    """Results of a batch by the number in their id, not by its text; those without a number last."""
    return results.orderBy(F.get(F.split(column, "-"), F.lit(1)).try_cast("long").asc_nulls_last(), column)


def by_name(rows: DataFrame, name: str = "name", tie: str = "id") -> DataFrame:
    """Rows by name in the order of code points."""
    return rows.orderBy(F.col(name).asc_nulls_last(), tie)


def ranked(rows: DataFrame, group: Sequence[str | Column], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, within a group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def first_of_each(rows: DataFrame, group: Sequence[str | Column], order: Sequence[str | Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k of a group in each task before it shuffles."""
    return ranked(rows, group, order, name).filter(F.col(name) <= k)


# --- selections ----------------------------------------------------------------------------------

def of_prompt(ratings: DataFrame, number: int) -> DataFrame:
    return ratings.filter(F.col("prompt_number") == number)


def finished(jobs: DataFrame, stamp: str, tie: str, k: int = 5) -> DataFrame:
    """The k newest jobs that are completed."""
    return newest_first(jobs.filter(F.col("status") == "completed"), stamp, tie).limit(k)


def shown_tags(tags: DataFrame, order: str, k: int = 100) -> DataFrame:
    """The first k tags that have both names, as prompts show them."""
    return tags.filter("tag_zh <> '' and tag_en <> ''").orderBy(order).limit(k)


def tag_names(chunks: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag_zh): each name once that a chunk has among its tags."""
    return chunks.select(F.explode(tags).alias("t")).select(F.col("t.tag_zh").alias("tag_zh")).filter("tag_zh <> ''").distinct()


# --- running figures -----------------------------------------------------------------------------

def progress(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with the share of their group that is done with them."""
    own = Window.partitionBy(*group)
    return rows.withColumn("progress", F.row_number().over(own.orderBy(*order)) / F.count(F.lit(1)).over(own))


def running_total(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


# --- summaries (the names of their fields are fixed values) ---------------------------------------

def outcomes(rows: DataFrame, failed: Column, seconds: str) -> DataFrame:
    """One row: how many, how many succeeded and failed, seconds in all and on average."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"), F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("avg_seconds"))


def usage(rows: DataFrame, group: str, used: str, over: float) -> DataFrame:
    """Per group: how many, how many used more than `over`, and the mean use, a missing one as 0."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(used) > over).alias("over"), F.avg(F.coalesce(used, F.lit(0.0))).alias("avg_used"))


def by_date(rows: DataFrame, stamp: str) -> DataFrame:
    """(run_date, n, first_stamp) as folders and file names have them."""
    return rows.groupBy(F.date_format(stamp, "yyyy-MM-dd").alias("run_date")).agg(F.count(F.lit(1)).alias("n"), F.min(F.date_format(stamp, "yyyyMMdd_HHmmss")).alias("first_stamp"))


def file_statistics(files: DataFrame, group: str, size: Column) -> DataFrame:
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("total_bytes"))


def flat_summary(index: DataFrame, source: str = "source") -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_distinct(source).alias("sources"))


def structured_summary(records: DataFrame, content: Column) -> DataFrame:
    """One row: records, books, chapters, mean length of the content."""
    return records.agg(F.count(F.lit(1)).alias("total_records"), F.count_distinct("book_id").alias("books"), F.count_distinct(F.struct("book_id", "chapter_index")).alias("total_chapters"), F.avg(F.length(content)).alias("avg_content_length"))


def chunk_sizes(chunks: DataFrame, size: str, large: int = LARGE, kind: str | None = None) -> DataFrame:
    """One row: chunks, the large ones and their share in percent, mean and largest size; with a column of types also the
    semantic ones and their share."""
    n, big = F.count(F.lit(1)), F.count_if(F.col(size) > large)
    semantic = [] if kind is None else [F.count_if(F.col(kind).startswith("semantic")).alias("semantic"), (100.0 * ratio(F.count_if(F.col(kind).startswith("semantic")), n)).alias("semantic_share")]
    return chunks.agg(n.alias("chunks"), big.alias("large"), (100.0 * ratio(big, n)).alias("large_share"), F.avg(size).alias("avg_chars"), F.max(size).alias("max_chars"), *semantic)
