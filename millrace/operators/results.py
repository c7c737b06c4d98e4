"""Shapes of results: search results, contexts, run rows, consolidated evaluations, and the sinks of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.text import is_blank
from .evaluation import ratio

#: Extracted content of a record besides the whole (fixed values).
SPECIAL = ("symptoms", "organs", "formulas", "patterns")
METADATA = ("book_name", "book_id", "chapter_index", "chapter_title", "section_index", "section_title", "content_type", "word_count", "char_count")


def search_results(hits: DataFrame, near: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """One row per hit: id, content, score, metadata and specialised structs, and the adjacent records (hit, content,
    chapter_title, section_title, section_index, dist) in reading order, the hit itself left out."""
    meta = F.struct(*[F.col(c) for c in METADATA if c in hits.columns])
    special = F.struct(*[F.col(c) for c in SPECIAL if c in hits.columns]) if any(c in hits.columns for c in SPECIAL) else F.lit(None)
    kind = "array<struct<dist:int,content:string,chapter_title:string,section_title:string,section_index:bigint>>"
    beside = near.filter("dist <> 0").groupBy(F.col("hit").alias(id_column)).agg(F.array_sort(F.collect_list(F.struct("dist", "content", "chapter_title", "section_title", "section_index"))).cast(kind).alias("adjacent_content"))
    rows = hits.select(id_column, F.col("full_content").alias("content"), "score", meta.alias("metadata"), special.alias("specialized_content"))
    return rows.join(beside, id_column, "left").withColumn("adjacent_content", F.coalesce("adjacent_content", F.array().cast(kind)))


def structured_context(rows: DataFrame, group: str, rank: str, special: Sequence[str] = SPECIAL, most: int = 3) -> DataFrame:
    """(grp, context): the first `most` results of each group, a header and the content each, then "Title: text" for the
    specialised content that isn't blank, and an empty line."""
    extra = [F.when(~is_blank(F.col(c)), F.concat(F.lit(f"{c.title()}: "), F.col(c))) for c in special if c in rows.columns]
    header = F.concat(F.lit("Context "), F.col(rank).cast("string"), F.lit(" (from "), F.col("book_name"), F.lit(", Chapter "), F.col("chapter_index").cast("string"), F.lit("):"))
    lines = F.filter(F.array(header, F.col("content"), *extra, F.lit("")), lambda x: x.isNotNull())
    parts = rows.filter(F.col(rank) <= most).select(F.col(group).alias("grp"), F.struct(F.col(rank).alias("k"), F.array_join(lines, "\n").alias("text")).alias("p"))
    return parts.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "\n").alias("context"))


def response_rows(results: DataFrame) -> DataFrame:
    """Responses of answered prompts (prompt_number, prompt, response, error, tokens_used): an error's text stands as the
    response, with no tokens."""
    bad = F.col("error").isNotNull()
    return results.select("prompt_number", "prompt", F.when(bad, F.concat(F.lit("Error: "), "error")).otherwise(F.col("response")).alias("response"), F.when(bad, F.lit(0)).otherwise(F.coalesce("tokens_used", F.lit(0))).alias("tokens_used"), (~bad).alias("success"))


def consolidated(results: DataFrame) -> DataFrame:
    """Evaluation cases with defaults for what a result lacks."""
    have = set(results.columns)
    text = lambda c: (F.coalesce(c, F.lit("")) if c in have else F.lit("")).alias(c)
    number = lambda c, zero: (F.coalesce(c, F.lit(zero)) if c in have else F.lit(zero)).alias(c)
    return results.select("case_number", "prompt", "response", text("chinese_response"), text("english_response"), number("num_chunks_used", 0), number("processing_time", 0.0))


def summary(results: DataFrame) -> DataFrame:
    """Totals of a run (error, processing_time): cases, successes, failures, seconds in all and on average."""
    n = F.count(F.lit(1))
    seconds = F.coalesce(F.sum("processing_time"), F.lit(0.0))
    return results.agg(n.alias("total_cases"), F.count_if(F.col("error").isNull()).alias("successful_cases"), F.count_if(F.col("error").isNotNull()).alias("failed_cases"), F.round(seconds, 4).alias("total_processing_time"), F.round(ratio(seconds, n), 6).alias("average_processing_time"))


def with_prompt_metadata(prompts: DataFrame, run: str, order: str) -> DataFrame:
    """prompts with prompt_index (from 1 within a run) and prompt_id, "prompt_{index}" where none is given."""
    rows = prompts.withColumn("prompt_index", F.row_number().over(Window.partitionBy(run).orderBy(order)))
    return rows.withColumn("prompt_id", F.coalesce("prompt_id", F.concat(F.lit("prompt_"), F.col("prompt_index").cast("string"))))


def names_memory(names: Column, heading: str) -> Column:
    """A heading and the sorted names as a list, <none> without any."""
    listed = F.when(F.size(names) > 0, F.array_sort(names)).otherwise(F.array(F.lit("<none>")))
    return F.concat(F.lit(f"{heading}:\n- "), F.array_join(listed, "\n- "))


def expansion_statistics(tags: DataFrame, k: int = 5) -> DataFrame:
    """One row on tags (tag_zh, chapter_id): how many, of how many chapters, the first k names."""
    first = tags.select("tag_zh").distinct().orderBy("tag_zh").limit(k).agg(F.array_join(F.array_sort(F.collect_list("tag_zh")), ",").alias("first_tags"))
    return tags.agg(F.count(F.lit(1)).alias("total_tags"), F.count_distinct("chapter_id").alias("chapters")).crossJoin(F.broadcast(first))  # one row


def require(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, if it has all the columns; else an error that names those it lacks."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise InvalidInput(f"{', '.join(missing)} required")
    return df


def write_run(responses: DataFrame, benchmark: DataFrame, folder: str, run_id: str, batch: bool = False) -> None:
    """Both tables of a run as JSON, in a folder each whose name tells the kind of run."""
    if not run_id:
        raise InvalidInput("a run needs an id")
    kind = "batch_" if batch else ""
    responses.write.mode("overwrite").json(f"{folder}/responses_{kind}{run_id}")
    benchmark.write.mode("overwrite").json(f"{folder}/benchmark_{kind}{run_id}")
