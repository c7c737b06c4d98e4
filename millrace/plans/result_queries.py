"""Queries of result shapes: search results, contexts, run rows and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import results as S
from ..operators import retrieval as R
from . import retrieval_queries as Q
from .registry import query, table


@query(f"""with {Q._RECORDS}, {Q._QUERY}, {Q._MULTI}, h as (select vec_id, chapter_index, section_index, score from s order by s.score desc, vec_id limit 5), {Q._PLACED},
x as (select a.vec_id as hit, b.vec_id as adjacent, b.pos - a.pos as dist, row_number() over (partition by a.vec_id, b.chapter_index, b.section_index order by b.pos) as rn from h join p a using (vec_id), p b where abs(b.pos - a.pos) <= 2),
n as (select hit, string_agg('text ' || adjacent, '|' order by dist) as beside, count(*) as k from x where rn = 1 and dist <> 0 group by hit)
select h.vec_id, 'text ' || h.vec_id as content, round(h.score, 6) as score, cast(h.chapter_index as bigint) as chapter, cast(h.section_index as bigint) as section, 'sym ' || h.vec_id as symptoms, coalesce(n.beside, '') as beside, cast(coalesce(n.k, 0) as bigint) as n_beside from h left join n on n.hit = h.vec_id""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Q.records(spark, sf_dir)
    text = lambda c: F.concat(F.lit("text "), F.col(c).cast("string"))
    hits = R.search(r, Q.asked(spark, sf_dir))
    near = R.adjacent(r, hits, "vec_id").select("hit", "dist", text("adjacent").alias("content"), F.lit("").alias("chapter_title"), F.lit("").alias("section_title"), F.lit(0).cast("long").alias("section_index"))
    shaped = S.search_results(hits.withColumn("full_content", text("vec_id")).withColumn("symptoms", F.concat(F.lit("sym "), F.col("vec_id").cast("string"))), near)
    beside = F.transform("adjacent_content", lambda a: a["content"])
    return shaped.select("vec_id", "content", F.round("score", 6).alias("score"), F.col("metadata.chapter_index").cast("long").alias("chapter"), F.col("metadata.section_index").cast("long").alias("section"), F.col("specialized_content.symptoms").alias("symptoms"), F.array_join(beside, "|").alias("beside"), F.size(beside).cast("long").alias("n_beside"))


@query("""with r as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as rank from conversations),
p as (select conv_id, rank, 'Context ' || rank || ' (from ' || role || ', Chapter ' || turn || '):' || chr(10) || text || case when rank % 2 = 0 then chr(10) || 'Symptoms: s' || turn else '' end || chr(10) as t from r where rank <= 3)
select conv_id as grp, string_agg(t, chr(10) order by rank) as context from p group by conv_id""")
def structured_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", rank.alias("rank"), F.col("role").alias("book_name"), F.col("turn").alias("chapter_index"), F.col("text").alias("content"))
    rows = rows.withColumn("symptoms", F.when(F.col("rank") % 2 == 0, F.concat(F.lit("s"), F.col("chapter_index").cast("string"))).otherwise(F.lit("  ")))
    return S.structured_context(rows, "conv_id", "rank")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("prompt_number"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("prompt"), F.col("event_type").alias("response"), F.when(F.col("event_type") == "error", "quota").alias("error"), F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("int")).alias("tokens_used"), F.col("value").alias("processing_time"))


@query("select event_id as prompt_number, 'p' || event_id as prompt, case when event_type = 'error' then 'Error: quota' else event_type end as response, case when event_type = 'error' or event_id % 4 = 0 then 0 else cast(floor(value) as integer) end as tokens_used, event_type <> 'error' as success from events")
def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.response_rows(_answers(spark, sf_dir))


@query("select event_id as case_number, 'p' || event_id as prompt, event_type as response, '' as chinese_response, case when event_id % 2 = 0 then 'en' else '' end as english_response, 0 as num_chunks_used, value as processing_time from events")
def consolidated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumnRenamed("prompt_number", "case_number").withColumn("english_response", F.when(F.col("case_number") % 2 == 0, "en"))
    return S.consolidated(rows)


@query("select count(*) as total_cases, count(*) filter (event_type <> 'error') as successful_cases, count(*) filter (event_type = 'error') as failed_cases, round(sum(value), 4) as total_processing_time, round(sum(value) / count(*), 6) as average_processing_time from events")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(_answers(spark, sf_dir))


@query("with x as (select *, cast(row_number() over (partition by conv_id order by turn) as integer) as prompt_index from conversations) select conv_id, prompt_index, case when turn % 2 = 0 then 'id' || turn else 'prompt_' || prompt_index end as prompt_id from x")
def prompt_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("prompt_id", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("id"), F.col("turn").cast("string"))))
    return S.with_prompt_metadata(rows, "conv_id", "turn").select("conv_id", "prompt_index", "prompt_id")


@query("select p_brand, 'Existing Symptom Names (bilingual):' || chr(10) || '- ' || array_to_string(case when count(*) filter (p_partkey % 3 = 0) > 0 then list_sort(list(p_brand || ' / ' || p_name) filter (p_partkey % 3 = 0)) else ['<none>'] end, chr(10) || '- ') as memory from part group by p_brand")
def names_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" / ", "p_brand", "p_name"))).alias("names"))
    return rows.select("p_brand", S.names_memory(F.col("names"), "Existing Symptom Names (bilingual)").alias("memory"))


@query("select (select count(*) from part) as total_tags, (select count(distinct p_brand) from part) as chapters, (select string_agg(t, ',' order by t) from (select distinct p_type as t from part order by 1 limit 5)) as first_tags")
def expansion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expansion_statistics(table(spark, sf_dir, "part").select(F.col("p_type").alias("tag_zh"), F.col("p_brand").alias("chapter_id")))


@query("""select coalesce(d.doc_id, l.doc_id) as doc_id, coalesce(cast(d.n_chars % 7 as int), l.quality) as quality, l.quality as quality_before
from (select distinct doc_id, n_chars from documents) d full join labels l on l.doc_id = d.doc_id""")
def merged_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in a table of commits, upserted by a row of each document, beside the version before."""
    from ..operators.ordering import folder
    from ..sources.commits import CommitTable

    labels = CommitTable(spark, folder(spark, "labels"))
    first = labels.append(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")))
    labels.upsert(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 7).cast("int").alias("quality")).distinct(), ["doc_id"])
    return labels.read().join(labels.read(first).select("doc_id", F.col("quality").alias("quality_before")), "doc_id", "left")
