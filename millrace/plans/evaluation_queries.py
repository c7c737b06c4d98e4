"""Queries of evaluation runs, batch jobs and ratings. Events stand for run telemetry (run: user, seconds: value, failed:
type error, job status: type), conversations for prompts, labels and events for ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import listings as L
from ..sources import files as S
from .registry import query, table

_KEYS = ", ".join(f"1 + (event_id + {k}) % 5 as {c}" for k, c in enumerate(E.CRITERIA))
_RATED = f"r as (select event_id, user_id, case when event_id % 11 = 0 then null when event_id % 7 = 0 then 0 else 1 + event_id % 5 end as overall_rating, {_KEYS.replace('1 + (event_id + 0) % 5', 'case when event_id % 13 = 0 then null else 1 + event_id % 5 end')} from events)"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    overall = F.when(e % 11 == 0, None).when(e % 7 == 0, 0).otherwise(1 + e % 5)
    criteria = {c: 1 + (e + k) % 5 for k, c in enumerate(E.CRITERIA)}
    criteria[E.CRITERIA[0]] = F.when(e % 13 != 0, 1 + e % 5)
    return table(spark, sf_dir, "events").select("event_id", "user_id", overall.alias("overall_rating"), *[v.alias(k) for k, v in criteria.items()])


_SYSTEM = "You are a careful assistant."


@query(f"""select cast(conv_id * 1000 + turn as bigint) as prompt_index, 'request-' || (conv_id * 1000 + turn) as custom_id, text as prompt, '{_SYSTEM}' as system_prompt from conversations""")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines, decoded again."""
    prompts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("prompt_index"), F.col("text").alias("prompt"))
    lines = E.batch_requests(prompts, "some-model", _SYSTEM)
    kind = "struct<custom_id:string,body:struct<messages:array<struct<role:string,content:string>>>>"
    read = lines.select("prompt_index", F.from_json("line", kind).alias("r"))
    content = lambda k: F.get(F.col("r.body.messages"), F.lit(k))["content"]
    return read.select("prompt_index", F.col("r.custom_id").alias("custom_id"), content(1).alias("prompt"), content(0).alias("system_prompt"))


_RESULTS = "x as (select event_id, event_type = 'error' as failed, case when event_type = 'error' then 0 else cast(floor(value) as integer) + 1 end as tokens_used from events where event_type <> 'view')"


def _results(spark: SparkSession, sf_dir: str, by_rank: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    body = F.struct(F.lit("some-model").alias("model"), F.array(F.struct(F.struct(F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("content")).alias("message"))).alias("choices"), F.struct(F.floor("value").cast("int").alias("prompt_tokens"), F.lit(1).alias("completion_tokens")).alias("usage"))
    line = F.to_json(F.struct(F.concat(F.lit("request-"), F.col("event_id").cast("string")).alias("custom_id"), F.when(bad, F.struct(F.lit("quota").alias("message"))).alias("error"), F.when(~bad, F.struct(body.alias("body"))).alias("response")))
    lines = events.filter("event_type <> 'view'").select(line.alias("value"))
    prompts = events.select(F.col("event_id").alias("prompt_index"), F.concat(F.lit("prompt "), F.col("event_id").cast("string")).alias("prompt"))
    return E.batch_results(lines, prompts, by_rank)


@query(f"with {_RESULTS} select event_id as prompt_index, 'prompt ' || event_id as prompt, case when failed then 'Error: quota' else 'answer ' || event_id end as response, failed, tokens_used from x")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


@query(f"with {_RESULTS}, y as (select event_id, failed, tokens_used, row_number() over (order by event_id) - 1 as k from x) select k as prompt_index, 'prompt ' || k as prompt, case when failed then 'Error: quota' else 'answer ' || event_id end as response, failed, tokens_used from y where k in (select event_id from events)")
def batch_results_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, by_rank=True)


@query(f"with {_RESULTS} select count(*) as total, count(*) filter (failed) as failures, cast(sum(tokens_used) as bigint) as total_tokens, round(100.0 * count(*) filter (not failed) / count(*), 2) as success_rate from x")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.totals(_results(spark, sf_dir))


@query("""select user_id, count(*) as prompts, count(*) filter (event_type <> 'error') as successes, count(*) filter (event_type = 'error') as failures, cast(sum(event_id % 100) as bigint) as total_tokens, round(sum(value) / count(*), 6) as avg_seconds,
coalesce(round(sum(event_id % 100) / nullif(sum(value), 0), 6), 0) as tokens_per_second, round(100.0 * count(*) filter (event_type <> 'error') / count(*), 6) as success_rate from events group by user_id""")
def bench_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "value", (F.col("event_id") % 100).alias("tokens"), (F.col("event_type") == "error").alias("failed"))
    return E.realtime(rows, "user_id", "value", "tokens", "failed")


@query("select count(*) as total, count(*) filter (event_type <> 'error') as successful, count(*) filter (event_type = 'error') as failed, round(sum(value), 4) as total_seconds, round(avg(value), 6) as avg_seconds from events")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.outcomes(table(spark, sf_dir, "events"), F.col("event_type") == "error", "value")
    return found.withColumns({"total_seconds": F.round("total_seconds", 4), "avg_seconds": F.round("avg_seconds", 6)})


@query("select event_type, count(*) as n, count(*) filter (value > 50) as over_50, round(avg(coalesce(value, 0)), 6) as avg_used from events group by event_type")
def success_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usage(table(spark, sf_dir, "events"), "event_type", "value", 50).withColumnRenamed("over", "over_50").withColumn("avg_used", F.round("avg_used", 6))


@query(f"with {_RATED} select count(*) as total_ratings, round(avg(nullif(overall_rating, 0)), 6) as average_overall_rating, " + ", ".join(f"round(avg({c}), 6) as avg_{c}" for c in E.CRITERIA) + " from r")
def rating_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rating_statistics(ratings(spark, sf_dir))


@query(f"with {_RATED} select overall_rating, count(*) as n from r where overall_rating <> 0 group by 1")
def rating_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rating_distribution(ratings(spark, sf_dir))


@query(f"with {_RATED}, m as (" + " union all ".join(f"select {k} as pos, '{c}' as criterion, round(avg({c}), 6) as mean from r" for k, c in enumerate(E.CRITERIA)) + ") select criterion, mean from m order by mean desc, pos limit 1")
def best_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_criterion(ratings(spark, sf_dir))


@query("""with runs as (select conv_id as run_id, count(*) as total_prompts from conversations group by 1), r as (select doc_id % 100 as run_id, doc_id % 3 as prompt_number from labels)
select runs.run_id, total_prompts, coalesce(n, 0) as rated_count, total_prompts - coalesce(d, 0) as unrated_count, coalesce(d, 0) >= total_prompts as complete from runs left join (select run_id, count(*) as n, count(distinct prompt_number) as d from r group by 1) using (run_id)""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.count(F.lit(1)).alias("total_prompts"))
    rated = table(spark, sf_dir, "labels").select((F.col("doc_id") % 100).alias("run_id"), (F.col("doc_id") % 3).alias("prompt_number"))
    return E.run_summary(runs, rated)


@query("select doc_id, coalesce(nullif(doc_id % 10, 9), 0) as prompt_number, cast(row_number() over (partition by doc_id % 10 order by coalesce(nullif(doc_id % 10, 9), 0), doc_id) as integer) as rank from labels")
def ratings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.coalesce(F.nullif(F.col("doc_id") % 10, F.lit(9)), F.lit(0))
    rows = table(spark, sf_dir, "labels").select("doc_id", number.alias("prompt_number"), (F.col("doc_id") % 10).alias("run"))
    return L.ranked(rows, ["run"], [L.prompt_number(), "doc_id"]).drop("run")


_LAST = "j as (select user_id as job, case when event_type = 'purchase' then 'completed' when event_type = 'error' then 'failed' when event_type = 'view' then null else event_type end as status, ts, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind != "view", kind)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), status.alias("status"), "ts", "event_id")
    return E.latest_state(rows, "job", ["ts", "event_id"])


@query(f"with {_LAST} select job, status, event_id from j")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("job", "status", "event_id")


@query(f"with {_LAST} select job, status from j where coalesce(status not in ('completed', 'failed', 'cancelled'), true)")
def jobs_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.active(jobs(spark, sf_dir)).select("job", "status")


@query(f"with {_LAST}, n as (select max(ts) as now from events) select job from j, n where ts < now - interval 6 hours")
def jobs_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("interval 6 hours")).alias("now"))
    return E.older_than(jobs(spark, sf_dir).crossJoin(F.broadcast(now)), "ts", F.col("now"), 0).select("job")  # one row


@query("select event_id, cast(props ->> '$.k' as integer) as k, cast(props ->> '$.k' as integer) as k_in_text from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda x: X.lenient_json(x, "struct<k:int>")["k"]
    return table(spark, sf_dir, "events").select("event_id", read(F.col("props")).alias("k"), read(F.concat(F.lit("Sure: "), "props", F.lit(" as asked"))).alias("k_in_text"))


@query("with f as (select 'in/responses_' || case when event_id % 3 = 0 then 'batch_' else '' end || strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_id || '.json' as path from events) select max(path) as path, replace(replace(max(path), 'in/responses_', ''), '.json', '') as run_id from f")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("in/responses_"), F.when(F.col("event_id") % 3 == 0, "batch_").otherwise(""), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".json"))
    found = S.latest_file(table(spark, sf_dir, "events").select(name.alias("path"), F.col("ts").alias("modified")))
    return found.select("path", S.run_of(F.col("path")).alias("run_id"))


@query("select conv_id, turn, cast(sum(cast(role = 'assistant' as integer)) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as running, sum(cast(role = 'assistant' as integer)) over (partition by conv_id order by turn rows unbounded preceding) <= 3 as within_budget from conversations")
def conv_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.tool_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant", 3)
    return rows.select("conv_id", "turn", "running", "within_budget")


@query("select conv_id, cast(ceil(n / 5.0) as integer) as batch_index, count(*) as n from (select conv_id, row_number() over (partition by conv_id order by turn) as n from conversations) group by all")
def batches_of_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batches(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).groupBy("conv_id", "batch_index").agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(ts, '%Y-%m-%d') as run_date, count(*) as n, min(strftime(ts, '%Y%m%d_%H%M%S')) as first_stamp from events group by 1")
def date_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_date(table(spark, sf_dir, "events"), "ts")


@query("select event_id, round(cast(row_number() over (partition by user_id order by event_id) as double) / count(*) over (partition by user_id), 6) as progress from events")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.progress(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("event_id", F.round("progress", 6).alias("progress"))


@query("select event_id, cast(round(sum(value) over (partition by user_id order by event_id rows unbounded preceding), 4) as double) as running_seconds from events")
def running_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.running_total(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value", "running_seconds")
    return rows.select("event_id", F.round("running_seconds", 4).alias("running_seconds"))


@query(f"with {_LAST} select job, status, row_number() over (order by ts desc, event_id desc) as rank from j where status = 'completed' order by ts desc, event_id desc limit 5")
def jobs_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest completed jobs."""
    five = L.finished(jobs(spark, sf_dir), "ts", "event_id")
    return L.ranked(five, [F.lit(0)], [F.desc("ts"), F.desc("event_id")]).select("job", "status", F.col("rank").cast("long").alias("rank"))  # five rows


@query("select doc_id, quality + 2 * toxic as prompt_number from labels where quality + 2 * toxic = 2")
def ratings_of_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of one prompt; the labels of a document stand for its number."""
    return L.of_prompt(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("prompt_number")), 2)


# --- what Spark adds for nothing: beyond what such an engine must have ---------------------------

@query("select event_type, user_id % 10 as bucket, count(*) as n, grouping(event_type) as no_type from events group by rollup (event_type, user_id % 10)")
def extension_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)
    return rows.rollup("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").cast("long").alias("no_type"))


@query("select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n from events group by all")
def extension_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour").select(F.col("window.start").alias("hour"), "event_type", "n")


@query("select l_partkey as k from lineitem intersect select o_custkey from orders")
def extension_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))
