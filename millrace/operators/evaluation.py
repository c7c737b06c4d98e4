"""Evaluation runs, batch jobs and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from .ordering import consecutive

#: Criteria of a rating besides the overall one (fixed values).
CRITERIA = ("accuracy_rating", "completeness_rating", "clarity_rating", "clinical_relevance_rating", "safety_rating")
#: States in which a batch job isn't active any more (fixed values).
ENDED = ("completed", "failed", "cancelled")

#: Fields of a request's and of a result's line (fixed values).
RESULT = "struct<custom_id:string,error:struct<message:string>,response:struct<body:struct<model:string,choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:int,completion_tokens:int>>>>"


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where that isn't a number."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


# --- batches -------------------------------------------------------------------------------------

def batch_requests(prompts: DataFrame, model: str, system_prompt: str, temperature: float = 0.7, max_tokens: int = 500) -> DataFrame:
    """(prompt_index, line): a JSON request per prompt (prompt_index, prompt); custom_id is request-{index}."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.array(message("system", F.lit(system_prompt)), message("user", F.col("prompt"))).alias("messages"))
    request = F.struct(F.concat(F.lit("request-"), F.col("prompt_index").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return prompts.select("prompt_index", F.to_json(request).alias("line"))


def requests_of(prompts: DataFrame, settings: Settings, system_prompt: str) -> DataFrame:
    """`batch_requests` with the model, temperature and length of the settings."""
    return batch_requests(prompts, settings.model, system_prompt, settings.temperature, settings.max_tokens)


def batch_results(lines: DataFrame, prompts: DataFrame, by_rank: bool = False) -> DataFrame:
    """Responses of result lines (value) with their prompts, joined by the number in custom_id (or by rank, as results
    of an incomplete batch would shift): prompt_index, prompt, response, failed, tokens_used."""
    rows = lines.select(F.from_json("value", RESULT).alias("r")).select("r.*").withColumn("number", F.get(F.split("custom_id", "-"), F.lit(1)).try_cast("long"))
    if by_rank:
        rows = consecutive(rows, ["number", "custom_id"], "rank").drop("number").withColumnRenamed("rank", "number")
    failed = F.col("error").isNotNull()
    usage = F.col("response.body.usage")
    tokens = F.coalesce(usage["prompt_tokens"], F.lit(0)) + F.coalesce(usage["completion_tokens"], F.lit(0))
    answer = F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]
    joined = rows.join(prompts, rows.number == prompts.prompt_index)
    return joined.select("prompt_index", "prompt", F.when(failed, F.concat(F.lit("Error: "), F.col("error.message"))).otherwise(answer).alias("response"), failed.alias("failed"), F.when(failed, 0).otherwise(tokens).alias("tokens_used"))


def totals(results: DataFrame) -> DataFrame:
    """One row: how many results, failures, tokens, and the share that succeeded in percent."""
    n = F.count(F.lit(1))
    return results.agg(n.alias("total"), F.count_if("failed").alias("failures"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("long").alias("total_tokens"), F.round(100 * ratio(F.count_if(~F.col("failed")), n), 2).alias("success_rate"))


def batches(rows: DataFrame, group: list[str], order: list[str], size: int = 5) -> DataFrame:
    """rows with prompt_number (from 1, within a group) and the number of the batch of `size` that it falls in."""
    numbered = rows.withColumn("prompt_number", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.withColumn("batch_index", F.ceil(F.col("prompt_number") / size).cast("int"))


def realtime(runs: DataFrame, run: str, seconds: str, tokens: str, failed: str) -> DataFrame:
    """Per run: prompts, successes, failures, tokens, mean seconds, tokens a second and success rate; 0 for no number."""
    n, ok = F.count(F.lit(1)), F.count_if(~F.col(failed))
    total = F.coalesce(F.sum(tokens), F.lit(0)).cast("long")
    return runs.groupBy(run).agg(
        n.alias("prompts"), ok.alias("successes"), (n - ok).alias("failures"), total.alias("total_tokens"),
        F.round(ratio(F.sum(seconds), n), 6).alias("avg_seconds"), F.round(ratio(total, F.sum(seconds)), 6).alias("tokens_per_second"), F.round(ratio(ok * 100.0, n), 6).alias("success_rate"),
    )


# --- jobs ----------------------------------------------------------------------------------------

def latest_state(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """The last row of each job."""
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in events.columns]), F.struct(*order))
    return events.groupBy(F.col(job).alias("_job")).agg(last.alias("row")).select("row.*")


def active(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Jobs that haven't ended; a job that has no status, or was downloaded, counts as active."""
    return jobs.filter(~F.coalesce(F.col(status).isin(*ENDED), F.lit(False)))


def older_than(jobs: DataFrame, stamp: str, now: Column, days: int) -> DataFrame:
    """Jobs of a time strictly before `days` days ago; times that can't be read are never old."""
    return jobs.filter(F.try_to_timestamp(F.col(stamp).cast("string")) < now - F.make_dt_interval(F.lit(days)))


# --- ratings -------------------------------------------------------------------------------------

def rating_statistics(ratings: DataFrame) -> DataFrame:
    """One row: all ratings counted, the mean overall rating over those that are neither null nor 0, and each
    criterion's mean over those that aren't null."""
    overall = F.col("overall_rating")
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in CRITERIA if c in ratings.columns]
    return ratings.agg(F.count(F.lit(1)).alias("total_ratings"), F.round(F.avg(F.when(overall != 0, overall)), 6).alias("average_overall_rating"), *means)


def rating_distribution(ratings: DataFrame) -> DataFrame:
    return ratings.filter("overall_rating is not null and overall_rating <> 0").groupBy("overall_rating").agg(F.count(F.lit(1)).alias("n"))


def best_criterion(ratings: DataFrame) -> DataFrame:
    """(criterion, mean) of the highest mean; of equal ones the first in the list."""
    means = ratings.agg(*[F.round(F.avg(c), 6).alias(c) for c in CRITERIA])
    long = means.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("mean")) for c in CRITERIA])).alias("pos", "c")).select("pos", "c.*")
    return long.filter("mean is not null").orderBy(F.desc("mean"), "pos").limit(1).select("criterion", "mean")


def run_summary(runs: DataFrame, ratings: DataFrame) -> DataFrame:
    """runs(run_id, total_prompts) with rated_count (ratings) and unrated_count (prompts without any)."""
    counts = ratings.groupBy("run_id").agg(F.count(F.lit(1)).alias("rated_count"), F.count_distinct("prompt_number").alias("rated_prompts"))
    rows = runs.join(counts, "run_id", "left").na.fill(0, ["rated_count", "rated_prompts"])
    return rows.select(*runs.columns, "rated_count", (F.col("total_prompts") - F.col("rated_prompts")).alias("unrated_count"), (F.col("rated_prompts") >= F.col("total_prompts")).alias("complete"))


def tool_budget(turns: DataFrame, conv: str, order: str, is_call: Column, budget: int = 30) -> DataFrame:
    """turns with the running number of tool calls of their conversation, and whether the budget still holds."""
    running = F.sum(is_call.cast("int")).over(Window.partitionBy(conv).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("running", running.cast("long")).withColumn("within_budget", F.col("running") <= budget)
