"""Queries of events in time: job states by a stream with keyed state, sessions, requests with their responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import folder
from ..streaming import jobs as J
from ..streaming import windows as W
from .evaluation_queries import _LAST
from .registry import query, table

PATIENCE_HOURS, GAP_MINUTES, ANSWER_SECONDS = 6, 30, 3600


def job_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind != "view", kind)
    return events.select(F.col("user_id").alias("job"), status.alias("status"), "ts", "event_id")


@query(f"""with {_LAST}, n as (select max(ts) as newest from events), c as (select user_id as job, count(*) as events from events group by 1)
select job, case when coalesce(status not in ('completed', 'failed', 'cancelled'), true) and j.ts + interval {PATIENCE_HOURS} hours <= newest - interval 1 day then 'timed_out' else status end as status,
status as last_status, event_id, events from j join c using (job), n""")
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a stream over all events: their last state, or that they have timed out by the watermark."""
    top = folder(spark, "jobs")
    before = spark.conf.get(J.STORE[0])
    spark.conf.set(*J.STORE)
    try:
        events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
        changes = J.lifecycle(job_events(events), PATIENCE_HOURS * 3_600_000)

        def keep(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{top}/changes/batch={number}")

        changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(J.STORE[0], before)
    return J.states(spark.read.parquet(f"{top}/changes")).select("job", "status", "last_status", "event_id", "events")


@query(f"""with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval {GAP_MINUTES} minutes then 0 else 1 end as first from events),
g as (select *, sum(first) over (partition by user_id order by ts, event_id) as session from s)
select user_id, epoch_us(min(ts)) as started, epoch_us(max(ts)) + {GAP_MINUTES * 60_000_000} as ended, count(*) as n, round(sum(value), 4) as total from g group by user_id, session""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.sessions(table(spark, sf_dir, "events"), "user_id", f"{GAP_MINUTES} minutes", "value")
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n", F.round("total", 4).alias("total"))


@query(f"""select a.user_id, a.event_id as request, b.event_id as response from events a join events b using (user_id)
where a.event_type = 'click' and b.event_type = 'purchase' and b.ts between a.ts and a.ts + interval {ANSWER_SECONDS} seconds""")
def request_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return W.answered_within(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", ANSWER_SECONDS).select("user_id", "request", "response")


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all events a type and day, stored and read again."""
    from ..operators import sketches as K
    from ..operators.ordering import written

    return written(K.sketched(table(spark, sf_dir, "events"), ["event_type"], F.col("ts").cast("timestamp"), F.col("user_id"), F.col("value")), "sketches")


@query("select event_type, count(*) as n, true as close from events group by event_type")
def sketched_distincts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users a type by merged sketches of days: whether they are within the stated error of the exact number."""
    from ..operators import sketches as K

    found = K.estimated(K.merged(_sketches(spark, sf_dir), ["event_type"]), ["event_type"])
    exact = table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return found.join(exact, "event_type").select("event_type", "n", (F.abs(F.col("distinct") - F.col("exact")) <= K.DISTINCT_ERROR * F.col("exact")).alias("close"))


@query("""select event_type, cast(s * 25 as int) as percent, true as close from (select distinct event_type from events), range(1, 4) t(s)""")
def sketched_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles a type by merged sketches of days: whether their rank is within the stated error."""
    from ..operators import sketches as K

    events = table(spark, sf_dir, "events")
    found = K.estimated(K.merged(_sketches(spark, sf_dir), ["event_type"]), ["event_type"]).select("event_type", F.posexplode("quantiles").alias("i", "q"))
    ranked = events.join(F.broadcast(found), "event_type").groupBy("event_type", "i").agg((F.count_if(F.col("value") < F.col("q")) / F.count("value")).alias("below"), (F.count_if(F.col("value") <= F.col("q")) / F.count("value")).alias("upto"))  # three rows a type
    share = (F.col("i") + 1) / 4
    return ranked.select("event_type", ((F.col("i") + 1) * 25).alias("percent"), ((share >= F.col("below") - K.RANK_ERROR) & (share <= F.col("upto") + K.RANK_ERROR)).alias("close"))
