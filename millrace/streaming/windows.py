"""Windows over events, and a join of two kinds of events by time, for batches and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """ts as a timestamp; on a stream, rows more than `late` behind the newest are dropped, and state of that time with them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n). On a stream, rows more than `late` behind the newest are dropped."""
    return timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, gap: str, value: str, late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n, total): runs of a key's events with less than `gap` between one and the next. ended is the
    last event's time plus the gap. Partial sessions are merged before the shuffle."""
    found = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "total")


def answered_within(requests: DataFrame, responses: DataFrame, key: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, request, request_ts, response, response_ts): responses of the key up to `seconds` after a request, both of
    them (key, id, ts).

    Joined by key and stretch of time, so that one key's rows of all times don't meet; on a stream each side's rows are
    dropped once the other's watermark has passed the range.
    """
    stretch = lambda c: F.floor(F.unix_micros(c) / F.lit(seconds * 1_000_000)).cast("long")
    asked = timed(requests, late).select(F.col(key).alias("key"), F.col("id").alias("request"), F.col("ts").alias("request_ts"))
    asked = asked.withColumn("stretch", F.explode(F.array(stretch(F.col("request_ts")), stretch(F.col("request_ts")) + 1)))
    given = timed(responses, late).select(F.col(key).alias("key"), F.col("id").alias("response"), F.col("ts").alias("response_ts"))
    given = given.withColumn("stretch", stretch(F.col("response_ts")))
    near = F.expr(f"response_ts >= request_ts and response_ts <= request_ts + interval {seconds} seconds")
    return asked.join(given, ["key", "stretch"]).filter(near).select(F.col("key").alias(key), "request", "request_ts", "response", "response_ts")
