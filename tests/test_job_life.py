"""Keyed state of jobs equals the batch fold, in any order and after a restart; sessions and joins on streams."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.streaming import jobs as J
from millrace.streaming import windows as W

SCHEMA = "job string, status string, ts timestamp, event_id long"
START = dt.datetime(2024, 1, 1)
STATES = ["validating", "in_progress", None, "completed", "failed", "cancelled"]


def events(n=120):
    rng = random.Random(2)
    return [(f"j{rng.randint(0, 9)}", rng.choice(STATES), START + dt.timedelta(seconds=rng.randint(0, 40_000)), k) for k in range(n)]


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get(J.STORE[0])
    spark.conf.set(*J.STORE)
    yield
    spark.conf.set(J.STORE[0], before)


def feed(spark, rows, folder, parts, schema=SCHEMA):
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, top, patience=10**9, late="30 days"):
    inputs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
    keep = lambda rows, number: rows.write.mode("overwrite").parquet(f"{top}/out/batch={number}")
    query = J.lifecycle(inputs, patience, late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return J.states(spark.read.parquet(f"{top}/out")), query


@pytest.mark.parametrize("order", ["as made", "by time", "backwards"])
def test_stream_equals_the_batch_fold(spark, tmp_path, order):
    rows = events()
    if order != "as made":
        rows = sorted(rows, key=lambda r: (r[2], r[3]), reverse=order == "backwards")
    want = {tuple(r) for r in E.latest_state(spark.createDataFrame(rows, SCHEMA), "job", ["ts", "event_id"]).collect()}
    feed(spark, rows[:70], f"{tmp_path}/in", 3)
    run(spark, tmp_path)
    feed(spark, rows[70:], f"{tmp_path}/in", 2)  # a second run goes on from the checkpoint
    found, _ = run(spark, tmp_path)
    got = found.collect()
    assert {(r.job, r.last_status, r.ts, r.event_id) for r in got} == want
    assert sum(r.events for r in got) == len(rows) and all(r.status == r.last_status for r in got)


def test_time_outs_and_late_news(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    feed(spark, [("slow", "in_progress", at(0), 1), ("done", "completed", at(0), 2), ("busy", "in_progress", at(9), 3)], f"{tmp_path}/in", 1)
    feed(spark, [("clock", "completed", at(10), 4)], f"{tmp_path}/in", 1)
    found, _ = run(spark, tmp_path, 3 * 3_600_000, "1 hour")
    assert {r.job: (r.status, r.last_status) for r in found.collect()} == {"slow": ("timed_out", "in_progress"), "done": ("completed",) * 2, "busy": ("in_progress",) * 2, "clock": ("completed",) * 2}
    feed(spark, [("slow", "completed", at(11), 5)], f"{tmp_path}/in", 1)
    found, _ = run(spark, tmp_path, 3 * 3_600_000, "1 hour")
    assert {r.job: r.status for r in found.collect()}["slow"] == "completed"


def stream(spark, top, frame, name, schema):
    inputs = {k: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/{k}") for k in name}
    query = frame(*inputs.values()).writeStream.outputMode("append").option("checkpointLocation", f"{top}/check").format("parquet").option("path", f"{top}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{top}/out"), query


def test_sessions_on_a_stream(spark, tmp_path):
    rng = random.Random(3)
    schema, rows = "user long, ts timestamp, value double", []
    for day in range(6):  # a file a day
        rows.append([(rng.randint(0, 3), START + dt.timedelta(days=day, seconds=rng.randint(0, 80_000)), 1.0) for _ in range(60)])
    for part in [*rows, [(99, START + dt.timedelta(days=40), 0.0)]]:
        feed(spark, part, f"{tmp_path}/in", 1, schema)
    make = lambda e: W.sessions(e, "user", "30 minutes", "value", "1 day")
    want = {tuple(r) for r in make(spark.createDataFrame(sum(rows, []), schema)).collect()}
    found, query = stream(spark, tmp_path, make, ["in"], schema)
    assert {tuple(r) for r in found.collect()} == want  # the last row has only moved the watermark
    state = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(state) < 360 and state[-1] <= 2


def test_join_of_two_streams(spark, tmp_path):
    rng = random.Random(4)
    schema = "user long, id long, ts timestamp"
    sides = {"asked": [], "given": []}
    for k, side in enumerate(sides):
        for day in range(6):
            sides[side].append([(rng.randint(0, 2), 1000 * k + 100 * day + j, START + dt.timedelta(days=day, seconds=rng.randint(0, 80_000))) for j in range(40)])
    for side, parts in sides.items():
        for part in [*parts, [(77, 9999, START + dt.timedelta(days=40))]]:
            feed(spark, part, f"{tmp_path}/{side}", 1, schema)
    make = lambda a, b: W.answered_within(a, b, "user", 3600, "1 day")
    both = [spark.createDataFrame(sum(parts, []), schema) for parts in sides.values()]
    want = {tuple(r) for r in make(*both).collect()}
    brute = {(a[0], a[1], b[1]) for a in sum(sides["asked"], []) for b in sum(sides["given"], []) if a[0] == b[0] and dt.timedelta(0) <= b[2] - a[2] <= dt.timedelta(seconds=3600)}
    assert {(u, a, b) for u, a, _, b, _ in want} == brute and brute
    found, query = stream(spark, tmp_path, make, ["asked", "given"], schema)
    assert {tuple(r) for r in found.filter("user <> 77").collect()} == want
    state = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(state) < 720 and state[-1] < max(state)
