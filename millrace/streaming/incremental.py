"""Incremental work: batches that resume, retries, budgets. State is written tables, never memory of a process."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..sources.files import restore, snapshot, versions

T = TypeVar("T")


def unprocessed(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that aren't done yet."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def resumed(spark: SparkSession, inputs: DataFrame, order: str, step: Callable[[DataFrame], DataFrame], folder: str, keys: list[str]) -> DataFrame:
    """Applies step to what no part in folder covers, one value of `order` after the other, each result written as a part
    of its own; gives all parts together. A run that was broken off goes on behind the last part that is complete, and
    what is written stays as it is, however many steps there are."""
    known = versions(spark, folder)
    left = unprocessed(inputs, parts(spark, folder, known), keys) if known else inputs
    for value in sorted(r[0] for r in left.select(order).distinct().collect()):  # steps are taken by the driver, so they are few
        version = known[-1] + 1 if known else 0
        snapshot(step(left.filter(left[order] == value)), folder, version)
        known.append(version)
    return parts(spark, folder, known) if known else step(left)


def parts(spark: SparkSession, folder: str, known: list[int]) -> DataFrame:
    """The rows of these parts."""
    first = restore(spark, folder, known[0])
    return spark.read.schema(first.schema).parquet(*[f"{folder}/version={v}" for v in known])


def stream(inputs: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str):
    """The same on a stream: each micro-batch is a folder of its own, so that a batch that is repeated replaces its own
    rows only."""

    def batch(df: DataFrame, number: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return inputs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def retried(call: Callable[[], T], attempts: int = 3, delay: Callable[[int], float] = lambda n: 2.0**n, retry: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> T:
    """call(), again after delay(n) seconds while it raises what may be retried; then the last error. Exponential by
    default; `lambda n: 5 * (n + 1)` is linear."""
    for n in range(attempts + 1):
        try:
            return call()
        except retry:
            if n == attempts:
                raise
            sleep(delay(n))
    raise AssertionError


def in_batches(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = 5, keep_failed: bool = True, order: list[str] | None = None) -> DataFrame:
    """call on `size` rows at once; a batch that fails is left out unless keep_failed. With an order, batches follow it:
    ranges of it are dealt to tasks, which go through theirs one batch after the other."""
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in batches:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            whole = len(held) // size * size
            yield from each(held.iloc[:whole])
            held = held.iloc[whole:]
        if held is not None:
            yield from each(held)

    def each(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for i in range(0, len(part), size):
            try:
                yield call(part.iloc[i : i + size].reset_index(drop=True))
            except Exception:  # noqa: BLE001  a provider may fail in any way
                if keep_failed:
                    raise

    return rows.mapInPandas(run, schema)
