"""The life of batch jobs as keyed state: what a job's events make of it, and when it has waited too long.

Events come in any order; a job's state is its last event by (ts, event_id), so the same events give the same states however
they arrive, as the batch fold `evaluation.latest_state` does. A job that hasn't ended gets a timer in event time; when the
watermark passes it without news the job counts as timed out, until a later event says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.evaluation import ENDED

#: What holds keyed state on a stream (the setting's name and value).
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TIMED_OUT = "timed_out"
_COLUMNS = ["job", "status", "ts", "event_id", "events", "timed_out"]


def _millis(stamp: pd.Timestamp) -> int:
    return int(stamp.value // 1_000_000)


class JobLife(StatefulProcessor):
    """State of a job: its last event, the number of its events, and the time at which it runs out of patience."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, ts long, event_id long, events long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        status, ts, event_id, events, timer = self.last.get() if self.last.exists() else (None, None, None, 0, None)
        for part in rows:
            events += len(part)
            new = part.sort_values(["ts", "event_id"]).iloc[-1]
            at = (int(new.ts.value // 1000), int(new.event_id))
            if ts is None or at > (ts, event_id):
                status, (ts, event_id) = (None if pd.isna(new.status) else str(new.status)), at
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if status in ENDED else ts // 1000 + self.patience_ms
        if timer is not None:
            self.handle.registerTimer(timer)
        self.last.update((status, ts, event_id, events, timer))
        yield self._row(key, status, ts, event_id, events, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, ts, event_id, events, timer = self.last.get()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            self.last.update((status, ts, event_id, events, None))
            yield self._row(key, status, ts, event_id, events, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, status: str | None, ts: int, event_id: int, events: int, timed_out: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], status, pd.Timestamp(ts, unit="us"), event_id, events, timed_out]], columns=_COLUMNS)


def lifecycle(events: DataFrame, patience_ms: int, late: str = "1 day") -> DataFrame:
    """Changes of jobs, as a stream of events(job, status, ts, event_id) brings them: job, status, ts, event_id of its last event,
    how many it had, and whether it has timed out. Rows more than `late` behind the newest aren't waited for. A job's state is
    one row; its newest row of changes has the most events, and the time-out comes last (see `states`)."""
    job = events.schema["job"].dataType.simpleString()
    rows = events.select("job", "status", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id")).withWatermark("ts", late)
    return rows.groupBy("job").transformWithStateInPandas(JobLife(patience_ms), f"job {job}, status string, ts timestamp, event_id long, events long, timed_out boolean", "Update", "EventTime")


def states(changes: DataFrame) -> DataFrame:
    """The last change of each job: status is `timed_out` for those that waited too long, `last_status` what they had."""
    last = F.max_by(F.struct("status", "ts", "event_id", "events", "timed_out"), F.struct("events", "timed_out"))
    rows = changes.groupBy("job").agg(last.alias("s")).select("job", "s.*")
    return rows.select("job", F.when(F.col("timed_out"), TIMED_OUT).otherwise(F.col("status")).alias("status"), F.col("status").alias("last_status"), "ts", "event_id", "events")
