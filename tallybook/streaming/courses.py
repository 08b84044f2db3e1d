"""The course of jobs through their gates, as a stream: one state for each job, which leaves with a timer when the job is over or idle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Runs of a job that fail before it is an error for good.
MOST_FAILURES = 2
#: A job without news for so long has expired.
IDLE = "3 days"

_STATE = "status string, failures int, at long, number long"
_OUT = "job long, number long, at long, status string, reason string"


@dataclass
class Job:
    """A job's place in its course; ``status`` is empty before it is submitted."""

    status: str = ""
    failures: int = 0
    at: int = 0
    number: int = -1
    history: list[tuple[int, int, str, str]] = field(default_factory=list)

    def _now(self, status: str, reason: str = "") -> None:
        self.status = status
        self.history.append((self.number, self.at, status, reason))

    def idle_from(self, now: int, idle: int) -> None:
        """Expire if the last news is more than ``idle`` before ``now``."""
        if self.status and now > self.at + idle:
            self.history.append((self.number, self.at + idle, "expired", self.status))
            self.status, self.failures, self.number = "", 0, -1

    def take(self, at: int, number: int, kind: str, most_failures: int) -> None:
        """One piece of news, by the rules that ``courses`` states."""
        if (at, number) <= (self.at, self.number):
            self.history.append((number, at, "late", self.status))
            return
        self.at, self.number = at, number
        if kind == "submitted" and self.status in ("", "error"):
            self.failures = 0
            self._now("new")
        elif kind in ("no_profile", "no_items") and self.status == "new":
            self._now("error", kind)
        elif kind == "failed" and self.status == "new":
            self.failures += 1
            if self.failures < most_failures:
                self.history.append((number, at, "retry", kind))
            else:
                self._now("error", kind)
        elif kind == "extracted" and self.status == "new":
            self._now("extracted")
        elif kind == "confirmed" and self.status == "extracted":
            self._now("confirmed")
            self.status = ""
        else:
            self.history.append((number, at, "refused", kind))


class _Course(StatefulProcessor):
    def __init__(self, idle: int, most_failures: int) -> None:
        self.idle, self.most_failures = idle, most_failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", _STATE)

    def _kept(self) -> Job:
        return Job(*self.state.get()) if self.state.exists() else Job()

    def _left(self, key: tuple, job: Job) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.status:
            self.state.update((job.status, job.failures, job.at, job.number))
            # The timer counts in milliseconds, the first after the job is idle.
            self.handle.registerTimer((job.at + self.idle) // 1000 + 1)
        else:
            self.state.clear()
        return pd.DataFrame([(key[0], *h) for h in job.history], columns=["job", "number", "at", "status", "reason"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        job = self._kept()
        news = pd.concat(list(rows)).sort_values(["at", "number"], kind="stable")
        for at, number, kind in zip(news["at"].tolist(), news["number"].tolist(), news["kind"].tolist(), strict=True):
            job.idle_from(at, self.idle)
            job.take(at, number, kind, self.most_failures)
        yield self._left(key, job)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        job = self._kept()
        job.idle_from(1000 * expiredTimerInfo.getExpiryTimeInMs(), self.idle)
        yield self._left(key, job)

    def close(self) -> None:
        pass


def micros(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {interval}) AS n").first()["n"]


def keep_state_on_disk(spark: SparkSession) -> None:
    """Timers need the state store that keeps its state on disk, whatever the number of keys, with changes only in its checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def courses(news: DataFrame, lateness: str = "1 hour", idle: str = IDLE, most_failures: int = MOST_FAILURES) -> DataFrame:
    """(job, number, at, status, reason): the history of each job of the stream ``news`` (job long, number long, ts, kind), times in microseconds.

    A job is new once submitted, an error without profile, without items, or after ``most_failures`` failed runs (a
    run that failed before is a retry), then extracted, then confirmed, which ends it. A job in error may be
    submitted anew. News that a gate does not let through is refused and changes nothing; ``reason`` says which. News of
    a job come in the order of times and numbers; older than the last taken is late. A job without
    news for more than ``idle`` expires, by a timer once the watermark is past it or by its next news: its state
    leaves, and so does that of one confirmed, so what is kept grows with the jobs under way alone.
    """
    spark = news.sparkSession
    keep_state_on_disk(spark)
    rows = news.withWatermark("ts", lateness).select(F.col("job").cast("long").alias("job"), F.col("number").cast("long").alias("number"), "ts", F.unix_micros("ts").alias("at"), "kind")
    return rows.groupBy("job").transformWithStateInPandas(_Course(micros(spark, idle), most_failures), _OUT, "Append", "EventTime")
