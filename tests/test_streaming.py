"""Streams over several triggers against their batch results."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tallybook.operators import timing
from tallybook.streaming import courses, limits


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stream")
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=7 * k), k % 3, ("error", "view", "click")[k * k % 3], float(k), "{}") for k in range(90)]
    for part in range(3):
        path = str(top / f"p{part}")
        frame = spark.createDataFrame(rows[30 * part : 30 * part + 30], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        frame.coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.makedirs(top / "events", exist_ok=True)
                os.rename(f"{path}/{name}", top / "events" / f"{part}.parquet")
                stamp = time.time() - 1000 + 10 * part
                os.utime(top / "events" / f"{part}.parquet", (stamp, stamp))
    return top


def test_closed_states_follow_over_triggers(spark, folder):
    stream = limits.closed_states(limits.event_stream(spark, str(folder / "events")), "user_id")
    got = sorted(tuple(r)[:4] for r in limits.drained(stream, spark, str(folder / "a")).collect())
    batch = timing.state_durations(spark.read.parquet(str(folder / "events")), "user_id", "ts", ["event_id"]).filter("until is not null")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    assert got == sorted(tuple(r) for r in batch.select("user_id", "event_type", micros("ts"), micros("until")).collect())
    assert len(got) == 87


def test_windowed_counts(spark, folder):
    stream = limits.windowed_counts(limits.event_stream(spark, str(folder / "events")), "user_id", "error", "30 minutes", "10 minutes", "1 day")
    found = limits.drained(stream, spark, str(folder / "b"), "update").groupBy("user_id", "w").agg(F.max("n").alias("n"))
    events = spark.read.parquet(str(folder / "events")).withColumn("ts", F.col("ts").cast("timestamp")).filter("event_type = 'error'")
    want = events.groupBy(F.window("ts", "30 minutes", "10 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda d: sorted((r["user_id"], r["w"]["start"], r["n"]) for r in d.collect())
    assert pick(found) == pick(want) and len(pick(want)) > 0


def test_once_each(spark, folder):
    stream = limits.once_each(limits.event_stream(spark, str(folder / "events")).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "10 days")
    got = limits.drained(stream, spark, str(folder / "c")).select("user_id", "event_type").collect()
    assert len(got) == len(set(got)) == spark.read.parquet(str(folder / "events")).select("user_id", "event_type").distinct().count()


def plain_course(news, idle, most_failures, watermark):
    """One job's history by the stated rules: (number, at, status) of each piece of news, and whether it is still under way."""
    status, failures, last, out = "", 0, None, []
    for at, number, kind in sorted(news):
        if status and at > last + idle:
            out.append((last + idle, "expired"))
            status = ""
        last = at
        if kind == "submitted" and status in ("", "error"):
            status, failures = "new", 0
            out.append((at, "new"))
        elif status == "new" and kind in ("no_profile", "no_items"):
            status = "error"
            out.append((at, "error"))
        elif status == "new" and kind == "failed":
            failures += 1
            status = "error" if failures == most_failures else status
            out.append((at, "error" if status == "error" else "retry"))
        elif (status, kind) in (("new", "extracted"), ("extracted", "confirmed")):
            status = kind if kind == "extracted" else ""
            out.append((at, kind))
        else:
            out.append((at, "refused"))
    if status and watermark > last + idle:
        out.append((last + idle, "expired"))
        status = ""
    return sorted(out), bool(status)


def test_job_courses_over_triggers(spark, tmp_path):
    """Gates, one retry, jobs that expire between triggers and at the end; the state that is left is that of jobs under way."""
    import random

    draw = random.Random(3)
    start, kinds = dt.datetime(2024, 1, 1), ["submitted", "submitted", "no_profile", "no_items", "failed", "failed", "extracted", "extracted", "confirmed"]
    # Job 0 is submitted once and then silent; time goes on with the others.
    news = [(0, -1, start, "submitted"), *((draw.randrange(1, 9), k, start + dt.timedelta(minutes=11 * k + k % 7), draw.choice(kinds)) for k in range(240))]
    schema = "job long, number long, ts timestamp_ntz, kind string"
    for part in range(4):
        rows = news[part * 60 : part * 60 + 60] + (news[240:] if part == 3 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "news"))
        time.sleep(1.1)
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "news")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "news")).withColumn("ts", F.col("ts").cast("timestamp"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")}
    try:
        got = limits.drained(courses.courses(stream, lateness="5 minutes", idle="5 hours"), spark, str(tmp_path / "checkpoint")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len({r.batch for r in got}) > 3
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    end = max(micros(n[2]) for n in news) - 5 * 60 * 1_000_000
    for job in range(9):
        want, under_way = plain_course([(micros(ts), number, kind) for j, number, ts, kind in news if j == job], 5 * 3600 * 1_000_000, 2, end)
        mine = sorted((r.at, r.status) for r in got if r.job == job)
        assert mine == want, job
    assert {"new", "retry", "error", "extracted", "confirmed", "refused", "expired"} <= {r.status for r in got}
