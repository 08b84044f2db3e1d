"""Streams: sliding limits, last state by key, and time spent in a state."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a table, its event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # A table may be one file or a folder of files.
    is_file = spark.read.format("binaryFile").load(path).select("path").limit(1).first()["path"].rstrip("/").endswith("/" + name)
    stream = reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, kind: str, length: str = "15 minutes", slide: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    """Rows of a kind for each key and sliding window; state older than ``lateness`` is dropped."""
    seen = events.filter(F.col("event_type") == kind).withWatermark("ts", lateness)
    return seen.groupBy(F.window("ts", length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def once_each(events: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Rows without repeats of their keys within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, spark: SparkSession, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream over the files at hand gives, as a table: all of it is run once, and written exactly once."""
    out = f"{checkpoint}/out-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # A stream without files gives an empty table.
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", out).parquet(out)


def closed_states(events: DataFrame, key: str) -> DataFrame:
    """(key, state, begin, until) of every state that its key's next row ended; times in microseconds.

    A key's last row is kept between triggers. Rows of one trigger are put in order; a row older than the
    key's last one comes too late and is left out, so triggers have to follow each other in time.
    """
    kind = events.schema[key].dataType.simpleString()

    def follow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        names, times, ids = rows["event_type"].tolist(), rows["at"].tolist(), rows["event_id"].tolist()
        if state.exists:
            name, at, number = state.get
            late = sum((t, i) < (at, number) for t, i in zip(times, ids, strict=True))
            names, times, ids = [name, *names[late:]], [at, *times[late:]], [number, *ids[late:]]
        state.update((names[-1], times[-1], ids[-1]))
        n = len(names) - 1
        yield pd.DataFrame({"key": [k[0]] * n, "state": names[:-1], "begin": times[:-1], "until": times[1:]})

    rows = events.select(key, "event_type", F.unix_micros("ts").alias("at"), "event_id")
    return rows.groupBy(key).applyInPandasWithState(follow, f"key {kind}, state string, begin long, until long", "name string, at long, number long", "append", GroupStateTimeout.NoTimeout)
