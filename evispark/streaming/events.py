"""Streams of events: windows with watermarks, the task state fold, and batches that complete in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import materialise, shared_path


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by window and type; events later than ``late`` are left out of a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    counted = timed.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's sessions: runs of events no further apart than ``gap``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    grouped = timed.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def without_repeats(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def task_states(events: DataFrame) -> DataFrame:
    """A stream's (task_id, seq, state) folded to each task's latest state and its attempts, by keyed state."""

    def fold(key, frames: Iterator[pd.DataFrame], state):
        seq, last, attempts = state.get if state.exists else (-1, "", 0)
        for frame in frames:
            attempts += int((frame["state"] == "running").sum())
            top = frame.loc[frame["seq"].idxmax()]
            if top["seq"] > seq:
                seq, last = int(top["seq"]), str(top["state"])
        state.update((seq, last, attempts))
        yield pd.DataFrame({"task_id": [key[0]], "state": [last], "attempts": [attempts]})

    return events.groupBy("task_id").applyInPandasWithState(fold, "task_id long, state string, attempts long", "seq long, state string, attempts long", "update", "NoTimeout")


def in_order(batches: DataFrame, done: int) -> list[int]:
    """The numbers of batches that may be processed now: those that follow ``done`` without a gap."""
    ready = {r["batch"] for r in batches.where(F.col("batch") > done).select("batch").distinct().collect()}
    out = []
    while done + 1 in ready:
        done += 1
        out.append(done)
    return out


def merge_batches(batches: DataFrame, order: list[str], key: list[str], upto: int) -> DataFrame:
    """Candidates of all batches up to a number, the first of each key; stored, as reports read it many times."""
    from ..operators.dedup import first_wins

    return materialise(first_wins(batches.where(F.col("batch") <= upto), key, [F.col("batch"), *map(F.col, order)]), "candidates")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives from all that lies at its source now: its rows with ``batch``, the number of their micro-batch.

    Micro-batches are written to the shared folder, each to a folder of its own, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    path, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")  # so that a stream without batches can be read

    def store(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(store).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(path).where("batch >= 0")
