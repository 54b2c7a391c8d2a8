"""Retries as keyed state with timers: an attempt that may be repeated sets a timer, and what is due comes out when time has passed it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.queue import retry_delay

#: task_id, the attempt that is due next, and the time (milliseconds) at which it is.
DUE = StructType([StructField("task_id", LongType()), StructField("attempt", IntegerType()), StructField("due_ms", LongType())])


class Retries(StatefulProcessor):
    """Holds each task's number of attempts and at most one timer.

    Rows are attempts in order of time: a success or a failure that isn't to be repeated takes the timer away, a repeatable
    failure moves it, unless the task has had all its attempts.
    """

    def __init__(self, most: int = 3, base: float = 5.0, longest: float = 60.0):
        self.most, self.base, self.longest = most, base, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", StructType([StructField("n", IntegerType())]))
        self.due = handle.getValueState("due", StructType([StructField("ms", LongType())]))

    def _clear(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        for row in sorted(rows, key=lambda r: (r.at_ms, r.attempt_id)):
            n = (self.attempts.get()[0] if self.attempts.exists() else 0) + 1
            # One micro-batch may hold what came before and after a timer, so what was due by now comes out first.
            if self.due.exists() and self.due.get()[0] <= row.at_ms:
                yield Row(task_id=key[0], attempt=n, due_ms=self.due.get()[0])
            self.attempts.update((n,))
            self._clear()
            if row.repeatable and n < self.most:
                wait = min(self.longest, self.base * 2 ** max(0, n - 1))
                due = row.at_ms + int(1000 * wait)
                self.handle.registerTimer(due)
                self.due.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        yield Row(task_id=key[0], attempt=self.attempts.get()[0] + 1, due_ms=due)

    def close(self) -> None:
        pass


def due_retries(attempts: DataFrame, late: str = "0 seconds", most: int = 3, base: float = 5.0, longest: float = 60.0) -> DataFrame:
    """The retries (see DUE) of a stream of attempts (task_id, attempt_id, at timestamp, repeatable), each when the watermark has passed it.

    State is kept in the RocksDB store, which the session has to be set to (``use_rocksdb``). Null ``repeatable`` is not repeatable.
    """
    told = attempts.select("task_id", "attempt_id", "at", F.unix_millis("at").alias("at_ms"), F.coalesce("repeatable", F.lit(False)).alias("repeatable"))
    return told.withWatermark("at", late).groupBy("task_id").transformWithState(Retries(most, base, longest), DUE, "append", "eventTime")


def use_rocksdb(spark) -> None:
    """Keyed state with timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def retry_schedule(attempts: DataFrame, now: str | None = None, most: int = 3, base: float = 5.0, longest: float = 60.0) -> DataFrame:
    """The same retries from a table of all attempts: those after which nothing came before they were due, up to ``now`` (null: all)."""
    order = Window.partitionBy("task_id").orderBy("at_ms", "attempt_id")
    told = attempts.select("task_id", "attempt_id", F.unix_millis("at").alias("at_ms"), F.coalesce("repeatable", F.lit(False)).alias("repeatable"))
    n = F.row_number().over(order)
    each = told.withColumns({"n": n, "next_ms": F.lead("at_ms").over(order)}).where(F.col("repeatable") & (F.col("n") < most))
    due = each.select("task_id", (F.col("n") + 1).cast("int").alias("attempt"), (F.col("at_ms") + (1000 * retry_delay(F.col("n"), base, longest)).cast("long")).alias("due_ms"), "next_ms")
    kept = due.where(F.col("next_ms").isNull() | (F.col("next_ms") >= F.col("due_ms")))
    return (kept if now is None else kept.where(F.col("due_ms") <= F.unix_millis(F.lit(now).cast("timestamp")))).drop("next_ms")
