"""The task queue and its budgets: import, claim, retry, state, circuit breaker, rolling limits and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.rules import RETRY_HTTP, RETRY_KINDS
from .ranges import positions, running


def import_rows(rows: DataFrame, required: list[str], text_columns: list[str], url_columns: list[str]) -> dict[str, DataFrame]:
    """Sources, tasks, the bridge between them and events, from raw rows with ``input_path`` and ``row_number``.

    Rows without a required field are skipped. A task is one canonical URL with the highest priority of its sources;
    URLs that aren't web URLs become events.
    """
    valid = rows
    for c in required:
        valid = valid.where(F.coalesce(F.trim(c), F.lit("")) != "")
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in text_columns))
    sources = valid.select(
        F.substring(F.sha2(F.concat_ws(":", "input_path", F.col("row_number").cast("string")), 256), 1, 24).alias("source_id"),
        *valid.columns,
        T.coarse_tags(text).alias("tags"),
        T.coarse_priority(text).alias("priority"),
    )

    def named(column: str) -> Column:
        return F.transform(U.extract(F.col(column)), lambda u: F.struct(u.alias("raw_url"), F.lit(column).alias("field")))

    found = [named(c) for c in url_columns]
    each = sources.select("source_id", "priority", F.explode(F.flatten(F.array(*found))).alias("_u")).select("source_id", "priority", "_u.*")
    each = each.withColumn("url", U.canonical(F.col("raw_url")))
    good = each.where("url is not null").withColumn("task_id", U.task_id(F.col("url")))
    return {
        "sources": sources,
        "tasks": good.groupBy("task_id", "url").agg(F.max("priority").alias("priority")),
        "bridge": good.select("source_id", "task_id", "field").distinct(),
        "events": each.where("url is null").select("source_id", F.lit("invalid_url").alias("kind"), F.substring("raw_url", 1, 2000).alias("detail")),
    }


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Tasks of both, each with the highest priority; the old row's other columns stay."""
    fresh = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key))
    joined = old.join(fresh, key, "full_outer")
    return joined.select(
        key,
        *(
            (F.greatest("priority", "_new_priority") if c == "priority" else F.coalesce(c, f"_new_{c}") if c in new.columns else F.col(c)).alias(c)
            for c in old.columns
            if c != key
        ),
    )


def claim(tasks: DataFrame, now: Column, n: int, key: str = "task_id") -> DataFrame:
    """The next n tasks: those that wait or are due again, the highest priority first."""
    due = (F.col("status") == "pending") | ((F.col("status") == "retry_wait") & (F.col("available_at") <= now))
    return tasks.where(due).orderBy(F.desc("priority"), key).limit(n)


def retry_delay(attempt: Column, base: float = 5.0, most: float = 60.0) -> Column:
    """Seconds to wait after an attempt: doubled each time, up to ``most``."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def retryable(status: Column, flag: Column, kind: Column, http: Column) -> Column:
    allowed = flag.eqNullSafe(F.lit(True)) | F.coalesce(kind.isin(*RETRY_KINDS), F.lit(False)) | F.coalesce(http.isin(*RETRY_HTTP), F.lit(False))
    return (status == "error") & ~flag.eqNullSafe(F.lit(False)) & allowed


def failure_class(status: Column, http: Column, message: Column) -> Column:
    """(status, retryable, error_kind) of a failure."""
    text = F.lower(F.coalesce(message, F.lit("")))
    kind = (
        F.when(http.isin(401, 403) | text.rlike("captcha|verify|forbidden"), "access_challenge")
        .when(http.isin(404, 410), "deleted")
        .when(http == 429, "rate_limited")
        .when(http >= 500, "upstream_unavailable")
        .when(text.rlike("timed? ?out"), "timeout")
        .when(text.rlike("connect|dns|reset|network"), "transport")
        .otherwise("unknown")
    )
    final = F.when(kind == "access_challenge", "blocked").when(kind == "deleted", "deleted").otherwise(status)
    return F.struct(final.alias("status"), kind.isin(*RETRY_KINDS).alias("retryable"), kind.alias("error_kind"))


def fold_states(events: DataFrame, key: str, order: list[str], state: Column) -> DataFrame:
    """Each key's last state, its events and its attempts."""
    return events.withColumn("_state", state).groupBy(key).agg(
        F.max_by("_state", F.struct(*order)).alias("state"), F.count("*").alias("events"), F.count_if(F.col("_state") == "running").alias("attempts")
    )


def never_demoted(events: DataFrame, key: str, order: list[str], status: str, success: tuple[str, ...]) -> DataFrame:
    """Each key's status: the first success if it ever had one, else the last status."""
    won = F.col(status).isin(*success)
    return events.groupBy(key).agg(
        F.coalesce(F.min_by(F.when(won, F.col(status)), F.when(won, F.struct(*order))), F.max_by(F.col(status), F.struct(*order))).alias(status)
    )


def circuit_breaker(runs: DataFrame, run: list[str], order: list[str], failed: Column, most: int = 10) -> DataFrame:
    """Mark what comes after a run's first failure beyond ``most`` as deferred."""
    seen = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(failed, 1).otherwise(0)).over(seen), F.lit(0))
    return runs.withColumns({"failures_before": before, "deferred": before > most})


def running_budget(rows: DataFrame, run: list[str], order: list[str], amount: Column, budget: float) -> DataFrame:
    """Mark rows that keep the running sum of a run within its budget."""
    upto = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("spent", F.sum(amount).over(upto)).withColumn("within", F.col("spent") <= budget)


def rolling_count(events: DataFrame, key: list[str], seconds: Column, span: int = 86_400) -> DataFrame:
    """For each event, how many of its key there were within the span that ends with it."""
    by = Window.partitionBy(*key).orderBy("_at").rangeBetween(-span, 0)
    return events.withColumn("_at", seconds).withColumn("in_span", F.count("*").over(by)).drop("_at")


def gaps(events: DataFrame, key: list[str], order: list[str], seconds: Column, least: int) -> DataFrame:
    """Seconds since the key's last event, and whether they are fewer than ``least``."""
    by = Window.partitionBy(*key).orderBy(*order)
    gap = seconds - F.lag(seconds).over(by)
    return events.withColumn("gap", gap).withColumn("too_soon", F.coalesce(F.col("gap") < least, F.lit(False)))


def paced_starts(requests: DataFrame, key: str, order: list[str], asked: Column, delay: float) -> DataFrame:
    """When each request of a domain may start: not before it is asked for, nor within ``delay`` of the one before.

    start_i = max over j <= i of asked_j + (i - j) * delay, which is a running maximum.
    """
    placed = positions(requests.withColumn("_asked", asked), [key], order, "_nth")
    led = running(placed, [key], order, highest={"_lead": F.col("_asked") - F.col("_nth") * delay})
    return led.withColumn("start", F.col("_lead") + F.col("_nth") * delay).drop("_nth", "_asked", "_lead")


def batches(rows: DataFrame, order: list[str], size: int, within: list[str]) -> DataFrame:
    """Number the rows of each group into batches of ``size``."""
    placed = positions(rows, within, order, "_nth")
    return placed.withColumn("batch", F.floor((F.col("_nth") - 1) / size).cast("long") + 1).drop("_nth")


def capped(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """Mark the first ``most`` rows of each group as kept; the rest are counted in ``beyond``."""
    by = Window.partitionBy(*group)
    nth = F.row_number().over(by.orderBy(*order))
    return rows.withColumn("kept", nth <= most).withColumn("beyond", F.greatest(F.lit(0).cast("long"), F.count("*").over(by) - most))
