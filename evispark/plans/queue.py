"""Queue queries: import, claim, budgets and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, queue, rollups
from .base import Registry

R = Registry()
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'pending' ELSE 'retry_wait' END"


def tasks(t):
    return t.orders.selectExpr("o_orderkey AS task_id", "o_custkey", f"{STATUS} AS status", "6 - cast(substr(o_orderpriority, 1, 1) AS int) AS priority", "cast(o_orderdate AS timestamp) AS available_at", "o_totalprice", "o_orderpriority")


@R.add(
    f"""SELECT c_mktsegment AS segment, o_orderpriority AS level, count(*) AS tasks, count(DISTINCT o_custkey) AS sources,
    max(6 - CAST(substr(o_orderpriority, 1, 1) AS int)) AS priority, sum(CASE WHEN {STATUS} = 'pending' THEN 1 ELSE 0 END)::BIGINT AS waiting
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name <> '' GROUP BY ALL"""
)
def q_queue_import(t):
    """Tasks and their sources, by segment and level."""
    joined = tasks(t).join(t.customer.where("c_name <> ''"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("level")).agg(
        F.count("*").alias("tasks"),
        F.countDistinct("o_custkey").alias("sources"),
        F.max("priority").alias("priority"),
        F.count_if(F.col("status") == "pending").alias("waiting"),
    )


@R.add(
    f"""SELECT o_orderkey AS task_id, 6 - CAST(substr(o_orderpriority, 1, 1) AS int) AS priority FROM orders
    WHERE {STATUS} = 'pending' OR ({STATUS} = 'retry_wait' AND o_orderdate <= TIMESTAMP '1998-01-01')
    ORDER BY priority DESC, task_id LIMIT 50"""
)
def q_claim_topk(t):
    """The next fifty tasks."""
    return queue.claim(tasks(t), F.lit("1998-01-01").cast("timestamp"), 50).select("task_id", "priority")


@R.add("SELECT o_custkey, max(6 - CAST(substr(o_orderpriority, 1, 1) AS int)) AS priority, count(*) AS n FROM orders GROUP BY 1")
def q_task_max_priority(t):
    """One task for each key with the highest priority of its sources."""
    return tasks(t).groupBy("o_custkey").agg(F.max("priority").alias("priority"), F.count("*").alias("n"))


@R.add(
    f"""SELECT d.status, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('ok'), ('pending'), ('retry_wait'), ('blocked'), ('deleted')) d(status)
    LEFT JOIN (SELECT {STATUS} AS status, count(*) AS n FROM orders GROUP BY 1) x ON x.status = d.status"""
)
def q_status_stats(t):
    """Tasks by status, 0 for statuses that none has."""
    return rollups.zero_filled(tasks(t), "status", ["ok", "pending", "retry_wait", "blocked", "deleted"])


@R.add(
    """SELECT o_orderkey AS task_id, attempt, least(60.0, 5.0 * pow(2.0, greatest(0, attempt - 1)))::DOUBLE AS delay,
    attempt < 3 AS again FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS int) AS attempt FROM orders WHERE o_orderstatus = 'P')"""
)
def q_retry_schedule(t):
    """Delay before the next attempt of tasks that wait for it."""
    waiting = t.orders.where("o_orderstatus = 'P'").selectExpr("o_orderkey AS task_id", "cast(substr(o_orderpriority, 1, 1) AS int) AS attempt")
    return waiting.select("task_id", "attempt", queue.retry_delay(F.col("attempt")).alias("delay"), (F.col("attempt") < 3).alias("again"))


@R.add(
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, failures_before, failures_before > 10 AS deferred FROM (
    SELECT *, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey
      ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS failures_before
    FROM lineitem)"""
)
def q_circuit_breaker(t):
    """What each supplier's run does before and after its eleventh failure."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    out = queue.circuit_breaker(t.lineitem, ["l_suppkey"], order, F.col("l_returnflag") == "R")
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "failures_before", "deferred")


@R.add(
    """SELECT event_id, user_id, spent, spent <= 500 AS within FROM (SELECT *, sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id
    ORDER BY ts, event_id)::DOUBLE AS spent FROM events)"""
)
def q_running_budget(t):
    """Events that keep their user's running sum within a budget."""
    return queue.running_budget(t.events, ["user_id"], ["ts", "event_id"], F.col("value").cast("decimal(18,4)"), 500).select("event_id", "user_id", F.col("spent").cast("double").alias("spent"), "within")


@R.add(
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_span FROM events"""
)
def q_rolling_24h(t):
    """Events of the same user within the day that ends with each."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return queue.rolling_count(t.events, ["user_id"], seconds).select("event_id", "in_span")


@R.add(
    """SELECT event_id, gap, coalesce(gap < 180, false) AS too_soon FROM (SELECT event_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)"""
)
def q_pacing_gap(t):
    """Seconds since the same user's last event."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return queue.gaps(t.events, ["user_id"], ["ts", "event_id"], seconds, 180).select("event_id", "gap", "too_soon")


@R.add(
    """WITH x AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS asked, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM events)
    SELECT event_id, (max(asked - nth * 240) OVER (PARTITION BY event_type ORDER BY nth) + nth * 240)::BIGINT AS start FROM x"""
)
def q_paced_starts(t):
    """When each request may start if those of a type are 240 seconds apart."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    out = queue.paced_starts(t.events, "event_type", ["ts", "event_id"], seconds, 240)
    return out.select("event_id", F.col("start").cast("long").alias("start"))


@R.add(
    """SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS state, count(*) AS events,
    count(*) FILTER (event_type = 'click') AS attempts FROM events GROUP BY 1"""
)
def q_task_state_fold(t):
    """Each task's last state and its attempts."""
    state = F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type"))
    out = queue.fold_states(t.events, "user_id", ["ts", "event_id"], state)
    return out.withColumn("state", F.when(F.col("state") == "running", "click").otherwise(F.col("state")))


@R.add(
    """SELECT user_id, coalesce(arg_min(event_type, struct_pack(a := ts, b := event_id)) FILTER (event_type IN ('purchase', 'signup')),
    arg_max(event_type, struct_pack(a := ts, b := event_id))) AS status FROM events GROUP BY 1"""
)
def q_success_never_demoted(t):
    """The first success of each key, else its last status."""
    return queue.never_demoted(t.events.withColumnRenamed("event_type", "status"), "user_id", ["ts", "event_id"], "status", ("purchase", "signup"))


@R.add("SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 20 + 1 AS batch FROM customer")
def q_batch_slices(t):
    """Batches of twenty companies within each segment."""
    return queue.batches(t.customer, ["c_custkey"], 20, ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "batch")


@R.add(
    """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) <= 3 AS kept,
    greatest(0, count(*) OVER (PARTITION BY l_orderkey) - 3) AS beyond FROM lineitem"""
)
def q_capped_details(t):
    """The first three details of each task are enqueued, the others counted."""
    return queue.capped(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], 3).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "kept", "beyond")


@R.add(f"SELECT min(o_orderdate)::VARCHAR AS next_due FROM orders WHERE {STATUS} = 'retry_wait'")
def q_next_due(t):
    """When the next waiting task is due."""
    return tasks(t).where("status = 'retry_wait'").agg(F.date_format(F.min("available_at"), "yyyy-MM-dd HH:mm:ss").alias("next_due"))


@R.add(
    """SELECT l_orderkey, l_linenumber, max(l_shipdate)::VARCHAR AS shipped, arg_max(l_partkey, struct_pack(a := l_shipdate, b := l_partkey, c := l_extendedprice)) AS l_partkey FROM lineitem GROUP BY 1, 2"""
)
def q_last_wins_results(t):
    """The last result of each key."""
    out = dedup.last_wins(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_extendedprice"], ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"])
    return out.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"), "l_partkey")


QUERIES, ORACLE_SQL = R.queries, R.sql
