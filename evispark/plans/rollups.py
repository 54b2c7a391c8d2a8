"""Roll-ups, clusters, histograms and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, rollups
from .base import Registry

R = Registry()
LEVEL = "CASE p_size % 5 WHEN 0 THEN 'limited_source_ai_mention' WHEN 1 THEN 'csv_declared' WHEN 2 THEN 'page_text' WHEN 3 THEN 'structured_job' ELSE 'audit_confirmed' END"
RANK = "CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END"


@R.add(
    f"""SELECT l_suppkey, min(p_size % 4 + 1)::INT AS best_priority, count(*) AS matched_role_count, arg_max({LEVEL}, {RANK}) AS evidence_level
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
)
def q_company_rollup(t):
    """Best priority, roles and highest evidence level of each company."""
    jobs = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.selectExpr("p_partkey", "p_size % 4 + 1 AS priority", f"{LEVEL} AS level"), F.col("l_partkey") == F.col("p_partkey"))
    return rollups.company_rollup(jobs, ["l_suppkey"], "priority", "level")


@R.add(
    """SELECT r_name AS scope, count(*) AS companies, count(DISTINCT n_nationkey) AS industries, round(sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE, 2) AS balance
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)"""
)
def q_scope_rollup(t):
    """Counts of each scope and of all."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "scope")
    measures = {"companies": F.count("*"), "industries": F.countDistinct("n_nationkey"), "balance": F.round(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double"), 2)}
    return rollups.scope_rollup(rows, "scope", measures)


@R.add(
    """SELECT CASE WHEN v = '' THEN 'unknown' ELSE v END AS reason, count(*) AS n FROM (SELECT regexp_extract(props, '"k": ?([0-9])', 1) AS v FROM events) GROUP BY 1"""
)
def q_stop_reason_hist(t):
    """A histogram of what a pattern finds in a text."""
    return rollups.reasons(t.events, "props", '"k": ?([0-9])', "unknown")


@R.add(
    """SELECT event_type, user_id, n, array_to_string(list_transform(l[1:3], lambda x: x.e::VARCHAR), ',') AS examples FROM (
    SELECT event_type, user_id, count(*) AS n, list(struct_pack(t := ts, e := event_id) ORDER BY ts, event_id) AS l FROM events GROUP BY 1, 2)"""
)
def q_failure_clusters(t):
    """Size and first three examples of each cluster."""
    return rollups.clusters(t.events, ["event_type", "user_id"], "ts", "event_id")


@R.add("SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def q_top_domains(t):
    """The twenty most frequent domains."""
    from ..functions import urls

    return rollups.top(t.pages.select(urls.host(F.col("url")).alias("domain")), "domain", 20)


@R.add(
    """SELECT d.p AS priority, coalesce(n, 0)::BIGINT AS n FROM (VALUES (1), (2), (3), (4), (5), (6)) d(p) LEFT JOIN (SELECT CAST(substr(o_orderpriority, 1, 1) AS int) AS p, count(*) AS n FROM orders GROUP BY 1) x ON x.p = d.p"""
)
def q_status_by_priority(t):
    """Tasks by priority, 0 for priorities that none has."""
    return rollups.zero_filled(t.orders.selectExpr("cast(substr(o_orderpriority, 1, 1) AS int) AS priority"), "priority", [1, 2, 3, 4, 5, 6])


@R.add(
    """SELECT 'orphan_tasks' AS "check", count(*) AS violations, count(*) = 0 AS passed FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'tasks_without_children', count(*), count(*) = 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'repeated_children', count(*), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'negative_prices', count(*), count(*) = 0 FROM lineitem WHERE l_extendedprice < 0"""
)
def q_consistency_report(t):
    """Violations of four checks."""
    return checks.report(
        {
            "orphan_tasks": checks.subset_violations(t.orders, t.customer.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]),
            "tasks_without_children": checks.subset_violations(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]),
            "repeated_children": t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
            "negative_prices": t.lineitem.where("l_extendedprice < 0"),
        }
    )


@R.add(
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1996)
    SELECT id, 'added' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT id, 'removed' FROM (FROM b EXCEPT FROM a)"""
)
def q_delta_new_ids(t):
    """Ids that one of two years has."""
    year = lambda y: t.orders.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("id"))
    return checks.delta(year(1997), year(1996), "id")


@R.add(
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1996)
    SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'first', count(*) FROM (FROM a EXCEPT FROM b)"""
)
def q_set_ops(t):
    """Sizes of intersection, union and difference."""
    year = lambda y: t.orders.where(F.year("o_orderdate") == y).select("o_custkey").distinct()
    a, b = year(1997), year(1996)
    size = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return size(a.intersect(b), "both").unionByName(size(a.union(b).distinct(), "either")).unionByName(size(a.subtract(b), "first"))


@R.add(
    """WITH q AS (SELECT l_orderkey AS id, count(*) FILTER (l_linestatus = 'F') AS done, count(*) AS jobs FROM lineitem GROUP BY 1),
    p AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS done, count(*) AS jobs FROM lineitem GROUP BY 1)
    SELECT q.id, CASE WHEN p.done > q.done THEN 'after' WHEN p.done = q.done THEN 'before' ELSE 'before' END AS kept, greatest(p.done, q.done) AS done, q.jobs FROM q JOIN p USING (id)"""
)
def q_better_result(t):
    """Of two results of a task the better, the earlier one on a tie."""
    results = lambda flag: t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(flag).alias("done"), F.count("*").alias("jobs"))
    return checks.better(results(F.col("l_returnflag") == "R"), results(F.col("l_linestatus") == "F"), "id", ["done", "jobs"])


QUERIES, ORACLE_SQL = R.queries, R.sql
