"""Queries that judge results: failures, causes, completeness and shared context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, dedup, documents, joins, pagination, queue, targets
from .base import Registry

R = Registry()
_HTTP = "[200, 403, 404, 429, 500, 503][(event_id % 6 + 1)::INT]"
_WORDS = ("fine", "captcha shown", "read timed out", "connection reset")
_MESSAGE = f"{list(_WORDS)}[(user_id % 4 + 1)::INT]"
_KIND = f"""CASE WHEN {_HTTP} IN (401, 403) OR regexp_matches({_MESSAGE}, 'captcha|verify|forbidden') THEN 'access_challenge' WHEN {_HTTP} IN (404, 410) THEN 'deleted'
    WHEN {_HTTP} = 429 THEN 'rate_limited' WHEN {_HTTP} >= 500 THEN 'upstream_unavailable' WHEN regexp_matches({_MESSAGE}, 'timed? ?out') THEN 'timeout'
    WHEN regexp_matches({_MESSAGE}, 'connect|dns|reset|network') THEN 'transport' ELSE 'unknown' END"""


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


@R.add(
    f"""SELECT event_id, CASE WHEN kind = 'access_challenge' THEN 'blocked' WHEN kind = 'deleted' THEN 'deleted' ELSE 'error' END AS status,
    kind IN ('timeout', 'transport', 'rate_limited', 'upstream_unavailable') AS retryable, kind AS error_kind FROM (SELECT event_id, {_KIND} AS kind FROM events)"""
)
def q_failure_class(t):
    """What a failure is, and whether to try again."""
    http, message = _pick((200, 403, 404, 429, 500, 503), "event_id"), _pick(_WORDS, "user_id")
    return t.events.select("event_id", queue.failure_class(F.lit("error"), http, message).alias("f")).select("event_id", "f.*")


@R.add(
    f"""SELECT event_id, event_type = 'error' AND event_id % 7 <> 0 AND (event_id % 5 = 0 OR {_HTTP} IN (408, 425, 429, 500, 502, 503, 504)) AS again FROM events"""
)
def q_retryable(t):
    """Whether the policy retries a result: errors that say so or have a passing cause, unless they say no."""
    flag = F.when(F.col("event_id") % 7 == 0, False).when(F.col("event_id") % 5 == 0, True)
    http = _pick((200, 403, 404, 429, 500, 503), "event_id")
    return t.events.select("event_id", queue.retryable(F.col("event_type"), flag, F.lit(None).cast("string"), http).alias("again"))


@R.add(
    """SELECT id, CASE WHEN jobs = 0 AND chars = 0 THEN 'empty_document' WHEN jobs = 0 AND id % 2 = 0 THEN 'article_without_jobs' WHEN jobs = 0 THEN 'no_structured_jobs' WHEN chars < 80 THEN 'short_body' ELSE 'coverage_unconfirmed' END AS cause
    FROM (SELECT o_orderkey AS id, count(l_orderkey) FILTER (l_returnflag = 'R') AS jobs, (coalesce(sum(l_quantity), 0) * 2)::BIGINT AS chars FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""
)
def q_root_cause(t):
    """Why results are only partial."""
    joined = t.orders.select(F.col("o_orderkey").alias("id")).join(t.lineitem.select(F.col("l_orderkey").alias("id"), "l_returnflag", "l_quantity"), "id", "left")
    shown = joined.groupBy("id").agg(F.count_if(F.col("l_returnflag") == "R").alias("jobs"), (F.coalesce(F.sum("l_quantity"), F.lit(0.0)) * 2).cast("long").alias("chars"))
    host = F.when(F.col("id") % 2 == 0, "mp.weixin.qq.com").otherwise("x.com")
    return shown.select("id", checks.root_cause(F.lit("partial"), F.lit(""), F.col("jobs"), F.col("chars"), host).alias("cause"))


@R.add(
    """SELECT l_orderkey AS batch, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus, count(*) AS records FROM lineitem GROUP BY 1"""
)
def q_shared_context(t):
    """Fields that all records of a batch share are told once."""
    return documents.shared_context(t.lineitem.withColumnRenamed("l_orderkey", "batch"), "batch", ["l_returnflag", "l_linestatus"])


@R.add(
    """WITH s AS (SELECT l_suppkey % 50 AS run, l_linenumber AS snapshot, l_partkey % 3 AS item FROM lineitem), g AS (SELECT run, snapshot, list_sort(list(DISTINCT item)) AS items FROM s GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY snapshot DESC) AS nth, lead(items) OVER (PARTITION BY run ORDER BY snapshot DESC) AS before FROM g)
    SELECT n.run, CASE WHEN before IS NOT NULL THEN items = before AND len(items) = u ELSE NULL END AS stable FROM n JOIN (SELECT run, count(DISTINCT item) AS u FROM s GROUP BY 1) a ON a.run = n.run WHERE nth = 1"""
)
def q_stable_snapshots(t):
    """Whether the last two snapshots of a list agree and nothing else was ever seen."""
    rows = t.lineitem.selectExpr("l_suppkey % 50 AS run", "l_linenumber AS snapshot", "l_partkey % 3 AS item")
    return pagination.stable_snapshots(rows)


@R.add(
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'wechat' WHEN page_id % 4 = 1 AND page_id % 3 = 0 THEN 'static_topic' WHEN page_id % 4 = 2 THEN 'questionnaire' WHEN page_id % 3 = 1 THEN 'static_document' ELSE '' END AS kind FROM pages"""
)
def q_limited_sources(t):
    """Sources that show only part of their content."""
    host = _pick(("mp.weixin.qq.com", "campus.51job.com", "v.wjx.cn", "x.com"), "page_id")
    reason = _pick(("static_topic_complete", "static_document", "last_page"), "page_id")
    return t.pages.select("page_id", targets.limited_kind(F.lit("partial"), host, reason).alias("kind"))


@R.add(
    """SELECT k AS o_custkey, coalesce(a.v, b.v) AS status FROM (SELECT o_custkey AS k, arg_min(o_orderstatus, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, arg_min(o_orderstatus, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b USING (k)"""
)
def q_store_over_files(t):
    """Documents of the store take precedence over those of files."""
    side = lambda odd: t.orders.where(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"))
    return dedup.precedence([side(0), side(1)], ["o_custkey"])


@R.add(
    """SELECT doc_id, true AS listed FROM labels UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def q_augment(t):
    """Documents that no label lists are added to those that are labelled."""
    return joins.augment(t.labels.select("doc_id", F.lit(True).alias("listed")), t.documents.select("doc_id"), ["doc_id"])


QUERIES, ORACLE_SQL = R.queries, R.sql
