"""Acceptance rules over orders (results) and their line items (jobs and pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acceptance as A
from .base import Registry

R = Registry()
_STOPS = ("terminal_pagination", "last_page", "reported_total_reached", "max_pages_reached", "")
_STATUSES = ("partial", "ok", "blocked", "partial", "error", "deleted", "strange")
_STOP_SQL = f"{list(_STOPS)}[(o_orderkey % 5 + 1)::INT]"
_STATUS_SQL = f"{list(_STATUSES)}[(o_orderkey % 7 + 1)::INT]"
# Jobs are what the line items have; the n-th page is line n.
_BASE = f"""WITH l AS (SELECT l_orderkey AS k, count(*) AS jobs, count(*) FILTER (l_quantity > 3) AS titled, count(*) FILTER (l_returnflag <> 'R' AND l_tax < 0.07) AS good,
    count(*) FILTER (l_quantity > 25) AS long_text, count(DISTINCT l_linenumber) AS lines, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(*) FILTER (l_quantity <= 25) AS lacking FROM lineitem GROUP BY 1),
  r AS (SELECT o_orderkey AS id, {_STATUS_SQL} AS status, {_STOP_SQL} AS stop_reason, o_orderkey % 3 <> 0 AS list_complete, coalesce(jobs, 0) AS jobs, coalesce(titled, 0) AS titled,
    coalesce(good, 0) AS good, coalesce(lacking, 0) AS lacking, coalesce(lines = jobs AND lo = 1 AND hi = jobs, false) AS in_a_row, o_orderkey FROM orders LEFT JOIN l ON k = o_orderkey)"""


def results(t):
    """Results with jobs and pages, one for each order; all of an order's items are in its arrays, which are small."""
    item = F.struct(
        F.col("l_linenumber").cast("long").alias("actual_page"),
        ((F.col("l_returnflag") != "R") & (F.col("l_tax") < 0.07)).alias("accepted"),
        F.concat(F.lit("page-"), F.col("l_partkey")).alias("raw_ref"),
        F.when(F.col("l_quantity") > 3, F.concat(F.lit("Job "), F.col("l_partkey"))).otherwise(" ").alias("title"),
        F.repeat(F.lit("t"), F.col("l_quantity").cast("int") * 2).alias("text"),
        F.repeat(F.lit("d"), F.col("l_quantity").cast("int")).alias("duty"),
        F.repeat(F.lit("r"), F.col("l_quantity").cast("int")).alias("requirement"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("https://x.example/job/"), F.col("l_partkey"))).otherwise("").alias("url"),
        (F.col("l_quantity") <= 25).alias("needs_details"),
        F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("ids"),
    )
    jobs = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("jobs"))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % n + 1).cast("int"))
    base = t.orders.select(F.col("o_orderkey").alias("id")).join(jobs, "id", "left")
    return base.withColumn("jobs", F.coalesce("jobs", F.array().cast(jobs.schema["jobs"].dataType))).select(
        "id", "jobs", F.col("jobs").alias("pages"), pick(_STATUSES, 7).alias("status"), pick(_STOPS, 5).alias("stop_reason"), (F.col("id") % 3 != 0).alias("list_complete"),
        F.size("jobs").alias("expected_total"), F.size("jobs").alias("expected_pages"), F.size("jobs").alias("pages_received"), (F.col("id") % 4).alias("pages_seen"),
        F.when(F.col("id") % 6 > 0, F.array(F.lit("a.html"))).otherwise(F.array().cast("array<string>")).alias("refs"),
    )


@R.add(
    f"""{_BASE}, e AS (SELECT *, CASE WHEN NOT list_complete THEN NULL WHEN stop_reason IN ('last_page', 'reported_total_reached') AND jobs > 0 AND good = jobs AND in_a_row THEN 'reported_last_page'
    WHEN stop_reason = 'terminal_pagination' AND id % 4 >= 1 AND id % 6 > 0 THEN 'disabled_or_absent_next_control' END AS evidence FROM r)
  SELECT id, evidence, CASE WHEN evidence IS NOT NULL AND status NOT IN ('blocked', 'deleted', 'error') THEN 'ok' ELSE status END AS status FROM e"""
)
def q_accept_complete(t):
    """Results whose complete list is proven by pages or by the missing next control."""
    return A.accept_complete_list(results(t)).select("id", "evidence", "status")


@R.add(f"""{_BASE} SELECT id, CASE WHEN take THEN titled END AS accepted_jobs, CASE WHEN take THEN 'ok' ELSE status END AS status
    FROM (SELECT *, status = 'partial' AND NOT list_complete AND titled >= 4 AND stop_reason <> '' AS take FROM r)""")
def q_accept_substantial(t):
    """Large partial lists are accepted for the time being (four titled jobs here)."""
    return A.accept_substantial_partial_list(results(t), 4).select("id", "accepted_jobs", "status")


@R.add(
    """WITH j AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (NOT (l_quantity > 19)) AS lacking,
      count(DISTINCT CASE WHEN NOT (l_quantity > 19) AND l_linenumber > 1 THEN l_partkey END) AS urls FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey AS id, coalesce(n, 0) AS n, coalesce(lacking, 0) AS lacking, coalesce(urls, 0) AS urls FROM orders LEFT JOIN j ON k = o_orderkey)
    SELECT id, n >= 3 AS list_complete, n > 0 AND urls = 0 AS jd_complete, lacking::BIGINT AS needs_details_count, urls::BIGINT AS details,
      CASE WHEN n < 3 THEN 'reported_total_mismatch' WHEN NOT (n > 0 AND urls = 0) THEN 'zhiye_public_api_list_complete_details_optional' ELSE 'zhiye_public_api_complete' END AS stop_reason,
      CASE WHEN n >= 3 THEN 'ok' ELSE 'partial' END AS status FROM r"""
)
def q_finalize_list(t):
    """What is complete of lists and job texts, and which details are needed; three jobs are reported for each list."""
    run = results(t).select("id", "jobs", F.lit(3).alias("total"), F.lit(None).cast("int").alias("items_seen"))
    out = A.finalize_public_list(run)
    return out.select("id", "list_complete", "jd_complete", "needs_details_count", F.size("detail_urls").cast("long").alias("details"), "stop_reason", "status")


@R.add(
    f"""WITH j AS (SELECT l_orderkey AS k, count(*) AS n, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN s IN ('blocked', 'deleted', 'error') THEN s WHEN n = 1 AND q >= 20 AND p % 2 = 0 THEN 'ok' ELSE 'partial' END AS status,
      CASE WHEN s IN ('blocked', 'deleted', 'error') THEN NULL WHEN n = 1 AND q >= 20 AND p % 2 = 0 THEN 'single_job_complete' ELSE 'single_job_evidence_incomplete' END AS stop_reason
    FROM (SELECT *, {_STATUS_SQL} AS s FROM orders LEFT JOIN j ON k = o_orderkey)"""
)
def q_single_job(t):
    """Detail pages with one job that has the page's identity."""
    job = F.element_at("jobs", 1)
    identity = F.when(F.size("jobs") > 0, F.when(F.try_element_at(F.col("jobs"), F.lit(1))["ids"][0].cast("long") % 2 == 0, F.try_element_at(F.col("jobs"), F.lit(1))["ids"][0]).otherwise("other"))
    return results(t).select("id", A.single_job(F.col("status"), F.col("jobs"), identity).alias("s")).select("id", "s.*")


@R.add(
    f"""{_BASE} SELECT id, CASE WHEN list_complete THEN 'ok' WHEN jobs > 0 THEN 'partial' ELSE 'error' END AS status, jobs > 0 AND lacking = 0 AS jd_complete,
      concat_ws(',', CASE WHEN status NOT IN ('ok', 'partial', 'blocked', 'deleted', 'error') THEN 'status' END, CASE WHEN id % 11 = 0 THEN 'url' END,
        CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_quantity <= 3 AND l_linenumber <= 1) THEN 'job_identity' END,
        CASE WHEN status = 'error' AND id % 2 = 0 THEN 'error_kind' END, CASE WHEN list_complete AND status <> 'ok' THEN 'complete' END) AS broken FROM r"""
)
def q_contract(t):
    """List runs as canonical results, and what results break of the contract."""
    r = results(t).withColumn("records", F.size("jobs"))
    url = F.when(F.col("id") % 11 == 0, "ftp:x").otherwise("https://x.example/")
    kind = F.when(F.col("id") % 2 == 1, "timeout")
    broken = A.contract_violations(F.col("status"), url, F.col("jobs"), F.col("list_complete"), kind)
    checked = r.withColumn("broken", F.array_join(broken, ","))
    return A.list_document(checked).select("id", "status", "jd_complete", "broken")


@R.add(
    f"""{_BASE}, m AS (SELECT *, lead(id) OVER (PARTITION BY id % 50 ORDER BY id) AS nid, lead(jobs) OVER (PARTITION BY id % 50 ORDER BY id) AS njobs, lead(status) OVER (PARTITION BY id % 50 ORDER BY id) AS nstatus,
      lead(list_complete) OVER (PARTITION BY id % 50 ORDER BY id) AS nlist FROM r)
    SELECT id % 4 AS category, count(*) AS cases, sum((CASE id % 4 WHEN 0 THEN njobs > jobs WHEN 1 THEN njobs * 30 >= 80 AND njobs > jobs WHEN 2 THEN nlist AND NOT list_complete ELSE nstatus = 'ok' AND status <> 'ok' END)::INT)::BIGINT AS fixed,
      sum(njobs - jobs)::BIGINT AS added_jobs FROM m WHERE nid IS NOT NULL GROUP BY 1"""
)
def q_repairs(t):
    """Repairs by kind of fault: cases, how many are fixed, and the jobs they added; the next result is the one after."""
    from pyspark.sql import Window

    r = results(t).select("id", "status", "list_complete", F.size("jobs").cast("long").alias("jobs"), (F.size("jobs") * 30).cast("long").alias("chars"))
    now = F.struct("status", "jobs", "chars", "list_complete")
    paired = r.select("id", now.alias("before"), F.lead(now).over(Window.partitionBy(F.col("id") % 50).orderBy("id")).alias("after")).where("after is not null")
    kind = F.element_at(F.array(*map(F.lit, ("missing_jobs", "short_text", "incomplete_list", "status"))), (F.col("id") % 4 + 1).cast("int"))
    marked = paired.withColumn("fixed", A.repaired(kind, F.col("before"), F.col("after")))
    return marked.groupBy((F.col("id") % 4).alias("category")).agg(
        F.count("*").alias("cases"), F.count_if("fixed").alias("fixed"), F.sum(F.col("after.jobs") - F.col("before.jobs")).alias("added_jobs")
    )


@R.add(
    r"""SELECT doc_id, lang = 'de' OR source = 'src1' OR (length(trim(coalesce(text, ''), ' ')) >= 120 AND regexp_matches(lower(coalesce(text, '')), '招聘|职位|岗位|任职要求|job|position|career')) AS effective FROM documents"""
)
def q_effective_content(t):
    """Whether captured texts are worth keeping as static pages."""
    none = F.array().cast("array<string>")
    kinds = F.when(F.col("source") == "src1", F.array(F.lit("menu"), F.lit("detail"))).otherwise(none)
    return t.documents.select("doc_id", A.effective_content(F.lit("partial"), F.col("lang") == "de", F.lit(None).cast("boolean"), none, kinds, F.col("text")).alias("effective"))


@R.add(
    """SELECT status, list_complete, count(*) AS results, sum(jobs)::BIGINT AS jobs, sum(details)::BIGINT AS details, sum(done::INT)::BIGINT AS offline_done FROM (
    SELECT o_orderkey AS id, s AS status, o_orderkey % 3 <> 0 AS list_complete, coalesce(n, 0) AS jobs, coalesce(d, 0) AS details, coalesce(n, 0) >= 4 AS done FROM (SELECT *, """
    + _STATUS_SQL
    + """ AS s FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity <= 25) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY ALL"""
)
def q_result_metrics(t):
    """Measures of results that reports compare, by status."""
    m = results(t).select(A.metrics(F.col("status"), F.col("jobs"), F.lit("x"), F.col("list_complete"), F.lit(4)).alias("m")).select("m.*")
    return m.groupBy("status", "list_complete").agg(F.count("*").alias("results"), F.sum("jobs").alias("jobs"), F.sum("details").alias("details"), F.count_if("offline_done").alias("offline_done"))


@R.add(
    """SELECT g.l_orderkey AS doc, g.l_linenumber AS image, CASE WHEN r.l_orderkey IS NOT NULL THEN 'again_' || r.f ELSE g.f END AS reason FROM
    (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) g LEFT JOIN
    (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, max(l_quantity) AS q, min(l_linestatus) AS st FROM lineitem WHERE l_tax > 0.02 GROUP BY 1, 2) r
    ON g.l_orderkey = r.l_orderkey AND g.l_linenumber = r.l_linenumber WHERE NOT coalesce(r.st = 'F' AND r.q > 10, false)"""
)
def q_gaps_after_recovery(t):
    """Image gaps that are left after images were read again."""
    key = [F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("image")]
    gaps = t.lineitem.where("l_returnflag = 'R'").groupBy(*key).agg(F.min("l_linestatus").alias("reason"))
    again = t.lineitem.where("l_tax > 0.02").groupBy(*key).agg(F.min("l_returnflag").alias("f"), F.max("l_quantity").alias("q"), F.min("l_linestatus").alias("st"))
    recovered = again.select("doc", "image", F.when(F.col("st") == "F", "ok").otherwise("error").alias("status"), F.when(F.col("q") > 10, "text").otherwise("").alias("text"), F.concat(F.lit("again_"), "f").alias("reason"))
    return A.gaps_after_recovery(gaps, recovered, ["doc", "image"]).select("doc", "image", "reason")


QUERIES, ORACLE_SQL = R.queries, R.sql
