"""Reports over the driver's tables: pages are stored results, orders tasks, parts vendor records, conversations snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as P
from .base import Registry

R = Registry()

_URL = "CASE page_id % 4 WHEN 0 THEN concat('https://t', page_id % 9, '.zhiye.com', regexp_replace(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '^/[a-z]+', CASE WHEN page_id % 3 = 0 THEN '/Detail' ELSE '/list' END)) WHEN 1 THEN concat('https://app.mokahr.com/', CASE WHEN page_id % 5 < 2 THEN 'campus_apply/x/' ELSE 'social/' END, page_id) ELSE url END"
_STATUS = "CASE length(html) % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'error' WHEN 3 THEN 'blocked' ELSE 'deleted' END"


@R.add(f"""WITH r AS (SELECT {_URL} AS url, {_STATUS} AS status, length(html) > 3000 AS html, CASE WHEN page_id % 7 > 0 THEN left(html, 10) ELSE '' END AS text, page_id % 4 AS n FROM pages),
    o AS (SELECT *, regexp_matches(url, '^https?://[^/]*\\.zhiye\\.com(/|$)') AND regexp_matches(lower(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)), '/detail|/jobdetails') AS d, starts_with(url, 'https://app.mokahr.com/') AS m FROM r WHERE status IN ('partial', 'error', 'blocked'))
    SELECT count(*) FILTER (d) AS detail_records, count(*) FILTER (d AND html) AS detail_html, count(*) FILTER (d AND text <> '') AS detail_texts, count(*) FILTER (m) AS legacy_records, count(*) FILTER (m AND contains(url, '/campus_apply/')) AS legacy_routes, coalesce(sum(n) FILTER (m), 0)::BIGINT AS legacy_artifacts FROM o""")
def q_replay_counts(t):
    """What of unfinished pages could be read again."""
    return P.replay_counts(t.pages.select(F.expr(_URL).alias("url"), F.expr(_STATUS).alias("status"), (F.length("html") > 3000).alias("html"), F.when(F.col("page_id") % 7 > 0, F.substring("html", 1, 10)).otherwise("").alias("text"), (F.col("page_id") % 4).alias("json_artifacts")))


@R.add("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'P' THEN 'pending_ocr' WHEN o_totalprice > 200000 THEN 'running' ELSE 'blocked' END AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
    r AS (SELECT l_suppkey AS batch, CASE WHEN l_linenumber % 4 = 3 THEN -l_orderkey ELSE l_orderkey END AS url FROM lineitem)
    SELECT batch, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'pending_ocr') AS partial, count(*) FILTER (status IS NULL OR status = 'running') AS deferred, count(*) FILTER (status = 'blocked') AS error, coalesce(sum(n), 0)::BIGINT AS detail_urls FROM r LEFT JOIN t ON o_orderkey = url GROUP BY 1""")
def q_batch_counts(t):
    """What became of each batch's rows, and their details."""
    s = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "pending_ocr").when(F.col("o_totalprice") > 200000, "running").otherwise("blocked")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("details"))
    tasks = t.orders.join(lines, "o_orderkey", "left").select(F.col("o_orderkey").alias("url"), s.alias("status"), F.coalesce("details", F.lit(0)).alias("details"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("batch"), F.when(F.col("l_linenumber") % 4 == 3, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("url"))
    return P.batch_counts(rows, tasks, "batch")


@R.add("""WITH i AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'M' WHEN o_orderpriority LIKE '2%' THEN 'H' ELSE 'X' END AS adapter, CASE WHEN o_custkey % 2 = 0 THEN 'https://campus.51job.com/' ELSE 'https://o.example.com/' END || o_orderkey AS url FROM orders),
    j AS (SELECT l_orderkey AS task_id, count(*) FILTER (l_returnflag = 'A') AS b, count(*) FILTER (l_returnflag = 'N') AS a FROM lineitem GROUP BY 1), m AS (SELECT i.*, coalesce(b, 0) AS b, a, adapter <> 'X' AS ours, j.task_id IS NULL OR a < b AS kept FROM i LEFT JOIN j USING (task_id))
    SELECT task_id, adapter, CASE WHEN NOT ours THEN 'blocked' WHEN NOT kept AND a > b THEN 'fixed' ELSE 'unchanged' END AS outcome, CASE WHEN ours THEN '' WHEN contains(url, 'campus.51job.com') THEN 'adapter_not_implemented_in_stage' ELSE 'deferred_unstable_or_single_site' END AS reason,
    CASE WHEN ours THEN b END AS before_jobs, CASE WHEN ours THEN CASE WHEN kept THEN b ELSE a END END AS after_jobs, CASE WHEN ours THEN CASE WHEN kept THEN 0 ELSE greatest(a - b, 0) END END AS added_jobs, ours AND kept AS preserved_prior FROM m""")
def q_stage_outcomes(t):
    """What a stage for two adapters did to each order's jobs."""
    p = F.col("o_orderpriority")
    adapter = F.when(F.startswith(p, F.lit("1")), "M").when(F.startswith(p, F.lit("2")), "H").otherwise("X")
    url = F.concat(F.when(F.col("o_custkey") % 2 == 0, "https://campus.51job.com/").otherwise("https://o.example.com/"), "o_orderkey")
    items = t.orders.select(F.col("o_orderkey").alias("task_id"), adapter.alias("adapter"), url.alias("url"))
    jobs = lambda flag: t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count_if(F.col("l_returnflag") == flag).alias("jobs"))
    return P.stage_outcomes(items, jobs("A"), jobs("N"), ["M", "H"], ["jobs"])


@R.add("""SELECT c_custkey, 'review_category=B; task_id=' || c_custkey || '; rationale=' || c_mktsegment || '; root_cause=' || CASE WHEN c_nationkey > 12 THEN c_nationkey::VARCHAR ELSE '' END || '; evidence=' || c_name || '; source=' AS line FROM customer""")
def q_audit_evidence(t):
    """Evidence lines of audited rows."""
    row = {"task_id": F.col("c_custkey"), "review_rationale": F.col("c_mktsegment"), "root_cause": F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")), "evidence": F.col("c_name"), "source_url": F.lit(None)}
    return t.customer.select("c_custkey", P.audit_evidence(row).alias("line"))


@R.add("""WITH j AS (SELECT l_orderkey AS task, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, CASE WHEN l_partkey % 5 > 0 THEN 'https://e.com/' || l_partkey END AS url, 'job ' || l_suppkey AS title FROM lineitem)
    SELECT url, arg_max(task, (task, n)) AS task, arg_max(title, (task, n)) AS title FROM j WHERE url IS NOT NULL GROUP BY 1""")
def q_jobs_by_url(t):
    """The last job with each link, over all results."""
    url = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit(" https://e.com/"), "l_partkey", F.lit("/")))
    job = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat(F.lit("job "), "l_suppkey").alias("title"), url.alias("url"))
    return P.jobs_by_url(t.lineitem.groupBy(F.col("l_orderkey").alias("task")).agg(F.array_sort(F.collect_list(job)).alias("jobs")), "task")


@R.add("""SELECT p_partkey AS id, 'running' AS status, (p_size + 1)::INT AS attempts FROM part WHERE p_type <> 'PROMO' ORDER BY p_size, p_partkey LIMIT 40""")
def q_claimed_articles(t):
    """The next forty articles in their order."""
    articles = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("position"), F.when(F.col("p_type") == "PROMO", "ok").otherwise("pending").alias("status"), F.col("p_size").alias("attempts"))
    return P.claimed_articles(articles, 40).select("id", "status", F.col("attempts").cast("int").alias("attempts"))


@R.add("""SELECT page_id FROM pages WHERE page_id % 3 < 2 AND page_id % 5 > 0 AND length(html) % 2 = 0""")
def q_seeds(t):
    """Links whose stored result is sound and finished."""
    from ..functions import urls as U

    own = t.pages.withColumn("link", F.concat(F.lit("https://e.com/"), "page_id"))
    status = F.when(F.col("page_id") % 5 == 0, "error").when(F.col("page_id") % 5 == 1, "pending_ocr").otherwise("ok")
    results = own.where("page_id % 3 < 2").select(U.task_id(F.col("link")).alias("task_id"), status.alias("status"), (F.length("html") % 2 == 0).alias("sound"))
    return P.seeds(own.select("page_id", F.col("link").alias("url")), results).select("page_id")


@R.add("""SELECT p_partkey AS id, trim(p_name) AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS company, p_type AS location,
    CASE WHEN p_size % 6 > 0 THEN 'https://xyz.example.com/consumer/pc/home/job?ctmid=' || p_size || '&_jobId=' || p_partkey || '&jobid=' || CASE WHEN p_size % 3 = 0 THEN 'E' || p_partkey ELSE 'e' || p_size END END AS url, p_size % 6 > 0 AS valid
    FROM (SELECT CASE WHEN p_size % 6 > 0 THEN p_partkey::VARCHAR END AS p_partkey, p_name, p_size, p_brand, p_type FROM part)""")
def q_vendor_jobs(t):
    """Jobs and their pages from a vendor's records."""
    key = F.when(F.col("p_size") % 6 > 0, F.col("p_partkey").cast("string"))
    records = t.part.select(
        key.alias("jobId"), F.concat(F.lit(" "), "p_name").alias("jobName"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("companyName"), F.col("p_type").alias("jobCompanyName"), F.col("p_type").alias("jobAreas"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("E"), key)).otherwise(F.concat(F.lit("e"), "p_size")).alias("eHireJobId"), "p_size",
    )
    return P.vendor_jobs(records, "p_size", "xyz.example.com")


@R.add("""WITH g AS (SELECT * FROM conversations WHERE turn % 5 <> 3), b AS (SELECT conv_id, arg_min(turn, (-length(text), turn)) AS place FROM g GROUP BY 1)
    SELECT b.conv_id, b.place, g.role AS title, md5(g.text) AS text FROM b JOIN g ON g.conv_id = b.conv_id AND g.turn = b.place WHERE length(trim(g.text)) >= 80""")
def q_longest_snapshot(t):
    """The longest snapshot of each page."""
    rows = t.conversations.select("conv_id", F.col("turn").alias("place"), F.when(F.col("turn") % 5 == 3, "blocked").otherwise("ok").alias("status"), F.col("role").alias("title"), "text")
    return P.longest_snapshot(rows, "conv_id").withColumn("text", F.md5("text"))


QUERIES, ORACLE_SQL = R.queries, R.sql
