"""Audits of recovered jobs over the driver's tables: documents are job texts, line items the jobs of tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from .base import Registry

R = Registry()
_PHRASES = (
    "负责计算机视觉算法", "训练深度学习模型", "大模型应用开发", "Agent算法研究", "图像处理 OpenCV", "调用视觉API", "调用视觉API 负责模型优化", "普通工程师", "RAG", "使用预训练模型",
)
_AFFIRM = "计算机视觉|深度学习算法|训练.{0,28}深度学习.{0,16}模型|视觉.{0,16}模型.{0,28}优化"
_TEXT_SQL = f"{list(_PHRASES)}[(p_partkey % 10 + 1)::INT]"


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


# RE2 knows no lookbehind; none of the phrases needs one.
_CLASS_SQL = f"""SELECT *, CASE WHEN NOT called AND regexp_matches(x, '{_AFFIRM}') THEN 1 WHEN regexp_matches(x, '(?i)(Agent|智能体|大模型|LLM).{{0,12}}(开发|研发|工程|应用|Infra)|RAG') THEN 2
    WHEN regexp_matches(x, '(?i)(Agent|智能体|大模型|LLM|NLP).{{0,12}}(算法|研究|训练|推理)') THEN 3 END AS priority, regexp_matches(x, '(?i)图像处理|OpenCV|预训练|视觉API') AS weak
    FROM (SELECT *, regexp_matches(x, '(?i)(调用|使用).{{0,24}}(预训练模型|视觉API)') AND NOT regexp_matches(x, '负责.{{0,24}}模型|模型.{{0,24}}优化') AS called FROM (SELECT *, {_TEXT_SQL} AS x FROM part))"""


@R.add(f"""SELECT p_partkey AS id, priority, CASE WHEN priority IS NULL AND (weak OR called) THEN 'image_processing_without_ai_evidence' ELSE '' END AS exclusion_code,
    CASE WHEN regexp_matches(p_type, 'ECONOMY') THEN '校招/实习' WHEN p_type = 'PROMO' THEN '社招' ELSE '未明确' END AS recruitment FROM ({_CLASS_SQL})""")
def q_audit_class(t):
    """Priority, exclusion code and kind of recruitment of job texts."""
    text = _pick(_PHRASES, "p_partkey")
    url = F.when(F.col("p_type") == "ECONOMY", "https://x.example/campus").when(F.col("p_type") == "PROMO", "https://x.example/social")
    return t.part.select(F.col("p_partkey").alias("id"), A.audit_class(text).alias("c"), A.recruitment_type(url, text).alias("recruitment")).select("id", "c.*", "recruitment")


def _audited(t):
    text = _pick(_PHRASES, "p_partkey")
    rows = t.part.select("p_partkey", A.audit_class(text).alias("c"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"), (F.col("p_size") > 20).alias("here"))
    return rows.select("p_partkey", "c.*", "company", "title", (F.col("c.priority").isNotNull() & F.col("here")).alias("should_include"), text.rlike("模型|算法|工程师").alias("broad_signal"))


_AUDITED_SQL = f"""SELECT *, priority IS NOT NULL AND p_size > 20 AS inc, regexp_matches(x, '模型|算法|工程师') AS broad FROM ({_CLASS_SQL})"""


@R.add(f"""SELECT count(*) AS unique_jobs, count(*) FILTER (inc) AS included, count(*) FILTER (NOT inc) AS excluded, count(*) FILTER (NOT inc AND broad) AS near_misses, count(priority) AS role_matched,
    count(priority) FILTER (NOT inc) AS location_excluded, count(*) FILTER (priority IS NULL AND (weak OR called)) AS image_only, count(DISTINCT CASE WHEN inc THEN p_brand END) AS companies,
    count(*) FILTER (inc AND priority = 1) AS priority_1, count(*) FILTER (inc AND priority = 2) AS priority_2, count(*) FILTER (inc AND priority = 3) AS priority_3 FROM ({_AUDITED_SQL})""")
def q_audit_summary(t):
    """Counts of the audit."""
    return A.audit_summary(_audited(t))


@R.add(f"""SELECT p_partkey, row_number() OVER (ORDER BY inc DESC, coalesce(priority, 99), lower(p_brand), lower(p_name), p_partkey) AS place FROM ({_AUDITED_SQL}) ORDER BY place LIMIT 100""")
def q_audit_order(t):
    """The first hundred rows of the audit, in its order."""
    from pyspark.sql import Window

    top = A.audit_order(_audited(t), "p_partkey").limit(100)
    order = Window.orderBy(F.col("should_include").desc(), F.coalesce("priority", F.lit(99)), F.lower("company"), F.lower("title"), "p_partkey")
    return top.select("p_partkey", F.row_number().over(order).alias("place"))


@R.add("""SELECT p_partkey AS id, NOT hit AND p_retailprice > 950 AND here AS admitted, CASE WHEN hit THEN code WHEN p_retailprice <= 950 THEN 'not_target_category' WHEN NOT here THEN 'location_out_of_scope' ELSE '' END AS exclusion_code,
    CASE WHEN hit THEN why WHEN p_retailprice <= 950 THEN 'none' WHEN NOT here THEN 'location' ELSE '' END AS rationale FROM (SELECT *, code IS NOT NULL AS hit, p_size <= 40 AS here,
    CASE code WHEN 'generic' THEN 'a ring' WHEN 'gaps' THEN 'gaps' END AS why FROM (SELECT *, CASE WHEN p_name LIKE '%ring%' THEN 'generic' WHEN p_brand = 'Brand#2' THEN 'gaps' END AS code FROM part))""")
def q_role_decision(t):
    """Roles decided by an ordered table; admitted ones still need the place."""
    table = [(F.contains("p_name", F.lit("ring")), "generic", "a ring"), (F.col("p_brand") == "Brand#2", "gaps", "gaps")]
    out = A.decided(t.part, table, ("not_target_category", "none"), F.col("p_retailprice") > 950, F.col("p_size") <= 40)
    return out.select(F.col("p_partkey").alias("id"), "admitted", "exclusion_code", "rationale")


_ITEM_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


@R.add(f"""SELECT l_orderkey AS task, count(*) AS reported_added, count(*) FILTER (n = 1) AS unique_contributed, count(*) FILTER (n > 1) AS cross_task_duplicates_removed FROM (SELECT *, row_number() OVER (PARTITION BY
    CASE WHEN l_partkey % 3 > 0 THEN 'id:' || l_partkey WHEN l_suppkey % 2 > 0 THEN 'url:' || l_suppkey ELSE 'text:' || l_returnflag || l_linestatus END ORDER BY {_ITEM_ORDER}) AS n FROM lineitem) GROUP BY 1""")
def q_global_delta(t):
    """What each task added that no task before it had."""
    item = t.lineitem.withColumns(
        {
            "task": F.col("l_orderkey"),
            "key": A.job_key(
                F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")), F.when(F.col("l_suppkey") % 2 > 0, F.col("l_suppkey").cast("string")).otherwise(" "), F.col("l_returnflag"), F.col("l_linestatus")
            ),
        }
    )
    return A.global_delta(item, "key", _ITEM_ORDER.split(", "), "task")[1]


@R.add("""SELECT p_brand AS company, p_name AS title, min(rank) AS best, arg_min(p_partkey, (rank, p_partkey)) AS survivor FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN -4 WHEN 1 THEN -3 WHEN 2 THEN -2 WHEN 3 THEN -1 ELSE 0 END AS rank FROM part)
    GROUP BY lower(p_brand), lower(p_name), p_brand, p_name""")
def q_canonical_jobs(t):
    """Jobs alike in company, title and address, with the best evidence."""
    level = F.element_at(F.array(*map(F.lit, ("audit_confirmed", "structured_job", "page_text", "csv_declared", "limited_source_ai_mention"))), (F.col("p_size") % 5 + 1).cast("int"))
    jobs = t.part.select(F.col("p_brand").alias("company"), F.col("p_name").alias("title"), F.lit("").alias("source_url"), level.alias("evidence_level"), F.col("p_partkey").alias("at"), (-(4 - F.col("p_size") % 5)).alias("best"))
    return A.canonical_jobs(jobs, "at").select("company", "title", "best", F.col("at").alias("survivor"))


@R.add("""WITH d AS (SELECT p_partkey, p_name || p_brand AS id, CASE WHEN p_size % 4 > 0 THEN p_type || p_size END AS url FROM part WHERE p_retailprice > 1000), k AS (SELECT p_name || p_brand AS id, CASE WHEN p_size % 4 > 0 THEN p_type || p_size END AS url FROM part WHERE p_retailprice <= 950),
    f AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM k) AND (url IS NULL OR url NOT IN (SELECT url FROM k WHERE url IS NOT NULL))),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS n FROM f) WHERE n = 1)
    SELECT p_partkey AS at, id AS jd_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(url, id) ORDER BY p_partkey) AS m FROM a) WHERE m = 1""")
def q_new_jobs(t):
    """Jobs of a delta that are new by id and address."""
    each = t.part.select(F.concat("p_name", "p_brand").alias("jd_id"), F.when(F.col("p_size") % 4 > 0, F.concat("p_type", "p_size")).alias("source_url"), F.col("p_partkey").alias("at"), "p_retailprice")
    return A.new_jobs(each.where("p_retailprice > 1000"), each.where("p_retailprice <= 950"), "at").select("at", "jd_id")


@R.add("""SELECT o_orderkey AS task, CASE WHEN o_orderkey % 10 = 1 THEN 'count' ELSE 'slice' END AS violation FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE o_orderkey % 10 = 1 OR (o_orderkey % 10 = 2 AND n > 1)""")
def q_delta_boundary(t):
    """Tasks whose added jobs aren't those after the ones they had: one in ten with a wrong count, one in ten with a wrong part."""
    jobs = t.lineitem.groupBy(F.col("l_orderkey").alias("task")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))).alias("jobs"))
    n = F.size("jobs")
    bad = F.col("task") % 10
    tasks = jobs.join(t.orders.select(F.col("o_orderkey").alias("task")), "task").select(
        "task", "jobs", F.lit(1).alias("before"), (n + F.when(bad == 1, 1).otherwise(0)).alias("after"), F.slice("jobs", F.when((bad == 2), 1).otherwise(2), F.greatest(n - 1, F.lit(0))).alias("added")
    )
    return A.delta_violations(tasks)


@R.add("""SELECT count(*) AS cases, count(*) FILTER (NOT w AND n) AS recovered, count(*) FILTER (w AND n) AS preserved, count(*) FILTER (w AND NOT n) AS lost, sum(greatest(b - a, 0))::BIGINT AS added_jobs FROM
    (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') > 1 AS w, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') > 1 AS n, count(*) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY 1)""")
def q_progress(t):
    """What changed between two runs of the same tasks."""
    run = lambda flag: t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == flag).alias("jobs")).withColumn("status", F.when(F.col("jobs") > 1, "ok").otherwise("partial"))
    return A.progress(run("A"), run("N"), "id")


@R.add("""WITH o AS (SELECT c_nationkey AS k, arg_max(c_mktsegment, c_custkey) AS seg, arg_max(c_name, c_custkey) AS name FROM customer WHERE c_nationkey < 20 GROUP BY 1)
    SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE coalesce(seg, '') END AS segment, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE coalesce(name, '') END AS name FROM nation LEFT JOIN o ON k = n_nationkey""")
def q_merged_row(t):
    """New company rows over what is known of them."""
    old = t.customer.where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.max_by("c_mktsegment", "c_custkey").alias("segment"), F.max_by("c_name", "c_custkey").alias("name"))
    part = lambda n: F.when(F.col("n_nationkey") % n == 0, F.col("n_name")).otherwise("")
    new = t.nation.select(F.col("n_nationkey").alias("k"), part(2).alias("segment"), part(3).alias("name"))
    return A.merged_row(old, new, ["k"], ["segment", "name"])


@R.add()
def q_preferred_role(t):
    """The role candidate that the ordered fold keeps for each conversation; tested against a plain fold."""
    rows = t.conversations.select("conv_id", "turn", F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("segment"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("excerpt"), (F.col("role") == "assistant").alias("matched"))
    return A.preferred_role(rows, "conv_id", "turn")


QUERIES, ORACLE_SQL = R.queries, R.sql
