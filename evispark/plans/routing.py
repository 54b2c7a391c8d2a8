"""Routes, lookups and listings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import routing as X
from .base import Registry

R = Registry()
_URLS = (
    ("https://mp.weixin.qq.com/s?__biz=1", "WechatImage", "web"), ("https://www.wjx.cn/vm/a.aspx", "WjxPublicForm", "WJX"), ("https://campus.51job.com/abc/", "Job51StaticTopic", ""),
    ("https://campus.51job.com/", None, ""), ("https://xyz.51job.com/consumer/pc/home/index?ctmid=123456", "Job51XYZ", ""), ("https://app.mokahr.com/campus-recruitment/x/12#/job/77", "MokahrJobDetailPortal", ""),
    ("https://app.mokahr.com/campus_apply/x/12", "MokahrPublicPortal", ""), ("https://a.hotjob.cn/SU1/x", "HotjobPublicPortal", ""), ("https://b.zhiye.com/campus/detail?jobAdId=9", "ZhiyeJobDetailPortal", ""),
    ("https://b.zhiye.com/campus/jobs", "ZhiyePublicPortal", ""), ("https://z.jobs.feishu.cn/index/#/position/list?k=1", "FeishuPublicPortal", ""), ("https://z.jobs.feishu.cn/other", None, ""),
    ("https://example.com/x", "genericweb", ""), ("ftp://example.com/x", None, ""), ("", None, ""),
)
_N = len(_URLS)
_IDENTITY = {5: "77", 8: "9"}


def _list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _pick(values, key):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(key) % len(values) + 1).cast("int"))


_PLATFORM_SQL = "CASE WHEN regexp_matches(h, '(^|\\.)wjx\\.cn$') THEN 'WJX' WHEN regexp_matches(h, '(^|\\.)hotjob\\.cn$') THEN 'Hotjob' WHEN regexp_matches(h, '(^|\\.)51job\\.com$') THEN '51job' ELSE h END"


@R.add(
    f"""SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'asked' WHEN event_id % 29 = 0 THEN 'ConfiguredPublicList' ELSE {_list(x[1] for x in _URLS)}[(event_id % {_N} + 1)::INT] END AS adapter,
    {_list(_IDENTITY.get(i) for i in range(_N))}[(event_id % {_N} + 1)::INT] AS identity, {_PLATFORM_SQL} AS platform, event_id % {_N} IN (10) AS is_list, event_id % {_N} IN (3, 13, 14) AS is_landing
    FROM (SELECT *, regexp_extract({_list(x[0] for x in _URLS)}[(event_id % {_N} + 1)::INT], '^https://([^/]+)', 1) AS h FROM events)"""
)
def q_adapter_choice(t):
    """The rule for each URL, the identity of detail URLs, and the platform."""
    url = _pick([x[0] for x in _URLS], "event_id")
    chosen = X.Registry().chosen(F.col("u"), F.when(F.col("event_id") % 31 == 0, "asked"), F.col("event_id") % 29 == 0)
    from ..functions import urls as U

    return t.events.select("event_id", url.alias("u")).select(
        "event_id", chosen.alias("adapter"), X.job_identity(F.col("u")).alias("identity"), X.platform(U.host(F.col("u"))).alias("platform"), X.is_list_route(F.col("u")).alias("is_list"), X.is_landing(F.col("u")).alias("is_landing")
    )


@R.add(
    f"""WITH e AS (SELECT event_id, {_list([x[0] for x in _URLS])}[(event_id % {_N} + 1)::INT] || CASE WHEN event_id % {_N} < 13 AND event_id % 7 > 3 AND event_id % {_N} NOT IN (4, 5, 8, 10) THEN '?utm_source=x' ELSE '' END AS u FROM events WHERE event_id % {_N} <> 0),
    f AS (SELECT *, event_id % {_N} AS k FROM e) SELECT route, reason, count(*) AS rows, min(event_id) AS first FROM (
      SELECT 'web' AS route, NULL AS reason, min(event_id) AS event_id FROM f WHERE k < 13 GROUP BY k UNION ALL SELECT 'invalid', CASE WHEN k = 14 THEN 'missing_url' ELSE 'invalid_url' END, event_id FROM f WHERE k >= 13
      UNION ALL SELECT 'deferred', 'articles_disabled', min(event_id) FROM events WHERE event_id % {_N} = 0) GROUP BY ALL"""
)
def q_partitioned(t):
    """Web, deferred and invalid rows, one for each canonical URL."""
    k = F.col("event_id") % _N
    tracked = F.when((k < 13) & (F.col("event_id") % 7 > 3) & ~k.isin(0, 4, 5, 8, 10), "?utm_source=x").otherwise("")
    rows = t.events.select("event_id", F.concat(_pick([x[0] for x in _URLS], "event_id"), tracked).alias("u"))
    return X.partitioned(rows, "u", ["event_id"]).groupBy("route", "reason").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"))


@R.add("""SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal <= 8000 AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_name LIKE '%99%') AND n_regionkey < 3""")
def q_admitted(t):
    """Candidates by ownership, industry and place."""
    rows = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).withColumn("nature", F.when(F.col("c_acctbal") > 8000, "国有独资").otherwise("民企"))
    rows = rows.withColumn("place", F.concat(F.lit("region "), "n_regionkey"))
    return X.admitted(rows, "c_name", "nature", "c_mktsegment", "place", "BUILDING|MACHINERY|99", "region [0-2]", "国有").select("c_custkey")


@R.add("""SELECT o_orderkey, coalesce(st, 'blocked') AS status, coalesce(n, 0) AS gaps FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS st, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def q_default_document(t):
    """Queue rows with their document, or as blocked without one."""
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("status"), F.count("*").alias("gaps"))
    return X.with_default(t.orders.select("o_orderkey"), docs, "o_orderkey", {"status": "blocked", "gaps": 0}).select("o_orderkey", "status", F.col("gaps").cast("long"))


@R.add("""SELECT s_suppkey, coalesce(brand, '(none)') AS role, coalesce(i, 1)::INT AS role_index FROM supplier LEFT JOIN (SELECT k, brand, row_number() OVER (PARTITION BY k ORDER BY brand) AS i FROM (SELECT DISTINCT p_size AS k, p_brand AS brand FROM part)) ON k = s_suppkey""")
def q_inventory(t):
    """A row for each known role, or a placeholder."""
    inventory = t.part.select(F.col("p_size").cast("long").alias("s_suppkey"), F.col("p_brand").alias("role"))
    return X.with_inventory(t.supplier.select("s_suppkey"), inventory, "s_suppkey", "role", "(none)")


@R.add("""SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN 'error' WHEN c_mktsegment <> 'BUILDING' THEN 'pending' END AS origin, CASE WHEN c_acctbal < 1000 THEN c_name WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS note FROM customer""")
def q_templates(t):
    """Companies with their error row, else their pending row."""
    c = t.customer
    pending = c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", F.col("c_mktsegment").alias("note"))
    errors = c.where("c_acctbal < 1000").select("c_custkey", F.col("c_name").alias("note"))
    return X.template_of(c.select("c_custkey"), pending, errors, "c_custkey", ["note"])


@R.add("""WITH s AS (SELECT url || CASE WHEN page_id % 2 = 0 THEN '#a' ELSE '' END AS u, min(page_id) AS v FROM pages WHERE length(html) > 1500 GROUP BY 1), b AS (SELECT regexp_replace(u, '#.*$', '') AS u, arg_min(v, u) AS v FROM s GROUP BY 1)
    SELECT page_id, coalesce(s.v, b.v) AS value FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '#a' WHEN 1 THEN '#b' ELSE '' END AS u FROM pages) p LEFT JOIN s ON s.u = p.u LEFT JOIN b ON b.u = regexp_replace(p.u, '#.*$', '')""")
def q_url_fragments(t):
    """Stored values by URL, or by URL without its fragment."""
    stored = t.pages.where("length(html) > 1500").select(F.concat("url", F.when(F.col("page_id") % 2 == 0, "#a").otherwise("")).alias("u"), F.col("page_id").alias("value")).groupBy("u").agg(F.min("value").alias("value"))
    report = t.pages.select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, "#a").when(F.col("page_id") % 3 == 1, "#b").otherwise("")).alias("u"))
    return X.without_fragment(report, stored, "u", "value").select("page_id", "value")


@R.add("SELECT DISTINCT o_custkey AS source, l_partkey AS task FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def q_inherited(t):
    """Children inherit the sources of their parents."""
    bridge = t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("task"))
    return X.inherited(bridge, t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("task")))


@R.add("""SELECT url, arg_max(company, (p_partkey, company)) AS company FROM (SELECT unnest([p_brand, p_type]) AS url, CASE WHEN p_size % 10 = 0 THEN 'unknown' ELSE p_name END AS company, p_partkey FROM part) WHERE url <> '' GROUP BY 1""")
def q_url_companies(t):
    """The company of each URL; the last row counts."""
    rows = t.part.withColumn("company", F.when(F.col("p_size") % 10 == 0, " ").otherwise(F.col("p_name")))
    return X.url_companies(rows, ["p_brand", "p_type"], "company", "p_partkey", "unknown")


@R.add("""(SELECT 'parent' AS kind, page_id FROM pages WHERE starts_with(url, 'http://') AND page_id % 3 = 0 ORDER BY page_id DESC LIMIT 1)
    UNION ALL SELECT 'recoverable', page_id FROM pages WHERE page_id % 4 = 1 AND page_id % 3 > 0 AND page_id % 5 < 3 AND url IN (SELECT url FROM pages WHERE length(html) > 1500)""")
def q_task_selection(t):
    """The latest parent with a prefix, and tasks whose images can be read again."""
    p = t.pages.withColumn("at", F.col("page_id"))
    parent = X.latest_parent(p, "http://", "url", "at", F.col("page_id") % 3 == 0).select(F.lit("parent").alias("kind"), "page_id")
    kinds = F.when(F.col("page_id") % 5 < 3, F.array(F.lit("html"), F.lit("manifest"))).otherwise(F.array(F.lit("html")))
    tasks = p.select("page_id", "url", F.when(F.col("page_id") % 4 == 1, "pending_ocr").otherwise("ok").alias("status"), (F.col("page_id") % 3).alias("gaps"), kinds.alias("kinds"))
    return parent.unionByName(X.recoverable(tasks, p.where("length(html) > 1500"), "url").select(F.lit("recoverable").alias("kind"), "page_id"))


@R.add("""WITH a AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'cached' WHEN o_orderpriority LIKE '5%' THEN 'stopped' END AS r FROM orders)
    SELECT coalesce(r, CASE WHEN n <= 40 THEN 'run' ELSE 'deferred' END) AS route, count(*) AS tasks, min(o_orderkey) AS lowest FROM (SELECT *, row_number() OVER (PARTITION BY r IS NULL ORDER BY o_totalprice DESC, o_orderkey) AS n FROM a) GROUP BY 1""")
def q_run_plan(t):
    """What happens to requested tasks within a budget of forty."""
    plan = X.run_plan(t.orders.withColumn("gain", -F.col("o_totalprice")), t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_orderpriority LIKE '5%'"), "o_orderkey", ["gain"], 40)
    return plan.groupBy("route").agg(F.count("*").alias("tasks"), F.min("o_orderkey").alias("lowest"))


@R.add("""SELECT s_suppkey, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS position FROM supplier""")
def q_next_positions(t):
    """New rows follow the positions that are taken."""
    return X.next_positions(t.supplier.select("s_suppkey", "s_acctbal"), t.nation.select(F.col("n_nationkey").alias("position")), "position", ["s_acctbal", "s_suppkey"]).select("s_suppkey", F.col("position").cast("long"))


@R.add("""SELECT * FROM (SELECT 'companies' AS listing, s_suppkey AS id, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 5 END NULLS LAST, s_name) AS place FROM supplier) WHERE place <= 50
    UNION ALL SELECT * FROM (SELECT 'shortlist', p_partkey, row_number() OVER (ORDER BY p_size > 30 DESC, p_type = 'PROMO' DESC, p_size % 7 DESC, p_partkey) AS place FROM part) WHERE place <= 300
    UNION ALL SELECT * FROM (SELECT 'tasks', o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS place FROM orders) WHERE place <= 100""")
def q_listings(t):
    """The top of three listings with their places: companies, the shortlist, and tasks."""
    from pyspark.sql import Window

    def top(df, name, key, order, n):
        first = df.orderBy(*order).limit(n)  # a top-k; only its rows are numbered
        return first.select(F.lit(name).alias("listing"), F.col(key).alias("id"), F.row_number().over(Window.orderBy(*order)).alias("place"))

    companies = t.supplier.withColumn("priority", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 5))
    short = t.part.select("p_partkey", F.when(F.col("p_size") > 30, "A-x").otherwise("B").alias("bucket"), F.when(F.col("p_type") == "PROMO", "direct").otherwise("").alias("direct"), (F.col("p_size") % 7).alias("score"))
    return (
        top(companies, "companies", "s_suppkey", X.company_order("priority", "s_name"), 50)
        .unionByName(top(short, "shortlist", "p_partkey", X.shortlist_order("bucket", "direct", "score", "p_partkey"), 300))
        .unionByName(top(t.orders, "tasks", "o_orderkey", [F.col("o_orderpriority").desc(), F.col("o_orderkey")], 100))
    )


@R.add("""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages), n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN substr(p_name, 3, 3) ELSE (SELECT substr(any_value(title), 1 + p_partkey % 5, 2 + p_partkey % 3) FROM t WHERE page_id = p_partkey % 50) END AS name FROM part)
    SELECT p_partkey, name, (SELECT arg_min(title, (page_id, title)) FROM t WHERE title <> '' AND contains(title, name) AND name <> '') AS contained_in FROM n""")
def q_contained_names(t):
    """The first page title that contains each name; names are pieces of parts' names and of titles."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    titles = t.pages.select("page_id", title.alias("title"))
    own = titles.where("page_id < 50").select(F.col("page_id").alias("_k"), F.col("title").alias("_t"))
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.substring_index("p_name", " ", 1)).when(k % 3 == 1, F.substring("p_name", 3, 3)).otherwise(F.substr("_t", (1 + k % 5).cast("int"), (2 + k % 3).cast("int")))
    names = t.part.join(own, k % 50 == F.col("_k"), "left").select("p_partkey", name.alias("name"))
    return X.contained_names(names, titles, "name", "title", "page_id")



@R.add("""SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 1 THEN 'missing' WHEN c_custkey % 50 = 2 THEN 'repeated' WHEN c_custkey % 50 = 3 THEN 'changed' ELSE 'garbled' END AS problem FROM customer WHERE c_custkey % 50 IN (1, 2, 3, 4)
    UNION ALL SELECT -c_custkey, 'extra' FROM customer WHERE c_custkey % 500 = 7""")
def q_source_fidelity(t):
    """Where an output differs from its source rows."""
    c = t.customer.select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    m = F.col("id") % 50
    source = c.withColumn("c_name", F.when(m == 4, F.concat("c_name", F.lit("锟斤拷"))).otherwise(F.col("c_name")))
    kept = source.where(m != 1).withColumn("c_mktsegment", F.when(m == 3, "other").otherwise(F.col("c_mktsegment")))
    output = kept.unionByName(kept.where(m == 2)).unionByName(kept.where("id % 500 = 7").withColumn("id", -F.col("id")))
    return X.source_fidelity(source, output, "id", ["c_name", "c_mktsegment"], T.looks_garbled)


QUERIES, ORACLE_SQL = R.queries, R.sql
