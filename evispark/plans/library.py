"""Functions and operators of the library that no other query goes through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import checks, dedup, documents, joins, queue, targets
from ..operators import pages as P
from ..sources import tables
from ..streaming import events as E
from .base import Registry

R = Registry()


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


_WEB = "'https://x.example/c/' || o_custkey"


@R.add(
    f"""SELECT lower(url) AS url, max(p)::INT AS priority, count(*) AS links FROM (SELECT {_WEB} AS url, CASE WHEN o_orderpriority LIKE '1%' THEN 20 WHEN o_orderpriority LIKE '2%' THEN 10 ELSE 0 END AS p FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'https://y.example/o?id=' || o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 20 WHEN o_orderpriority LIKE '2%' THEN 10 ELSE 0 END FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1"""
)
def q_import_rows(t):
    """Raw rows imported as sources, tasks of canonical URLs with their highest priority, and the bridge between them."""
    raw = t.orders.select(
        F.lit("orders.csv").alias("input_path"),
        F.col("o_orderkey").alias("row_number"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("company"),
        F.when(F.col("o_orderpriority").startswith("1"), "大模型 LLM").when(F.col("o_orderpriority").startswith("2"), "大模型").otherwise("x").alias("role"),
        F.concat(F.lit("see HTTPS https://X.example/c/"), "o_custkey", F.lit("?utm_source=a, and https://y.example/o?gclid=1&id="), "o_orderkey", F.lit(")")).alias("link"),
    )
    found = queue.import_rows(raw, ["company"], ["role"], ["link"])
    links = found["bridge"].groupBy("task_id").agg(F.count("*").alias("links"))
    return found["tasks"].join(links, "task_id").select("url", "priority", "links")


@R.add(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://a.example/d' WHEN 1 THEN 'https://b.example/n' WHEN 2 THEN 'https://mp.weixin.qq.com/s/n' WHEN 3 THEN 'https://mp.weixin.qq.com/s/d' ELSE '' END AS url,
    CASE WHEN c_custkey % 5 < 2 THEN 'web' WHEN c_custkey % 5 < 4 THEN 'wechat' ELSE 'missing' END AS pool FROM customer"""
)
def q_pools(t):
    """Which URL is acquired, and its pool: all routes."""
    delivery = _pick(("https://a.example/d", "https://mp.weixin.qq.com/s/d", " ", "https://mp.weixin.qq.com/s/d", "mailto:x"), "c_custkey")
    news = _pick(("https://b.example/n", "https://b.example/n", "https://mp.weixin.qq.com/s/n", "none", ""), "c_custkey")
    return t.customer.select("c_custkey", U.preferred(delivery, news).alias("p")).select("c_custkey", "p.*")


@R.add(
    r"""SELECT p_partkey, p_name || ' at ' || p_brand AS shown, ['算法工程师', '算法工程师', '算法工程师', '工程师 实习 研发'][(p_partkey % 4 + 1)::INT] AS title, p_partkey % 5 < 3 AS blank, p_partkey % 3 = 0 AS garbled,
    CASE p_partkey % 2 WHEN 0 THEN '北京,成都市' ELSE '' END AS places, CASE WHEN p_partkey % 2 = 0 THEN 'in 北京 or' END AS around FROM part"""
)
def q_titles(t):
    """Titles as shown and as compared, placeholders, wrong decodings, places, and the text about a match."""
    shown = T.display_title(F.concat("p_name", F.lit(" at "), "p_brand", F.lit(" at "), "p_brand"))
    raw = _pick(("算法工程师 发布于 2024-01-01 北京", "算法工程师  全职 | 上海", "算法工程师 岗位职责：写代码", "工程师  实习 研发"), "p_partkey")
    value = _pick(("待定", " N/A ", "", "说明", "0"), "p_partkey")
    text = F.when(F.col("p_partkey") % 2 == 0, "we work in 北京 or 成都市 and 成都").otherwise("nowhere")
    doubled = F.regexp_replace(shown, "^(.+) at (.+) at \\2$", "$1 at $2")
    return t.part.select(
        "p_partkey", doubled.alias("shown"), T.clean_title(raw).alias("title"), T.placeholder(value).alias("blank"),
        T.looks_garbled(F.when(F.col("p_partkey") % 3 == 0, "锟斤拷").otherwise("fine")).alias("garbled"), F.array_join(T.locations(text, "北京市?|成都市?"), ",").alias("places"), T.window(text, "北京", 3, 3).alias("around"),
    )


@R.add("""SELECT p_partkey, unnest(CASE p_partkey % 5 WHEN 0 THEN ['大模型算法', 'Agent开发'] WHEN 1 THEN ['视觉算法工程师', '测试工程师'] WHEN 2 THEN ['视觉AI'] WHEN 3 THEN ['销售/运营（全国/北京）'] ELSE ['后端'] END) AS role FROM part""")
def q_expand_roles(t):
    """The titles in declared roles: lists, blobs of categories, dense cells and slashes."""
    told = _pick(("大模型算法；Agent开发", "视觉算法工程师 测试工程师", "视觉AI/行政", "销售/运营（全国/北京）", "后端、技术类设计类产品类"), "p_partkey")
    return t.part.select("p_partkey", F.explode(T.expand_role(told)).alias("role"))


@R.add("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 3 WHEN p_partkey % 5 = 1 THEN 1 WHEN p_partkey % 5 = 3 THEN 2 END AS priority FROM part""")
def q_discovered(t):
    """Priorities of structured jobs: by title, by evidence for image titles, by text for plain engineers."""
    title = _pick(("大模型算法", "图像处理", "图像处理", "算法工程师", "销售"), "p_partkey")
    text = _pick(("", "负责训练深度学习模型", "使用相机", "做 RAG 应用", "大模型开发"), "p_partkey")
    return t.part.select("p_partkey", T.discovered_priority(title, text).alias("priority"))


@R.add("SELECT page_id, url || '&token=REDACTED&a=1' AS safe FROM pages")
def q_redact(t):
    """Addresses with the values of secret parameters replaced."""
    return t.pages.select("page_id", U.redact(F.concat("url", F.lit("&token=abc&a=1"))).alias("safe"))


@R.add("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'https://x.example/job/123' WHEN 1 THEN 'https://x.example/jobs/list' WHEN 2 THEN 'https://x.example/?jobId=1' ELSE 'https://x.example/position-detail/' END AS url, o_orderkey % 4 <> 1 AS detail,
    CASE o_orderkey % 4 WHEN 0 THEN 'https://x.example/job/123' WHEN 1 THEN 'https://x.example/jobs/list' WHEN 2 THEN 'https://x.example/?jobId=1' ELSE 'https://x.example/position-detail/' END AS static FROM orders""")
def q_detail_urls(t):
    """Detail URLs by their shape, and URLs without what changes nothing."""
    url = _pick(("https://x.example/job/123", "https://x.example/jobs/list", "https://x.example/?jobId=1", "https://x.example/position-detail/"), "o_orderkey")
    noisy = F.when(F.contains(url, F.lit("?")), F.concat(F.replace(url, F.lit("https://x.example/"), F.lit("HTTPS://X.example:443//")), F.lit("&utm_medium=a&spm=1#top"))).otherwise(F.concat(F.replace(url, F.lit("https://x.example/"), F.lit("https://x.example:443//")), F.lit("?from=z#top")))
    return t.orders.select("o_orderkey", url.alias("url"), U.is_detail(url).alias("detail"), U.canonical_static(noisy).alias("static"))


@R.add("""SELECT 'f' || page_id AS name, CASE page_id % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'size' ELSE 'hash' END AS problem FROM pages WHERE page_id % 4 > 0""")
def q_damaged_files(t):
    """Files that are missing or differ in size or content from what is recorded."""
    name, m = F.concat(F.lit("f"), "page_id").alias("name"), F.col("page_id") % 4
    data = F.encode("html", "utf-8")
    expected = t.pages.select(name, F.octet_length("html").cast("long").alias("size"), F.sha2(data, 256).alias("sha256"))
    changed = F.when(m == 2, F.concat(data, F.encode(F.lit("x"), "utf-8"))).when(m == 3, F.encode(F.concat(F.lit("\t"), F.expr("substr(html, 2)")), "utf-8")).otherwise(data)
    return checks.damaged_files(expected, t.pages.select(name, changed.alias("content"), m.alias("m")).where("m <> 1").drop("m"))


@R.add("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey WHEN c_custkey % 3 = 1 THEN 'v' ELSE NULL END AS url FROM customer""")
def q_first_url(t):
    """The first of several fields that says something."""
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" u"), "c_custkey")).otherwise("  ").alias("a"), F.when(F.col("c_custkey") % 3 == 1, "v").alias("b"))
    return rows.select("c_custkey", tables.first_url(["a", "b"]).alias("url"))


@R.add("""SELECT CASE WHEN p_brand = 'Brand#1' THEN p_partkey END AS alone, p_brand, p_type, min(p_partkey) AS first_key, count(*) AS merged FROM part GROUP BY ALL""")
def q_anonymous_merge(t):
    """Records merged by their key, but for those without any identity (here one brand's)."""
    rows = t.part.select("p_brand", "p_type", F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).otherwise("").alias("identity"), "p_partkey", F.array(F.col("p_partkey").cast("string")).alias("keys"))
    out = dedup.merge_records(rows, ["p_brand", "p_type"], "p_partkey", ["identity"], ["keys"])
    return out.select(F.when(F.col("p_brand") == "Brand#1", F.col("p_partkey")).alias("alone"), "p_brand", "p_type", F.col("p_partkey").alias("first_key"), F.size("keys").cast("long").alias("merged"))


@R.add(
    """WITH s AS (SELECT 'https://mp.weixin.qq.com/s/' || o_custkey || '?a=' || o_orderkey AS url, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'ok' ELSE 'error' END AS status, o_custkey AS c, o_orderkey AS k FROM orders),
    d AS (SELECT c, arg_min(status, url) AS same FROM s WHERE status <> 'pending' GROUP BY 1)
    SELECT k AS id, CASE WHEN s.status = 'pending' THEN coalesce(d.same, 'pending') ELSE s.status END AS status FROM s LEFT JOIN d USING (c)"""
)
def q_task_lookup(t):
    """The task of each row by its first stored URL; a waiting article takes the state of one of the same path that has run."""
    url = F.concat(F.lit("https://mp.weixin.qq.com/s/"), "o_custkey", F.lit("?a="), "o_orderkey")
    tasks = t.orders.select(url.alias("url"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("not a url").alias("first"), url.alias("second"))
    return joins.task_lookup(rows, ["id"], ["first", "second"], tasks).select("id", "status")


@R.add("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'deleted' WHEN page_id % 7 = 1 THEN 'blocked' WHEN page_id % 7 = 2 THEN 'error' WHEN page_id % 7 = 3 THEN 'partial' WHEN page_id % 7 = 4 THEN 'blocked' WHEN page_id % 7 = 5 THEN 'deleted' ELSE 'ok' END AS status FROM pages""")
def q_page_status(t):
    """The state of captured pages by answer, text and forms."""
    m = F.col("page_id") % 7
    text = F.when(m == 3, "").when(m == 4, "请完成安全验证").when(m == 5, "该内容已被发布者删除").otherwise("some text")
    http = F.when(m == 0, 404).when(m == 1, 429).when(m == 2, 500).otherwise(200)
    return t.pages.select("page_id", P.page_status(F.lit("t"), text, F.lit(""), http, m == 4).alias("status"))


@R.add("""SELECT doc_id, md5(coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'seen line' ELSE '' END) AS digest FROM documents""")
def q_combined_text(t):
    """Texts with their recognised lines, blanks dropped."""
    lines = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(""), F.lit("seen line"))).otherwise(F.array(F.lit("")))
    return t.documents.select("doc_id", F.md5(documents.combined_text(F.coalesce("text", F.lit("")), lines)).alias("digest"))


@R.add(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 1 + c_custkey % 3 ELSE 0 END AS n, c_custkey % 5 AS l, ['ok', 'partial', 'error'][(c_custkey % 3 + 1)::INT] AS st FROM customer), x AS (SELECT *, n > 0 AS app, st = 'error' AS err FROM c),
    j AS (SELECT p_partkey % 5 AS l, 1 + p_size % 4 AS p FROM part), lv AS (SELECT unnest(['limited_source_ai_mention', 'csv_declared', 'page_text', 'structured_job', 'audit_confirmed']) AS v, unnest([0, 1, 2, 3, 4]) AS l)
    SELECT 'total' AS measure, 'analyzed' AS value, count(*) AS n FROM x UNION ALL SELECT 'total', 'applicable', count(*) FILTER (app) FROM x UNION ALL SELECT 'total', 'verified', count(*) FILTER (app AND l > 1) FROM x
    UNION ALL SELECT 'total', 'pending', count(*) FILTER (NOT app AND NOT err) FROM x UNION ALL SELECT 'total', 'error', count(*) FILTER (err) FROM x UNION ALL SELECT 'total', 'jobs', count(*) FROM j UNION ALL SELECT 'total', 'verified_details', count(*) FILTER (l > 2) FROM j
    UNION ALL SELECT 'evidence_level', v, (SELECT count(*) FROM j WHERE j.l = lv.l) FROM lv UNION ALL SELECT 'priority', p::VARCHAR, count(*) FROM j GROUP BY p UNION ALL SELECT 'fetch_status', st, count(*) FROM x GROUP BY st"""
)
def q_target_summary(t):
    """Totals of the target tables, with 0 for levels and priorities that none has."""
    levels = ("limited_source_ai_mention", "csv_declared", "page_text", "structured_job", "audit_confirmed")
    c = F.col("c_custkey")
    companies = t.customer.select(F.when(c % 4 > 0, 1 + c % 3).otherwise(0).alias("matched_role_count"), _pick(levels, "c_custkey").alias("evidence_level"), _pick(("ok", "partial", "error"), "c_custkey").alias("status"))
    jobs = t.part.select((1 + F.col("p_size") % 4).cast("int").alias("priority"), _pick(levels, "p_partkey").alias("evidence_level"), (F.col("p_partkey") % 5 > 2).alias("details_verified"))
    return targets.target_summary(companies, jobs)


@R.add("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def q_streamed_dedup(t):
    """Events by type from a real stream that drops repeated ids within its watermark (here every event comes twice)."""
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.folder}/events.parquet*")
    twice = stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = E.drained(E.without_repeats(twice, "event_id", "3650 days"), "append")
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@R.add("""SELECT user_id AS task_id, arg_max(event_type, event_id) AS state, count(*) FILTER (event_type = 'running')::BIGINT AS attempts FROM (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'running' ELSE event_type END AS event_type FROM events) GROUP BY 1""")
def q_streamed_states(t):
    """The latest state and attempts of each task, by a stateful stream."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    events = stream.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("state"))
    every = E.drained(E.task_states(events), "update")
    return every.groupBy("task_id").agg(F.max_by(F.struct("state", "attempts"), "batch").alias("s")).select("task_id", "s.*")


@R.add("""SELECT k, batch FROM (SELECT o_custkey AS k, 1 + o_orderkey % 4 AS batch, row_number() OVER (PARTITION BY o_custkey ORDER BY 1 + o_orderkey % 4, o_orderkey) AS n FROM orders WHERE 1 + o_orderkey % 4 <= 3) WHERE n = 1""")
def q_merged_batches(t):
    """Candidates of the first three batches, the first of each key."""
    batches = t.orders.select(F.col("o_custkey").alias("k"), (1 + F.col("o_orderkey") % 4).alias("batch"), "o_orderkey")
    return E.merge_batches(batches, ["o_orderkey"], ["k"], 3).select("k", "batch")


QUERIES, ORACLE_SQL = R.queries, R.sql
