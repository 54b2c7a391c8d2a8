"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import dedup, documents, joins
from .base import Registry

R = Registry()


@R.add(
    """SELECT c_custkey, count(*) AS tasks, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS task_ids FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1"""
)
def q_source_task_bridge(t):
    """The tasks of each source, in order."""
    joined = t.customer.select("c_custkey").join(t.orders.select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"))
    grouped = joined.groupBy("c_custkey").agg(F.count("*").alias("tasks"), F.array_sort(F.collect_list("o_orderkey")).alias("_ids"))
    return grouped.select("c_custkey", "tasks", F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",").alias("task_ids"))


@R.add(
    """WITH c AS (SELECT l_orderkey AS k, count(*) FILTER (l_linestatus <> 'F') AS open FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'partial' END AS status, (coalesce(open, 0) + CASE WHEN k IS NULL THEN 1 ELSE 0 END)::BIGINT AS unresolved,
    o_orderstatus = 'F' AND coalesce(open, 0) = 0 AND k IS NOT NULL AS complete FROM orders LEFT JOIN c ON k = o_orderkey"""
)
def q_unresolved_details(t):
    """Children that aren't done and discovered ones that were never enqueued keep a task from being complete."""
    tasks = t.orders.selectExpr("o_orderkey AS task_id", "CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'partial' END AS status", "true AS complete")
    children = t.lineitem.selectExpr("l_orderkey AS task_id", "cast(l_orderkey AS string) AS child_url", "CASE l_linestatus WHEN 'F' THEN 'ok' ELSE 'partial' END AS status")
    found = t.orders.selectExpr("o_orderkey AS task_id", "cast(o_orderkey AS string) AS url")
    return documents.packets(tasks, children, found)


@R.add(
    """WITH s AS (SELECT c_custkey, c_nationkey, [c_custkey * 7, c_custkey * 3, c_custkey] AS probes FROM customer),
    e AS (SELECT c_custkey, i - 1 AS probe, probes[i] AS v FROM s, range(1, 4) x(i)),
    h AS (SELECT c_custkey, arg_min(struct_pack(probe, k := o_orderkey, st := o_orderstatus), probe) AS b FROM e JOIN orders ON v = o_orderkey GROUP BY 1)
    SELECT s.c_custkey, b.probe::INT AS probe, b.k AS o_orderkey, coalesce(b.st, 'not_started') AS status FROM s LEFT JOIN h ON s.c_custkey = h.c_custkey"""
)
def q_fallback_join(t):
    """The task that the first of three keys finds."""
    probes = [F.col("c_custkey") * 7, F.col("c_custkey") * 3, F.col("c_custkey")]
    found = joins.fallback_join(t.customer.select("c_custkey"), ["c_custkey"], probes, t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return found.select("c_custkey", "probe", "o_orderkey", F.coalesce("o_orderstatus", F.lit("not_started")).alias("status"))


@R.add(
    """WITH a AS (SELECT l.doc_id, d.lang, CASE WHEN l.quality = 1 THEN l.doc_id::VARCHAR ELSE '' END AS row_id, 'q' || l.quality || 't' || l.toxic AS audit FROM labels l JOIN documents d USING (doc_id)),
    loose AS (SELECT lang, min(audit) AS audit FROM a WHERE row_id = '' GROUP BY 1), exact AS (SELECT lang, row_id, min(audit) AS audit FROM a GROUP BY 1, 2)
    SELECT d.doc_id, coalesce(e.audit, g.audit) AS audit FROM documents d LEFT JOIN exact e ON e.lang = d.lang AND e.row_id = d.doc_id::VARCHAR LEFT JOIN loose g ON g.lang = d.lang"""
)
def q_audit_fallback(t):
    """A document's own audit, else that of its language."""
    audits = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").selectExpr("lang", "CASE WHEN quality = 1 THEN cast(doc_id AS string) ELSE '' END AS row_id", "concat('q', quality, 't', toxic) AS audit")
    audits = audits.groupBy("lang", "row_id").agg(F.min("audit").alias("audit"))
    rows = t.documents.select("doc_id", "lang", F.col("doc_id").cast("string").alias("row_id"))
    return joins.keyed_fallback(rows, audits, ["lang", "row_id"], ["lang"], "audit").select("doc_id", "audit")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_left_semi_verified(t):
    """Sources with a finished task."""
    return t.customer.select("c_custkey", "c_name").join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_left_anti_pending(t):
    """Sources without a valid result."""
    return joins.pending(t.customer.select("c_custkey", "c_name"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", F.col("o_orderstatus") == "F")


@R.add(
    """SELECT o_orderkey, o_custkey, 'old' AS version FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
    UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderpriority LIKE '1%'"""
)
def q_replace_by_key(t):
    """Rows of refreshed companies replaced."""
    old = t.orders.select("o_orderkey", "o_custkey", F.lit("old").alias("version"))
    new = t.orders.where("o_orderpriority LIKE '1%'").select("o_orderkey", "o_custkey", F.lit("new").alias("version"))
    return joins.replace_by_key(old, new, ["o_custkey"])


@R.add(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE n_name END AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def q_backfill_dimension(t):
    """Blank industries taken from the dimension."""
    rows = t.supplier.selectExpr("s_suppkey", "s_nationkey", "CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE '' END AS industry")
    source = t.nation.selectExpr("n_nationkey AS s_nationkey", "n_name AS industry")
    return joins.backfill(rows, source, ["s_nationkey"], "industry").select("s_suppkey", "industry")


@R.add(
    """WITH c AS (SELECT DISTINCT c_name AS company, lower(regexp_replace(c_name, '[^0-9a-zA-Z]+', '', 'g')) AS a FROM customer),
    h AS (SELECT DISTINCT lower(regexp_replace(replace(c_name, 'Customer', 'Cust'), '[^0-9a-zA-Z]+', '', 'g')) AS b FROM customer WHERE c_mktsegment = 'BUILDING'
          UNION SELECT lower(regexp_replace(c_name, '[^0-9a-zA-Z]+', '', 'g')) FROM customer WHERE c_acctbal < 0)
    SELECT company, bool_or(coalesce(a = b OR starts_with(a, b) OR starts_with(b, a) OR (length(b) >= 3 AND contains(a, b)), false)) AS applied FROM c LEFT JOIN h ON a = b OR starts_with(a, b) OR starts_with(b, a) OR (length(b) >= 3 AND contains(a, b)) GROUP BY 1"""
)
def q_theta_company_match(t):
    """Companies whose name equals, begins, continues or holds a recorded one."""
    names = t.customer.select(F.col("c_name").alias("company")).distinct()
    history = t.customer.where("c_mktsegment = 'BUILDING'").selectExpr("replace(c_name, 'Customer', 'Cust') AS recorded").union(t.customer.where("c_acctbal < 0").select("c_name"))
    return joins.applied_companies(names, "company", history, "recorded").select("company", "applied")


@R.add(
    """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS id FROM region JOIN nation ON r_regionkey = n_regionkey
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    x AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT root, e.id, depth + 1 FROM x JOIN e ON e.parent = x.id)
    SELECT root, id, depth FROM x"""
)
def q_descendants(t):
    """All that hangs below each root."""
    edges = t.nation.selectExpr("concat('r', n_regionkey) AS parent", "concat('n', n_nationkey) AS id").union(t.supplier.selectExpr("concat('n', s_nationkey)", "concat('s', s_suppkey)"))
    return joins.descendants(edges, t.region.selectExpr("concat('r', r_regionkey) AS id"))


@R.add(
    """SELECT p_partkey, p_size, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1"""
)
def q_best_candidate(t):
    """The best row of each company."""
    return dedup.best_by(t.part, ["p_brand"], [F.col("p_size"), -F.col("p_retailprice"), F.col("p_partkey")], ["p_partkey", "p_size", "p_name"]).drop("p_brand")


@R.add(
    """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) > 1 AS is_repeat FROM lineitem"""
)
def q_overlap_marks(t):
    """Later rows of a key marked, not removed."""
    return dedup.repeated(t.lineitem, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "is_repeat")


@R.add(
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'new' || c_custkey WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer"""
)
def q_overlay_nonempty(t):
    """New values over old ones where they say something."""
    old = t.customer.where("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey", "c_mktsegment AS segment")
    new = t.customer.where("c_mktsegment = 'BUILDING' OR c_acctbal > 0").selectExpr("c_custkey", "CASE WHEN c_acctbal > 5000 THEN concat('new', c_custkey) ELSE '' END AS segment")
    return dedup.overlay(old, new, ["c_custkey"])


@R.add(
    """SELECT p_brand, p_type, min(p_partkey) AS first_key, count(*) AS merged, string_agg(p_name, '|' ORDER BY p_partkey) AS names FROM part GROUP BY 1, 2"""
)
def q_merge_records(t):
    """Rows alike in their key merged, with their lists in order."""
    rows = t.part.selectExpr("p_brand", "p_type", "p_partkey", "array(concat(p_partkey, ':', p_name)) AS names")
    out = dedup.merge_records(rows, ["p_brand", "p_type"], "p_partkey", ["p_brand"], ["names"])
    names = F.array_join(F.transform("names", lambda x: F.regexp_replace(x, "^\\d+:", "")), "|")
    return out.select("p_brand", "p_type", F.col("p_partkey").alias("first_key"), F.size("names").cast("long").alias("merged"), names.alias("names"))


@R.add(
    """WITH k AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h, rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS p FROM pages),
    b AS (SELECT DISTINCT regexp_replace(h, '^www\\.', '') AS host FROM k WHERE page_id IN (SELECT page_id FROM pages WHERE length(html) > 4000))
    SELECT page_id, regexp_replace(h, '^www\\.', '') IN (SELECT host FROM b) AS applied FROM k"""
)
def q_url_key_match(t):
    """Pages whose URL shares a key with a recorded one."""
    rows = t.pages.select("page_id", "url")
    return joins.applied_urls(rows, "url", t.pages.where("length(html) > 4000").select(F.col("url").alias("recorded")), "recorded").select("page_id", "applied")


@R.add(
    """SELECT p_name AS name, substr(sha256(lower('C' || chr(31) || trim(regexp_replace(p_name, '\\s+', ' ', 'g')))), 1, 24) AS id FROM part"""
)
def q_stable_ids(t):
    """Identities that don't depend on case and white space."""
    return t.part.select(F.col("p_name").alias("name"), T.stable_id(F.lit("C"), F.col("p_name")).alias("id"))


@R.add(
    """WITH k AS (SELECT page_id, url, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS base,
      list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid)(=|$)')) AS q, regexp_extract(url, '(#.+)$', 1) AS f FROM pages),
    u AS (SELECT page_id, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') ELSE '' END || f AS canonical FROM k)
    SELECT canonical, min(page_id) AS page_id, count(*) AS n FROM u GROUP BY 1"""
)
def q_url_dedup(t):
    """One page for each canonical URL."""
    return t.pages.select(U.canonical(F.col("url")).alias("canonical"), "page_id").groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


QUERIES, ORACLE_SQL = R.queries, R.sql
