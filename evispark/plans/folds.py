"""Folds and batches over the driver's tables: line items are recognised lines, documents evidence texts, conversations tasks with jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import agents, audit, checks, ocr, segments
from .base import Registry

R = Registry()

# Each line item is shown by two slices, the second some pixels lower: tax tells how many, and discount and quantity how sure each reading is.
_BOXES = """(SELECT l_orderkey AS image, n, l_returnflag AS text, round(l_tax * 100)::INT AS shift, CASE WHEN l_discount > 0.01 THEN l_discount END AS first, CASE WHEN l_quantity > 5 THEN l_quantity / 1000.0 END AS second
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem))"""


@R.add(
    f"""WITH b AS (SELECT *, 2 * (10 - shift) >= 10 AS again, coalesce(second, -1) > coalesce(first, -1) AS better FROM {_BOXES})
    SELECT image, 2 * n AS slice_index, n AS line_index, 100 * n AS top FROM b WHERE NOT again OR NOT better UNION ALL SELECT image, 2 * n + 1, n, 100 * n + shift FROM b WHERE NOT again OR better"""
)
def q_ocr_survivors(t):
    """Recognised lines without those that another slice shows again."""
    c = F.col
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    line = t.lineitem.withColumn("n", n).select(c("l_orderkey").alias("image"), "n", c("l_returnflag").alias("text"), F.round(c("l_tax") * 100).cast("int").alias("shift"), "l_discount", "l_quantity")
    box = lambda slice_, shift, sure: F.struct((2 * c("n") + slice_).cast("long").alias("slice_index"), (100 * c("n") + shift).cast("long").alias("top"), sure.alias("confidence"))
    first = box(0, F.lit(0), F.when(c("l_discount") > 0.01, c("l_discount").cast("double")))
    second = box(1, c("shift"), F.when(c("l_quantity") > 5, c("l_quantity").cast("double") / 1000))
    each = line.select("image", c("n").cast("long").alias("line_index"), "text", F.explode(F.array(first, second)).alias("b"))
    lines = each.select("image", "b.slice_index", "line_index", "text", "b.confidence", F.lit(0).cast("long").alias("left"), "b.top", F.lit(100).cast("long").alias("width"), F.lit(10).cast("long").alias("height"))
    return ocr.survivors(lines).select("image", "slice_index", "line_index", "top")


@R.add(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}') AS w FROM documents),
    t AS (SELECT doc_id, text, unnest(list_distinct(list_filter([w[2], w[5], w[9], w[30]], lambda x: x IS NOT NULL))) AS title FROM d),
    p AS (SELECT doc_id, title, sum(len(piece)) OVER w + (i - 1) * len(title) AS pos, i, n FROM (SELECT doc_id, title, len(string_split(text, title)) AS n, unnest(string_split(text, title)) AS piece, generate_subscripts(string_split(text, title), 1) AS i FROM t) WINDOW w AS (PARTITION BY doc_id, title ORDER BY i)),
    s AS MATERIALIZED (SELECT doc_id, title, pos::BIGINT AS pos FROM p WHERE i < n),
    p2 AS (SELECT a.doc_id, a.title, a.pos, o.title AS other FROM s a LEFT JOIN t o ON o.doc_id = a.doc_id AND o.title <> a.title),
    o AS (SELECT p2.doc_id, p2.title, p2.pos, min(b.pos) AS next FROM p2 ASOF LEFT JOIN s b ON b.doc_id = p2.doc_id AND b.title = p2.other AND b.pos > p2.pos GROUP BY 1, 2, 3),
    g AS (SELECT o.doc_id, o.title, o.pos, text[o.pos + 1:least(coalesce(next, len(text)), o.pos + 2200)] AS segment FROM o JOIN t ON t.doc_id = o.doc_id AND t.title = o.title),
    m AS (SELECT *, len(list_filter(string_split(segment, chr(10)), lambda x: regexp_matches(x, '(?i)(^|[^A-Za-z])(AI|LLM|Agent|CV|NLP)($|[\\s_/（(-])'))) > 0 OR regexp_matches(title, '(?i)^(AI|LLM|Agent|CV|NLP)$') AS telling FROM g)
    SELECT doc_id, title, md5(coalesce(arg_min(segment, pos) FILTER (telling), arg_min(segment, pos))) AS segment, count(*)::INT AS mentions FROM m GROUP BY 1, 2"""
)
def q_role_segments(t):
    """The segments of four of each document's own words; those with the pronounced letters of AI come first."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array_compact(F.array(*(F.try_element_at(words, F.lit(i)) for i in (2, 5, 9, 30)))).alias("titles"))
    found = segments.role_segments(docs, "doc_id", "text", "titles")
    return found.select("doc_id", "title", F.md5("segment").alias("segment"), "mentions")


_JOBS = """(SELECT conv_id, turn, role, text, CASE turn % 4 WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'j' || turn // 2 END AS id, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN '' ELSE 'notes' END AS notes FROM conversations WHERE conv_id % 5 > 0)"""


def _review(t):
    c = F.col
    packets = t.conversations.groupBy(c("conv_id").cast("string").alias("task_id")).agg(
        F.lit("talk").alias("title"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])).alias("compact_text"), F.concat(F.lit("context "), F.repeat(F.lit("x"), 600)).alias("document_context"),
        F.array(F.lit("whole")).alias("evidence_ids"),
    )
    ident = F.when(c("turn") % 4 == 1, None).when(c("turn") % 4 == 2, "").otherwise(F.concat(F.lit("j"), F.floor(c("turn") / 2).cast("string")))
    notes = F.when(c("turn") % 3 == 0, c("text")).when(c("turn") % 3 == 1, "").otherwise("notes")
    blank = F.lit(None).cast("string")
    jobs = t.conversations.where("conv_id % 5 > 0").select(
        c("conv_id").cast("string").alias("task_id"), c("turn").alias("nth"), ident.alias("id"), blank.alias("raw_job_id"), c("role").alias("title"), blank.alias("url"), blank.alias("location"), blank.alias("department"), blank.alias("company"),
        F.repeat("text", 6).alias("requirements"), c("text").alias("description"), notes.alias("text"), F.array(c("turn").cast("string")).alias("evidence_ids"),
    )
    return agents.agent_records(packets, jobs)


_RECORDS = f"""WITH j AS (SELECT conv_id, turn, role, repeat(text, 6) AS req, text AS descr, notes, CASE WHEN notes = '' THEN '' WHEN notes = text THEN 'description' ELSE '' END AS alias,
      coalesce(nullif(id, ''), 'turn ' || turn) AS ident FROM {_JOBS}),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, ident, role, descr, notes ORDER BY turn) AS n FROM j) WHERE n = 1),
    r AS (SELECT conv_id, turn, role, alias, least(6000, len(req)) AS n1, len(req) AS f1, len(descr) AS f2, CASE WHEN alias = '' THEN len(notes) ELSE 0 END AS f3, 608 AS f4 FROM f),
    q AS (SELECT *, least(f2, 6000 - n1) AS n2 FROM r), x AS (SELECT *, least(f3, 6000 - n1 - n2) AS n3 FROM q), y AS (SELECT *, least(f4, 512, 6000 - n1 - n2 - n3) AS n4 FROM x),
    records AS (SELECT conv_id::VARCHAR AS task_id, 'job' AS kind, turn::VARCHAR AS evidence, alias, concat_ws(',', CASE WHEN f1 > n1 THEN 'requirements' END, CASE WHEN f2 > n2 THEN 'description' END, CASE WHEN f3 > n3 THEN 'text' END, CASE WHEN f4 > n4 THEN 'document_context' END) AS truncated,
      (f1 + f2 + f3 + f4)::INT AS original_chars, (n1 + n2 + n3 + n4)::INT AS included_chars FROM y
    UNION ALL SELECT conv_id::VARCHAR, 'document', 'whole', '', CASE WHEN n > 6000 THEN 'compact_text' ELSE '' END, n::INT, least(n, 6000)::INT FROM (SELECT conv_id, sum(len(text)) + count(*) - 1 AS n FROM conversations WHERE conv_id % 5 = 0 GROUP BY 1))"""


@R.add(f"{_RECORDS} SELECT * FROM records")
def q_agent_records(t):
    """Records for review: one for each distinct job of a conversation, or one for a conversation without jobs."""
    r = _review(t)
    return r.select("task_id", "kind", F.array_join("evidence_ids", ",").alias("evidence"), F.coalesce(F.try_element_at("field_aliases", F.lit("text")), F.lit("")).alias("alias"), F.array_join("truncated_fields", ",").alias("truncated"), "original_chars", "included_chars")


def _as_maps(t):
    r = _review(t)
    return r.select("task_id", "record_id", F.map_filter(F.create_map(
        F.lit("kind"), F.col("kind"), F.lit("title"), F.col("title"), F.lit("truncated"), F.array_join("truncated_fields", ","), F.lit("alias"), F.try_element_at("field_aliases", F.lit("text")), F.lit("evidence"), F.array_join("evidence_ids", ","),
    ), lambda k, v: (k != "alias") | v.isNotNull()).alias("record"))


_FOLDED = f"""{_RECORDS}, e AS (SELECT records.*, CASE WHEN kind = 'document' THEN 'talk' ELSE (SELECT any_value(role) FROM conversations WHERE conv_id::VARCHAR = task_id AND turn::VARCHAR = evidence) END AS title FROM records)"""


@R.add(
    f"""{_FOLDED} SELECT task_id, count(*) AS records, concat_ws(',', CASE WHEN count(nullif(alias, '')) = count(*) AND min(alias) = max(alias) THEN 'alias=' || min(alias) END, 'kind=' || min(kind), CASE WHEN min(title) = max(title) THEN 'title=' || min(title) END,
    CASE WHEN min(truncated) = max(truncated) THEN 'truncated=' || min(truncated) END) AS context FROM e GROUP BY 1"""
)
def q_agent_batches(t):
    """What all records of a conversation share."""
    contexts, residuals = agents.fold(_as_maps(t), "task_id", "record", ["kind", "title", "truncated", "alias"])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("context")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return contexts.join(residuals.groupBy("task_id").agg(F.count("*").alias("records")), "task_id").select("task_id", "records", shown.alias("context"))


@R.add(f"{_FOLDED} SELECT task_id, evidence, kind, title, truncated, nullif(alias, '') AS alias FROM e")
def q_agent_unfolded(t):
    """Records put together again from their batch's context and what is their own."""
    records = agents.unfold(*agents.fold(_as_maps(t), "task_id", "record", ["kind", "title", "truncated", "alias"]), "task_id", "record")
    return records.select("task_id", *(F.try_element_at("record", F.lit(f)).alias(f) for f in ("evidence", "kind", "title", "truncated", "alias")))


@R.add(
    """WITH a AS (SELECT c_custkey, c_nationkey % 3 AS way, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer)
    SELECT o_orderkey, c_custkey FROM orders JOIN a ON o_custkey = c_custkey WHERE way = 0 OR (way = 1 AND o_orderkey = last)"""
)
def q_audit_rows(t):
    """Orders with the audit of their customer: a third of the audits name no row in particular, a third the last one, a third one that isn't there."""
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last"))
    way = F.col("c_nationkey") % 3
    none = F.array().cast("array<bigint>")
    audits = t.customer.join(last, "c_custkey", "left").select("c_custkey", F.when(way == 0, none).when(way == 1, F.array("last")).otherwise(F.array(F.lit(-1).cast("bigint"))).alias("rows"))
    found = audit.with_audit(t.orders.select("o_custkey", "o_orderkey"), audits.withColumn("o_custkey", F.col("c_custkey")), "o_custkey", "o_orderkey", "rows")
    return found.select("o_orderkey", "c_custkey")


_ROLE = "CASE p_size % 8 WHEN 0 THEN 'AI工程师（MES方向）' WHEN 1 THEN 'AI药物研发' || p_type WHEN 2 THEN 'AI Pilot ' || p_name WHEN 3 THEN p_name || '图像处理' WHEN 4 THEN p_type || '岗位族' ELSE p_name END"
_HOW = {"is": "role = '{}'", "begins": "starts_with(role, '{}')", "contains": "contains(role, '{}')", "company": "company = '{}'", "": "true"}
_TABLE = [(_HOW[how].format(text), code, why) for how, text, code, why in rules.ROLE_TABLE]


@R.add(
    f"""WITH r AS (SELECT p_partkey, {_ROLE} AS role, CASE WHEN p_brand LIKE '%1' THEN '赫力昂' ELSE p_brand END AS company, p_partkey % 3 AS gaps, CASE WHEN p_retailprice > 950 THEN '上海' ELSE p_type END AS place FROM part),
    d AS (SELECT *, CASE {' '.join(f"WHEN {when} THEN '{code}'" for when, code, _ in _TABLE)} END AS code, CASE {' '.join(f"WHEN {when} THEN '{why}'" for when, _, why in _TABLE)} END AS why FROM r)
    SELECT p_partkey, CASE WHEN code = 'insufficient_target_evidence' AND gaps > 0 THEN 'insufficient_evidence_ocr_gaps' ELSE code END AS exclusion_code,
      why || CASE WHEN code = 'insufficient_target_evidence' AND gaps > 0 THEN ' 同时存在' || gaps || '个图片OCR缺口，证据进一步降级。' ELSE '' END AS rationale, place = '上海' AS location_eligible FROM d"""
)
def q_role_table(t):
    """Roles that the fixed table leaves out, and why."""
    company = F.when(F.endswith("p_brand", F.lit("1")), "赫力昂").otherwise(F.col("p_brand"))
    place = F.when(F.col("p_retailprice") > 950, "上海").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", audit.role_decisions(company, F.expr(_ROLE), F.col("p_partkey") % 3, place).alias("d")).select("p_partkey", "d.*")


@R.add("""WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 8), p AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey BETWEEN 7 AND 15), e AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey > 15), j AS (SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem),
    v AS (SELECT 'summary_matches_files' AS name, 1 + ((SELECT count(*) FROM p) <> (SELECT count(*) - (SELECT count(*) FROM c) FROM customer) - (SELECT count(*) FROM e))::INT AS n
      UNION ALL SELECT 'company_outputs_deduplicated', count(*) FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'job_outputs_deduplicated', count(*) FROM (SELECT id FROM j GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'task_companies_pending_or_error', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT id FROM p UNION ALL SELECT id FROM e) UNION ALL SELECT 'baseline_preserved', 1)
    SELECT name AS "check", n::BIGINT AS violations, n = 0 AS passed FROM v""")
def q_target_consistency(t):
    """The consistency report over customers as companies and line items as jobs; customers of one nation are in two outputs."""
    of = lambda cond: t.customer.where(cond).select(F.col("c_custkey").alias("company_id"))
    outputs = {"companies": of("c_nationkey < 8"), "pending": of("c_nationkey BETWEEN 7 AND 15"), "errors": of("c_nationkey > 15"), "jobs": t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("jd_id"))}
    whole = t.customer.agg(F.count("*").alias("n")).select(F.lit("pending").alias("name"), "n")
    known = whole.crossJoin(F.broadcast(outputs["companies"].agg(F.count("*").alias("a")))).crossJoin(F.broadcast(outputs["errors"].agg(F.count("*").alias("b")))).select("name", (F.col("n") - F.col("a") - F.col("b")).alias("told"))
    counts = lambda n: outputs[n].agg(F.count("*").alias("told")).select(F.lit(n).alias("name"), "told")
    # The summary says nothing of jobs, and counts a company once.
    summary = known.unionByName(counts("companies")).unionByName(counts("errors"))
    tasks = t.orders.select(F.col("o_custkey").alias("company_id")).distinct()
    return checks.target_consistency(outputs, summary, tasks, {"companies": 1, "jobs": 1_000_000_000})


QUERIES, ORACLE_SQL = R.queries, R.sql
