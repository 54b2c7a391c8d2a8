"""Document, page and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import dedup, documents, pages, targets
from .base import Registry

R = Registry()


@R.add(
    """SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) FILTER (NOT keep) AS dropped_lines FROM (SELECT *, length(trim(line, ' ')) < 20 OR n = 1 AS keep FROM (
    SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)))
    GROUP BY 1""".replace("string_agg(line, chr(10) ORDER BY i) AS text", "string_agg(line, chr(10) ORDER BY i) FILTER (keep) AS text")
)
def q_line_dedup(t):
    """Texts without lines that repeat."""
    return dedup.without_repeated_lines(t.documents.select("doc_id", "text"), "text", ["doc_id"])


@R.add(
    """SELECT doc_id, c::INT AS chunk, 'document:' || doc_id || ':' || c AS chunk_id, 'document' AS kind, substr(text, c::INT * 6000 + 1, 6000) AS text
    FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 5999) // 6000)) AS c FROM documents)"""
)
def q_chunks(t):
    """Evidence chunks."""
    return documents.evidence_chunks(t.documents, "doc_id", "text", "document")


@R.add(
    """SELECT doc_id, substr(lang, 1, 30) AS lang, substr(source, 1, greatest(0, 30 - length(lang))) AS source, substr(text, 1, greatest(0, 30 - length(lang) - length(source))) AS text,
    CASE WHEN length(text) > greatest(0, 30 - length(lang) - length(source)) THEN 'text' ELSE '' END AS truncated FROM documents"""
)
def q_limited_fields(t):
    """Fields within a shared budget."""
    return documents.limited_fields(t.documents, "doc_id", ["lang", "source", "text"], 30)


def _matches(pattern: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{pattern}'), lambda x: lower(x)))), ','), '')"


#: Word boundaries in SQL know ASCII only, so what stands about a word is told.
_EDGE = "[^\\p{L}\\p{N}_]"
_AI = (
    "coalesce(array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, '(?i)大模型|人工智能|算法|机器学习'), "
    f"regexp_extract_all(text, '(?i)(?:^|{_EDGE})(ai|agent)(?:$|{_EDGE})', 1)), lambda x: lower(x)))), ','), '')"
)


@R.add(
    f"SELECT doc_id, {_matches(rules.SIGNALS['recruitment'].replace('(?iu)', '(?i)'))} AS recruitment, {_AI} AS ai, {_matches(rules.SIGNALS['access_challenge'].replace('(?iu)', '(?i)'))} AS access_challenge FROM documents"
)
def q_signals(t):
    """The signals in texts."""
    return documents.signal_table(t.documents, "doc_id", "text")


@R.add("SELECT min(doc_id) AS doc_id, count(*) AS copies, min(source) AS source FROM documents GROUP BY md5(text)")
def q_exact_dup_docs(t):
    """One row for each distinct text."""
    return t.documents.groupBy(F.sha2("text", 256).alias("_h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("source").alias("source")).drop("_h")


@R.add(
    """SELECT doc_id, quality, toxic FROM (SELECT d.doc_id, d.source, l.quality, l.toxic, row_number() OVER (PARTITION BY source ORDER BY (CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN l.toxic IS NOT NULL THEN 1 ELSE 0 END) DESC, d.doc_id) AS n
    FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE n = 1"""
)
def q_best_completeness(t):
    """The fullest row of each source."""
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select("source", "quality", "toxic", "doc_id")
    return dedup.fullest(rows, ["source"], [F.col("doc_id")]).select("doc_id", "quality", "toxic")


@R.add("SELECT conv_id, count(*) AS lines, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1")
def q_ordered_lines_concat(t):
    """Conversations with their lines in order."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    grouped = t.conversations.groupBy("conv_id").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("_l"))
    return grouped.select("conv_id", "lines", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


@R.add(
    """SELECT conv_id, segment::BIGINT AS segment, count(*) AS lines, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations) GROUP BY 1, 2"""
)
def q_segment_by_anchor(t):
    """Lines from each question to the next."""
    return documents.segments(t.conversations, "conv_id", "turn", F.col("role") == "user", "text")


def _bare(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


_GRAB = {k: f"regexp_extract(html, '(?is)<{k}[^>]*>(.*?)</{k}>', 1)" for k in ("title", "h1", "article")}


@R.add(
    f"""SELECT page_id, {_bare(_GRAB['title'])} AS title, {_bare(_GRAB['h1'])} AS h1, length({_bare(_GRAB['article'])}) AS article_chars, substr({_bare(_GRAB['article'])}, 1, 300) AS sample,
    len(regexp_extract_all(html, '(?i)<img[\\s>]'))::BIGINT AS images FROM pages"""
)
def q_html_summary(t):
    """Titles and article samples by regular expressions."""
    shown = pages.summary(F.col("html"))
    return t.pages.select("page_id", *(shown[c].alias(c) for c in ("title", "h1", "article_chars", "sample", "images")))


@R.add()
def q_html_extract(t):
    """The structure of pages and their status."""
    found = pages.extract(t.pages)
    status = pages.page_status(F.col("title"), F.col("text"), F.col("article_text"), F.lit(200), F.col("password_form"))
    return found.select("page_id", "title", "h1", F.length("text").alias("chars"), F.length("article_text").alias("article_chars"), F.size("links").alias("links"), F.size("images").alias("images"), status.alias("status"))


_PLAIN = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"


@R.add(
    f"""WITH a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS x FROM pages), b AS (SELECT page_id, base, {_PLAIN('''regexp_extract(x, 'href="([^"]*)"', 1)''')} AS h, {_PLAIN('''regexp_extract(x, '(?is)^<a[^>]*>(.*)</a>$', 1)''')} AS l FROM a)
    SELECT page_id, regexp_extract(base, '^(https?://[^/?#]*)', 1) || h AS url, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS label, 'page' AS kind FROM b"""
)
def q_html_links(t):
    """The links of pages."""
    return pages.extract(t.pages).select("page_id", F.explode("links").alias("l")).select("page_id", "l.url", "l.label", "l.kind")


@R.add()
def q_preprocess(t):
    """The derived view of pages: reliable text without repeated lines, reasons and signals."""
    c = F.col
    rows = pages.extract(t.pages).select(
        c("page_id").alias("doc"), c("article_text").alias("html_text"), (F.length("article_text") >= 80).alias("html_certain"), c("text"),
        F.array().cast("array<string>").alias("ocr"), F.lit(None).cast("boolean").alias("coverage_complete"), F.lit(0).alias("unresolved"), F.lit("ok").alias("status"),
    )
    return documents.preprocess(rows)


@R.add()
def q_targets(t):
    """Company and job targets from suppliers as candidates, with roles, tasks, jobs and audits made from the tables."""
    from .text import ROLES

    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    role = pick(ROLES, "s_suppkey")
    candidates = t.supplier.select(
        F.col("s_suppkey").alias("candidate"), F.col("s_name").alias("company"), pick(("国企", "民企", "外企", ""), "s_suppkey").alias("enterprise_nature"), F.lit("").alias("ownership_status"),
        pick(("医疗器械", "生物医药", "软件"), "s_suppkey").alias("industry"), F.to_json(F.array(F.struct(F.lit("1").alias("priority"), F.lit("x").alias("category"), role.alias("role")))).alias("matched_roles"),
        F.col("s_suppkey").cast("string").alias("source_row"),
    )
    tasks = t.supplier.select(F.col("s_suppkey").alias("candidate"), pick(("ok", "partial", "error"), "s_suppkey").alias("status"), pick(("jobs.example.com", "mp.weixin.qq.com"), "s_suppkey").alias("host"), F.lit("last_page").alias("stop_reason"), role.alias("page_text"))
    jobs = t.supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("candidate"), F.lit(0).alias("at"), role.alias("title"), F.lit("训练深度学习模型").alias("job_text"), F.lit("https://jobs.example.com/1").alias("url"))
    audits = t.supplier.where("s_suppkey % 11 = 0").select(F.col("s_name").alias("company"), F.lit("").alias("source_row"), F.lit("seen").alias("evidence"))
    built = targets.build(candidates, tasks, jobs, audits)
    parts = targets.split(built["companies"], built["jobs"])
    return built["companies"].join(parts["verified"].select("company_id", F.lit(True).alias("verified")), "company_id", "left")


QUERIES, ORACLE_SQL = R.queries, R.sql
