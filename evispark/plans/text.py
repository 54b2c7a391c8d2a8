"""Text and URL function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions import urls as U
from ..operators import targets
from .base import Registry

R = Registry()

#: Role-like text from the part names, so that the vocabularies apply: each type stands for one title.
ROLES = (
    "大模型算法工程师", "Agent开发工程师", "计算机视觉算法", "销售经理", "图像处理工程师", "NLP算法研究员", "RAG应用", "运营",
    "深度学习研究,Agent研发", "医疗影像重建", "算法工程师", "多模态感知算法",
)
_ROLE_SQL = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"
_ROLE = f"{_ROLE_SQL}[(p_partkey % {len(ROLES)} + 1)::INT]"


def roles(t):
    return t.part.select("p_partkey", "p_name", "p_type", F.element_at(F.array(*map(F.lit, ROLES)), (F.col("p_partkey") % len(ROLES) + 1).cast("int")).alias("role"))


def _re2(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


@R.add(
    f"SELECT p_partkey, (CASE {' '.join(f'WHEN regexp_matches({_ROLE}, {chr(39)}{_re2(p)}{chr(39)}) THEN {v}' for v, p in rules.TARGET_ROLES)} END)::INT AS priority FROM part"
)
def q_role_classify(t):
    """A role's priority by the ordered target rules."""
    return roles(t).select("p_partkey", T.classify(F.col("role")).alias("priority"))


_SPLIT = f"list_filter(list_transform(regexp_split_to_array({_ROLE}, '[,，、;；\\n]+'), lambda x: trim(x)), lambda x: x <> '')"
_CASES = " ".join(f"WHEN regexp_matches(x, '{_re2(p)}') THEN {v}" for v, p in rules.SELECTION_ROLES)


@R.add(f"SELECT p_partkey, x AS role, (CASE {_CASES} END)::INT AS priority FROM (SELECT p_partkey, unnest(list_distinct({_SPLIT})) AS x FROM part) WHERE CASE {_CASES} END IS NOT NULL")
def q_selected_roles(t):
    """The roles of a list that a selection rule takes."""
    each = roles(t).select("p_partkey", F.explode(T.selected_roles(F.col("role"))).alias("r"))
    return each.select("p_partkey", F.col("r.role").alias("role"), F.col("r.priority").alias("priority"))


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{x.lower()}')" for x in terms) + ")"


def _count(text: str, terms) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{x.lower()}')::INT" for x in terms) + ")"


_TEXT = f"(p_name || ' ' || {_ROLE})"


@R.add(
    f"""SELECT p_partkey, ({_count(_TEXT, rules.SCORE_TERMS)} + 3 * {_count(_TEXT, rules.STRONG_TERMS)} + 4 * {_any(_ROLE, rules.STRONG_TERMS)}::INT
    - 2 * ({_any(_ROLE, rules.NOISE_TERMS)} AND NOT {_any(_ROLE, rules.STRONG_TERMS)})::INT + (p_partkey % 2)::INT)::INT AS score FROM part"""
)
def q_score(t):
    """Keyword scores."""
    text = F.concat_ws(" ", "p_name", "role")
    link = F.when(F.col("p_partkey") % 2 == 1, "https://jobs.example.com/1").otherwise("https://mp.weixin.qq.com/s/1")
    return roles(t).select("p_partkey", T.score(text, F.col("role"), link).cast("int").alias("score"))


@R.add(
    f"""SELECT p_partkey, CASE WHEN {_any(_ROLE, ('agent', '大模型', '多模态', 'llm'))} THEN 'A-Agent/大模型'
    WHEN {_any(_ROLE, ('计算机视觉', '机器视觉', '视觉算法', '图像算法', 'slam', '感知算法'))} THEN 'A-CV/视觉'
    WHEN {_any(_ROLE, ('算法工程师', '算法研究', 'ai算法', '机器学习', '深度学习'))} THEN 'B-算法' ELSE 'C-泛AI' END AS bucket FROM part"""
)
def q_bucket(t):
    """Priority buckets."""
    return roles(t).select("p_partkey", T.bucket(F.col("role")).alias("bucket"))


@R.add(
    f"""SELECT p_partkey, {_count(_ROLE, rules.COARSE_TERMS)} + regexp_matches(lower({_ROLE}), '(^|[^a-z])ai([^a-z]|$)')::INT AS n_tags,
    (10 * ({_count(_ROLE, rules.COARSE_TERMS)} + regexp_matches(lower({_ROLE}), '(^|[^a-z])ai([^a-z]|$)')::INT))::INT AS priority FROM part"""
)
def q_coarse_tags(t):
    """Coarse tags and the priority they give."""
    return roles(t).select("p_partkey", F.size(T.coarse_tags(F.col("role"))).alias("n_tags"), T.coarse_priority(F.col("role")).alias("priority"))


_NATURE = "['国企', '民企', '外企', '', '国有控股', '事业单位'][(s_suppkey % 6 + 1)::INT]"
_INDUSTRY = "['医疗器械', '生物医药', '软件', '基因检测', '金融'][(s_suppkey % 5 + 1)::INT]"


@R.add(
    f"""SELECT s_suppkey, CASE WHEN regexp_matches({_NATURE}, '{rules.EXPLICIT_SOE}') THEN 'high' WHEN {_NATURE} IN ('民企', '外企') THEN 'medium' ELSE 'low' END AS confidence,
    '企业性质=' || CASE WHEN {_NATURE} = '' THEN '未注明' ELSE {_NATURE} END || '; 预筛判断=未提供' AS evidence FROM supplier
    WHERE s_name <> '' AND regexp_matches({_INDUSTRY}, '{_re2(rules.INDUSTRY)}') AND NOT regexp_matches({_NATURE}, '{rules.EXPLICIT_SOE}')"""
)
def q_candidate_admission(t):
    """Companies that are admitted, and what is known of their owners."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("s_suppkey") % len(values) + 1).cast("int"))
    rows = t.supplier.select("s_suppkey", "s_name", pick(("国企", "民企", "外企", "", "国有控股", "事业单位")).alias("nature"), pick(("医疗器械", "生物医药", "软件", "基因检测", "金融")).alias("industry"))
    named = rows.select(F.col("s_suppkey").alias("candidate"), F.col("s_name").alias("company"), F.col("nature").alias("enterprise_nature"), F.lit(None).cast("string").alias("ownership_status"), "industry")
    return targets.admitted(named).select(F.col("candidate").alias("s_suppkey"), F.col("ownership_confidence").alias("confidence"), F.col("ownership_evidence").alias("evidence"))


@R.add(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 1 THEN 'open' WHEN o_orderdate::DATE >= DATE '1996-06-01' THEN 'open' ELSE 'expired' END AS status FROM orders"""
)
def q_deadline_status(t):
    """Whether deadlines, in several formats, have passed on a day."""
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    value = F.when(F.col("o_orderkey") % 7 == 0, "/").when(F.col("o_orderkey") % 7 == 1, "尽快投递").otherwise(day)
    return t.orders.select("o_orderkey", T.deadline_status(value, F.lit("1996-06-01").cast("date")).alias("status"))


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_QUERY = "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid)(=|$)'))"


@R.add(
    f"""SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END
    || CASE WHEN len({_QUERY}) > 0 THEN '?' || array_to_string(list_transform({_QUERY}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') ELSE '' END
    || regexp_extract(url, '(#.+)$', 1) AS canonical FROM pages"""
)
def q_canonical_url(t):
    """Canonical URLs."""
    return t.pages.select("page_id", U.canonical(F.col("url")).alias("canonical"))


@R.add(f"SELECT page_id, 'exact:' || regexp_replace({_HOST}, '^www\\.', '') || lower(rtrim({_PATH}, '/')) || ',host:' || regexp_replace({_HOST}, '^www\\.', '') AS keys FROM pages")
def q_url_keys(t):
    """The keys of URLs."""
    return t.pages.select("page_id", F.array_join(U.keys(F.col("url")), ",").alias("keys"))


@R.add("SELECT page_id, regexp_matches(url, '(?i)(job|position|vacancy)(Id|_id|id)=') AS detail, 'web' AS pool FROM pages")
def q_url_routes(t):
    """Whether URLs have the shape of a job's page, and their pool."""
    return t.pages.select("page_id", U.is_detail(F.col("url")).alias("detail"), U.preferred(F.col("url"), F.lit("")).getField("pool").alias("pool"))


QUERIES, ORACLE_SQL = R.queries, R.sql
