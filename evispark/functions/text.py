"""Text columns: cleaning, identity, classification, scores, excerpts and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .rules import any_term, choose, count_terms, first_match

UNIT = "\x1f"
ROLE_SPLIT = "[,，、;；\n]+"


def clean(value: Column) -> Column:
    """White space of any kind collapsed to single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "(?U)\\s+", " "))


def stable_id(*parts: Column) -> Column:
    """24 hex digits that depend on the parts but for case and white space (lower case, not full case folding)."""
    return F.substring(F.sha2(F.lower(F.concat_ws(UNIT, *map(clean, parts))), 256), 1, 24)


def coarse_tags(text: Column) -> Column:
    """The coarse terms that a text has, and ``ai`` where it stands alone."""
    low = F.lower(text)
    found = F.filter(F.array(*map(F.lit, rules.COARSE_TERMS)), lambda t: F.contains(low, t))
    return F.when(low.rlike("(?<![a-z])ai(?![a-z])"), F.concat(found, F.array(F.lit("ai")))).otherwise(found)


def coarse_priority(text: Column) -> Column:
    return F.size(coarse_tags(text)) * 10


def classify(title: Column) -> Column:
    """Priority 3, 2 or 1 by the target rules, in this order; null where none holds."""
    return first_match(title, rules.TARGET_ROLES).cast("int")


def selected_roles(text: Column) -> Column:
    """Distinct (priority, role) of a role list by the selection rules, sorted."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ROLE_SPLIT, -1), lambda x: F.trim(x)), lambda x: x != "")
    matched = F.transform(parts, lambda x: F.struct(first_match(x, rules.SELECTION_ROLES).cast("int").alias("priority"), x.alias("role")))
    return F.array_sort(F.array_distinct(F.filter(matched, lambda x: x["priority"].isNotNull())))


def clean_title(value: Column) -> Column:
    """A job title without what follows markers of date, employment list or section, and without trailing repeats."""
    title = clean(value)
    for pattern in (
        "(?s)\\s+发布于\\s+.*$",
        "(?s)\\s+(?:(?:实习|全职|兼职|校招)\\s+){1,3}\\|\\s*.*$",
        "(?s)\\s+(?:团队介绍|岗位职责|职位职责|职位描述|任职要求)\\s*[：:].*$",
        "(?:\\s+(?:实习|全职|兼职|校招)){2,}$",
    ):
        title = F.regexp_replace(title, pattern, "")
    return F.trim(title)


def expand_role(role: Column) -> Column:
    """The titles in a declared role: lists are split, blobs of categories dropped, dense cells and slashes taken apart."""
    parts = F.filter(F.transform(F.split(F.coalesce(role, F.lit("")), ROLE_SPLIT, -1), clean), lambda x: x != "")
    parts = F.filter(parts, lambda x: ~((F.regexp_count(x, F.lit("类")) >= 3) & classify(x).isNull()))

    def titles(part: Column) -> Column:
        dense = F.regexp_extract_all(part, F.lit("[^\\s,/，、;；]{1,32}(?:工程师|研究员|科学家|实习生|算法类)"), F.lit(0))
        several = (F.size(dense) > 1) | ((F.size(dense) == 1) & (F.try_element_at(dense, F.lit(1)) != part))
        slashed = F.filter(F.split(part, "/", -1), lambda x: classify(x).isNotNull())
        return (
            F.when(several & F.exists(dense, lambda x: classify(x).isNotNull()), dense)
            .when(F.contains(part, F.lit("/")) & ~part.rlike("[（(].*/.*[）)]"), F.transform(slashed, clean))
            .otherwise(F.array(part))
        )

    return F.flatten(F.transform(parts, titles))


def discovered_priority(title: Column, job_text: Column) -> Column:
    """A structured job's priority: by title; generic image titles need evidence, generic engineers take the text's."""
    own = classify(title)
    return choose(
        [
            (own, own.isNotNull()),
            (F.when(job_text.rlike(rules.GENERIC_IMAGE_EVIDENCE), 1), title.rlike(rules.GENERIC_IMAGE_ROLE)),
            (classify(job_text), title.rlike(rules.GENERIC_ENGINEER)),
        ]
    ).cast("int")


def ownership(nature: Column, supplied: Column) -> Column:
    """Status, confidence and evidence of who owns a company."""
    n, s = clean(nature), clean(supplied)
    soe = n.rlike(rules.EXPLICIT_SOE) | (s.rlike(rules.SUPPLIED_SOE) & ~F.contains(s, F.lit("非国企")))
    told = n.isin("民企", "外企")
    evidence = F.concat(
        F.lit("企业性质="), F.when(n == "", "未注明").otherwise(n), F.lit("; 预筛判断="), F.when(s == "", "未提供").otherwise(s)
    )
    return F.struct(
        F.when(soe, "明确国企（排除）").when(told, "非国企（CSV标注）").otherwise("未发现国企标记，待核验").alias("status"),
        F.when(soe, "high").when(told, "medium").otherwise("low").alias("confidence"),
        evidence.alias("evidence"),
    )


def score(text: Column, role: Column, link: Column) -> Column:
    """A posting's keyword score."""
    role, link = F.coalesce(role, F.lit("")), F.coalesce(link, F.lit(""))
    strong = any_term(role, rules.STRONG_TERMS)
    noise = F.exists(F.array(*map(F.lit, rules.NOISE_TERMS)), lambda t: F.contains(role, t))
    return (
        count_terms(text, rules.SCORE_TERMS)
        + 3 * count_terms(text, rules.STRONG_TERMS)
        + F.when(strong, 4).otherwise(0)
        - F.when(noise & ~strong, 2).otherwise(0)
        + F.when((F.trim(link) != "") & ~F.contains(link, F.lit("mp.weixin.qq.com")), 1).otherwise(0)
    )


def bucket(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    return (
        F.when(any_term(role, ("agent", "大模型", "多模态", "llm")), "A-Agent/大模型")
        .when(any_term(role, ("计算机视觉", "机器视觉", "视觉算法", "图像算法", "slam", "感知算法")), "A-CV/视觉")
        .when(any_term(role, ("算法工程师", "算法研究", "ai算法", "机器学习", "深度学习")), "B-算法")
        .otherwise("C-泛AI")
    )


def deadline_status(value: Column, as_of: Column) -> Column:
    """open, expired or unknown on a given day."""
    text = F.trim(F.coalesce(value, F.lit("")))
    day = F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(text, 1, 10), "yyyy/MM/dd"))
    return (
        F.when((text == "") | (text == "/"), "unknown")
        .when(F.contains(text, F.lit("尽快")) | F.contains(text, F.lit("持续")), "open")
        .when(day >= as_of, "open")
        .when(day < as_of, "expired")
        .otherwise("unknown")
    )


def signals(text: Column, pattern: str) -> Column:
    """Distinct matches, lower-cased and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)))


def window(text: Column, pattern: str, before: int, after: int, most: int | None = None) -> Column:
    """The first match with what stands around it, cleaned; null where there is none."""
    at = F.regexp_instr(text, F.lit(pattern))
    begin = F.greatest(F.lit(1), at - before)
    end = at + F.length(F.regexp_substr(text, F.lit(pattern))) + after
    found = clean(F.substr(text, begin, end - begin))
    return F.when(at > 0, F.substring(found, 1, most) if most else found)


def display_title(value: Column) -> Column:
    """A title whose suffix is told twice, with it once."""
    return F.regexp_replace(clean(value), "^(.+?)\\s+(.{2,100})\\s+\\2$", "$1 $2")


def locations(text: Column, pattern: str) -> Column:
    """Distinct matches, without those that only begin a longer one."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.filter(found, lambda x: ~F.exists(found, lambda y: (y != x) & F.startswith(y, x)))


def placeholder(value: Column) -> Column:
    """Whether a field tells nothing."""
    bare = F.lower(clean(value))
    return bare.isin("", "-", "--", "/", "n/a", "na", "none", "null", "nan", "unknown", "tbd", "暂无", "无", "不详", "详见", "待定")


def looks_garbled(value: Column) -> Column:
    """Whether a text has the marks of a wrong decoding."""
    marks = F.exists(F.array(*map(F.lit, rules.MOJIBAKE)), lambda m: F.contains(value, m))
    return F.coalesce(marks | value.rlike("[\\x{80}-\\x{9f}]"), F.lit(False))


def company_tokens(value: Column) -> Column:
    """The names by which a company may be known: parts and aliases, lower-cased, without marks and legal suffixes."""
    aliases = F.regexp_extract_all(value, F.lit("[（(]([^）)]*)[）)]"), F.lit(1))
    rest = F.regexp_replace(value, "[（(][^）)]*[）)]", "")
    parts = F.concat(F.split(rest, "[、·•,，/／;；|&＆+＋]+", -1), aliases)

    def bare(x: Column) -> Column:
        token = F.regexp_replace(F.lower(x), "[^0-9a-z\\x{4e00}-\\x{9fff}]+", "")
        # All suffixes at the end are taken off, while two characters stay.
        return F.regexp_replace(token, f"^(..+?)(?:{'|'.join(rules.COMPANY_SUFFIXES)})+$", "$1")

    return F.array_distinct(F.filter(F.transform(parts, bare), lambda x: F.length(x) >= 2))


def chunks(text: Column, size: int = 6000) -> Column:
    """The text in pieces of ``size`` characters; none for an empty one."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substr(text, at + 1, F.lit(size)))


def limited(fields: dict[str, Column], budget: int) -> dict[str, Column]:
    """Fields cut so that together, in order, they stay within a budget of characters."""
    out, used = {}, F.lit(0)
    for name, value in fields.items():
        value = F.coalesce(value, F.lit(""))
        out[name] = F.substr(value, F.lit(1), F.greatest(F.lit(0), F.lit(budget) - used))
        used = used + F.length(value)
    return out
