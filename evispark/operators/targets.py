"""Company and job target tables: roles from declarations, structured jobs and page text, ranked by evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..session import materialise
from .dedup import best_by, first_wins
from .rollups import company_rollup

#: Levels that leave a company unverified.
UNVERIFIED = ("csv_declared", "limited_source_ai_mention")


def admitted(candidates: DataFrame, industry_pattern: str = rules.INDUSTRY) -> DataFrame:
    """Candidates with a company, in the industry, whose owner isn't excluded; with the columns of ``ownership``."""
    own = T.ownership(F.col("enterprise_nature"), F.col("ownership_status"))
    text = F.concat_ws(" ", F.col("company"), F.col("industry"))
    shown = candidates.withColumn("_own", own).drop("ownership_status")
    kept = shown.where((T.clean(F.col("company")) != "") & text.rlike(industry_pattern) & (F.col("_own.confidence") != "high"))
    return kept.withColumns({"ownership_status": F.col("_own.status"), "ownership_confidence": F.col("_own.confidence"), "ownership_evidence": F.col("_own.evidence")}).drop("_own")


def declared_roles(candidates: DataFrame) -> DataFrame:
    """(candidate, priority, role, origin) from ``matched_roles``, JSON text; malformed JSON has none.

    The rules' priority counts; the declared one only for a role that wasn't taken apart and is no generic image title.
    """
    schema = "array<struct<priority:string,category:string,role:string>>"
    each = candidates.select("candidate", F.posexplode(F.from_json(F.coalesce("matched_roles", F.lit("[]")), schema)).alias("ord", "r"))
    parts = each.withColumn("_parts", T.expand_role(F.col("r.role"))).select("candidate", "ord", "r", F.size("_parts").alias("many"), F.posexplode("_parts").alias("sub", "role"))
    own = T.classify(F.col("role"))
    told = F.when((F.col("many") == 1) & ~F.col("role").rlike(rules.GENERIC_IMAGE_ROLE), F.expr("try_cast(r.priority as int)"))
    ranked = parts.withColumn("priority", F.coalesce(own, told)).where("priority between 1 and 4")
    return ranked.select("candidate", "priority", "role", F.lit("csv").alias("origin"), F.lit(0).alias("rank"), (F.col("ord") * 1000 + F.col("sub")).alias("at"))


def structured_roles(jobs: DataFrame) -> DataFrame:
    """The same from structured jobs (candidate, at, title, job_text)."""
    title = T.clean_title(F.col("title"))
    found = jobs.select("candidate", T.discovered_priority(title, T.clean(F.col("job_text"))).alias("priority"), title.alias("role"), "at")
    return found.where("priority is not null and role <> ''").select("candidate", "priority", "role", F.lit("structured_job").alias("origin"), F.lit(1).alias("rank"), "at")


def page_roles(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """The same from page lines (candidate, page_text), only where there are no structured jobs."""
    bare = pages.join(jobs.select("candidate").distinct(), "candidate", "left_anti")
    lines = bare.select("candidate", F.posexplode(F.split(F.coalesce("page_text", F.lit("")), "\n", -1)).alias("at", "_line")).withColumn("role", T.clean(F.col("_line")))
    noun = "(?iu)工程师|研究员|科学家|实习生|算法|开发|研发"
    kept = lines.where((F.length("role").between(1, 80)) & F.col("role").rlike(noun)).withColumn("priority", T.classify(F.col("role"))).where("priority is not null")
    return kept.select("candidate", "priority", "role", F.lit("page_text").alias("origin"), F.lit(2).alias("rank"), "at")


def evidence_level(limited: Column, audit: Column, matched: Column, role: Column, page_text: Column, origin: Column) -> Column:
    """How well a role is shown, the first that holds."""
    bare = lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), "(?U)\\s+", ""))
    on_page = F.contains(bare(page_text), bare(role)) | (origin == "page_text")
    return (
        F.when(F.coalesce(limited, F.lit("")) != "", "limited_source_ai_mention")
        .when(F.coalesce(audit, F.lit("")) != "", "audit_confirmed")
        .when(matched, "structured_job")
        .when(on_page, "page_text")
        .otherwise("csv_declared")
    )


def limited_kind(status: Column, host: Column, stop_reason: Column) -> Column:
    """The kind of a source that shows only part of its content; empty for others."""
    return F.when(status != "partial", "").otherwise(
        F.when(host == "mp.weixin.qq.com", "wechat")
        .when(host.isin("v.wjx.cn", "www.wjx.top"), "questionnaire")
        .when((host == "campus.51job.com") & (stop_reason == "static_topic_complete"), "static_topic")
        .when(host == "doc.weixin.qq.com", "wechat_form")
        .when(host == "alidocs.dingtalk.com", "dingtalk_form")
        .when(stop_reason == "static_document", "static_document")
        .otherwise("")
    )


def build(
    candidates: DataFrame, tasks: DataFrame, jobs: DataFrame, audits: DataFrame, industry_pattern: str = rules.INDUSTRY, screening_scope: str = ""
) -> dict[str, DataFrame]:
    """Companies and jobs, stamped with ``screening_scope`` where one is given.

    ``candidates``: candidate (a number, their order), company, enterprise_nature, ownership_status, industry,
    matched_roles, source_row. ``tasks``: candidate, status, host, stop_reason, page_text. ``jobs``: candidate, at, title,
    job_text, url. ``audits``: company, source_row (blank: any), evidence.
    Of rows with one company or job id the last candidate's counts.
    """
    kept = admitted(candidates, industry_pattern).join(tasks, "candidate", "left")
    exact = audits.select("company", "source_row", F.col("evidence").alias("_exact"))
    loose = audits.where("coalesce(source_row, '') = ''").select("company", F.col("evidence").alias("_loose"))
    kept = kept.join(exact, ["company", "source_row"], "left").join(loose, "company", "left")
    limited = limited_kind(F.coalesce("status", F.lit("")), F.coalesce("host", F.lit("")), F.coalesce("stop_reason", F.lit("")))
    # Stored, as roles are taken from it in three ways and it is joined to them again.
    kept = materialise(kept.withColumns({"limited": limited, "audit": F.coalesce("_exact", "_loose", F.lit(""))}).drop("_exact", "_loose"), "candidates")
    own = jobs.join(kept.select("candidate"), "candidate", "left_semi")
    every = declared_roles(kept).unionByName(structured_roles(own)).unionByName(page_roles(kept.select("candidate", "page_text"), own))
    key = F.lower("role")
    roles = first_wins(every.withColumn("_key", key), ["candidate", "priority", "_key"], [F.col("rank"), F.col("at")]).drop("_key")
    titled = own.withColumn("_title", F.lower(F.regexp_replace(T.clean_title(F.col("title")), "(?U)\\s+", "")))
    by_title = best_by(titled.where("_title <> ''"), ["candidate", "_title"], [F.col("at")], ["url"]).withColumnRenamed("url", "job_url")
    matched = roles.withColumn("_title", F.lower(F.regexp_replace("role", "(?U)\\s+", ""))).join(by_title.withColumn("_hit", F.lit(True)), ["candidate", "_title"], "left")
    shown = matched.join(kept, "candidate").withColumn(
        "evidence_level", evidence_level(F.col("limited"), F.col("audit"), F.coalesce("_hit", F.lit(False)), F.col("role"), F.col("page_text"), F.col("origin"))
    )
    ids = shown.withColumns(
        {
            "company_id": T.stable_id(F.col("company")),
            "jd_id": T.stable_id(F.col("company"), F.col("role"), F.coalesce("job_url", F.lit(""))),
            "details_verified": F.col("evidence_level").isin("structured_job", "audit_confirmed"),
        }
    )
    job_columns = ["company_id", "company", "priority", "role", "evidence_level", "details_verified", "source_row", "job_url"]
    job_rows = best_by(ids, ["jd_id"], [-F.col("candidate"), F.col("rank"), F.col("at")], job_columns)
    rolled = company_rollup(ids.groupBy("candidate", "company_id", "priority", F.lower("role").alias("_r")).agg(F.max_by("evidence_level", _rank("evidence_level")).alias("evidence_level")), ["candidate", "company_id"], "priority", "evidence_level")
    companies = kept.withColumn("company_id", T.stable_id(F.col("company"))).join(rolled, ["candidate", "company_id"], "left")
    columns = ["company", "ownership_status", "ownership_confidence", "industry", "best_priority", "matched_role_count", "evidence_level", "status", "source_row"]
    company_rows = best_by(companies, ["company_id"], [-F.col("candidate")], columns)
    company_rows = company_rows.withColumn("matched_role_count", F.coalesce("matched_role_count", F.lit(0).cast("long")))
    if screening_scope:
        company_rows, job_rows = (x.withColumn("screening_scope", F.lit(screening_scope)) for x in (company_rows, job_rows))
    return {"companies": company_rows, "jobs": job_rows}


def _rank(level: str) -> Column:
    return F.create_map(*(F.lit(x) for pair in rules.EVIDENCE_RANK.items() for x in pair))[F.col(level)]


def split(companies: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """applicable, verified, pending and error companies, and verified jobs; errors may be applicable too."""
    applicable = F.col("matched_role_count") > 0
    failed = F.col("status").isin("error", "blocked", "failed")
    verified = companies.where(applicable & ~F.col("evidence_level").isin(*UNVERIFIED))
    return {
        "applicable": companies.where(applicable),
        "verified": verified,
        "error": companies.where(F.coalesce(failed, F.lit(False))),
        "pending": companies.where(~applicable & ~F.coalesce(failed, F.lit(False))),
        "verified_jobs": jobs.where(~F.col("evidence_level").isin(*UNVERIFIED)).join(verified.select("company_id"), "company_id", "left_semi"),
    }


def merge_scopes(frames: dict[str, DataFrame], key: str, order: list[str]) -> DataFrame:
    """Rows of several scopes, each stamped with its own; of rows of one scope and id the fullest stays, the first by
    ``order`` on a tie. A blank id fails."""
    from .dedup import fullest

    every = None
    for scope, rows in frames.items():
        if not scope.strip():
            raise ValueError("a scope needs a name")
        stamped = rows.withColumn("screening_scope", F.lit(scope))
        every = stamped if every is None else every.unionByName(stamped, allowMissingColumns=True)
    checked = every.withColumn(key, F.when(F.coalesce(F.trim(key), F.lit("")) == "", F.raise_error(F.lit(f"a row has no {key}"))).otherwise(F.col(key)))
    return fullest(checked, ["screening_scope", key], [F.col(c) for c in order])


def target_summary(companies: DataFrame, jobs: DataFrame, unverified: tuple = UNVERIFIED) -> DataFrame:
    """(measure, value, n): totals, and jobs by evidence level and priority with 0 where there are none, companies by status."""
    applicable = F.col("matched_role_count") > 0
    failed = F.coalesce(F.col("status").isin("error", "blocked", "failed"), F.lit(False))
    shown = ~F.col("evidence_level").isin(*unverified)
    total = lambda df, counts: df.agg(*(c.alias(n) for n, c in counts.items())).unpivot([], list(counts), "value", "n").select(F.lit("total").alias("measure"), "value", "n")
    by_company = {"analyzed": F.count("*"), "applicable": F.count_if(applicable), "verified": F.count_if(applicable & shown), "pending": F.count_if(~applicable & ~failed), "error": F.count_if(failed)}
    by_job = {"jobs": F.count("*"), "verified_details": F.count_if("details_verified")}

    def by(df: DataFrame, measure: str, column, domain: list) -> DataFrame:
        counts = {str(v): F.count_if(column == v) for v in domain}
        return total(df, counts).withColumn("measure", F.lit(measure))

    out = total(companies, by_company).unionByName(total(jobs, by_job))
    out = out.unionByName(by(jobs, "evidence_level", F.col("evidence_level"), list(rules.EVIDENCE_RANK))).unionByName(by(jobs, "priority", F.col("priority"), list(rules.PRIORITY_LABELS)))
    status = companies.groupBy(F.coalesce("status", F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    return out.unionByName(status.select(F.lit("fetch_status").alias("measure"), "value", "n"))
