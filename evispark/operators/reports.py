"""Reports over stored results: what could be replayed, batches, stages before and after, evidence lines, and jobs by their link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

#: The hosts and routes whose saved results can be read again, and statuses that count as unfinished.
DETAIL_HOST, DETAIL_ROUTES, LEGACY_HOST, LEGACY_ROUTE = ".zhiye.com", ("/detail", "/jobdetails"), "app.mokahr.com", "/campus_apply/"
UNFINISHED = ("partial", "error", "blocked")
#: Why items are deferred in a stage for other adapters, by a part of their URL.
DEFERRED_TOPIC, DEFERRED_OTHER = ("campus.51job.com", "adapter_not_implemented_in_stage"), "deferred_unstable_or_single_site"


def replay_counts(results: DataFrame) -> DataFrame:
    """One row: unfinished results (url, status, html, text, json_artifacts) of detail pages and of one platform, and what of them is stored.

    ``html`` says whether the page is stored, ``text`` is its text, ``json_artifacts`` the number of stored responses. Nulls are nothing.
    """
    path = F.lower(U.part(F.col("url"), 3))
    open_ = results.where(F.col("status").isin(*UNFINISHED))
    detail = F.endswith(U.host(F.col("url")), F.lit(DETAIL_HOST)) & path.rlike("|".join(DETAIL_ROUTES))
    legacy = U.host(F.col("url")) == LEGACY_HOST
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return open_.agg(
        count(detail).alias("detail_records"), count(detail & F.col("html")).alias("detail_html"), count(detail & (F.col("text") != "")).alias("detail_texts"),
        count(legacy).alias("legacy_records"), count(legacy & F.contains(U.part(F.col("url"), 3), F.lit(LEGACY_ROUTE))).alias("legacy_routes"),
        F.coalesce(F.sum(F.when(legacy, F.col("json_artifacts"))), F.lit(0)).cast("long").alias("legacy_artifacts"),
    )


def batch_counts(rows: DataFrame, tasks: DataFrame, batch: str) -> DataFrame:
    """(batch, ok, partial, deferred, error, detail_urls): the rows of each batch by what became of their task, and their details.

    ``rows`` has url; ``tasks`` url, status and details (number). Rows without a task, and tasks that wait or run, are deferred.
    """
    joined = rows.join(tasks.select(F.col("url").alias("_url"), "status", "details"), F.col("url") == F.col("_url"), "left")
    s = F.col("status")
    bucket = F.when(s == "ok", "ok").when(s.isin("partial", "pending_ocr"), "partial").when(s.isNull() | s.isin("pending", "running"), "deferred").otherwise("error")
    return joined.groupBy(batch).agg(*(F.count_if(bucket == b).alias(b) for b in ("ok", "partial", "deferred", "error")), F.coalesce(F.sum("details"), F.lit(0)).cast("long").alias("detail_urls"))


def deferred_reason(url: Column) -> Column:
    """Why an item isn't for the adapters of a stage."""
    return F.when(F.contains(url, F.lit(DEFERRED_TOPIC[0])), DEFERRED_TOPIC[1]).otherwise(DEFERRED_OTHER)


def stage_outcomes(items: DataFrame, before: DataFrame, after: DataFrame, adapters: list[str], quality: list[str]) -> DataFrame:
    """What a stage did to unfinished items (task_id, url, adapter): outcome, reason, jobs before and after, and whether the earlier result stays.

    Items of other adapters are ``blocked`` with a reason. ``before`` and ``after`` have task_id, jobs and the columns of ``quality``, compared in
    order: a worse new result is dropped for the earlier one. More jobs are ``fixed``, else ``unchanged``.
    """
    old = before.select("task_id", F.col("jobs").alias("_old"), F.struct(*quality).alias("_old_quality"))
    new = after.select("task_id", F.col("jobs").alias("_new"), F.struct(*quality).alias("_new_quality"))
    joined = items.join(old, "task_id", "left").join(new, "task_id", "left")
    ours = F.col("adapter").isin(*adapters)
    had = F.coalesce("_old", F.lit(0))
    kept = F.col("_new_quality").isNull() | F.coalesce(F.col("_new_quality") < F.col("_old_quality"), F.lit(False))
    got = F.when(kept, had).otherwise(F.coalesce("_new", F.lit(0)))
    return joined.select(
        "task_id", "adapter", F.when(~ours, "blocked").when(got > had, "fixed").otherwise("unchanged").alias("outcome"), F.when(~ours, deferred_reason(F.col("url"))).otherwise("").alias("reason"),
        F.when(ours, had).alias("before_jobs"), F.when(ours, got).alias("after_jobs"), F.when(ours, F.greatest(got - had, F.lit(0))).alias("added_jobs"), (ours & kept).alias("preserved_prior"),
    )


def audit_evidence(row: dict[str, Column]) -> Column:
    """One line of evidence for a row of an audit; what is null is blank."""
    names = {"task_id": "task_id", "rationale": "review_rationale", "root_cause": "root_cause", "evidence": "evidence", "source": "source_url"}
    return F.concat_ws("; ", F.lit("review_category=B"), *(F.concat(F.lit(f"{label}="), F.coalesce(row[field].cast("string"), F.lit(""))) for label, field in names.items()))


def jobs_by_url(results: DataFrame, order: str) -> DataFrame:
    """(url, task, title): of all jobs (array of title and url) of results, the last with each link, by ``order`` and place; jobs without a link are left out."""
    each = results.select(order, F.posexplode("jobs").alias("_at", "_job")).select(order, "_at", U.trimmed(F.coalesce("_job.url", F.lit(""))).alias("url"), F.col("_job.title").alias("title")).where("url <> ''")
    return each.groupBy("url").agg(F.max_by(F.struct(F.col(order).alias("task"), "title"), F.struct(order, "_at")).alias("_l")).select("url", "_l.task", "_l.title")


def claimed_articles(articles: DataFrame, n: int) -> DataFrame:
    """The first n pending articles by position, then id, with their attempt counted."""
    return articles.where("status = 'pending'").orderBy("position", "id").limit(n).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def seeds(links: DataFrame, results: DataFrame) -> DataFrame:
    """Links (url) whose task has a result that is sound (``sound``) and finished or waits for images only."""
    good = results.where(F.col("sound") & F.col("status").isin("ok", "partial", "pending_ocr")).select("task_id").distinct()
    return links.where(F.trim("url") != "").join(good, U.task_id(F.col("url")) == F.col("task_id"), "left_semi")


def vendor_jobs(records: DataFrame, site: str, host: str) -> DataFrame:
    """Jobs from a vendor's records (jobId, jobName, companyName, jobCompanyName, jobAreas, eHireJobId in either spelling, and ``site``, its number): id, title, company,
    location and the URL of its page; records without an id or a title are invalid and have ``valid`` false."""
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names), F.lit(""))
    part = lambda name, x: F.concat(F.lit(f"{name}="), F.url_encode(x))
    query = F.concat_ws("&", part("ctmid", F.col(site).cast("string")), part("_jobId", F.col("jobId")), part("jobid", some("eHireJobId")))
    valid = (some("jobId") != "") & (F.trim(some("jobName")) != "")
    return records.select(
        F.col("jobId").alias("id"), F.trim("jobName").alias("title"), F.trim(some("companyName", "jobCompanyName")).alias("company"), F.trim(some("jobAreas")).alias("location"),
        F.when(valid, F.concat(F.lit(f"https://{host}/consumer/pc/home/job?"), query)).alias("url"), valid.alias("valid"),
    )


def longest_snapshot(snapshots: DataFrame, key: str, least: int = 80) -> DataFrame:
    """(key, place, title, text): of a page's snapshots (place, status, title, text) that aren't blocked, deleted or errors the one with the longest text, the first on a
    tie; pages whose longest text is shorter than ``least`` have no row."""
    good = snapshots.where(~F.coalesce("status", F.lit("")).isin("blocked", "deleted", "error"))
    size = F.char_length(F.coalesce("text", F.lit("")))
    best = good.groupBy(key).agg(F.min_by(F.struct("place", "title", "text"), F.struct(-size, F.col("place"))).alias("_b"))
    return best.select(key, "_b.*").where(F.char_length(F.trim("text")) >= least)


