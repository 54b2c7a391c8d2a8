"""When a collected result counts as complete: whole lists, large partial lists, single jobs, and repairs of them.

Results are rows with ``status``, ``stop_reason``, ``list_complete``, ``jobs`` (an array of structs) and what each rule names.
Rules only ever add columns or replace ``status``; blocked, deleted and failed results keep theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import TERMINAL_STOPS

FAILED = ("blocked", "deleted", "error")
#: Stops at which pages are counted, not controls seen.
COUNTED_STOPS = ("last_page", "reported_last_page", "reported_total_reached")
#: Titled jobs from which a partial list is useful, and characters of a substantive job text or page.
SUBSTANTIAL, JOB_TEXT, PAGE_TEXT, FIELD_TEXT = 20, 40, 120, 10
#: Words of a page about jobs.
JOB_WORDS = ("招聘", "职位", "岗位", "任职要求", "job", "position", "career")


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def filled(value: Column) -> Column:
    return _yes(F.length(F.trim(value)) > 0)


def settled(status: Column) -> Column:
    """Whether the status is one that acceptance doesn't touch."""
    return _yes(status.isin(*FAILED))


def last_page_proven(pages: Column, jobs: Column, expected_total: Column, expected_pages: Column, pages_received: Column) -> Column:
    """Whether every page from 1 to the last reported one was accepted with its raw capture, and gave all reported jobs."""
    accepted = F.filter(pages, lambda p: _yes(p["accepted"]))
    numbers = F.transform(accepted, lambda p: p["actual_page"].cast("long"))
    run = F.sequence(F.lit(1).cast("long"), F.greatest(expected_pages, F.lit(1)).cast("long"))
    return _yes(
        (expected_total >= 0)
        & (expected_total == F.size(jobs))
        & (expected_pages >= 1)
        & (expected_pages == pages_received)
        & (F.size(pages) == pages_received)
        & (F.size(accepted) == pages_received)
        & F.forall(accepted, lambda p: filled(p["raw_ref"]))
        & (numbers == run)
    )


def artifact_refs(single: list[Column], lists: list[Column], evidence: Column, fields: list[str]) -> Column:
    """References to captures, in order of where they are told, without blanks and repeats."""
    told = F.flatten(F.transform(F.coalesce(evidence, F.array()), lambda e: F.array(*(e[f] for f in fields))))
    every = F.concat(F.array(*single), *(F.coalesce(x, F.array().cast("array<string>")) for x in lists), told)
    return F.array_distinct(F.filter(every, lambda x: _yes(x != "")))


def accept_complete_list(results: DataFrame) -> DataFrame:
    """Results (status, stop_reason, list_complete, jobs, pages, expected_total, expected_pages, pages_received, pages_seen, refs)
    with ``status`` ok where a complete list is proven, and ``evidence``, the kind of proof (null: none)."""
    c = F.col
    asked = _yes(c("list_complete")) & _yes(c("stop_reason").isin(*TERMINAL_STOPS)) & c("jobs").isNotNull()
    counted = last_page_proven(c("pages"), c("jobs"), c("expected_total"), c("expected_pages"), c("pages_received"))
    seen = _yes(c("pages_seen") >= 1) & _yes(F.size("refs") > 0)
    by_count = c("stop_reason").isin(*COUNTED_STOPS)
    kind = F.when(asked & by_count & counted, "reported_last_page").when(asked & ~by_count & seen, "disabled_or_absent_next_control")
    return results.withColumn("evidence", kind).withColumn("status", F.when(c("evidence").isNotNull() & ~settled(c("status")), "ok").otherwise(c("status")))


def accept_substantial_partial_list(results: DataFrame, least: int = SUBSTANTIAL) -> DataFrame:
    """Partial results with ``least`` titled jobs and a told stop become ok for the time being: ``accepted_jobs`` has their
    number (null: not accepted). The list stays incomplete."""
    titled = F.size(F.filter("jobs", lambda j: filled(j["title"])))
    take = _yes(F.col("status") == "partial") & F.col("jobs").isNotNull() & ~_yes(F.col("list_complete")) & (titled >= least) & filled(F.col("stop_reason"))
    return results.withColumn("accepted_jobs", F.when(take, titled.cast("long"))).withColumn("status", F.when(take, "ok").otherwise(F.col("status")))


def finish(text_chars: Column, jobs: Column, total: Column, open_details: Column, missing_images: Column, stop_reason: Column) -> Column:
    """Completeness of a crawl: (list_complete, complete). A list is complete at a terminal stop or when the reported total is there."""
    terminal = _yes(stop_reason.isin(*TERMINAL_STOPS)) | _yes(jobs >= total)
    return F.struct(terminal.alias("list_complete"), (terminal & (open_details == 0) & (missing_images == 0) & (text_chars > 0)).alias("complete"))


def single_job(status: Column, jobs: Column, identity: Column) -> Column:
    """(status, stop_reason) of a detail page: ok where its one job has a title, a substantive text and the page's identity."""
    job = F.try_element_at(jobs, F.lit(1))
    proven = (F.size(jobs) == 1) & filled(job["title"]) & _yes(F.length(F.trim(job["text"])) >= JOB_TEXT) & _yes(F.array_contains(job["ids"], identity))
    return F.when(settled(status), F.struct(status.alias("status"), F.lit(None).cast("string").alias("stop_reason"))).when(
        _yes(proven), F.struct(F.lit("ok").alias("status"), F.lit("single_job_complete").alias("stop_reason"))
    ).otherwise(F.struct(F.lit("partial").alias("status"), F.lit("single_job_evidence_incomplete").alias("stop_reason")))


def has_complete_text(job: Column) -> Column:
    """Whether a job tells both duties and requirements."""
    long = lambda x, n: _yes(F.length(F.trim(x)) >= n)
    return filled(job["title"]) & long(job["duty"], FIELD_TEXT) & long(job["requirement"], FIELD_TEXT) & long(job["text"], JOB_TEXT)


def finalize_public_list(results: DataFrame) -> DataFrame:
    """Results (jobs, total, items_seen) with what is complete of list and job texts, the stop reason, and the details to get.

    The status is that of the list; missing job texts are told, and don't make it partial.
    """
    lacking = F.filter("jobs", lambda j: ~has_complete_text(j))
    urls = F.array_distinct(F.filter(F.transform(lacking, lambda j: j["url"]), lambda u: _yes(u != "")))
    counted = F.coalesce(F.col("items_seen"), F.size("jobs"))
    listed = _yes(counted >= F.col("total"))
    texts = (F.size("jobs") > 0) & (F.size(F.col("detail_urls")) == 0)
    found = results.withColumns({"detail_urls": urls, "needs_details_count": F.size(lacking).cast("long"), "list_complete": listed})
    found = found.withColumn("jd_complete", texts)
    reason = (
        F.when(~F.col("list_complete"), "reported_total_mismatch")
        .when(~F.col("jd_complete"), "zhiye_public_api_list_complete_details_optional")
        .otherwise("zhiye_public_api_complete")
    )
    return found.withColumns({"stop_reason": reason, "status": F.when(F.col("list_complete"), "ok").otherwise("partial")})


def effective_content(status: Column, complete: Column, list_complete: Column, jobs: Column, link_kinds: Column, text: Column) -> Column:
    """Whether a static page was worth it: it is gone, complete, lists jobs, links to some, or speaks of them at length."""
    speaks = F.exists(F.array(*map(F.lit, JOB_WORDS)), lambda w: F.contains(F.lower(text), w))
    return (
        _yes(status.isin("blocked", "deleted"))
        | _yes(complete)
        | _yes(list_complete)
        | _yes(F.size(jobs) > 0)
        | _yes(F.exists(link_kinds, lambda k: k.isin("job", "detail")))
        | (_yes(F.length(F.trim(text)) >= PAGE_TEXT) & _yes(speaks))
    )


def contract_violations(status: Column, url: Column, jobs: Column, complete: Column, error_kind: Column) -> Column:
    """What a canonical result breaks, in order: its status, its address, jobs without identity, errors without a kind, and
    completeness claimed for what isn't ok."""
    named = [
        ("status", ~_yes(status.isin("ok", "partial", *FAILED))),
        ("url", ~_yes(url.rlike("^https?://[^/\\s]+"))),
        ("job_identity", _yes(F.exists(jobs, lambda j: ~filled(j["title"]) & ~filled(j["url"])))),
        ("error_kind", _yes(status == "error") & ~filled(error_kind)),
        ("complete", _yes(complete) & ~_yes(status == "ok")),
    ]
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in named)))


def failure_document(url: Column, reason: Column, message: Column) -> Column:
    """The canonical result of an attempt that failed."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit("error").alias("status"), url.alias("url"), F.lit("").alias("text"), none.alias("jobs"), none.alias("links"), F.lit(False).alias("complete"),
        reason.alias("stop_reason"), F.substring(message, 1, 400).alias("message"),
    )


def list_document(run: DataFrame) -> DataFrame:
    """List runs (list_complete, records, reasons, jobs) as canonical results: ok, partial or error, the details that jobs
    still need, and whether job texts are complete."""
    needing = F.filter("jobs", lambda j: _yes(j["needs_details"]))
    urls = F.array_distinct(F.filter(F.transform(needing, lambda j: j["url"]), lambda u: _yes(u != "")))
    status = F.when(_yes(F.col("list_complete")), "ok").when(F.col("records") > 0, "partial").otherwise("error")
    return run.withColumns({"status": status, "detail_urls": urls, "jd_complete": (F.col("records") > 0) & (F.size(needing) == 0)})


def repaired(category: Column, before: Column, after: Column) -> Column:
    """Whether a repair fixed what was wrong: structs of status, jobs, chars and list_complete before and after."""
    return _yes(
        F.when(category == "missing_jobs", (after["jobs"] > before["jobs"]))
        .when(category == "short_text", (after["chars"] >= JOB_TEXT * 2) & (after["chars"] > before["chars"]))
        .when(category == "incomplete_list", after["list_complete"] & ~before["list_complete"])
        .otherwise((after["status"] == "ok") & (before["status"] != "ok"))
    )


def metrics(status: Column, jobs: Column, text: Column, list_complete: Column, total: Column) -> Column:
    """The measures of a result that reports compare; ``offline_done`` says whether its jobs reach the reported total."""
    n = F.coalesce(F.size(jobs), F.lit(0)).cast("long")
    need = F.size(F.filter(jobs, lambda j: _yes(j["needs_details"]))).cast("long")
    return F.struct(
        F.coalesce(status, F.lit("missing")).alias("status"), n.alias("jobs"), need.alias("details"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"),
        _yes(list_complete).alias("list_complete"), _yes((total > 0) & (n >= total)).alias("offline_done"),
    )


def gaps_after_recovery(gaps: DataFrame, recovered: DataFrame, key: list[str]) -> DataFrame:
    """Image gaps (key, reason) that recovery (key, status, text) leaves: those with a recovered text go, those that failed
    again take the new reason."""
    found = recovered.select(*key, F.col("status").alias("_status"), F.col("text").alias("_text"), F.col("reason").alias("_why"))
    joined = gaps.join(found, key, "left")
    left = joined.where(~(_yes(F.col("_status") == "ok") & filled(F.col("_text"))))
    return left.withColumn("reason", F.coalesce("_why", "reason")).drop("_status", "_text", "_why")


def without_text(results: DataFrame, images_only: Column) -> DataFrame:
    """Results of which only images are wanted lose their text and say so."""
    return results.withColumn("text_skipped", images_only).withColumn("text", F.when(images_only, "").otherwise(F.col("text")))
