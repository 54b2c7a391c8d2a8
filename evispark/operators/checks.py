"""Consistency reports, comparisons of runs, and integrity of stored evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(violations: dict[str, DataFrame]) -> DataFrame:
    """One row for each check with the number of violations and whether it passed."""
    rows = None
    for name, frame in violations.items():
        counted = frame.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))
        rows = counted if rows is None else rows.unionByName(counted)
    return rows


def summary_mismatches(summary: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """(name, told, found): entries of a summary (name, told) that don't say how many rows their output has, or that are missing."""
    counted = None
    for name, frame in outputs.items():
        one = frame.agg(F.count("*").alias("found")).select(F.lit(name).alias("name"), "found")
        counted = one if counted is None else counted.unionByName(one)
    return counted.join(summary.select("name", "told"), "name", "left").where(~F.col("told").eqNullSafe(F.col("found"))).select("name", "told", "found")


def repeated_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that several rows of one or more outputs have."""
    every = frames[0].select(key)
    for frame in frames[1:]:
        every = every.unionByName(frame.select(key))
    return every.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def below_baseline(outputs: dict[str, DataFrame], baseline: dict[str, int]) -> DataFrame:
    """(name, found, least): outputs with fewer rows than they had at least."""
    rows = None
    for name, least in baseline.items():
        one = outputs[name].agg(F.count("*").alias("found")).select(F.lit(name).alias("name"), "found", F.lit(least).cast("long").alias("least"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.where("found < least")


def target_consistency(outputs: dict[str, DataFrame], summary: DataFrame, tasks: DataFrame, baseline: dict[str, int]) -> DataFrame:
    """The report over target outputs (companies, pending, errors with company_id; jobs with jd_id), as ``report``.

    The summary (name, told) matches the files, each company is in one output once, each job once, every company of ``tasks`` is
    pending or an error, and no output has fewer rows than ``baseline``.
    """
    left_over = outputs["pending"].select("company_id").unionByName(outputs["errors"].select("company_id"))
    return report(
        {
            "summary_matches_files": summary_mismatches(summary, outputs),
            "company_outputs_deduplicated": repeated_keys([outputs[n] for n in ("companies", "pending", "errors")], "company_id"),
            "job_outputs_deduplicated": repeated_keys([outputs["jobs"]], "jd_id"),
            "task_companies_pending_or_error": subset_violations(tasks, left_over, ["company_id"]),
            "baseline_preserved": below_baseline(outputs, baseline),
        }
    )


def delta(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Ids that only one of two runs has, and which."""
    a, b = new.select(key).distinct(), old.select(key).distinct()
    return a.subtract(b).select(key, F.lit("added").alias("change")).unionByName(b.subtract(a).select(key, F.lit("removed").alias("change")))


def better(after: DataFrame, before: DataFrame, key: str, quality: list[str]) -> DataFrame:
    """For each key, the row of the better quality by the columns in order; the earlier one on a tie."""
    a = after.select(key, F.struct(*quality).alias("_q"), F.lit(0).alias("_first"), F.lit("after").alias("kept"), *quality)
    b = before.select(key, F.struct(*quality).alias("_q"), F.lit(1).alias("_first"), F.lit("before").alias("kept"), *quality)
    both = a.unionByName(b)
    return both.groupBy(key).agg(F.max_by(F.struct("kept", *quality), F.struct("_q", "_first")).alias("_b")).select(key, "_b.*")


def subset_violations(part: DataFrame, whole: DataFrame, key: list[str]) -> DataFrame:
    return part.join(whole.select(*key).distinct(), key, "left_anti")


def damaged_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected files (name, size, sha256) that are absent or differ from the stored ones (name, content)."""
    stored = files.select("name", F.length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_hash"))
    joined = expected.join(stored, "name", "left")
    why = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("_hash") != F.col("sha256"), "hash")
    return joined.select("name", why.alias("problem")).where("problem is not null")


def root_cause(status: Column, stop_reason: Column, jobs: Column, chars: Column, host: Column) -> Column:
    """Why a result is only partial, the first that holds."""
    return (
        F.when(status.isin("deleted"), "source_deleted")
        .when(status.isin("blocked"), "access_challenge")
        .when(status.isin("error"), "acquisition_error")
        .when(stop_reason == "max_pages_reached", "page_limit")
        .when((jobs == 0) & (chars == 0), "empty_document")
        .when((jobs == 0) & (host == "mp.weixin.qq.com"), "article_without_jobs")
        .when(jobs == 0, "no_structured_jobs")
        .when(chars < 80, "short_body")
        .otherwise("coverage_unconfirmed")
    )
