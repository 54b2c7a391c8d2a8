"""Audits of recovered jobs and how what they find is merged: classes, decisions, deltas across tasks, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rules import choose, first_match
from ..functions.text import clean, stable_id

#: The columns of a job that are read as one text.
JOB_TEXT = ("title", "description", "requirements", "location", "department", "text")


def job_text(*fields: Column) -> Column:
    """Fields of a job as one text with single spaces; blanks leave none."""
    return clean(F.concat_ws(" ", *fields))


def audit_class(text: Column) -> Column:
    """(priority, exclusion_code) of a job's text: affirmed vision 1, agents 2 and 3, else null, with a code where only image
    processing is told. Calling ready models isn't affirmed vision, unless own work on models is told too."""
    called = text.rlike(rules.IMAGE_INTEGRATION) & ~text.rlike(rules.MODEL_OWNERSHIP)
    affirmed = ~called & (text.rlike(rules.VISUAL_AFFIRMATIVE[0]) | text.rlike(rules.VISUAL_AFFIRMATIVE[1]))
    priority = choose([(F.lit(1), affirmed)], first_match(text, rules.AUDIT_AGENT)).cast("int")
    weak = text.rlike(rules.IMAGE_WEAK) | called
    return F.struct(priority.alias("priority"), F.when(priority.isNull() & weak, "image_processing_without_ai_evidence").otherwise("").alias("exclusion_code"))


def recruitment_type(url: Column, text: Column) -> Column:
    both = F.concat_ws(" ", url, text)
    return F.when(both.rlike(rules.CAMPUS), "校招/实习").when(both.rlike(rules.SOCIAL), "社招").otherwise("未明确")


def role_mentions_ai(title: Column, segment: Column) -> Column:
    """Whether a role speaks of AI: its title does, or a line of its segment that isn't mere copy about the company."""
    lines = F.split(F.coalesce(segment, F.lit("")), "\r\n|[\n\r]", -1)
    own = lambda x: x.rlike(rules.AI_MENTION) & (~x.rlike(rules.COMPANY_COPY) | x.rlike(rules.ROLE_COPY))
    return F.coalesce(title.rlike(rules.AI_MENTION), F.lit(False)) | F.exists(lines, own)


def decided(rows: DataFrame, table: list[tuple[Column, str, str]], otherwise: tuple[str, str], admitted: Column, eligible: Column) -> DataFrame:
    """Add admitted, exclusion_code and rationale by an ordered table of (condition, code, rationale); rows that are admitted
    but not eligible by place are not, and say so."""
    code = choose([(F.lit(c), when) for when, c, _ in table], F.lit(otherwise[0]))
    why = choose([(F.lit(r), when) for when, _, r in table], F.lit(otherwise[1]))
    hit = choose([(F.lit(True), when) for when, _, _ in table], F.lit(False))
    ok = admitted & ~hit
    return rows.withColumns(
        {
            "admitted": ok & eligible,
            "exclusion_code": F.when(ok & eligible, "").when(ok, "location_out_of_scope").otherwise(code),
            "rationale": F.when(ok & eligible, "").when(ok, "location").otherwise(why),
        }
    )


def role_decisions(company: Column, role: Column, gaps: Column, location: Column) -> Column:
    """(exclusion_code, rationale, location_eligible) of a role by the fixed table (rules.ROLE_TABLE): no role in it is admitted.

    Roles that are short of evidence say so when images have gaps (their number). Nulls are empty texts and no gaps.
    """
    name, who, n = F.coalesce(role, F.lit("")), F.coalesce(company, F.lit("")), F.coalesce(gaps.cast("long"), F.lit(0).cast("long"))
    fits = {"is": lambda x: name == x, "begins": lambda x: F.startswith(name, F.lit(x)), "contains": lambda x: F.contains(name, F.lit(x)), "company": lambda x: who == x, "": lambda x: F.lit(True)}
    more, before, after = rules.ROLE_GAPS
    rows = [(fits[how](text), code, why) for how, text, code, why in rules.ROLE_TABLE]
    found = choose([(F.struct(F.lit(code).alias("code"), F.lit(why).alias("why")), when) for when, code, why in rows])
    short = (found["code"] == "insufficient_target_evidence") & (n > 0)
    eligible = F.coalesce(location, F.lit("")).rlike("|".join(rules.ROLE_PLACES))
    return F.struct(
        F.when(short, more).otherwise(found["code"]).alias("exclusion_code"),
        F.when(short, F.concat(found["why"], F.lit(before), n.cast("string"), F.lit(after))).otherwise(found["why"]).alias("rationale"),
        eligible.alias("location_eligible"),
    )


def job_key(job_id: Column, url: Column, title: Column, text: Column) -> Column:
    """What makes a job the same across tasks: its id, else its URL, else title and text."""
    told = lambda x: F.nullif(F.trim(F.coalesce(x.cast("string"), F.lit(""))), F.lit(""))
    return F.coalesce(F.concat(F.lit("id:"), told(job_id)), F.concat(F.lit("url:"), told(url)), F.concat(F.lit("text:"), F.sha2(F.concat_ws("\x1f", title, text), 256)))


def global_delta(items: DataFrame, key: str, order: list[str], task: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, counts): of jobs with equal ``key`` the first in ``order`` stays; for each task, what it gave and what others
    had given before."""
    best = items.groupBy(key).agg(F.min_by(F.struct(*items.columns), F.struct(*order)).alias("_r"))
    survivors = best.select(*(F.col(f"_r.`{c}`").alias(c) for c in items.columns))
    given = items.groupBy(task).agg(F.count("*").alias("reported_added"))
    first = survivors.groupBy(task).agg(F.count("*").alias("_first")).withColumnRenamed(task, "_task")
    unique = F.coalesce("_first", F.lit(0))
    counts = given.join(first, F.col(task).eqNullSafe(F.col("_task")), "left").select(task, "reported_added", unique.alias("unique_contributed"), (F.col("reported_added") - unique).alias("cross_task_duplicates_removed"))
    return survivors, counts


def canonical_jobs(jobs: DataFrame, order: str) -> DataFrame:
    """Jobs (company, title, source_url, evidence_level, ...) with their id computed anew; of those alike the one with the best
    evidence stays, the first on a tie."""
    ranks = F.create_map(*(F.lit(x) for pair in rules.EVIDENCE_RANK.items() for x in pair))
    keyed = jobs.withColumn("jd_id", stable_id(F.col("company"), F.col("title"), F.col("source_url")))
    rest = [c for c in keyed.columns if c != "jd_id"]
    rank = F.struct(-F.coalesce(F.try_element_at(ranks, F.col("evidence_level")), F.lit(-1)), F.col(order))
    return keyed.groupBy("jd_id").agg(F.min_by(F.struct(*rest), rank).alias("_b")).select("jd_id", *(F.col(f"_b.{c}").alias(c) for c in rest))


def new_jobs(delta: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Delta jobs (jd_id, source_url, ...) whose id and URL aren't known yet, each id and each URL once."""
    fresh = delta.join(known.select("jd_id").distinct(), "jd_id", "left_anti")
    fresh = fresh.join(known.where("coalesce(source_url, '') <> ''").select("source_url").distinct(), "source_url", "left_anti")
    url = F.when(F.coalesce("source_url", F.lit("")) != "", F.col("source_url")).otherwise(F.col("jd_id"))
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    once = fresh.withColumn("_a", first(F.col("jd_id"))).where("_a").withColumn("_b", first(url)).where("_b")
    return once.select(*delta.columns)


def unmatched(items: DataFrame, master: DataFrame, key: list[str]) -> DataFrame:
    """Items that have no row in the master table; merging needs none."""
    return items.join(master.select(*key).distinct(), key, "left_anti")


def with_audit(master: DataFrame, audit: DataFrame, company: str, row: str, rows: str) -> DataFrame:
    """Master rows with the audit of their company that names their row, or no rows at all (``rows`` is an array).

    ``company`` has to tell companies apart: a company with many rows and many audits without rows has all pairs of them.
    """
    fits = (F.size(rows) == 0) | F.array_contains(rows, F.col(row))
    a = audit.withColumnRenamed(company, "_company")
    return master.join(a, (master[company] == a["_company"]) & fits).drop("_company")


def delta_violations(tasks: DataFrame) -> DataFrame:
    """Tasks (task, jobs array, before, after, added array) whose delta isn't the jobs after the first ``before`` ones."""
    begins = F.col("before").cast("int") + 1
    part = F.when(F.col("after") > F.col("before"), F.slice("jobs", begins, F.greatest(F.lit(0), F.col("after") - F.col("before")).cast("int"))).otherwise(F.slice("jobs", 1, 0))
    why = F.when(F.size("jobs") != F.col("after"), "count").when(~(part == F.col("added")), "slice")
    return tasks.select("task", why.alias("violation")).where("violation is not null")


def merged_row(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """New rows over what an existing row of the key already tells: blank fields are taken from it."""
    known = old.select(*key, *(F.col(f).alias(f"_old_{f}") for f in fields))
    joined = new.join(known, key, "left")
    return joined.select(*key, *(F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_old_{f}"), F.lit("")).alias(f) for f in fields))


def audit_summary(rows: DataFrame) -> DataFrame:
    """One row of counts over audited jobs (should_include, priority, broad_signal, exclusion_code, company)."""
    c, inc, role = F.col, F.col("should_include"), F.col("priority").isNotNull()
    return rows.agg(
        F.count("*").alias("unique_jobs"),
        F.count_if(inc).alias("included"),
        F.count_if(~inc).alias("excluded"),
        F.count_if(~inc & c("broad_signal")).alias("near_misses"),
        F.count_if(role).alias("role_matched"),
        F.count_if(role & ~inc).alias("location_excluded"),
        F.count_if(c("exclusion_code") == "image_processing_without_ai_evidence").alias("image_only"),
        F.count_distinct(F.when(inc, c("company"))).alias("companies"),
        *(F.count_if(inc & (c("priority") == p)).alias(f"priority_{p}") for p in (1, 2, 3)),
    )


def audit_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Included rows first, then by priority (blank last), company and title; ``ties`` tell equal ones apart."""
    return rows.orderBy(F.col("should_include").desc(), F.coalesce("priority", F.lit(99)), F.lower("company"), F.lower("title"), *ties)


def progress(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: how many cases recovered, were kept and got worse between two runs (key, status, jobs), and jobs won."""
    a, b = before.select(key, F.col("status").alias("_s"), F.col("jobs").alias("_j")), after.select(key, "status", "jobs")
    both = a.join(b, key)
    was, now = F.col("_s") == "ok", F.col("status") == "ok"
    return both.agg(
        F.count("*").alias("cases"), F.count_if(~was & now).alias("recovered"), F.count_if(was & now).alias("preserved"), F.count_if(was & ~now).alias("lost"),
        F.coalesce(F.sum(F.greatest(F.col("jobs") - F.col("_j"), F.lit(0))), F.lit(0)).alias("added_jobs"),
    )


def preferred_role(roles: DataFrame, key: str, order: str) -> DataFrame:
    """Of role candidates (key, order, title, segment, excerpt, matched) alike in key, the one that an ordered fold keeps.

    One with a matched job takes the place of one without; of two alike in that, a later one takes it if its segment is longer than
    the excerpt held, which is no maximum, so candidates are folded in their order. Candidates of a key are those of one page.
    """
    fields = ["matched", "segment_chars", "excerpt", "title"]
    rows = roles.withColumn("segment_chars", F.length("segment"))
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_all"))

    def step(held: Column, x: Column) -> Column:
        better = (x["matched"] & ~held["matched"]) | ((x["matched"] == held["matched"]) & (x["segment_chars"] > F.length(held["excerpt"])))
        return F.when(better, x).otherwise(held)

    found = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.col("_all")[0], step)
    return packed.select(key, found.alias("_f")).select(key, F.col("_f.title").alias("title"), F.col("_f.excerpt").alias("excerpt"), F.col("_f.matched").alias("matched"))
