"""Static topic pages: job records in their scripts, links to jobs, and where to go on, read within bounds over captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import urls as U
from ..functions.tables import JsonObjects
from ..session import materialise
from .payloads import as_text, kind, member


def _text(value: Column, names: tuple[str, ...]) -> Column:
    """The first member that is a text with letters, single blanks inside; empty where none is."""
    clean = lambda n: F.when(kind(member(value, n)) == "STRING", F.nullif(F.trim(F.regexp_replace(as_text(member(value, n)), "\\s+", " ")), F.lit("")))
    return F.coalesce(*(clean(n) for n in names), F.lit(""))


def records(sources: DataFrame, key: str, source: str, base: str) -> DataFrame:
    """(key, nth, id, title, url, category, education, location) of the job records that stand as JSON in sources.

    Objects without a title are left out; links are resolved against ``base`` and made canonical; a record without a link has an id of its
    title and location. Null sources have no records.
    """
    each = sources.select(F.col(key), F.col(source).alias("_source"), F.col(base).alias("_base")).lateralJoin(JsonObjects(F.col("_source").outer()))
    v = F.try_parse_json("object")
    told = each.select(
        key, "nth", _text(v, rules.STATIC_TITLES).alias("title"), U.canonical_static(F.nullif(_text(v, rules.STATIC_URLS), F.lit("")), F.col("_base")).alias("url"),
        *(_text(v, names).alias(n) for n, names in rules.STATIC_FIELDS.items()),
    ).where("title <> ''")
    own = F.concat(F.lit("static:"), "title", F.lit(":"), "location")
    return told.select(key, "nth", F.coalesce("url", own).alias("id"), "title", "url", *rules.STATIC_FIELDS)


def links(pages: DataFrame, page: str, href: str, label: str, is_script: str) -> DataFrame:
    """Add ``target`` (canonical), and what a page's link (page: its URL) leads to: job, script, page, or null."""
    target = U.canonical_static(F.col(href), F.col(page))
    told = pages.withColumn("target", target)
    parts, own = U.split(F.col("target")), U.host(F.col(page))
    same = U.host(F.col("target")) == own
    name = F.lower(F.regexp_extract(parts["path"], "([^/]*)$", 1))
    job = (F.coalesce(F.col(label), F.lit("")) != "") & (F.endswith(U.host(F.col("target")), F.lit(".zhiye.com")) | F.contains(F.lower(parts["query"]), F.lit("jobadid=")) | F.contains(F.lower(parts["path"]), F.lit("/detail")))
    script = same & F.endswith(name, F.lit(".js")) & name.rlike("|".join(rules.STATIC_SCRIPTS))
    more = same & parts["path"].rlike(r"(?i)(?:^|/)(?:index|job|position)[^/]*\.html?$")
    leads = F.when(F.col(is_script), F.when(script, "script")).when(job, "job").when(more, "page")
    return told.withColumn("leads_to", leads)


def frontier(roots: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(root, url, nth, depth) of the pages that are read from each root (root, its URL), breadth first, ``most`` for a root at most, and
    of the one that was next when the bound was met, with ``beyond`` true.

    ``edges`` has url, place and target: what a captured page leads to, in its order. A page is read once for a root; pages of a level
    go by the place of their parent, then of their link. A round is one join over the pages that were found last, and each level is
    stored; roots that have met their bound take no further part. There are at most ``most`` rounds.
    """
    level = materialise(roots.select("root", F.col("root").alias("url"), F.lit(1).cast("long").alias("nth"), F.lit(0).alias("depth")).distinct(), "frontier")
    seen, last, depth = level, level, 0
    while True:
        depth += 1
        open_ = last.where(F.col("nth") <= most)
        step = open_.join(edges, "url").where(F.col("target").isNotNull()).groupBy("root", F.col("target").alias("url")).agg(F.min(F.struct("nth", "place")).alias("_at"))
        fresh = step.join(seen.select("root", "url"), ["root", "url"], "left_anti")
        counts = seen.groupBy("root").agg(F.max("nth").alias("_before")).where(F.col("_before") <= most)
        placed = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("_at", "url")))
        # One more than the bound is kept, to tell that it was met.
        last = materialise(placed.join(counts, "root").select("root", "url", (F.col("_before") + F.col("_n")).alias("nth"), F.lit(depth).alias("depth")).where(F.col("nth") <= most + 1), "frontier")
        if last.isEmpty():
            return seen.withColumn("beyond", F.col("nth") > most)
        seen = seen.unionByName(last)


def stop_reasons(topics: DataFrame) -> DataFrame:
    """Add ``stop_reason`` and ``list_complete`` to topics (hit_pages, hit_jobs, hit_details, hit_handoffs, failed, jobs), by precedence."""
    reason = (
        F.when(F.col("hit_pages"), "max_pages")
        .when(F.col("hit_jobs"), "max_jobs")
        .when(F.col("hit_details"), "max_details")
        .when(F.col("hit_handoffs"), "max_zhiye_handoffs")
        .when(F.col("failed") > 0, "static_asset_error")
        .when(F.col("jobs") > 0, "static_topic_complete")
        .otherwise("job_records_not_found")
    )
    return topics.withColumn("stop_reason", reason).withColumn("list_complete", reason == "static_topic_complete")


def image_outcomes(sources: DataFrame, most: int, bytes_each: int, bytes_all: int) -> DataFrame:
    """Add ``status`` (ok, error, skipped) to the images (run, place, url, size) of runs within their bounds.

    Only a URL's first place counts; later ones have its outcome. An image is skipped if ``most`` were looked at or the bytes are used up;
    one that is larger than ``bytes_each`` or than what is left is an error and uses none; a null size is an error too.
    What a run holds in memory is its first ``most`` images.
    """
    firsts = sources.groupBy("run", "url").agg(F.min(F.struct("place", "size")).alias("_f")).select("run", "url", "_f.place", "_f.size")
    ranked = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy("place", "url")))
    few = ranked.where(F.col("_n") <= most).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("_n", "url", "size"))).alias("_images"))

    def step(state, x):
        left = F.lit(bytes_all).cast("long") - state["total"]
        fits = F.coalesce(x["size"].cast("long") <= F.least(F.lit(bytes_each).cast("long"), left), F.lit(False))
        status = F.when(left <= 0, "skipped").when(fits, "ok").otherwise("error")
        return F.struct((state["total"] + F.when((left > 0) & fits, x["size"].cast("long")).otherwise(F.lit(0).cast("long"))).alias("total"), F.concat(state["done"], F.array(F.struct(x["url"].alias("url"), status.alias("status")))).alias("done"))

    none = F.array().cast("array<struct<url:string,status:string>>")
    folded = F.aggregate("_images", F.struct(F.lit(0).cast("long").alias("total"), none.alias("done")), step)
    told = few.select("run", F.explode(folded["done"]).alias("_d")).select("run", "_d.url", "_d.status")
    return sources.join(told, ["run", "url"], "left").withColumn("status", F.coalesce("status", F.lit("skipped")))
