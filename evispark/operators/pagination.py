"""Whether captured pages of a list prove that it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REASONS = (
    "repeated_page", "duplicate_item_ids", "collected_count_exceeds_total", "nonempty_zero_total_pages", "last_page_total_pages_mismatch", "empty_page_before_last",
    "total_reached_before_last_page", "total_reached_without_last_marker", "max_pages_reached", "total_count_mismatch",
)
#: Checks of a page that end a run as an error, in their order.
ERRORS = ("actual_page_mismatch", "total_changed", "total_pages_changed", "page_exceeds_total_pages")
#: Optional columns of pages: what the page says of itself, and errors that its reader met before, or after, the page's numbers.
OPTIONAL = {"actual": "long", "error": "string", "late_error": "string"}


def proof(items: DataFrame, pages: DataFrame, max_pages: int = 1000) -> DataFrame:
    """One row for each run: pages used, distinct items collected, total, the terminal that was seen, the reasons against, and
    whether the list is complete.

    ``pages`` has run, page, total, total_pages and last (boolean), and may have ``actual``, ``error`` and ``late_error`` (see
    OPTIONAL); ``items`` has run, page and item, the items' identities. Nulls say nothing. Pages are read in their order, and
    reading ends with the first that ends the list or speaks against it; those after it don't count. An erroneous page's items
    aren't collected. A page is repeated if any before it has the same items. A list is complete if a terminal
    was seen and there is no reason against. Runs without pages have no row.
    """
    c = F.col
    order = Window.partitionBy("run").orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One shuffle of items: the first row of an item is new; what a page holds is summed up before the next shuffle.
    marked = items.select("run", "page", "item").withColumn("_new", F.row_number().over(Window.partitionBy("run", "item").orderBy("page")) == 1)
    contents = marked.groupBy("run", "page").agg(F.count("*").alias("n"), F.count_if("_new").alias("new"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("content"))
    told = pages.select("run", "page", "total", "total_pages", "last", *(c(n) if n in pages.columns else F.lit(None).cast(t).alias(n) for n, t in OPTIONAL.items()))
    seen = told.join(contents, ["run", "page"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "new": F.coalesce("new", F.lit(0))})
    seen = seen.withColumns(
        {
            "ordinal": F.row_number().over(order),
            "count": F.sum("new").over(upto),
            "known_total": F.last("total", ignorenulls=True).over(before),
            "known_pages": F.last("total_pages", ignorenulls=True).over(before),
            "repeated": (c("n") > 0) & (F.row_number().over(Window.partitionBy("run", "n", "content").orderBy("page")) > 1),
        }
    )
    checks = (c("actual") != c("page"), c("total") != c("known_total"), c("total_pages") != c("known_pages"), c("total_pages").isNotNull() & (c("ordinal") > F.greatest(F.lit(1), c("total_pages"))))
    early = F.coalesce("error", *(F.when(x, F.lit(n)) for x, n in zip(checks[:2], ERRORS[:2], strict=True)))
    error = F.coalesce(early, *(F.when(x, F.lit(n)) for x, n in zip(checks[2:], ERRORS[2:], strict=True)), c("late_error"))
    total, of = F.coalesce(F.when(early.isNull(), c("total")), c("known_total")), F.coalesce("total_pages", "known_pages")
    seen = seen.withColumns({"error": error, "total": total, "of": of, "empty": c("n") == 0, "last_said": c("last").isNotNull(), "last": F.coalesce("last", F.lit(False))})
    end = F.coalesce((c("ordinal") == c("of")) | (c("of") == 0), F.lit(False))
    duplicate = c("repeated") | (c("new") < c("n"))
    over = F.coalesce(c("count") > c("total"), F.lit(False))
    torn = c("of").isNotNull() & ((c("last") & ~end) | (end & c("last_said") & ~c("last")))
    ended = c("empty") | c("last") | end
    reached = F.coalesce(c("count") == c("total"), F.lit(False))
    # What a page does to its run, in the order in which it is looked at.
    outcome = (
        F.when(c("error").isNotNull(), "error").when(duplicate, "duplicate").when(over, "over").when(torn, "torn").when(ended & c("empty"), "empty_page").when(ended, "last_page").when(reached, "response_total_reached")
    )
    seen = seen.withColumns({"outcome": outcome, "end": end})
    o = c("outcome")
    holds = {
        "repeated_page": (o == "duplicate") & c("repeated"),
        "duplicate_item_ids": (o == "duplicate") & (c("new") < c("n")),
        "collected_count_exceeds_total": o == "over",
        "nonempty_zero_total_pages": o.isin("torn", "last_page") & (c("of") == 0) & ~c("empty"),
        "last_page_total_pages_mismatch": o == "torn",
        "empty_page_before_last": (o == "empty_page") & (c("ordinal") < c("of")),
        "total_reached_before_last_page": (o == "response_total_reached") & c("of").isNotNull() & ~c("end"),
        "total_reached_without_last_marker": (o == "response_total_reached") & c("last_said") & ~c("last"),
    }
    against = F.concat(F.array_compact(F.array(*(F.when(F.coalesce(holds[r], F.lit(False)), r) for r in REASONS if r in holds))), F.when(c("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>")))
    collected = F.when(c("error").isNotNull(), c("count") - c("new")).otherwise(c("count"))
    state = F.struct("ordinal", collected.alias("collected"), "total", F.when(o.isin("empty_page", "last_page", "response_total_reached"), o).otherwise("none").alias("terminal"), against.alias("against"))
    by_run = seen.groupBy("run").agg(F.min_by(state, F.when(o.isNotNull(), c("ordinal"))).alias("stop"), F.max_by(state, "ordinal").alias("open"))
    run = by_run.select("run", F.coalesce("stop", "open").alias("s"), c("stop").isNull().alias("went_on"))
    more = F.concat(
        c("s.against"),
        F.when(c("went_on") & (c("s.ordinal") >= max_pages), F.array(F.lit("max_pages_reached"))).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce(c("s.collected") != c("s.total"), F.lit(False)), F.array(F.lit("total_count_mismatch"))).otherwise(F.array().cast("array<string>")),
    )
    return run.select(
        "run",
        c("s.ordinal").cast("long").alias("pages_seen"),
        c("s.collected").alias("collected"),
        c("s.total").alias("total"),
        c("s.terminal").alias("terminal"),
        F.array_join(more, ",").alias("reasons"),
        ((c("s.terminal") != "none") & (F.size(more) == 0)).alias("list_complete"),
    )


def stable_snapshots(snapshots: DataFrame) -> DataFrame:
    """Whether the last two snapshots (run, snapshot, item) of a run have the same items and the union of all has no more."""
    snapshots = snapshots.select("run", "snapshot", "item").distinct()
    sets = snapshots.groupBy("run", "snapshot").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("h"))
    order = Window.partitionBy("run").orderBy(F.desc("snapshot"))
    last = sets.withColumns({"nth": F.row_number().over(order), "n2": F.lead("n").over(order), "h2": F.lead("h").over(order)}).where("nth = 1")
    every = snapshots.groupBy("run").agg(F.countDistinct("item").alias("all_items"))
    return last.join(every, "run").select("run", ((F.col("n") == F.col("n2")) & (F.col("h") == F.col("h2")) & (F.col("n") == F.col("all_items"))).alias("stable"))
