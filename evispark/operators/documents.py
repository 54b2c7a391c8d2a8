"""Documents: cleaning with provenance, quality reasons, evidence chunks and review packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T

INSUFFICIENT, CHUNK, CONTEXT = 80, 6000, 512


def evidence_chunks(docs: DataFrame, key: str, text: str, kind: str, size: int = CHUNK) -> DataFrame:
    """(key, chunk, chunk_id, kind, text): each text in pieces of ``size`` characters."""
    each = docs.select(key, F.posexplode(T.chunks(F.coalesce(text, F.lit("")), size)).alias("chunk", "text"))
    return each.select(key, "chunk", F.concat_ws(":", F.lit(kind), F.col(key).cast("string"), F.col("chunk").cast("string")).alias("chunk_id"), F.lit(kind).alias("kind"), "text")


def signal_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct signals of each kind, lower-cased, sorted and joined."""
    return docs.select(key, *(F.array_join(T.signals(F.coalesce(text, F.lit("")), p), ",").alias(name) for name, p in rules.SIGNALS.items()))


def limited_fields(docs: DataFrame, key: str, fields: list[str], budget: int = CHUNK) -> DataFrame:
    """Fields cut to a shared budget in order, and the names of those that were cut."""
    cut = T.limited({f: F.col(f) for f in fields}, budget)
    truncated = F.array_join(F.array_compact(F.array(*(F.when(F.length(F.coalesce(F.col(f), F.lit(""))) > F.length(cut[f]), f) for f in fields))), ",")
    return docs.select(key, *(v.alias(f) for f, v in cut.items()), truncated.alias("truncated"))


def combined_text(text: Column, ocr: Column) -> Column:
    """A text and its recognised lines, blanks dropped."""
    return F.array_join(F.filter(F.concat(F.array(text), ocr), lambda x: F.coalesce(x, F.lit("")) != ""), "\n")


def preprocess(docs: DataFrame) -> DataFrame:
    """Derived view of documents (doc, html_text, html_certain, text, ocr array<string>, coverage_complete, unresolved, status).

    Reliable page text takes the place of the plain text; recognised lines are added where the text lacks them. Repeated
    lines go. ``reasons`` says, in order, why a document needs another look.
    """
    c = F.col
    html = F.coalesce("html_text", F.lit(""))
    reliable = (F.length(html) >= INSUFFICIENT) & F.coalesce("html_certain", F.lit(False))
    body = F.when(reliable, html).when(F.coalesce("text", F.lit("")) != "", c("text")).otherwise(html)
    lacking = F.filter(F.coalesce("ocr", F.array().cast("array<string>")), lambda x: ~F.contains(c("_body"), x))
    based = docs.withColumn("_body", body).withColumn("_whole", combined_text(c("_body"), lacking))
    from .dedup import without_repeated_lines

    keep = ["doc", "status", "coverage_complete", "unresolved", "html_text", "html_certain", "_body"]
    deduped = without_repeated_lines(based.select(*keep, "_whole"), "_whole", keep)
    reason = [
        ("insufficient_body", F.length("text") < INSUFFICIENT),
        ("article_extraction_fallback", (html != "") & ~reliable),
        ("source_text_retained_due_fallback", (html != "") & ~reliable & (c("_body") != html)),
        ("missing_or_placeholder_job_details", c("text").rlike(rules.PLACEHOLDER)),
        ("coverage_unconfirmed", ~c("coverage_complete").eqNullSafe(F.lit(True))),
        ("unresolved_evidence", F.coalesce("unresolved", F.lit(0)) > 0),
        ("acquisition_needs_confirmation", F.coalesce(c("status"), F.lit("")) != "ok"),
    ]
    reasons = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in reason))), ",")
    return deduped.select("doc", "status", "text", "dropped_lines", reasons.alias("reasons"), *(F.array_join(T.signals(c("text"), p), ",").alias(n) for n, p in rules.SIGNALS.items()))


def packets(tasks: DataFrame, children: DataFrame, found_urls: DataFrame) -> DataFrame:
    """Export coverage of tasks (task_id, status, complete): children (task_id, child_url, status) that aren't ok and
    discovered urls (task_id, url) without a child are unresolved, and nothing unresolved is complete."""
    open_children = children.where("status <> 'ok'").groupBy("task_id").agg(F.count("*").alias("open_children"))
    missing = found_urls.distinct().join(children.select("task_id", F.col("child_url").alias("url")), ["task_id", "url"], "left_anti").groupBy("task_id").agg(F.count("*").alias("missing"))
    joined = tasks.join(open_children, "task_id", "left").join(missing, "task_id", "left")
    unresolved = F.coalesce("open_children", F.lit(0)) + F.coalesce("missing", F.lit(0))
    return joined.select("task_id", "status", unresolved.cast("long").alias("unresolved"), (F.coalesce("complete", F.lit(False)) & (unresolved == 0) & (F.col("status") == "ok")).alias("complete"))


def shared_context(records: DataFrame, batch: str, fields: list[str]) -> DataFrame:
    """For each batch, the fields that all its records share, with their value; null where they differ."""
    same = lambda f: F.when(F.min(F.col(f)).eqNullSafe(F.max(F.col(f))) & (F.count(f).isin(0) | (F.count(f) == F.count("*"))), F.min(F.col(f)))
    return records.groupBy(batch).agg(*(same(f).alias(f) for f in fields), F.count("*").alias("records"))


def segments(lines: DataFrame, group: str, order: str, anchor: Column, text: str) -> DataFrame:
    """Lines joined from each anchor to the next; lines before a group's first anchor have segment 0."""
    by = Window.partitionBy(group).orderBy(order)
    numbered = lines.withColumn("segment", F.sum(F.when(anchor, 1).otherwise(0)).over(by))
    packed = numbered.groupBy(group, "segment").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_l"), F.count("*").alias("lines"))
    return packed.select(group, "segment", "lines", F.array_join(F.transform("_l", lambda x: x[text]), "\n").alias("text"))
