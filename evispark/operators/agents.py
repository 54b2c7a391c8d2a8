"""Records for review agents, one for each job or jobless document, and batches that state what their records share once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import CHUNK, CONTEXT

#: The fields of a job that say what it is, and those that make two records the same.
JOB_FIELDS = ("title", "location", "department", "company", "requirements", "description", "text")


def _limited(values: dict) -> tuple:
    """(column of each text cut to what the fields before it left of CHUNK characters, truncated fields, original and included characters)."""
    left, shown, whole = F.lit(CHUNK), {}, []
    for name, text in values.items():
        text = F.coalesce(text, F.lit(""))
        most = F.least(left, F.lit(CONTEXT)) if name == "document_context" else left
        shown[name] = F.substr(text, F.lit(1), most)
        left = left - F.least(F.char_length(text), most)
        whole.append((name, text))
    cut = F.array_compact(F.array(*(F.when(F.char_length(t) > F.char_length(shown[n]), F.lit(n)) for n, t in whole)))
    original = sum((F.char_length(t) for _, t in whole), F.lit(0))
    return shown, cut, original, F.lit(CHUNK) - left


def agent_records(packets: DataFrame, jobs: DataFrame) -> DataFrame:
    """task_id, record_id, kind, title, url, texts (map), field_aliases (map), truncated_fields, original_chars, included_chars and evidence_ids.

    ``packets`` has task_id, title, compact_text, document_context and evidence_ids (array); ``jobs`` task_id, nth, id, raw_job_id, url, JOB_FIELDS
    and evidence_ids (array). A task's jobs that are alike in identity, URL and all fields give one record, the first's; jobs
    without any id or URL are never alike. A job text that repeats its requirements or description is an alias of it.
    A task without jobs gives a record of its document. Texts share CHUNK characters in order, a document's context CONTEXT of
    them; what is cut is named. Nulls are empty texts; jobs of unknown tasks and repeated packets are left out.
    """
    c = F.col
    blank = lambda x: F.coalesce(x.cast("string"), F.lit("")) == ""
    anonymous = blank(c("raw_job_id")) & blank(c("url")) & blank(c("id"))
    own = F.coalesce(c("raw_job_id").cast("string"), F.nullif(F.coalesce("url", F.lit("")), F.lit("")), c("id").cast("string"))
    fields = F.to_json(F.struct(*(F.coalesce(f, F.lit("")).alias(f) for f in sorted(JOB_FIELDS))))
    identity = F.when(blank(own), F.concat(fields, F.when(anonymous, F.concat(F.lit(":anonymous:"), c("nth").cast("string"))).otherwise(""))).otherwise(own)
    digest = F.substring(F.sha2(F.to_json(F.struct(identity.alias("identity"), F.coalesce("url", F.lit("")).alias("url"), fields.alias("fields"))), 256), 1, 24)
    rest = ["title", "url", "requirements", "description", "text", "evidence_ids"]
    first = jobs.groupBy("task_id", digest.alias("_digest")).agg(F.min_by(F.struct(*rest), "nth").alias("_j")).select("task_id", "_digest", *(F.col(f"_j.{f}").alias(f) for f in rest))
    known = packets.groupBy("task_id").agg(F.min(F.struct("title", "compact_text", "document_context", "evidence_ids")).alias("_p"))
    texts = lambda shown: F.map_from_arrays(F.array(*map(F.lit, shown)), F.array(*shown.values()))

    joined = first.join(known, "task_id")
    alias = F.when(blank(c("text")), None).when(c("text") == F.coalesce("requirements", F.lit("")), "requirements").when(c("text") == F.coalesce("description", F.lit("")), "description")
    shown, cut, original, included = _limited({"requirements": c("requirements"), "description": c("description"), "text": F.when(alias.isNull(), c("text")), "document_context": c("_p.document_context")})
    kept = F.map_filter(texts(shown), lambda k, v: alias.isNull() | (k != "text"))
    none = F.create_map().cast("map<string,string>")
    of_jobs = joined.select(
        "task_id", F.concat("task_id", F.lit(":job:"), "_digest").alias("record_id"), F.lit("job").alias("kind"), "title", "url", kept.alias("texts"),
        F.when(alias.isNull(), none).otherwise(F.create_map(F.lit("text"), alias)).alias("field_aliases"), cut.alias("truncated_fields"), original.alias("original_chars"), included.alias("included_chars"), "evidence_ids",
    )
    shown, cut, original, included = _limited({"compact_text": c("_p.compact_text")})
    of_documents = known.join(jobs.select("task_id").distinct(), "task_id", "left_anti").select(
        "task_id", F.concat("task_id", F.lit(":document")).alias("record_id"), F.lit("document").alias("kind"), c("_p.title").alias("title"), F.lit(None).cast("string").alias("url"), texts(shown).alias("texts"),
        none.alias("field_aliases"), cut.alias("truncated_fields"), original.alias("original_chars"), included.alias("included_chars"), c("_p.evidence_ids").alias("evidence_ids"),
    )
    return of_jobs.unionByName(of_documents)


def fold(records: DataFrame, batch: str, record: str, shared: list[str]) -> tuple[DataFrame, DataFrame]:
    """(contexts, residuals): what all records of a batch share, and each record without it; ``unfold`` gives the records back.

    ``record`` is a map from field to value. Of the fields named in ``shared`` those that all records of a batch have, with equal
    values (nulls are equal), make its context (batch, context); other columns of the records stay. Counts and extremes
    of values are combined before the shuffle, so a batch may have any number of records, and they aren't brought together.
    Batches may be null; a batch without shared fields has an empty context.
    """
    size = records.groupBy(batch).agg(F.count("*").alias("_n"))
    some = F.map_filter(F.coalesce(F.col(record), F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*shared))
    each = records.select(batch, F.explode(some).alias("_k", "_v"))
    by_field = each.groupBy(batch, "_k").agg(F.count("*").alias("_c"), F.count("_v").alias("_told"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    alike = by_field.where(F.col("_low").eqNullSafe(F.col("_high")) & F.col("_told").isin(0, F.col("_c")))
    told = alike.groupBy(batch, "_c").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", F.col("_low").alias("_v"))))).alias("_m"))
    context = size.join(told.withColumnRenamed(batch, "_b"), F.col(batch).eqNullSafe(F.col("_b")) & (F.col("_c") == F.col("_n")), "left")
    contexts = context.select(batch, F.coalesce("_m", F.create_map().cast("map<string,string>")).alias("context"))
    known = contexts.select(F.col(batch).alias("_b"), F.map_keys("context").alias("_gone"))
    joined = records.join(known, F.col(batch).eqNullSafe(F.col("_b")))
    own = F.map_filter(F.col(record), lambda k, v: ~F.array_contains(F.col("_gone"), k))
    return contexts, joined.select(*(own.alias(c) if c == record else F.col(c) for c in records.columns))


def unfold(contexts: DataFrame, residuals: DataFrame, batch: str, record: str) -> DataFrame:
    """The records that ``fold`` was given, but that a null map comes back as its batch's context."""
    known = contexts.select(F.col(batch).alias("_b"), "context")
    whole = F.map_concat("context", F.coalesce(F.col(record), F.create_map().cast("map<string,string>")))
    return residuals.join(known, F.col(batch).eqNullSafe(F.col("_b"))).select(*(whole.alias(c) if c == record else F.col(c) for c in residuals.columns))
