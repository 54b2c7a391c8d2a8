"""A corpus from raw documents to packed sequences, in stages that are each written as Parquet and reread.

Toxic documents and those that fail the quality rules go, one document of each group of near duplicates stays, sources
are mixed to their target weights in training order, and what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import jaccard, mixing, packing, quality, toxicity
from evispark.llm.common import WORD, documents
from evispark.session import materialise, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; the model is fitted on the labelled ones among ``docs``."""
    prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, [*COLUMNS]).where("not toxic").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    return quality.apply_policy(quality.ledger(docs, COLUMNS)).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest doc_id, null last; texts without words stay.

    Rows are told apart by a hash of doc_id and text, so a doc_id on several texts takes none of them away, and copies without
    a doc_id go like others. Of rows alike in both, one stays.
    """
    prepare(spark)
    key = F.xxhash64("doc_id", "text", F.lit(23))
    found = jaccard.near_duplicates(docs.select(key.alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("_key"), "component_id")
    named = docs.select(key.alias("_key"), "doc_id").distinct()
    rows = materialise(found.join(named, "_key"), "groups")
    best = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).getField("_key").alias("_key"))
    gone = rows.select("_key").join(best.select("_key"), "_key", "left_anti").distinct()
    kept = docs.withColumn("_key", key).join(gone, "_key", "left_anti")
    # Rows alike pass unshuffled where there are none.
    repeated = materialise(docs.select(key.alias("_key"), "text").where(F.col("text").rlike(WORD)).groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "repeated")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.join(repeated, "_key", "left_anti").unionByName(once).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Readings in training order: a document that is taken twice is there twice, one taken in part is cut."""
    placed = mixing.curriculum(docs.select(*COLUMNS))
    read = mixing.training_order(placed, ["doc_id", "text", "lang", "source"])
    return read.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every reading with its sequence and place."""
    prepare(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("packing", pack),
]

#: A fitted model and a tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
