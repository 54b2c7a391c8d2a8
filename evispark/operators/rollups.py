"""Aggregations of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import EVIDENCE_RANK


def zero_filled(df: DataFrame, column: str, domain: list, count: str = "n") -> DataFrame:
    """How many rows each value of a fixed domain has, 0 included."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} {df.schema[column].dataType.simpleString()}")
    counts = df.groupBy(column).agg(F.count("*").alias(count))
    return F.broadcast(values).join(counts, column, "left").withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))


def best_evidence(level: Column) -> Column:
    """The highest evidence level of a group."""
    rank = F.create_map(*(F.lit(x) for pair in EVIDENCE_RANK.items() for x in pair))
    return F.max_by(level, rank[level])


def company_rollup(jobs: DataFrame, key: list[str], priority: str, level: str) -> DataFrame:
    """Best priority, number of roles and highest evidence level of each company."""
    return jobs.groupBy(*key).agg(
        F.min(priority).alias("best_priority"), F.count("*").alias("matched_role_count"), best_evidence(F.col(level)).alias("evidence_level")
    )


def scope_rollup(df: DataFrame, scope: str, measures: dict[str, Column]) -> DataFrame:
    """The measures of each scope and, with a null scope, of all."""
    return df.rollup(scope).agg(*(m.alias(name) for name, m in measures.items()))


def clusters(df: DataFrame, key: list[str], order: str, example: str, examples: int = 3) -> DataFrame:
    """Size of each cluster and its first examples.

    Examples are first cut within salted parts of a cluster, so no task holds a large one.
    """
    first = Window.partitionBy(*key, "_salt").orderBy("_o", "_e")
    counts = df.groupBy(*key).agg(F.count("*").alias("n"))
    salted = df.select(*key, F.col(order).alias("_o"), F.col(example).alias("_e"), F.pmod(F.xxhash64(order, example), F.lit(64)).alias("_salt"))
    few = salted.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= examples)
    shown = few.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_e").alias("e")))), 1, examples).alias("_first"))
    joined = counts.join(shown, [counts[k].eqNullSafe(shown[k]) for k in key]).select(*(counts[k] for k in key), "n", "_first")
    return joined.select(*key, "n", F.array_join(F.transform("_first", lambda x: x["e"].cast("string")), ",").alias("examples"))


def reasons(df: DataFrame, text: str, pattern: str, default: str) -> DataFrame:
    """A histogram of what a pattern finds in a text."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)
    return df.groupBy(F.when(found == "", default).otherwise(found).alias("reason")).agg(F.count("*").alias("n"))


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values; ties go by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of their key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
