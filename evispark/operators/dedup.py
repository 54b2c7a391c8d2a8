"""Which row survives: every rule takes an explicit order, so that reruns and other partitionings agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _nth(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return _nth(df, key, order).where("_nth = 1").drop("_nth")


def best_by(df: DataFrame, key: list[str], rank: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The row of each key that is least by ``rank``, by partial aggregation instead of a sort.

    ``rank`` must tell all rows of a key apart, or they must be alike in ``columns``.
    """
    rest = [c for c in (columns or df.columns) if c not in key]
    packed = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("_best"))
    return packed.select(*key, *(F.col(f"_best.{c}").alias(c) for c in rest))


def last_wins(df: DataFrame, key: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The last row of each key, by partial aggregation."""
    rest = [c for c in (columns or df.columns) if c not in key]
    packed = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return packed.select(*key, *(F.col(f"_best.{c}").alias(c) for c in rest))


def precedence(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of frames where, for each key, the row of the earliest frame counts."""
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    every = ranked[0]
    for f in ranked[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (*key, "_rank")]
    return best_by(every, key, [F.col("_rank"), *map(F.col, rest)], rest)


def repeated(df: DataFrame, key: list[str], order: list[Column], flag: str = "is_repeat") -> DataFrame:
    """Mark, not remove, the later rows of a key."""
    return _nth(df, key, order).withColumn(flag, F.col("_nth") > 1).drop("_nth")


def fullest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the most filled fields, the first by ``order`` (ascending) on a tie."""
    filled = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in df.columns if c not in key), F.lit(0))
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(-filled, *order)).alias("_r"))
    return best.select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest)).select(*df.columns)


def overlay(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows with the new ones' non-empty values over them, and the rows that only one side has."""
    fields = [c for c in old.columns if c not in key]
    fresh = new.select(*key, *(F.col(c).alias(f"_new_{c}") for c in fields if c in new.columns))
    joined = old.join(fresh, key, "full_outer")
    return joined.select(
        *key,
        *(
            (F.coalesce(F.when(F.col(f"_new_{c}").cast("string") != "", F.col(f"_new_{c}")), F.col(c)) if c in new.columns else F.col(c)).alias(c)
            for c in fields
        ),
    )


def merge_records(df: DataFrame, key: list[str], order: str, identity: list[str], lists: list[str]) -> DataFrame:
    """Rows alike in ``key`` merged, their ``lists`` joined in order; rows whose ``identity`` is all blank never merge."""
    blank = F.lit(True)
    for c in identity:
        blank = blank & (F.coalesce(F.trim(c), F.lit("")) == "")
    alone = F.when(blank, F.col(order)).otherwise(F.lit(None))
    packed = df.withColumn("_alone", alone).groupBy(*key, "_alone").agg(
        F.min(order).alias(order), F.array_sort(F.collect_list(F.struct(order, *lists))).alias("_all")
    )
    return packed.select(*key, order, *(F.array_distinct(F.flatten(F.col("_all").getField(c))).alias(c) for c in lists))


def without_repeated_lines(docs: DataFrame, text: str, key: list[str], least: int = 20) -> DataFrame:
    """Each text without lines of ``least`` characters or more that it had before, and how many went.

    Lines are compared within their own text only, without a shuffle: they are sorted with their places, those after an equal
    one are marked, and the rest is put back in order, so a text of n lines takes in the order of n log n steps.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    short = lambda x: F.length(F.trim(x["line"])) < least
    first = lambda x, i: (i == 0) | (x["line"] != F.try_element_at(F.col("_sorted"), F.greatest(i, F.lit(1)))["line"])
    sorted_lines = docs.withColumn("_lines", lines).withColumn("_sorted", F.array_sort(F.filter("_lines", lambda x: ~short(x))))
    whole = F.size(F.array_distinct(F.transform("_sorted", lambda x: x["line"]))) == F.size("_sorted")
    firsts = sorted_lines.withColumn("_whole", whole).withColumn("_first", F.when(~F.col("_whole"), F.filter("_sorted", first)))
    by_place = lambda rows: F.array_sort(F.transform(rows, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    kept = F.when(F.col("_whole"), by_place(F.col("_lines"))).otherwise(by_place(F.concat(F.filter("_lines", short), F.col("_first"))))
    out = firsts.withColumn("_kept", kept)
    return out.select(
        *key,
        F.array_join(F.transform("_kept", lambda x: x["line"]), "\n").alias("text"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("dropped_lines"),
    )
