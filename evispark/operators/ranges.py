"""Running values in an order, of groups of any size: rows are dealt to sorted ranges, so no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, highest: dict[str, Column] | None = None) -> DataFrame:
    """Add the sums and maxima of columns over a group's rows up to each row, itself included.

    Rows are dealt by group and order to ranges and stored; what the ranges before give is taken from one row for each group
    and range. Rows that are alike in group and order share a range, so ``order`` should tell rows apart. Null groups are one.
    """
    sums, highest = sums or {}, highest or {}
    values = {**sums, **highest}
    dealt = df.withColumns({f"_v_{n}": c for n, c in values.items()}).repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    how = {n: F.sum if n in sums else F.max for n in values}
    parts = dealt.groupBy(*group, "_range").agg(*(how[n](f"_v_{n}").alias(f"_p_{n}") for n in values))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_range").alias("_r"), *(how[n](f"_p_{n}").over(before).alias(f"_b_{n}") for n in values))
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = dealt.withColumns({f"_w_{n}": how[n](f"_v_{n}").over(within) for n in values})
    fits = F.col("_range") == F.col("_r")
    for g in group:
        fits = fits & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = inner.join(starts, fits)
    whole = {n: F.col(f"_w_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) if n in sums else F.greatest(f"_w_{n}", f"_b_{n}") for n in values}
    return joined.select(*df.columns, *(c.alias(n) for n, c in whole.items()))


def positions(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Add each row's place in its group, from 1."""
    return running(df, group, order, {name: F.lit(1).cast("long")})
