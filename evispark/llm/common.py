"""Helpers that several operators share: word patterns, range buckets and distributed running sums."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def give_back() -> None:
    """Return what this Python process' allocators hold unused to the system; workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library is another one
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def long_array(values: list[int]) -> Column:
    """A literal array that stays one constant in the plan, however long it is."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def quantiles(df: DataFrame, column: str, buckets: int) -> list[int]:
    """The smallest and largest of a long column and its quantiles, ascending, ``buckets`` + 1 values; none of an all-null one."""
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.agg(
        F.min(column), F.max(column), F.percentile_approx(column, probabilities or [0.5], max(10_000, 10 * buckets))
    ).first()
    return [] if found[0] is None else sorted([found[0], *found[2], found[1]])


def quantile_edges(df: DataFrame, column: str, buckets: int) -> list[int]:
    """Ascending values of a long column, the smallest and largest among them, that cut it into about equal counts."""
    return sorted(set(quantiles(df, column, buckets)))


def quantile_cuts(df: DataFrame, column: str, buckets: int) -> tuple[list[int], dict[int, int]]:
    """(edges, hot): ``quantile_edges``, and the values that fill more than a bucket, with the buckets that each is worth.

    A hot value has an edge of its own and one after it, so its bucket has no other value.
    """
    values = quantiles(df, column, buckets)
    hot = {x: n for x, n in Counter(values[1:-1]).items() if n > 1}
    return sorted({*values, *(x + 1 for x in hot if x < values[-1])}), hot


def part_of(value: Column, tie: Column, hot: dict[int, int]) -> Column:
    """0, but for rows of a hot value one of as many parts as it is worth, by a hash of ``tie``."""
    if not hot:
        return F.lit(0).cast("long")
    keys = sorted(hot)
    at = F.array_position(long_array(keys), value).cast("int")
    parts = F.when(at > 0, F.try_element_at(long_array([hot[k] for k in keys]), F.greatest(at, F.lit(1)))).otherwise(F.lit(1))
    return F.pmod(F.xxhash64(tie, F.lit(13)), parts)


def bucket_of(value: Column, edges: list[int]) -> Column:
    """How many of the ascending ``edges`` are at most ``value``, by binary search within one expression."""
    if not edges:
        return F.lit(0)
    table = long_array(edges)
    steps = [1 << i for i in reversed(range(len(edges).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.try_element_at(table, at + step) <= value, at + step).otherwise(at),
    )


def bucket_count(rows: int, per_bucket: int, most: int = 1 << 16) -> int:
    """A power of two of buckets that hold about ``per_bucket`` rows each, up to ``most`` buckets."""
    return min(most, 1 << max(0, math.ceil(math.log2(max(1, rows / per_bucket)))))


def running_start(df: DataFrame, group: list[str], bucket: str, order: list[Column], amounts: dict[str, str]) -> DataFrame:
    """Add to each row the sums over the rows before it in its group, ordered by bucket and ``order``.

    ``amounts`` maps new columns to the summed ones. Sums by bucket are taken first, so no task ever holds a group,
    only a bucket, and one narrow row for each bucket of a group.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(*(F.sum(c).alias(f"_sum_{new}") for new, c in amounts.items()))
    starts = sums.select(
        *(F.col(k).alias(f"_key_{k}") for k in keys),
        *(F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_base_{new}") for new in amounts),
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumns({f"_in_{new}": F.coalesce(F.sum(c).over(within), F.lit(0)) for new, c in amounts.items()})
    joined = inner.join(starts, [inner[k].eqNullSafe(starts[f"_key_{k}"]) for k in keys])
    return joined.withColumns({new: F.col(f"_in_{new}") + F.col(f"_base_{new}") for new in amounts}).drop(
        *(f"_key_{k}" for k in keys), *(f"_base_{new}" for new in amounts), *(f"_in_{new}" for new in amounts)
    )
