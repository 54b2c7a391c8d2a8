"""Mixing sources to target weights as a time-varying curriculum. DataFrame functions only.

Every source has a weight schedule over training time 0..1, a straight line whose integral is the source's target. A
source's cumulative demand is the schedule's integral; inverted, it gives the time at which a word of the source's stream
is due. Documents are range-sorted by the position in the whole mix that belongs to that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, bucket_count, running_start

WEIGHTS = (5, 2, 1)
#: How far a source's rate leans to the end (above 0) or the beginning (below 0) of training, in turn by source.
SLOPES = (-0.5, 0.0, 0.5)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target and slope for each row (source, source_size) of ``sizes``.

    Sources in order of code points, null last, weigh 5, 2, 1 in turn and share ``share`` times all sizes. No target
    exceeds ``most`` times its source's size; what is above is shared among the rest by weight until none is above.
    The result is min(cap, level * weight) for one level: sources are taken by cap per weight, and the level is what
    remains for those above over their weights. There is one row for each source here, not for each document, and one task
    sorts these; it holds for tens of millions of sources.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS)))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), turn.cast("int") + 1)
    weighed = sizes.select("source", "source_size", pick(WEIGHTS).cast("double").alias("weight"), pick(SLOPES).alias("slope"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    demand = F.sum("source_size").over(every) * F.lit(float(share))
    level = (demand - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = weighed.withColumns({"_level": level, "_nth": F.row_number().over(by_ratio)})
    levelled = levelled.withColumn("_open", F.col("_level") * F.col("weight") <= F.col("cap"))
    # The first source that stays below its cap sets the level for all after it.
    found = F.min(F.when(F.col("_open"), F.struct("_nth", F.col("_level").alias("l")))).over(every)
    target = F.least(F.col("cap"), F.coalesce(found["l"] * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", "slope", target.alias("target"))


def curriculum(docs: DataFrame, rows_per_bucket: int = 200, seed: int = 17) -> DataFrame:
    """Add to each row of ``docs`` its size, its source's size and target, the words taken, and its training positions.

    A source's documents, in an order hashed from the id, form a stream that is read until the target is reached, at
    most twice; the last document taken is taken in part. ``first_taken`` and ``second_taken`` are the words of either
    reading, and ``first_position`` and ``second_position`` (null where nothing is taken) the places in the whole mix.
    Null texts have no words; null sources are one source; equal rows are taken one after another.
    An empty table gives an empty one. Columns that start with an underscore are dropped, and columns with the names of
    the new ones are replaced.
    """
    return scheduled(docs.select(*docs.columns, n_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie")), rows_per_bucket, seed)


#: The columns that ``scheduled`` adds.
NEW = ("size", "source_size", "target", "taken", "first_taken", "second_taken", "first_position", "second_position")


def scheduled(docs: DataFrame, rows_per_bucket: int = 200, seed: int = 17) -> DataFrame:
    """``curriculum`` of rows whose words are counted in ``_size``, and that ``_tie`` tells apart where their ids don't."""
    kept = [c for c in docs.columns if not c.startswith("_") and c not in NEW]
    sized = docs.select(*kept, F.col("_size").alias("size"), "_tie")
    sums = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "source-sizes")
    rows = sums.agg(F.sum("_n")).first()[0] or 0
    targets = materialise(source_targets(sums.select("source", "source_size")), "source-targets")
    whole = targets.agg(F.sum("target"), F.sum(F.col("target") * F.col("slope"))).first()
    demand, lean = whole[0] or 0.0, whole[1] or 0.0
    buckets = bucket_count(rows, rows_per_bucket)
    key = F.xxhash64("doc_id", F.lit(seed), "_tie")
    keyed = sized.withColumn("_key", key).withColumn("_bucket", F.pmod(F.col("_key"), F.lit(buckets)).cast("int"))
    placed = running_start(keyed, ["source"], "_bucket", [F.col("_key"), F.col("doc_id").asc_nulls_first(), F.col("size")], {"_start": "size"})
    t = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("slope").alias("_slope"), F.col("target").alias("_target"))
    joined = placed.join(t, placed["source"].eqNullSafe(t["_source"]))

    goal = F.floor(F.col("_target") + F.lit(0.5)).cast("long")
    took = lambda start: F.least(F.greatest(goal - start, F.lit(0).cast("long")), F.col("size"))

    def position(start: Column, taken: Column) -> Column:
        """Solve target * (t + slope * (t*t - t)) = middle for t; then the words all sources have given by t."""
        share = F.least(F.lit(1.0), (start + taken / 2) / F.col("_target"))
        a, b = F.col("_slope"), 1 - F.col("_slope")
        time = F.when(a == 0, share).otherwise((-b + F.sqrt(b * b + 4 * a * share)) / (2 * a))
        return F.when(taken > 0, F.lit(demand) * time + F.lit(lean) * (time * time - time))

    again = F.col("_start") + F.col("_source_size")
    taken = joined.withColumns({"_first": took(F.col("_start")), "_second": took(again)})
    return taken.select(
        *kept,
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_first") + F.col("_second")).alias("taken"),
        F.col("_first").alias("first_taken"),
        F.col("_second").alias("second_taken"),
        position(F.col("_start"), F.col("_first")).alias("first_position"),
        position(again, F.col("_second")).alias("second_position"),
    )


def training_order(placed: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each reading of a document, range-sorted by training position, its text cut to the words taken."""
    readings = F.array(
        F.struct(F.col("first_position").alias("position"), F.col("first_taken").alias("words")),
        F.struct(F.col("second_position").alias("position"), F.col("second_taken").alias("words")),
    )
    read = placed.withColumn("_r", F.explode(readings)).where(F.col("_r.words") > 0)
    whole = F.col("_r.words") >= F.col("size")
    # The text up to where its word after the last taken begins.
    tail = F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("_r.words").cast("int"))
    cut = F.when(whole, F.col("text")).otherwise(F.array_join(tail, ""))
    shown = read.withColumns({"text": cut, "position": F.col("_r.position")})
    return shown.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id").select(*keep, "position")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix of ``docs`` in the order of the first training position; documents that aren't taken come first.

    Texts are read once, for their words and hash; what is read again is narrow. Odd rows are as for ``curriculum``.
    """
    narrow = docs.select("doc_id", "source", n_words(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie"))
    placed = scheduled(materialise(narrow, "sizes"))
    return placed.repartitionByRange(F.col("first_position"), F.col("doc_id")).sortWithinPartitions("first_position", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", "first_position", "second_position"
    )
