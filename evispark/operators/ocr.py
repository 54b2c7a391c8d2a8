"""Recognised lines of images that were read in overlapping slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_of(polygon: Column) -> Column:
    """The box (left, top, width, height) around a polygon, an array of points, each an array of x and y."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def reading_order() -> list[Column]:
    """From top to bottom, then from left to right."""
    return [F.col("top").asc_nulls_last(), F.col("left").asc_nulls_last(), F.col("slice_index"), F.col("line_index")]


def mean_confidence(lines: DataFrame, by: list[str]) -> DataFrame:
    """The mean confidence of lines that have one; null where none has."""
    return lines.groupBy(*by).agg(F.avg("confidence").alias("mean_confidence"))


def _seen_again(x: Column, old: Column) -> Column:
    """Whether a line shows what a survivor of another slice does: they share half the smaller box, or more."""
    width = F.least(x["left"] + x["width"], old["left"] + old["width"]) - F.greatest(x["left"], old["left"])
    height = F.least(x["top"] + x["height"], old["top"] + old["height"]) - F.greatest(x["top"], old["top"])
    shared = F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))
    smaller = F.greatest(F.lit(1), F.least(x["width"] * x["height"], old["width"] * old["height"]))
    return (x["slice_index"] != old["slice_index"]) & (2 * shared >= smaller)


def survivors(lines: DataFrame) -> DataFrame:
    """Lines (image, slice_index, line_index, text, confidence, left, top, width, height) without those that another slice shows again.

    A plain fold in reading order: a line is compared with the survivors so far that have its text and are of other slices, in
    their order, and takes the place of the first that it shows again if its confidence is higher (none is the lowest), else
    goes. So a line next to one that went may stay. An image with a line that has no box keeps all its lines. Nulls in texts count
    as empty; other columns are left out.

    Only lines that share a stretch of height can show the same, so each text's lines are first cut where no box
    reaches on; folds are over such runs of lines, never over an image. Runs of one line, the most, aren't folded.
    """
    names = ["slice_index", "line_index", "text", "confidence", "left", "top", "width", "height"]
    boxed = F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    told = lines.select("image", *names, F.coalesce("text", F.lit("")).alias("_text"), boxed.alias("_boxed"))
    plain = told.where(~F.col("_boxed")).select(F.col("image").alias("_image")).distinct()
    without = told.join(plain, F.col("image").eqNullSafe(F.col("_image")), "left_semi")
    order = Window.partitionBy("image", "_text").orderBy("top", "left", "slice_index", "line_index")
    reach = F.max(F.col("top") + F.greatest("height", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = told.join(plain, F.col("image").eqNullSafe(F.col("_image")), "left_anti").withColumn("_begins", F.coalesce(F.col("top") >= reach, F.lit(True)))
    runs = cut.withColumn("_run", F.sum(F.col("_begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rank = F.struct("top", "left", "slice_index", "line_index", *(n for n in names if n not in ("top", "left", "slice_index", "line_index")))
    grouped = runs.groupBy("image", "_text", "_run").agg(F.array_sort(F.collect_list(rank)).alias("_lines"))
    sure = lambda x: F.coalesce(x["confidence"], F.lit(-1))

    def step(kept, x):
        at = F.array_position(F.transform(kept, lambda old: _seen_again(x, old)), True).cast("int")
        better = sure(x) > sure(F.element_at(kept, F.greatest(at, F.lit(1))))
        replaced = F.transform(kept, lambda old, i: F.when(i + 1 == at, x).otherwise(old))
        return F.when(at == 0, F.concat(kept, F.array(x))).when(better, replaced).otherwise(kept)

    folded = F.when(F.size("_lines") == 1, F.col("_lines")).otherwise(F.aggregate(F.slice("_lines", 2, F.size("_lines")), F.slice("_lines", 1, 1), step))
    once = grouped.select("image", F.explode(folded).alias("_l")).select("image", *(F.col(f"_l.{n}").alias(n) for n in names))
    return once.unionByName(without.select("image", *names))
