"""Readers of the raw inputs and writers of the results."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def read_raw_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all fields text, with ``input_path`` and ``row_number`` (the header is row 1).

    Fields may have line breaks, so one file is read by one task; many files are read in parallel. Where no field has any,
    ``read_plain_csv`` splits files.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("input_path"))
    schema = StructType([StructField(c, StringType()) for c in columns])

    def parse(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(csv.DictReader(io.StringIO((value or "").removeprefix("﻿"))))
                arrays = [pa.array([r.get(c) or "" for r in rows], pa.string()) for c in columns]
                numbers = pa.array(range(2, len(rows) + 2), pa.int32())
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([name] * len(rows), pa.string()), numbers], [*columns, "input_path", "row_number"])

    fields = [*schema.fields, StructField("input_path", StringType())]
    return lines.mapInArrow(parse, StructType([*fields, StructField("row_number", IntegerType())]))


def read_plain_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``read_raw_csv`` for files without line breaks in fields: files are split, and row numbers are the places of lines.

    Lines are numbered within the split that Spark reads, and splits by their offset in the file, so no task sees a whole file.
    Files may have their columns in different orders.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta.file_path.alias("input_path"), meta.file_block_start.alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("input_path", "_block").agg(F.count("*").alias("_lines"), F.min("_at").alias("_first"))
    before = Window.partitionBy("input_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_base", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    numbered = lines.join(starts, ["input_path", "_block"]).withColumn("row_number", (F.col("_base") + F.col("_at") - F.col("_first") + 1).cast("int"))
    numbered = numbered.withColumn("value", F.regexp_replace("value", "\\r$", ""))
    heads = numbered.where("row_number = 1").select("input_path", F.regexp_replace("value", "^\\x{feff}", "").alias("_head"))
    # Only the number of columns of the widest header comes to the driver; headers stay a table with a row for each file.
    widest = heads.agg(F.max(F.size(F.split("_head", ",", -1)))).first()[0] or 1
    fields = ", ".join(f"_c{i} string" for i in range(widest))
    cells = lambda text: F.from_csv(text, fields, {"escape": '"'})
    listed = lambda row: F.array(*(row[f"_c{i}"] for i in range(widest)))
    names = heads.withColumn("_row", cells(F.col("_head"))).select("input_path", listed(F.col("_row")).alias("_names"))
    body = numbered.where((F.col("row_number") > 1) & (F.trim("value") != "")).withColumn("_row", cells(F.col("value")))
    parsed = body.select("input_path", "row_number", listed(F.col("_row")).alias("_cells")).join(names, "input_path")

    def cell(name: str):
        at = F.array_position("_names", F.lit(name)).cast("int")
        return F.when(at > 0, F.coalesce(F.try_element_at("_cells", at), F.lit(""))).otherwise("")

    return parsed.select(*(cell(c).alias(c) for c in columns), "input_path", "row_number")


def read_queue(spark: SparkSession, path: str, schema: str) -> dict[str, DataFrame]:
    """JSON lines: ``rows`` that parse and ``bad`` ones with their text."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", parsed.alias("_row"))
    bad = F.col("_row._corrupt_record").isNotNull()
    return {"rows": lines.where(~bad).select("_row.*").drop("_corrupt_record"), "bad": lines.where(bad).select(F.col("value").alias("text"))}


def first_url(row_columns: list[str]):
    """The first of several fields that isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in row_columns))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(company, status, urls, applied) from Markdown tables; in each file, the first row that names a company column is the header
    of what follows."""
    from ..functions.rules import PENDING_MARKERS

    text = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), "^\\||\\|$", ""), "\\|", -1), lambda x: F.trim(x))
    lines = text.select("file", F.posexplode(F.split(F.regexp_replace("value", "^\\x{feff}", ""), "\\r?\\n", -1)).alias("at", "line")).where(F.ltrim("line").startswith("|"))
    rows = lines.select("file", "at", cells.alias("cells"))
    lowered = F.transform("cells", F.lower)
    places = lambda names: F.filter(F.sequence(F.lit(1), F.size("cells")), lambda i: F.element_at(lowered, i).isin(*names))
    place = lambda names: F.try_element_at(places(names), F.lit(1))
    named = F.struct("at", place(("company", "公司")).alias("company"), place(("状态",)).alias("status"), places(("index", "url", "link", "链接", "网址", "投递链接")).alias("urls"))
    heads = rows.where(place(("company", "公司")).isNotNull()).groupBy("file").agg(F.min_by(named, "at").alias("head"))
    body = rows.join(heads, "file").where(F.col("at") > F.col("head.at")).where(F.exists("cells", lambda c: (c != "") & ~c.rlike("^:?-{2,}:?$")))
    cell = lambda i: F.try_element_at(F.col("cells"), i.cast("int"))
    urls = lambda i: F.coalesce(F.regexp_extract_all(cell(i), F.lit("https?://[^\\s\\])]+"), F.lit(0)), F.array().cast("array<string>"))
    found = F.flatten(F.transform("head.urls", urls))
    shown = body.select(cell(F.col("head.company")).alias("company"), F.coalesce(cell(F.col("head.status")), F.lit("")).alias("status"), F.transform(found, lambda u: F.rtrim(u, F.lit(">),，。"))).alias("urls"))
    waits = F.exists(F.array(*map(F.lit, PENDING_MARKERS)), lambda m: F.contains(F.replace(F.col("status"), F.lit(" "), F.lit("")), m))
    return shown.where("coalesce(company, '') <> ''").withColumn("applied", ~waits)


def completed_batches(spark: SparkSession, root: str, start: int = 0) -> DataFrame:
    """The batch folders under ``root`` that have a completion marker, by number."""
    marks = spark.read.text(f"{root}/batch_*/complete.json", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("marker"))
    return marks.withColumn("batch", F.regexp_extract("path", "batch_(\\d+)/complete\\.json$", 1).cast("int")).where(F.col("batch") >= start)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header; absent ones are blank, others left out."""
    have = set(df.columns)
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """JSON lines in a folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table, pipes escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
