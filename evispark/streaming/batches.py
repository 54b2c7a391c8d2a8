"""Incremental analysis of numbered batches: each completed batch makes a new version of the results, and one pointer says which holds.

A reader goes by the pointer, so it sees either the version before or the one after, whole. A version that was begun but not
pointed to is written anew by the next run.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, output: str) -> dict:
    """What the pointer says: done (the last batch), version (a path), summary, stop; an empty dict before the first version."""
    path, fs = _fs(spark, f"{output}/{POINTER}")
    if not fs.exists(path):
        return {}
    return json.loads("".join(r["value"] for r in spark.read.text(f"{output}/{POINTER}", wholetext=True).collect()))


def _switch(spark: SparkSession, output: str, state: dict) -> None:
    """Replace the pointer in one step, where the file system renames in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, fs = _fs(spark, f"{output}/_{POINTER}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(json.dumps(state, ensure_ascii=False).encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{output}/{POINTER}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(target), options)


def markers(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The completion markers (``batch_NNN/complete.json``) that are there, by number; one small file for each batch."""
    found = {}
    path, fs = _fs(spark, f"{folder}/batch_*/complete.json")
    for status in fs.globStatus(path) or []:
        name = status.getPath().toString()
        number = re.search(r"batch_(\d+)/complete\.json$", name)
        if number:
            text = "".join(r["value"] for r in spark.read.text(name, wholetext=True).collect())
            found[int(number[1])] = json.loads(text)
    return found


def analyse(spark: SparkSession, folder: str, output: str, key: list[str], order: list[str], first: int, last: int | None = None, analysis=None) -> list[int]:
    """Work off the batches that are complete and follow the last one done without a gap; the numbers of those done now.

    A batch's rows lie in ``batch_NNN/candidates`` as Parquet. A version holds the rows of all batches so far, the first of each
    ``key`` by batch and ``order``, after ``analysis`` (a function of that DataFrame). It is built on the version before and the one
    new batch, so earlier batches aren't read again. The summary counts rows, what is new against the version before, and what
    isn't there any more. A marker with the state circuit_open or blocked, or the batch ``last``, ends the work:
    later calls do nothing. A call without a new batch changes nothing.
    """
    done_now = []
    known = markers(spark, folder)
    while True:
        state = current(spark, output)
        number = state.get("done", first - 1) + 1
        if state.get("stop") or number not in known:
            return done_now
        fresh = spark.read.parquet(f"{folder}/batch_{number:03d}/candidates").withColumn("batch", F.lit(number))
        version = f"{output}/version={number}"
        if state:
            before = spark.read.parquet(f"{state['version']}/candidates")
            fresh = before.unionByName(fresh.select(*before.columns))
        rest = [c for c in fresh.columns if c not in key]
        merged = fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("batch", *order)).alias("_r")).select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest))
        merged.write.mode("overwrite").parquet(f"{version}/candidates")
        stored = spark.read.parquet(f"{version}/candidates")
        results = analysis(stored) if analysis else stored
        results.write.mode("overwrite").parquet(f"{version}/results")
        now = spark.read.parquet(f"{version}/results").select(*key).distinct()
        counts = {"candidates": stored.count(), "results": now.count(), "new": now.count(), "gone": 0}
        if state:
            old = spark.read.parquet(f"{state['version']}/results").select(*key).distinct()
            counts |= {"new": now.join(old, key, "left_anti").count(), "gone": old.join(now, key, "left_anti").count()}
        halted = known[number].get("state") in ("circuit_open", "blocked")
        stop = "runner_circuit_open" if halted else "runner_completed" if number == last else ""
        _switch(spark, output, {"done": number, "version": version, "summary": counts, "stop": stop})
        done_now.append(number)


def results(spark: SparkSession, output: str) -> DataFrame:
    """The results that hold now."""
    return spark.read.parquet(f"{current(spark, output)['version']}/results")


def follow(spark: SparkSession, folder: str, output: str, checkpoint: str, key: list[str], order: list[str], first: int, last: int | None = None, analysis=None) -> None:
    """Work off all complete batches as a stream of completion markers: new markers start the work, which itself goes by the pointer.

    A marker that comes before an earlier batch's is met again when that comes, and a micro-batch that is run twice finds its
    work done. The stream ends when it has seen all markers.
    """
    stream = spark.readStream.schema("state string").option("recursiveFileLookup", "true").option("pathGlobFilter", "complete.json").json(folder)
    work = lambda rows, number: analyse(spark, folder, output, key, order, first, last, analysis) and None
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
