"""Retries with timers against the batch schedule, and versions of results by completed batches."""

import json

import pytest
from pyspark.sql import functions as F

from evispark.streaming import batches, events, retries


def test_retries_fire_when_due(spark, tmp_path):
    rows = []
    for task in range(40):
        at = 1000 + 1000 * task % 7000  # what lies at the epoch is late from the start
        for n in range(task % 5):
            rows.append((task, n, at, (task + n) % 4 != 1))
            at += (3000, 9000, 30000)[(task + n) % 3]
    rows.append((999, 0, 600_000, None))  # time goes on
    table = spark.createDataFrame(rows, "task_id long, attempt_id int, ms long, repeatable boolean").select("task_id", "attempt_id", F.timestamp_millis("ms").alias("at"), "repeatable")
    for i, part in enumerate(("ms < 5000", "ms between 5000 and 20000", "ms > 20000")):
        table.withColumn("ms", F.unix_millis("at")).where(part).drop("ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    retries.use_rocksdb(spark)
    try:
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
        found = events.drained(retries.due_retries(stream, late="1 hour"), "append").drop("batch").collect()
        early = found
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in" / "p*"))
        found = events.drained(retries.due_retries(stream), "append").drop("batch").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    expected = retries.retry_schedule(table).collect()
    # With an hour for late rows no timer has run out, and only what later attempts have passed comes out.
    last = {r["task_id"]: r["ms"] for r in table.groupBy("task_id").agg(F.max(F.unix_millis("at")).alias("ms")).collect()}
    wanted = sorted(tuple(r) for r in expected if r["due_ms"] <= last[r["task_id"]])
    assert sorted(map(tuple, early)) == wanted, (set(wanted) - set(map(tuple, early)), [r for r in rows if r[0] in (7, 34)])
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected)) and len(found) > 10
    assert {r["attempt"] for r in found} == {2, 3}
    soon = retries.retry_schedule(table, now="1970-01-01 00:00:10").collect()
    assert 0 < len(soon) < len(expected) and all(r["due_ms"] <= 10_000 for r in soon)


def put(spark, folder, number, rows, marker):
    spark.createDataFrame(rows, "company_id long, name string, score int").write.mode("overwrite").parquet(f"{folder}/batch_{number:03d}/candidates")
    if marker is not None:
        (folder / f"batch_{number:03d}" / "complete.json").write_text(json.dumps(marker), encoding="utf-8")


@pytest.fixture
def places(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    return tmp_path / "in", str(tmp_path / "out")


def test_batches_in_order_and_once(spark, places):
    folder, out = places
    good = lambda df: df.where("score > 0")
    run = lambda: batches.analyse(spark, str(folder), out, ["company_id"], ["name"], 3, 6, good)
    assert run() == [] and batches.current(spark, out) == {}
    put(spark, folder, 3, [(1, "a", 1), (1, "b", 9), (2, "c", 0)], {"state": "completed"})
    put(spark, folder, 5, [(3, "e", 5)], {"state": "completed"})
    assert run() == [3]  # 4 isn't there, so 5 waits
    state = batches.current(spark, out)
    assert state["summary"] == {"candidates": 2, "results": 1, "new": 1, "gone": 0} and run() == [] and batches.current(spark, out) == state
    put(spark, folder, 4, [(1, "later", 7), (4, "d", 2)], {"state": "completed"})
    assert run() == [4, 5]
    assert sorted(map(tuple, batches.results(spark, out).select("company_id", "name", "batch").collect())) == [(1, "a", 3), (3, "e", 5), (4, "d", 4)]
    assert batches.current(spark, out)["summary"] == {"candidates": 4, "results": 3, "new": 1, "gone": 0}
    put(spark, folder, 6, [], {"state": "completed"})
    put(spark, folder, 7, [(9, "x", 1)], {"state": "completed"})
    assert run() == [6] and batches.current(spark, out)["stop"] == "runner_completed" and run() == []


def test_a_broken_version_is_written_anew(spark, places):
    folder, out = places
    put(spark, folder, 1, [(1, "a", 1)], {"state": "completed"})

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        batches.analyse(spark, str(folder), out, ["company_id"], ["name"], 1, None, fails)
    assert batches.current(spark, out) == {}
    assert batches.analyse(spark, str(folder), out, ["company_id"], ["name"], 1) == [1] and batches.results(spark, out).count() == 1


def test_markers_as_a_stream(spark, places, tmp_path):
    folder, out = places
    follow = lambda: batches.follow(spark, str(folder), out, str(tmp_path / "state"), ["company_id"], ["name"], 1)
    put(spark, folder, 2, [(2, "b", 1)], {"state": "circuit_open"})
    follow()
    assert batches.current(spark, out) == {}
    put(spark, folder, 1, [(1, "a", 1)], {"state": "completed"})
    follow()
    state = batches.current(spark, out)
    assert state["done"] == 2 and state["stop"] == "runner_circuit_open" and batches.results(spark, out).count() == 2
    follow()
    assert batches.current(spark, out) == state
