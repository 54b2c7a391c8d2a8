"""Readers, writers and streams."""

from pyspark.sql import functions as F

from evispark.sources import tables
from evispark.streaming import events


def test_csv_with_row_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿公司名称,备注\n甲,"x\ny"\n乙,\n', encoding="utf-8")
    out = tables.read_raw_csv(spark, str(tmp_path / "a.csv"), ["公司名称", "备注", "届次"]).orderBy("row_number").collect()
    assert [(r["公司名称"], r["备注"], r["届次"], r["row_number"]) for r in out] == [("甲", "x\ny", "", 2), ("乙", "", "", 3)]


def test_queue_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"url": "https://a.com"}\nnot json\n')
    out = tables.read_queue(spark, str(tmp_path / "q.jsonl"), "url string")
    assert [r["url"] for r in out["rows"].collect()] == ["https://a.com"] and out["bad"].count() == 1


def test_history(spark, tmp_path):
    (tmp_path / "h.md").write_text("# x\n| company | 状态 | index |\n|---|:--:|---|\n| 甲 | 已投 | [a](https://a.com/x), |\n| 乙 | 还没投 | |\n", encoding="utf-8")
    out = {r["company"]: r for r in tables.read_history(spark, str(tmp_path / "h.md")).collect()}
    assert out["甲"]["urls"] == ["https://a.com/x"] and out["甲"]["applied"] and not out["乙"]["applied"]


def test_completed_batches_go_in_order(spark, tmp_path):
    for n in (1, 2, 4):
        (tmp_path / f"batch_{n:03d}").mkdir()
        (tmp_path / f"batch_{n:03d}" / "complete.json").write_text("{}")
    found = tables.completed_batches(spark, str(tmp_path))
    assert events.in_order(found, 0) == [1, 2] and events.in_order(found, 2) == []


def test_fixed_columns(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("x", "extra")], "a string, b string"), str(tmp_path / "o"), ["a", "c"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "o")).collect()] == [("x", None)]
    line = tables.markdown_rows(spark.createDataFrame([("a|b", None)], "x string, y string"), ["x", "y"]).first()["line"]
    assert line == "| a\\|b |  |"


def _run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_windows_equal_batch(spark, data):
    batch = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{data}/events.parquet*")
    _run(events.windowed_counts(stream), "windows", "complete")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.windowed_counts(batch).collect()))


def test_stream_task_states(spark, tmp_path):
    rows = [(1, 1, "running"), (1, 3, "ok"), (1, 2, "error"), (2, 1, "running"), (2, 2, "running")]
    spark.createDataFrame(rows, "task_id long, seq long, state string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("task_id long, seq long, state string").parquet(str(tmp_path / "s"))
    _run(events.task_states(stream), "states", "update")
    last = spark.table("states").groupBy("task_id").agg(F.max_by("state", "attempts").alias("s"), F.max("attempts").alias("a"))
    assert sorted(map(tuple, last.collect())) == [(1, "ok", 1), (2, "running", 2)]


def test_stored_tables_are_released(spark):
    from evispark.session import materialise, release

    release(spark)
    kept = materialise(spark.range(3))
    assert kept.count() == 3 and release(spark) == 1 and release(spark) == 0


def test_plain_csv_numbers_lines_in_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n" + "".join(f'{i},"v, {i}"\n' for i in range(5000)), encoding="utf-8")
    (tmp_path / "b.csv").write_text('y,x\nb,"say ""hi"""\n', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        out = tables.read_plain_csv(spark, str(tmp_path), ["x", "y", "z"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = {r["row_number"]: (r["x"], r["y"], r["z"]) for r in out if r["input_path"].endswith("a.csv")}
    assert len(a) == 5000 and all(a[i + 2] == (str(i), f"v, {i}", "") for i in range(5000))
    assert [(r["x"], r["y"], r["row_number"]) for r in out if r["input_path"].endswith("b.csv")] == [('say "hi"', "b", 2)]


def test_history_takes_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.md").write_text("| company | index |\n|---|---|\n| 甲 | https://a.com/x |\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("| link | 状态 | 公司 |\n|---|---|---|\n| https://b.com | 未投 | 乙 |\n", encoding="utf-8")
    out = {r["company"]: (r["urls"], r["applied"]) for r in tables.read_history(spark, str(tmp_path)).collect()}
    assert out == {"甲": (["https://a.com/x"], True), "乙": (["https://b.com"], False)}


def test_delivery_files(spark, tmp_path):
    from evispark.operators import export

    df = spark.createDataFrame([("a", ["x", "y"], True), ("b", [], False)], "k string, tags array<string>, campus boolean")
    export.write_delivery(df, str(tmp_path / "d"), F.col("campus"))
    assert spark.read.json(str(tmp_path / "d" / "all_lists_jsonl")).count() == 2 and spark.read.json(str(tmp_path / "d" / "campus_lists_jsonl")).count() == 1
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "d" / "all_lists_csv").glob("*.csv"))
    assert text.startswith("﻿k") and '"[""x"",""y""]"' in text
    export.write_evidence(spark.createDataFrame([(7, "# Evidence 7")], "task int, markdown string"), str(tmp_path / "e"), "task")
    assert (tmp_path / "e" / "task=7").is_dir()
