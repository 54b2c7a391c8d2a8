"""Queries beside their SQL on small tables of odd rows."""

import json

from compare import difference
from pyspark.sql import functions as F

from evispark.operators import listing, payloads
from evispark.plans import ORACLE_SQL, QUERIES
from evispark.session import release


def test_pages_at_the_size_limit(spark, tmp_path):
    sizes = (0, 1, 2999, 3000, 3001)
    rows = [(k * 6 + way, f"https://e.com/{k}", None if k == len(sizes) else ("x" * sizes[k])) for k in range(len(sizes) + 1) for way in range(6)]
    rows += [(100 * 6 + way, "https://e.com/", "é" * 1500) for way in range(6)] + [(101 * 6 + way, "https://e.com/", "a�b") for way in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "all"))
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert not difference(QUERIES["q_snapshot_choice"](spark, str(tmp_path)), ORACLE_SQL["q_snapshot_choice"], str(tmp_path))


def test_paths_with_marks_and_figures(spark):
    body = '{"it\'s": {"0": {"a b": [5, {"x?": null}]}}, "r": [{"rows": [1]}], "": 7}'
    paths = ["it's.0.a b.0", "it's.0.a b.1.x?", "it's.0.a b.1.x?.y", "r.0.rows", "r.0.rows.00", "r.rows", "", "r.1", "0"]
    df = spark.createDataFrame([(body, p) for p in paths], "body string, path string").withColumn("v", F.parse_json("body"))
    got = {r["path"]: (r["a"], r["b"]) for r in df.select("path", F.to_json(listing.walk(F.col("v"), F.col("path"))).alias("a"), F.to_json(listing._walk_whole(F.col("v"), F.col("path"))).alias("b")).collect()}
    assert [got[p] for p in paths] == [(x, x) for x in ("5", "null", None, "[1]", "1", None, "7", None, None)]


def test_items_are_not_shuffled_unless_they_come_again(spark):
    config = {"source": "s", "url": "https://e.com/", "items_path": "data.list", "id_path": "id", "total_path": "data.total", "fields": {"title": "t.name", "description": "d"}}
    configs = spark.createDataFrame([tuple(config.get(x.split()[0]) for x in listing.CONFIG.split(", "))], listing.CONFIG)
    item = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((F.col("id") * 10 + i).alias("id"), F.struct(i.alias("name")).alias("t"), F.lit("x").alias("d")))
    pages = spark.range(4).select(F.lit("s").alias("source"), F.lit("run").alias("run"), (F.col("id") + 1).alias("page"), F.concat(F.lit('{"data":{"total":40,"list":'), F.to_json(item), F.lit("}}")).alias("body"))
    records, _ = listing.collect(pages, configs)
    assert len([r for r in records.collect() if r["needs_details"] and r["title"]]) == 40
    # Only what a run brings again goes through a window, beside all other items.
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("Union") < plan.find("Window") and plan.count("Window [row_number()") == 1


def test_deep_trees_are_opened_in_few_passes(spark):
    def nodes(x, path=()):
        inner = [x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else []
        return ([(path, json.dumps(x, separators=(",", ":"), sort_keys=True))] if isinstance(x, dict) else []) + [n for i, y in enumerate(inner) for n in nodes(y, (*path, i))]

    deep = {"end": None}
    for i in range(20):
        deep = {"b": deep, "a": i, "c": [[], [{}], "{"]} if i % 2 else [i, deep, {"x": [1]}]
    bodies = [deep, {"b": {"c": [{"d": {"e": [{"f": 1}]}}]}}, [], 5, None]
    release(spark)
    found = payloads.objects(spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "{"), (10, None)], "k long, body string"), ["k"])
    got = sorted((r["k"], tuple(r["path"]), r["j"]) for r in found.select("k", "path", F.to_json("value").alias("j")).collect())
    assert got == sorted((i, *n) for i, b in enumerate(bodies) for n in nodes(b))
    assert release(spark) <= 4


def test_reparse_stores_payloads_once(spark):
    body = {"url": "https://e.com/api", "body": {"a": {"b": {"list": [{"jobId": 7, "title": "again", "url": "/j/7", "total": 5}, {"count": 18446744073709551617, "Count": 1.0, "total": -3}]}}}}
    results = spark.createDataFrame([("r", "https://e.com/", 3, [])], "result string, url string, total long, detail_urls array<string>")
    jobs = spark.createDataFrame([], "result string, nth long, id string, title string, url string, text string, raw string")
    artifacts = spark.createDataFrame([("r", 0, json.dumps(body)), ("r", 1, json.dumps({"url": 5, "body": None})), ("r", 2, "[]")], "result string, nth long, body string")
    release(spark)
    merged, coverage = payloads.reparse(results, jobs, artifacts.where("nth > 0"))
    assert merged.count() == 0 and coverage.first()["total"] == 3
    merged, coverage = payloads.reparse(results, jobs, artifacts.withColumn("body", F.replace("body", F.lit("18446744073709551617"), F.lit("6"))))
    assert [(r["nth"], r["title"], r["url"], json.loads(r["raw"])["total"]) for r in merged.collect()] == [(0, "again", "https://e.com/j/7", 5)]
    assert coverage.first().asDict() == {"result": "r", "total": 6, "detail_urls": ["https://e.com/j/7"], "reparsed": [0]}
    assert release(spark) <= 4
