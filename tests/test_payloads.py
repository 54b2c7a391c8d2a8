"""Jobs in saved JSON, and lists mapped by configured paths."""

import hashlib
import json

from evispark.operators import listing, pagination, payloads

BODIES = [
    ("https://campus.51job.com/jobs", {"data": {"totalRows": 17, "records": [{"jobId": "k9", "jobName": "质量工程师"}]}}),
    ("https://firma.zhiye.com/api/x", {"Count": 23, "Data": [{"Id": "g-7", "JobAdId": 908, "JobAdName": "设备工程师", "Category": "校园招聘", "Duty": "维护设备", "Require": "本科"}]}),
    ("https://e.com/a/", [[[{"title": "deep", "href": "../j/1", "description": ""}], {"x": {"y": {"z": [{"positionName": "deeper", "id": 5, "children": [{"name": "n", "id": 1, "claim": "c"}, {"name": "plain", "id": 2}]}]}}}]]),
    ("https://e.com/", {"total": True, "count": -1, "Total": 3.0, "totalCount": "9", "total_count": 7, "title": 5, "name": "x", "id": 1}),
    ("https://e.com/", "text"),
    ("https://e.com/", {"title": "only a title"}),
    ("https://e.com/", {"title": "t", "url": "https://o.org/p", "requirements": ["a", 1]}),
]


def test_json_jobs(spark):
    rows = [(i, b, json.dumps(x)) for i, (b, x) in enumerate(BODIES)] + [(99, "https://e.com/", "{broken"), (98, None, None)]
    df = spark.createDataFrame(rows, "k long, base string, body string")
    found = payloads.objects(df, ["k", "base"])
    jobs = payloads.json_jobs(found).collect()
    shown = sorted((r["k"], r["title"], r["url"], r["text"]) for r in jobs)
    assert shown == [
        (0, "质量工程师", "", ""),
        (1, "设备工程师", "https://firma.zhiye.com/campus/jobdetails?jobId=908", "维护设备\n本科"),
        (2, "deep", "https://e.com/j/1", ""),
        (2, "deeper", "", ""),
        (2, "n", "", "c"),
        (6, "t", "https://o.org/p", '["a",1]'),
    ]
    ids = {r["title"]: r["id"] for r in jobs}
    name = lambda x: hashlib.sha256(x.encode()).hexdigest()[:24]
    assert ids["deeper"] == name("e.com:5") and ids["deep"] == name("e.com:https://e.com/j/1") and ids["质量工程师"] == name("campus.51job.com:k9")
    assert {r["k"]: r["total"] for r in payloads.reported_totals(found, ["k"]).collect()} == {0: 17, 1: 23, 3: 7}
    assert payloads.objects(df.where("false"), ["k"]).count() == 0


def test_reparse(spark):
    results = spark.createDataFrame([("r1", "https://e.com/list", 3, ["https://e.com/old"]), ("r2", "https://e.com/", None, None)], "result string, url string, total long, detail_urls array<string>")
    old = lambda **x: json.dumps(x)
    known = hashlib.sha256(b"e.com:7").hexdigest()[:24]
    jobs = spark.createDataFrame(
        [("r1", 0, "p", "plain", "", "", old(name="plain", id=1)), ("r1", 1, known, "kept", "https://e.com/j/7", "", old(name="kept", claim="c")), ("r1", 2, "q", "text", "", "", None), ("r1", 3, "q", "text", "", "", None)],
        "result string, nth long, id string, title string, url string, text string, raw string",
    )
    a = {"url": "https://e.com/api", "body": {"total": 9, "list": [{"jobId": 7, "title": "again"}, {"jobId": 8, "title": "new", "url": "/j/8"}]}}
    b = [{"jobId": 8, "title": "later"}, {"jobId": 9, "title": "last", "url": "/j/9"}]
    artifacts = spark.createDataFrame([("r1", 0, json.dumps(a)), ("r1", 1, "{broken"), ("r1", 2, json.dumps(b)), ("none", 0, json.dumps(b))], "result string, nth long, body string")
    merged, coverage = payloads.reparse(results, jobs, artifacts)
    assert [(r["nth"], r["title"]) for r in merged.orderBy("nth").collect()] == [(0, "kept"), (1, "text"), (2, "text"), (3, "new"), (4, "last")]
    got = {r["result"]: r for r in coverage.collect()}
    assert got["r1"]["total"] == 9 and got["r1"]["reparsed"] == [0, 2]
    assert got["r1"]["detail_urls"] == ["https://e.com/old", "https://e.com/j/7", "https://e.com/j/8", "https://e.com/j/9"]
    assert got["r2"]["total"] is None and got["r2"]["detail_urls"] == [] and got["r2"]["reparsed"] == []


def config(source, **more):
    base = dict(source=source, url="https://e.com/", method="GET", location="query", page_path="page", items_path="Data.Posts", id_path="PostId", success_path=None, success_value=None, actual_path=None, total_path="Data.Count", total_pages_path=None, last_path=None, null_items_are_empty=None, fields={"title": "Name", "url": "URL", "description": "d.0.text", "requirements": "r"}, company="c", scope="s")
    return {**base, **more}


def page(ids, total=None, **extra):
    return {"Data": {"Posts": [{"PostId": i, "Name": f"n{i}", "URL": f"https://e.com/{i}", "d": [{"text": "暂无" if i and i % 2 else "long"}], "r": "x"} for i in ids], **({} if total is None else {"Count": total}), **extra}}


RUNS = {
    "clamped": ({}, [page([1, 2], 5), page([3, 4], 5), page([5], 5)], "response_total_reached", ""),
    "repeated": ({}, [page([1, 2], 5), page([3], 5), page([2, 1], 5), page([9], 5)], "none", "repeated_page,duplicate_item_ids,total_count_mismatch"),
    "overlap": ({}, [page([1, 2], 5), page([1, 3], 5)], "none", "duplicate_item_ids,total_count_mismatch"),
    "twice": ({}, [page([1, 1], 2)], "none", "duplicate_item_ids,total_count_mismatch"),
    "short": ({}, [page([1, 2], 5), page([], 5)], "empty_page", "total_count_mismatch"),
    "many": ({}, [page([1, 2, 3], 2)], "none", "collected_count_exceeds_total,total_count_mismatch"),
    "actual": ({"actual_path": "Data.Page"}, [page([1], 3, Page=1), page([2], 3, Page=99)], "none", "actual_page_mismatch,total_count_mismatch"),
    "no page": ({"actual_path": "Data.Page"}, [page([1], 3)], "none", "actual_page_not_integer"),
    "changed": ({}, [page([1], 3), page([2], 4)], "none", "total_changed,total_count_mismatch"),
    "pages changed": ({"total_pages_path": "Data.Pages"}, [page([1], 3, Pages=3), page([2], 3, Pages=4)], "none", "total_pages_changed,total_count_mismatch"),
    "early last": ({"total_pages_path": "Data.Pages", "last_path": "Data.Last"}, [page([1], 3, Pages=3, Last=True)], "none", "last_page_total_pages_mismatch,total_count_mismatch"),
    "no last": ({"total_pages_path": "Data.Pages", "last_path": "Data.Last"}, [page([1], 1, Pages=1, Last=False)], "none", "last_page_total_pages_mismatch"),
    "last": ({"total_path": None, "last_path": "Data.Last"}, [page([1], Last=False), page([2], Last=True), page([3], Last=True)], "last_page", ""),
    "bad last": ({"last_path": "Data.Last"}, [page([1], 3, Last="yes")], "none", "last_marker_not_boolean,total_count_mismatch"),
    "hollow": ({"total_pages_path": "Data.Pages"}, [page([1], 3, Pages=3), page([], 3, Pages=3)], "empty_page", "empty_page_before_last,total_count_mismatch"),
    "zero": ({"total_pages_path": "Data.Pages"}, [page([1], 1, Pages=0)], "last_page", "nonempty_zero_total_pages"),
    "early total": ({"total_pages_path": "Data.Pages", "last_path": "Data.Last"}, [page([1, 2], 2, Pages=2, Last=False)], "response_total_reached", "total_reached_before_last_page,total_reached_without_last_marker"),
    "empty": ({"fields": None}, [page([], 0)], "empty_page", ""),
    "missing": ({}, [{"Data": {"Count": 0}}], "none", "items_not_objects"),
    "null": ({}, [{"Data": {"Posts": None, "Count": 0}}], "none", "items_not_objects"),
    "null allowed": ({"null_items_are_empty": True}, [{"Data": {"Posts": None, "Count": 0}}], "empty_page", ""),
    "null then short": ({"null_items_are_empty": True, "actual_path": "Data.Page"}, [page([1], 2, Page=1), {"Data": {"Posts": None, "Count": 2, "Page": 2}}], "empty_page", "total_count_mismatch"),
    "object items": ({"null_items_are_empty": True}, [{"Data": {"Posts": {}, "Count": 0}}], "none", "items_not_objects"),
    "plain items": ({}, [{"Data": {"Posts": [1], "Count": 1}}], "none", "items_not_objects"),
    "marker": ({"success_path": "ok", "success_value": "0"}, [{"ok": 1, **page([1], 1)}], "none", "success_marker_mismatch"),
    "marker fits": ({"success_path": "ok", "success_value": "0"}, [{"ok": 0, **page([1], 1)}], "response_total_reached", ""),
    "no id": ({}, [page([1, ""], 2)], "none", "missing_item_id,total_count_mismatch"),
    "by content": ({"id_path": None}, [page([1, 2], 3), page([3], 3)], "response_total_reached", ""),
    "bad total": ({}, [page([1], "many")], "none", "total_not_integer"),
    "text total": ({}, [page([1], "1")], "response_total_reached", ""),
    "goes on": ({}, [page([1], 9), page([2], 9)], "none", "total_count_mismatch"),
    "not json": ({}, ["{broken"], "none", "not_json"),
    "cap": ({"total_path": None}, [page([i]) for i in range(1, 8)], "none", "max_pages_reached"),
}


def tables(spark):
    configs = spark.createDataFrame([config(n, **c) for n, (c, *_) in RUNS.items()], listing.CONFIG)
    bodies = [(n, n, i, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) for n, (_, pages, *_) in RUNS.items() for i, x in enumerate(pages, 1)]
    return spark.createDataFrame([*bodies, ("unknown", "unknown", 1, "{}")], "source string, run string, page long, body string"), configs


def test_list_payloads(spark):
    records, coverage = listing.collect(*tables(spark), max_pages=7)
    found = {r["run"]: r for r in coverage.collect()}
    assert {n: (found[n]["terminal"], found[n]["reasons"]) for n in RUNS} == {n: x[2:] for n, x in RUNS.items()}
    assert all(r["list_complete"] == (r["terminal"] != "none" and r["reasons"] == "") for r in found.values())
    by = {}
    for r in records.orderBy("page", "raw_index").collect():
        by.setdefault(r["run"], []).append(r)
    assert [r["id"] for r in by["clamped"]] == ["1", "2", "3", "4", "5"] and [r["needs_details"] for r in by["clamped"]] == [True, False, True, False, True]
    assert found["clamped"]["needs_details"] == 3 and not found["clamped"]["jd_complete"] and len(by["repeated"]) == 3
    one = by["clamped"][0]
    assert (one["title"], one["url"], one["description"], one["url_provenance"], one["page"]) == ("n1", "https://e.com/1", "暂无", "response", 1) and json.loads(one["raw"])["PostId"] == 1
    assert {n: found[n]["collected"] for n in ("overlap", "actual", "last", "many")} == {"overlap": 3, "actual": 1, "last": 2, "many": 3}
    assert {n: len(by.get(n, [])) for n in ("overlap", "actual", "last", "many", "missing", "no id", "by content")} == {"overlap": 3, "actual": 1, "last": 2, "many": 3, "missing": 0, "no id": 0, "by content": 3}
    assert listing.collect(tables(spark)[0].where("false"), tables(spark)[1])[1].count() == 0


def test_configs(spark):
    rows = [config("fine"), config("bad", url="ftp://e", method="PUT", page_path=None, location="header", items_path="")]
    found = listing.config_problems(spark.createDataFrame(rows, listing.CONFIG)).collect()
    assert {r["source"] for r in found} == {"bad"} and len(found) == 5


def test_proof_without_optional_columns(spark):
    items = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "run string, page int, item int")
    pages = spark.createDataFrame([("a", 1, 2, None, None), ("a", 2, 2, None, None)], "run string, page int, total long, total_pages long, last boolean")
    assert [tuple(r) for r in pagination.proof(items, pages).collect()] == [("a", 2, 2, 2, "response_total_reached", "", True)]
