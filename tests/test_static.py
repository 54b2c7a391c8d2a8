"""Static topics: embedded records, links, bounded reading and image bounds, against plain Python."""

import json
import random

from pyspark.sql import functions as F

from evispark.functions import tables
from evispark.operators import static

SOURCE = """<script src="js/data.js"></script><style>p{margin:0}</style> var x = {"a": "}{", "title": " A  b ", "n": {"title": "inner"}};
{"value":"制造", "attr2":"设备维护", "attr3":"本科", "attr4":"苏州", "attr5":"/apply/detail?jobAdId=31&utm_source=x"} {broken {"title": ""} {"name": 5} {"jobName": "无链接", "city": "北京"} {"title": 1"""


def test_embedded_records(spark):
    df = spark.createDataFrame([(1, SOURCE, "https://campus.51job.com/Firma/index.html"), (2, None, "https://e.com/"), (3, "{" * 3000 + '{"a":' * 3000, "https://e.com/"), (4, "", None)], "k long, source string, base string")
    found = [tuple(r) for r in static.records(df, "k", "source", "base").orderBy("k", "nth").collect()]
    link = "https://campus.51job.com/apply/detail?jobAdId=31"
    assert found == [
        (1, 0, "static:A b:", "A b", None, "", "", ""), (1, 1, link, "设备维护", link, "制造", "本科", "苏州"), (1, 4, "static:无链接:北京", "无链接", None, "", "", "北京"),
    ]
    tables.register(spark)
    df.createOrReplaceTempView("sources")
    texts = [json.loads(r["object"]) for r in spark.sql("SELECT o.* FROM sources, LATERAL json_objects(source) o WHERE k = 1 ORDER BY nth").collect()]
    assert [sorted(x) for x in texts] == [["a", "n", "title"], ["attr2", "attr3", "attr4", "attr5", "value"], ["title"], ["name"], ["city", "jobName"]]
    assert [tuple(r) for r in spark.sql("SELECT * FROM explode_roles('a b，c、a  b;;d\ne')").collect()] == [(0, "a b"), (1, "c"), (2, "d"), (3, "e")]


def test_links(spark):
    base = "https://campus.51job.com/Firma/index.html"
    rows = [("js/data.js", "", True), ("js/jquery.js", "", True), ("https://o.com/data.js", "", True), ("jobs.html", "更多", False), ("https://firma.zhiye.com/campus/detail?jobAdId=30&utm_source=x", "质量检验", False), ("https://firma.zhiye.com/x", "", False), ("about.html", "x", False), ("#", "x", False)]
    df = spark.createDataFrame([(base, *r) for r in rows], "page string, href string, label string, script boolean")
    found = {r["href"]: (r["target"], r["leads_to"]) for r in static.links(df, "page", "href", "label", "script").collect()}
    assert found["js/data.js"] == ("https://campus.51job.com/Firma/js/data.js", "script") and found["jobs.html"] == ("https://campus.51job.com/Firma/jobs.html", "page")
    assert found[rows[4][0]] == ("https://firma.zhiye.com/campus/detail?jobAdId=30", "job")
    assert all(found[h][1] is None for h in ("js/jquery.js", "https://o.com/data.js", "https://firma.zhiye.com/x", "about.html", "#"))


def plain_frontier(root, edges, most):
    """Pages in the order in which they were first seen; each new one is put at the end of the line."""
    line = [root]
    k = 0
    while k < min(len(line), most):
        line += [x for x in dict.fromkeys(edges.get(line[k], [])) if x not in line]
        k += 1
    return line[:most], line[most] if len(line) > most else None


def test_frontier_equals_a_queue(spark):
    rng = random.Random(2)
    edges = {f"p{i}": [f"p{rng.randrange(60)}" for _ in range(rng.randint(0, 4))] for i in range(60)}
    rows = [(u, k, x) for u, links in edges.items() for k, x in enumerate(links)] + [("p0", 99, None)]
    table = spark.createDataFrame(rows, "url string, place int, target string")
    roots = spark.createDataFrame([(f"p{i}",) for i in range(0, 60, 5)] + [("nowhere",), ("p0",)], "root string")
    for most in (1, 7, 100):
        found = {}
        for r in static.frontier(roots, table, most).orderBy("root", "nth").collect():
            found.setdefault(r["root"], []).append((r["url"], r["beyond"]))
        for root in {r["root"] for r in roots.collect()}:
            seen, beyond = plain_frontier(root, edges, most)
            assert found[root] == [(u, False) for u in seen] + ([(beyond, True)] if beyond else [])
    assert static.frontier(roots.where("false"), table, 3).count() == 0


def test_stop_reasons(spark):
    names = ("hit_pages", "hit_jobs", "hit_details", "hit_handoffs")
    rows = [(*(i == k for i in range(4)), int(k == 4), int(k != 6)) for k in range(7)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names) + ", failed int, jobs int")
    assert [r["stop_reason"] for r in static.stop_reasons(df).collect()] == ["max_pages", "max_jobs", "max_details", "max_zhiye_handoffs", "static_asset_error", "static_topic_complete", "job_records_not_found"]


def plain_images(rows, most, each, all_):
    total, seen, out = 0, {}, []
    for place, url, size in sorted(rows):
        if url not in seen:
            if len(seen) >= most or total >= all_:
                seen[url] = "skipped"
            elif size is None or size > min(each, all_ - total):
                seen[url] = "error"
            else:
                total += size
                seen[url] = "ok"
        out.append((place, seen[url]))
    return out


def test_image_bounds(spark):
    rng = random.Random(7)
    rows = [(run, place, f"u{rng.randrange(12)}", rng.choice([None, 0, 3, 10, 40, 90])) for run in range(60) for place in range(rng.randint(1, 20))]
    sizes = {(r[0], r[2]): r[3] for r in rows}
    rows = [(run, place, url, sizes[run, url]) for run, place, url, _ in rows]
    df = spark.createDataFrame(rows, "run long, place int, url string, size int")
    for bounds in ((5, 50, 100), (20, 90, 60), (3, 1000, 1000)):
        found = static.image_outcomes(df, *bounds).collect()
        for run in range(60):
            assert sorted((r["place"], r["status"]) for r in found if r["run"] == run) == plain_images([r[1:] for r in rows if r[0] == run], *bounds)
