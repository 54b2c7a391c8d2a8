"""Behaviour of single operators on small rows."""

import pytest
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.functions import urls as U
from evispark.operators import checks, dedup, documents, joins, ocr, pages, pagination, queue, rollups, targets


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Ex.com/a?utm_source=x&b=&a=1#frag", "https://ex.com/a?b=&a=1#frag"),
        ("http://ex.com", "http://ex.com/"),
        ("http://ex.com/?fbclid=1&gclid=2", "http://ex.com/"),
        ("ftp://ex.com", None),
        ("not a url", None),
    ],
)
def test_canonical(spark, url, expected):
    assert one(spark, U.canonical(F.col("u")), u=url) == expected


def test_static_canonical_sorts_and_drops_fragment(spark):
    assert one(spark, U.canonical_static(F.col("u")), u="http://EX.com:80//a//b?z=1&a=2&utm_x=3#f") == "http://ex.com/a/b?a=2&z=1"


def test_url_keys(spark):
    assert one(spark, U.keys(F.col("u")), u="https://app.mokahr.com/campus_apply/acme/12") == ["exact:app.mokahr.com/campus_apply/acme/12", "tenant:mokahr:acme"]
    assert one(spark, U.keys(F.col("u")), u="https://www.acme.com/Jobs/") == ["exact:acme.com/jobs", "host:acme.com"]
    assert one(spark, U.keys(F.col("u")), u="https://mp.weixin.qq.com/s/1") == ["exact:mp.weixin.qq.com/s/1"]


@pytest.mark.parametrize("url, detail", [("https://x.com/job/detail?id=1", True), ("https://x.com/jobs/list", False), ("https://x.com/jobs/123", True), ("https://x.com/?jobId=4", True), ("https://x.com/about", False)])
def test_detail_urls(spark, url, detail):
    assert one(spark, U.is_detail(F.col("u")), u=url) is detail


@pytest.mark.parametrize("title, priority", [("大模型算法工程师", 3), ("Agent开发工程师", 2), ("计算机视觉工程师", 1), ("销售经理", None), ("RAG应用", 2)])
def test_classify(spark, title, priority):
    assert one(spark, T.classify(F.col("t")), t=title) == priority


def test_clean_and_ids(spark):
    assert one(spark, T.clean(F.col("t")), t="　a \n\t b　") == "a b"
    same = one(spark, T.stable_id(F.col("a")) == T.stable_id(F.col("b")), a="Acme  Co", b="acme co")
    assert same is True


def test_titles(spark):
    assert one(spark, T.clean_title(F.col("t")), t="算法工程师 发布于 2026-01-01") == "算法工程师"
    assert one(spark, T.expand_role(F.col("t")), t="研发类生产类销售类,Agent开发") == ["Agent开发"]
    assert one(spark, T.expand_role(F.col("t")), t="视觉算法工程师 测试工程师") == ["视觉算法工程师", "测试工程师"]


def test_company_tokens(spark):
    assert set(one(spark, T.company_tokens(F.col("c")), c="甲乙科技有限公司（丙丁）")) == {"甲乙", "丙丁"}


def test_deadlines(spark):
    day = F.lit("2026-06-01").cast("date")
    for value, expected in (("2026-06-01", "open"), ("2026/05/31", "expired"), ("尽快", "open"), ("/", "unknown"), ("soon", "unknown")):
        assert one(spark, T.deadline_status(F.col("v"), day), v=value) == expected


def test_ownership(spark):
    status = lambda nature, told: one(spark, T.ownership(F.col("n"), F.col("s"))["confidence"], n=nature, s=told)
    assert (status("国企", ""), status("民企", ""), status("", ""), status("", "明确国企"), status("", "非国企")) == ("high", "medium", "low", "high", "low")


def test_chunks_and_budget(spark):
    assert one(spark, F.transform(T.chunks(F.col("t"), 3), F.length), t="abcdefgh") == [3, 3, 2]
    assert one(spark, F.size(T.chunks(F.col("t"), 3)), t="") == 0
    docs = spark.createDataFrame([(1, "abcd", None, "efgh")], "k int, a string, b string, c string")
    assert rows(documents.limited_fields(docs, "k", ["a", "b", "c"], 6)) == [(1, "abcd", "", "ef", "c")]


def test_import_is_idempotent_and_keeps_one_task(spark):
    raw = spark.createDataFrame(
        [("f", 2, "2026", "甲", "大模型", "https://a.com/x?utm_s=1"), ("f", 3, "2026", "乙", "", "https://a.com/x，"), ("f", 4, "", "丙", "", "https://b.com"), ("f", 5, "2026", "丁", "", "https://?")],
        "input_path string, row_number int, updated string, company string, role string, link string",
    )
    out = queue.import_rows(raw, ["updated", "company"], ["company", "role"], ["link"])
    assert out["sources"].count() == 3
    assert rows(out["tasks"].select("url", "priority")) == [("https://a.com/x", 10)]
    assert out["bridge"].count() == 2 and out["events"].count() == 1
    again = queue.upsert(out["tasks"], out["tasks"], "task_id")
    assert rows(again.select("url", "priority")) == [("https://a.com/x", 10)]


def test_claim_and_retry(spark):
    tasks = spark.createDataFrame([(1, "pending", 5, 0), (2, "retry_wait", 9, 50), (3, "retry_wait", 9, 5), (4, "ok", 99, 0)], "task_id int, status string, priority int, available_at int")
    assert [r[0] for r in queue.claim(tasks, F.lit(10), 2).collect()] == [3, 1]
    delays = spark.range(1, 6).select(queue.retry_delay(F.col("id"))).collect()
    assert [r[0] for r in delays] == [5, 10, 20, 40, 60]


def test_circuit_opens_after_the_eleventh_failure(spark):
    runs = spark.range(15).withColumn("run", F.lit(1))
    out = queue.circuit_breaker(runs, ["run"], ["id"], F.lit(True))
    assert [r["id"] for r in out.where("deferred").orderBy("id").collect()] == [11, 12, 13, 14]


def test_pacing(spark):
    asked = spark.createDataFrame([("d", 1, 0.0), ("d", 2, 1.0), ("d", 3, 100.0), ("d", 4, 101.0)], "d string, n int, t double")
    assert [r["start"] for r in queue.paced_starts(asked, "d", ["n"], F.col("t"), 10).orderBy("n").collect()] == [0, 10, 100, 110]


def test_first_last_and_precedence(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert rows(dedup.first_wins(df, ["k"], [F.col("o")])) == [("a", 1, "x"), ("b", 3, "z")]
    assert rows(dedup.last_wins(df, ["k"], ["o"])) == [("a", 2, "y"), ("b", 3, "z")]
    over = dedup.precedence([df.where("o = 2"), df.where("o <> 2")], ["k"])
    assert rows(over) == [("a", 2, "y"), ("b", 3, "z")]


def test_overlay_keeps_what_the_new_row_lacks(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "k string, v string, w string")
    new = spark.createDataFrame([("a", "", "9"), ("c", "n", "3")], "k string, v string, w string")
    assert rows(dedup.overlay(old, new, ["k"])) == [("a", "x", "9"), ("b", "y", "2"), ("c", "n", "3")]


def test_anonymous_records_never_merge(spark):
    df = spark.createDataFrame([("t", "", 1, ["s1"]), ("t", "", 2, ["s2"]), ("u", "id", 3, ["s1"]), ("u", "id", 4, ["s2", "s1"])], "title string, id string, o int, src array<string>")
    out = dedup.merge_records(df, ["title", "id"], "o", ["id"], ["src"])
    assert rows(out, "o") == [("t", "", 1, ["s1"]), ("t", "", 2, ["s2"]), ("u", "id", 3, ["s1", "s2"])]


def test_repeated_lines(spark):
    long = "a line that is long enough to count"
    df = spark.createDataFrame([(1, f"{long}\nshort\n{long}\nshort"), (2, None)], "k int, text string")
    assert rows(dedup.without_repeated_lines(df, "text", ["k"])) == [(1, f"{long}\nshort\nshort", 1), (2, "", 0)]


def test_task_lookup_falls_back_to_the_same_article(spark):
    tasks = spark.createDataFrame([("https://mp.weixin.qq.com/s?a=1", "pending"), ("https://mp.weixin.qq.com/s?a=2", "ok"), ("https://b.com/", "pending")], "url string, status string")
    found = spark.createDataFrame([(1, "bad", "https://mp.weixin.qq.com/s?a=1"), (2, "https://b.com", "https://mp.weixin.qq.com/s?a=2"), (3, "x", "y")], "k int, u1 string, u2 string")
    out = joins.task_lookup(found, ["k"], ["u1", "u2"], tasks)
    assert rows(out.select("k", "status")) == [(1, "ok"), (2, "pending"), (3, "not_started")]


def test_applied_names(spark):
    names = spark.createDataFrame([("甲乙科技",), ("甲乙丙",), ("某某医学影像中心",), ("无关",)], "company string")
    history = spark.createDataFrame([("甲乙",), ("医学影像",)], "recorded string")
    out = dict(rows(joins.applied_companies(names, "company", history, "recorded").select("company", "applied")))
    assert out == {"甲乙科技": True, "甲乙丙": True, "某某医学影像中心": True, "无关": False}


def test_descendants(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent int, id int")
    assert rows(joins.descendants(edges, spark.createDataFrame([(1,)], "id int"))) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_descendants_of_a_deep_tree(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(20, 1), (1, 10)], "parent int, id int")
    far = lambda i: i - 1 if i < 10 else i - 9
    assert rows(joins.descendants(edges, spark.createDataFrame([(1,)], "id int"))) == [(1, i, far(i)) for i in range(1, 21)]
    chain = edges.where("not (parent = 1 and id = 10)")
    assert rows(joins.descendants(chain, spark.createDataFrame([(1,)], "id int"))) == [(1, i, i - 1) for i in range(1, 21)]


def test_zero_filled_and_clusters(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)], "s string, i int")
    assert rows(rollups.zero_filled(df, "s", ["a", "b"])) == [("a", 5), ("b", 0)]
    assert rows(rollups.clusters(df, ["s"], "i", "i")) == [("a", 5, "0,1,2")]


def test_pagination(spark):
    pages_ = spark.createDataFrame([(1, 1, 4, 2, False), (1, 2, 4, 2, True), (2, 1, 3, 2, False), (2, 2, 3, 2, True), (3, 1, 9, 9, False)], "run int, page int, total int, total_pages int, last boolean")
    items = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (1, 2, "d"), (2, 1, "a"), (2, 1, "b"), (2, 2, "a"), (2, 2, "b"), (3, 1, "z")], "run int, page int, item string")
    out = {r["run"]: r for r in pagination.proof(items, pages_).collect()}
    assert out[1]["list_complete"] and out[1]["terminal"] == "last_page"
    assert not out[2]["list_complete"] and {"repeated_page", "duplicate_item_ids"} <= set(out[2]["reasons"].split(","))
    assert out[3]["terminal"] == "none" and not out[3]["list_complete"]


HTML = """<html><head><title>T</title><script>var x = "verify you are human"</script></head><body><nav><a href="/jobs">jobs</a></nav>
<article><h1>Head</h1><p>One<p>Two <a href="#/job/1">engineer</a><img data-src="/i.png" src="x.gif"><img srcset="a.png 1x, b.png 2x"></article>
<a class="btn disabled" href="/2">next</a></body></html>"""


def test_html(spark):
    page = pages.parse(HTML, "https://x.com/a")
    assert page["title"] == "T" and page["h1"] == "Head" and "verify" not in page["text"]
    assert page["article_text"] == "Head\nOne\nTwo engineer"
    assert page["images"] == ["https://x.com/i.png", "https://x.com/b.png"]
    assert page["has_disabled_next"] and not page["has_next"]
    assert [x["url"] for x in page["links"]] == ["https://x.com/jobs", "https://x.com/a#/job/1", "https://x.com/2"]
    df = spark.createDataFrame([(1, "https://x.com/a", HTML), (2, None, None)], "page_id long, url string, html string")
    out = pages.extract(df)
    status = pages.page_status(F.col("title"), F.col("text"), F.col("article_text"), F.lit(200), F.col("password_form"))
    assert rows(out.select("page_id", status.alias("s"))) == [(1, "ok"), (2, "partial")]


def test_targets(spark):
    candidates = spark.createDataFrame(
        [
            (1, "甲", "民企", "", "医疗", '[{"priority":1,"role":"大模型算法工程师"},{"priority":2,"role":"Agent开发"}]', "2"),
            (2, "乙", "国企", "", "医疗", "[]", "3"),
            (3, "丙", "", "", "医疗", "not json", "4"),
            (4, "丁", "", "", "医疗", '[{"priority":1,"role":"Agent开发"}]', "5"),
        ],
        "candidate int, company string, enterprise_nature string, ownership_status string, industry string, matched_roles string, source_row string",
    )
    tasks = spark.createDataFrame([(4, "error", "x.com", "", "")], "candidate int, status string, host string, stop_reason string, page_text string")
    jobs = spark.createDataFrame([(1, 0, "Agent开发", "text", "https://x.com/1")], "candidate int, at int, title string, job_text string, url string")
    audits = spark.createDataFrame([], "company string, source_row string, evidence string")
    built = targets.build(candidates, tasks, jobs, audits)
    companies = {r["company"]: r for r in built["companies"].collect()}
    assert set(companies) == {"甲", "丙", "丁"}
    assert companies["甲"]["best_priority"] == 2 and companies["甲"]["matched_role_count"] == 2 and companies["甲"]["evidence_level"] == "structured_job"
    assert companies["丙"]["matched_role_count"] == 0
    parts = targets.split(built["companies"], built["jobs"])
    names = lambda k: {r["company"] for r in parts[k].collect()}
    assert names("applicable") == {"甲", "丁"} and names("error") == {"丁"} and names("pending") == {"丙"} and names("verified") == {"甲"}
    assert [r["role"] for r in parts["verified_jobs"].collect()] == ["Agent开发"]


def test_preprocess_reasons(spark):
    df = spark.createDataFrame([("d", "", None, "短", ["识别"], None, 1, "ok")], "doc string, html_text string, html_certain boolean, text string, ocr array<string>, coverage_complete boolean, unresolved int, status string")
    row = documents.preprocess(df).first()
    assert row["text"] == "短\n识别" and row["reasons"] == "insufficient_body,coverage_unconfirmed,unresolved_evidence"


def test_ocr_lines_of_two_slices(spark):
    df = spark.createDataFrame(
        [("i", 0, 0, "a", 0.5, 0, 0, 10, 10), ("i", 1, 0, "a", 0.9, 1, 1, 10, 10), ("i", 1, 1, "a", 0.1, 50, 50, 5, 5), ("i", 0, 1, "a", 0.2, 0, 0, 10, 10)],
        "image string, slice_index int, line_index int, text string, confidence double, left int, top int, width int, height int",
    )
    # Of the first image's lines only those of another slice are compared, so the second of slice 0 stays.
    assert rows(ocr.survivors(df).select("slice_index", "line_index")) == [(0, 1), (1, 0), (1, 1)]


def test_checks(spark):
    a = spark.createDataFrame([(1, 2, 0), (2, 1, 5)], "k int, q int, r int")
    b = spark.createDataFrame([(1, 1, 9), (2, 1, 5)], "k int, q int, r int")
    assert [(r["k"], r["kept"]) for r in checks.better(a, b, "k", ["q", "r"]).orderBy("k").collect()] == [(1, "after"), (2, "before")]
    assert rows(checks.delta(a.where("k = 1"), b.where("k = 2"), "k")) == [(1, "added"), (2, "removed")]


def test_scopes(spark):
    a = spark.createDataFrame([("1", "x", ""), ("1", "x", "full")], "company_id string, company string, note string")
    out = targets.merge_scopes({"s": a, "t": a.limit(1)}, "company_id", ["company"])
    assert rows(out.select("screening_scope", "note")) == [("s", "full"), ("t", "")]
    with pytest.raises(ValueError):
        targets.merge_scopes({" ": a}, "company_id", ["company"])
    with pytest.raises(Exception, match="has no company_id"):
        targets.merge_scopes({"s": spark.createDataFrame([("", "x")], "company_id string, company string")}, "company_id", ["company"]).collect()


def test_preferred_role_is_an_ordered_fold(spark):
    from evispark.operators import audit

    data = [("k", i, f"t{i}", "s" * n, "e" * m, hit) for i, (n, m, hit) in enumerate([(10, 5, False), (6, 6, False), (9, 2, False), (3, 1, True), (2, 2, False), (2, 1, True), (1, 1, True)])]
    df = spark.createDataFrame(data, "k string, o int, title string, segment string, excerpt string, matched boolean")
    held = data[0]
    for x in data[1:]:
        if (x[5] and not held[5]) or (x[5] == held[5] and len(x[3]) > len(held[4])):
            held = x
    assert audit.preferred_role(df, "k", "o").first()["title"] == held[2]


def test_role_mentions(spark):
    from evispark.operators import audit

    df = spark.createDataFrame([("AI算法", ""), ("销售", "我们公司是AI 企业"), ("销售", "公司岗位要求: 机器学习"), ("销售", "x\ny"), (None, None)], "t string, s string")
    assert [r[0] for r in df.select(audit.role_mentions_ai(F.col("t"), F.col("s"))).collect()] == [True, False, True, False, False]


def test_registry_of_rules(spark):
    from evispark.operators import routing

    rules = routing.Registry()
    rules.register(routing.Rule("mine", 300, lambda u: F.contains(u, F.lit("mine"))))
    assert rules.describe()[0]["name"] == "mine"
    df = spark.createDataFrame([("https://mine.example/",), ("https://b.zhiye.com/x",), ("no",)], "u string")
    assert [r[0] for r in df.select(rules.chosen(F.col("u"))).collect()] == ["mine", "ZhiyePublicPortal", None]
    try:
        rules.register(routing.Rule("mine", 1, lambda u: F.lit(True)))
        raise AssertionError("a name was taken twice")
    except ValueError:
        pass


def test_names_in_titles_without_blanks(spark):
    from evispark.operators import routing

    titles = spark.createDataFrame([(2, "上海某某科技招聘"), (1, "没有科技"), (3, ""), (4, None)], "o int, title string")
    names = spark.createDataFrame([("某某科技",), ("科技",), ("海",), ("科",), ("别的",), ("",), (None,)], "name string")
    assert rows(routing.contained_names(names, titles, "name", "title", "o").select("name", "contained_in").where("name <> ''"), "name") == [
        ("别的", None), ("某某科技", "上海某某科技招聘"), ("海", "上海某某科技招聘"), ("科", "没有科技"), ("科技", "没有科技"),
    ]


def test_rows_numbered_across_ranges(spark):
    from evispark.operators import ranges

    df = spark.range(0, 5000).selectExpr("(id * 7919) % 5000 AS k", "id % 13 AS v")
    found = ranges.positions(df, [], ["v", "k"], "place").collect()
    assert [(r["v"], r["k"]) for r in sorted(found, key=lambda r: r["place"])] == sorted((r["v"], r["k"]) for r in found)
    assert sorted(r["place"] for r in found) == list(range(1, 5001))
    assert ranges.positions(df.where("false"), [], ["v", "k"], "place").count() == 0


def test_running_values_of_groups(spark):
    from evispark.operators import ranges

    df = spark.range(0, 3000).selectExpr("if(id % 3 = 0, null, if(id % 7 < 6, 1, id % 11)) AS g", "(id * 7919) % 3000 AS k", "(id * 31) % 101 AS v")
    found = ranges.running(df, ["g"], ["k"], {"n": F.lit(1)}, {"top": F.col("v")}).collect()
    rows_ = sorted(found, key=lambda r: r["k"])
    seen = {}
    for r in rows_:
        n, top = seen.get(r["g"], (0, -1))
        seen[r["g"]] = n + 1, max(top, r["v"])
        assert (r["n"], r["top"]) == seen[r["g"]]


def test_natural_order_of_long_numbers(spark):
    from evispark.operators import export

    values = ["a1", "a" + "9" * 25, "a1" + "0" * 25, "a007", "a10", "b", "5", "12"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r["c"] for r in df.orderBy(*export.natural_order("c")).collect()] == ["5", "12", "a1", "a007", "a10", "a" + "9" * 25, "a1" + "0" * 25, "b"]


def test_artifact_references(spark):
    from evispark.operators import acceptance

    df = spark.createDataFrame([("a", ["b", "", "a"], [("c", None)])], "x string, l array<string>, e array<struct<raw_ref:string,path:string>>")
    assert df.select(acceptance.artifact_refs([F.col("x")], [F.col("l")], F.col("e"), ["raw_ref", "path"])).first()[0] == ["a", "b", "c"]


def test_public_images(spark):
    from evispark.operators import routing

    urls = ["https://mmbiz.example/a/1.jpg?wx_fmt=png", "http://mmbiz.example/a/1", "https://mmbiz.example:8443/a/1", "https://u@mmbiz.example/a/1", "https://mmbiz.example/a/1?x=1", "https://mmbiz.example/b", "https://mmbiz.example/a/1#f"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(routing.public_image(F.col("u"), {"mmbiz.example": ["/a/"]})).collect()] == [True, *[False] * 6]


def test_search_and_listing_order(spark):
    from evispark.operators import export

    df = spark.createDataFrame([(1, "Ab", "u")], "source_id int, company string, url string")
    assert export.listing(df).columns == ["company", "url", "source_id"] and export.searched(df, "B U").count() == 1 and export.searched(df, "zz").count() == 0
