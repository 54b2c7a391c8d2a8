"""Saved JSON and links over the driver's tables: events carry nested payloads, suppliers are lists that were read page by page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import urls as U
from ..operators import listing, pagination, payloads
from .base import Registry

R = Registry()

# Payloads in four shapes with the events' own props inside; the same text in Spark and DuckDB.
_BODY = """CASE event_id % 4 WHEN 0 THEN concat('{"data":{"totalRows":', user_id, ',"records":[{"jobId":"', event_id, '","jobName":"', event_type, '","more":', props, '}]}}')
    WHEN 1 THEN concat('{"Count":', user_id, ',"Data":[{"Id":"g","JobAdId":', event_id, ',"JobAdName":"', event_type, '","Category":"', CASE user_id % 3 WHEN 0 THEN '校园招聘' WHEN 1 THEN '实习' ELSE '' END, '","Duty":"d","Require":', props, '}]}')
    WHEN 2 THEN concat('[[{"title":"', event_type, '","href":"../j/./', event_id, '","description":""}],{"x":{"list":[{"name":"', event_type, '","id":', user_id, ',"claim":"c"},{"name":"plain","id":', event_id, '},', props, ']}}]')
    ELSE concat('{"a":{"b":{"total":', event_id % 50, ',"c":{"d":', props, ',"e":[{"title":"only"},{"positionName":"', event_type, '","id":', user_id % 40, ',"children":[{"code":"', event_id, '","title":"', event_type, '","requirements":"r"}]}]}}}}') END"""
_BASE = "CASE WHEN event_id % 4 = 1 THEN 'https://demo.zhiye.com/api/list' ELSE concat('https://e', user_id % 5, '.example.com/a/b/') END"


def _member(name: str) -> str:
    return f"json_extract(v, '$.{name}')"


def _text(name: str) -> str:
    return f"CASE WHEN json_type({_member(name)}) = 'VARCHAR' THEN {_member(name)} ->> '$' END"


def _coalesce(names, form) -> str:
    return f"coalesce({', '.join(form(n) for n in names)})"


def _any(names, form) -> str:
    return f"({' OR '.join(form(n) for n in names)})"


_SAYS = lambda n: f"coalesce({_member(n)}::VARCHAR NOT IN ('null', 'false', '0', '\"\"', '[]', '{{}}'), false)"
_IDENT = lambda n: f"CASE WHEN json_type({_member(n)}) IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN {_member(n)} ->> '$' END"
_TEXTS = ", ".join(f"CASE WHEN {_SAYS(k)} THEN CASE WHEN json_type({_member(k)}) = 'VARCHAR' THEN {_member(k)} ->> '$' ELSE {_member(k)}::VARCHAR END END" for k in rules.JOB_BODY_KEYS)
_OBJECTS = f"o AS (SELECT event_id, user_id, base, j.value AS v, j.id AS node_id FROM (SELECT event_id, user_id, {_BASE} AS base, {_BODY} AS body FROM events) b, json_tree(b.body) j WHERE j.type = 'OBJECT')"
_JOBS = f"""{_OBJECTS}, f AS (SELECT *, {_coalesce(rules.JOB_TITLE_KEYS, lambda n: f"CASE WHEN json_type({_member(n)}) = 'VARCHAR' THEN '{n}' END")} AS by_key, {_coalesce(rules.JOB_TITLE_KEYS, _text)} AS title, {_coalesce(rules.JOB_ID_KEYS, _IDENT)} AS ident,
    coalesce({', '.join(_text(n) for n in rules.JOB_LINK_KEYS)}, '') AS link, regexp_extract(base, '^https://([^/]*)', 1) AS origin, coalesce({_text('Category')}, '') AS category, concat_ws(chr(10), {_TEXTS}) AS text FROM o),
    g AS (SELECT *, CASE WHEN link = '' AND ident IS NOT NULL AND origin LIKE '%zhiye.com' THEN '/' || CASE WHEN category LIKE '%校园%' THEN 'campus' WHEN category LIKE '%实习%' THEN 'intern' ELSE 'social' END || '/jobdetails?jobId=' || ident ELSE link END AS way FROM f
      WHERE title <> '' AND (ident IS NOT NULL OR link <> '') AND ((by_key = 'name' AND {_any(('responsibility', 'claim'), _SAYS)}) OR {_any(rules.JOB_ONLY_KEYS, lambda n: f"{_member(n)} IS NOT NULL")}
        OR (by_key <> 'name' AND {_any(rules.JOB_BODY_KEYS, lambda n: f"{_member(n)} IS NOT NULL")}))),
    h AS (SELECT *, CASE WHEN way = '' THEN '' WHEN way LIKE '../%' THEN 'https://' || origin || '/a/' || replace(substr(way, 4), './', '') ELSE 'https://' || origin || way END AS url FROM g),
    jobs AS (SELECT *, substr(sha256(origin || ':' || coalesce(ident, url)), 1, 24) AS id FROM h)"""


def _bodies(t):
    return t.events.select("event_id", "user_id", F.expr(_BASE).alias("base"), F.expr(_BODY).alias("body"))


@R.add(f"WITH {_JOBS} SELECT event_id, id, title, url, text FROM jobs")
def q_json_jobs(t):
    """Jobs at any depth of the events' payloads."""
    found = payloads.objects(_bodies(t), ["event_id", "base"])
    return payloads.json_jobs(found).select("event_id", "id", "title", "url", "text")


_TOTAL = f"greatest({', '.join(f'CASE WHEN json_type({_member(n)}) IN (' + chr(39) + 'UBIGINT' + chr(39) + ') THEN ' + _member(n) + '::BIGINT END' for n in rules.TOTAL_KEYS)})"


@R.add(f"WITH {_OBJECTS} SELECT event_id, max({_TOTAL})::BIGINT AS total FROM o GROUP BY 1 HAVING max({_TOTAL}) IS NOT NULL")
def q_json_totals(t):
    """The largest total that each payload reports under any alias."""
    return payloads.reported_totals(payloads.objects(_bodies(t), ["event_id"]), ["event_id"])


@R.add(
    f"""WITH {_JOBS}, u AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1),
    told AS (SELECT user_id, max({_TOTAL})::BIGINT AS t FROM o GROUP BY 1), kept AS (SELECT user_id, id FROM (SELECT user_id, substr(sha256(origin || ':' || ident), 1, 24) AS id FROM jobs WHERE ident IS NOT NULL AND event_id % 4 = 0)),
    fresh AS (SELECT DISTINCT user_id, id FROM jobs WHERE (user_id, id) NOT IN (SELECT user_id, id FROM kept)),
    links AS (SELECT user_id, url FROM (SELECT user_id, arg_min(url, (event_id, node_id)) AS url FROM jobs WHERE (user_id, id) NOT IN (SELECT user_id, id FROM kept) GROUP BY user_id, id) WHERE url <> '' UNION SELECT user_id, 'https://old.example.com/' FROM u)
    SELECT u.user_id AS result, CASE WHEN t > 0 OR t IS NULL THEN coalesce(t, 0) ELSE 0 END::BIGINT AS total, (SELECT count(*) FROM kept WHERE kept.user_id = u.user_id) + (SELECT count(*) FROM fresh WHERE fresh.user_id = u.user_id) AS jobs,
      (SELECT count(*) FROM links WHERE links.user_id = u.user_id)::BIGINT AS urls, (SELECT count(DISTINCT event_id) FROM jobs WHERE jobs.user_id = u.user_id)::BIGINT AS reparsed FROM u LEFT JOIN told USING (user_id)"""
)
def q_reparse(t):
    """Users' results after their events' payloads are read again: a job in four was known, and each has a stale one."""
    events = t.events
    users = events.groupBy("user_id").agg(F.min("event_id").alias("first"))
    results = users.select(F.col("user_id").alias("result"), F.lit("https://none.example.com/").alias("url"), F.lit(0).cast("long").alias("total"), F.array(F.lit("https://old.example.com/")).alias("detail_urls"))
    origin = F.concat(F.lit("e"), F.col("user_id") % 5, F.lit(".example.com:"))
    known = events.where("event_id % 4 = 0").select(
        F.col("user_id").alias("result"), F.col("event_id").alias("nth"), F.substring(F.sha2(F.concat(origin, F.col("event_id").cast("string")), 256), 1, 24).alias("id"), F.col("event_type").alias("title"),
        F.lit("").alias("url"), F.lit("").alias("text"), F.lit(None).cast("string").alias("raw"),
    )
    stale = users.select(F.col("user_id").alias("result"), F.lit(-1).cast("long").alias("nth"), F.lit("stale").alias("id"), F.lit("plain").alias("title"), F.lit("https://gone.example.com/").alias("url"), F.lit("").alias("text"), F.lit('{"name":"plain","id":1}').alias("raw"))
    artifacts = events.select(F.col("user_id").alias("result"), F.col("event_id").alias("nth"), F.concat(F.lit('{"url":"'), F.expr(_BASE), F.lit('","body":'), F.expr(_BODY), F.lit("}")).alias("body"))
    merged, coverage = payloads.reparse(results, known.unionByName(stale), artifacts)
    counts = merged.groupBy("result").agg(F.count("*").alias("jobs"))
    return coverage.join(counts, "result", "left").select("result", "total", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.size("detail_urls").cast("long").alias("urls"), F.size("reparsed").cast("long").alias("reparsed"))


# Lists: a supplier's line items in twelve pages, read and told in fourteen ways.
_ITEMS = """(SELECT run, page, CASE WHEN way = 4 AND page = 3 THEN first_ids + slot WHEN way = 5 AND page = 2 AND slot = 0 THEN first_ids ELSE item END AS item FROM
    (SELECT *, row_number() OVER (PARTITION BY run, page ORDER BY item) - 1 AS slot, run * 1000000 AS first_ids FROM
    (SELECT l_suppkey AS run, l_suppkey % 14 AS way, n, l_suppkey * 1000000 + n - 1 AS item, 1 + (n - 1) * 12 // greatest(total, 1) AS page FROM
    (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)))
    WHERE NOT (way = 11 AND page = 4) AND NOT (way IN (3, 11) AND page = 12) AND NOT (way = 4 AND page = 3 AND slot >= (SELECT 1000000)))"""
_PAGES = """(SELECT run, page, CASE WHEN way IN (3, 10, 12) THEN NULL WHEN way = 1 THEN all_items + 1 WHEN way = 6 THEN all_items - 5 WHEN way = 8 AND page = 2 THEN all_items + 7 WHEN way = 13 THEN all_items - last_items ELSE all_items END::BIGINT AS total,
    CASE WHEN way IN (2, 3, 12) THEN NULL WHEN way = 10 THEN 1 WHEN way = 9 AND page = 5 THEN 11 ELSE 12 END::BIGINT AS total_pages, CASE WHEN way IN (2, 3, 10, 11, 12) THEN NULL WHEN way = 7 THEN page = 2 ELSE page = 12 END AS last,
    CASE WHEN way = 0 AND run % 3 = 0 AND page = 6 THEN page + 1 ELSE page END::BIGINT AS actual FROM
    (SELECT l_suppkey AS run, l_suppkey % 14 AS way, all_items, (all_items - 1) - (11 * all_items + 11) // 12 + 1 AS last_items, unnest(range(1, 13)) AS page FROM (SELECT l_suppkey, count(*) AS all_items FROM lineitem GROUP BY 1)))"""


def _list_tables(t):
    """Items and pages of the lists, as the SQL has them."""
    from pyspark.sql import Window

    c = F.col
    by = Window.partitionBy("l_suppkey")
    line = t.lineitem.select(c("l_suppkey").alias("run"), F.row_number().over(by.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("n"), F.count("*").over(by).alias("total"))
    way = c("run") % 14
    line = line.select("run", way.alias("way"), (c("run") * 1000000 + c("n") - 1).alias("item"), (1 + F.floor((c("n") - 1) * 12 / F.greatest("total", F.lit(1)))).cast("long").alias("page"))
    line = line.withColumn("slot", F.row_number().over(Window.partitionBy("run", "page").orderBy("item")) - 1)
    base = c("run") * 1000000
    item = F.when((c("way") == 4) & (c("page") == 3), base + c("slot")).when((c("way") == 5) & (c("page") == 2) & (c("slot") == 0), base).otherwise(c("item"))
    items = line.where(~((c("way") == 11) & (c("page") == 4)) & ~(c("way").isin(3, 11) & (c("page") == 12))).select("run", "page", item.alias("item"))
    sizes = t.lineitem.groupBy(c("l_suppkey").alias("run")).agg(F.count("*").alias("n")).select("run", way.alias("way"), "n", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page"))
    w, n, p = c("way"), c("n"), c("page")
    last_items = (n - 1) - F.floor((11 * n + 11) / 12) + 1
    total = F.when(w.isin(3, 10, 12), None).when(w == 1, n + 1).when(w == 6, n - 5).when((w == 8) & (p == 2), n + 7).when(w == 13, n - last_items).otherwise(n)
    of = F.when(w.isin(2, 3, 12), None).when(w == 10, 1).when((w == 9) & (p == 5), 11).otherwise(12)
    last = F.when(w.isin(2, 3, 10, 11, 12), None).when(w == 7, p == 2).otherwise(p == 12)
    actual = F.when((w == 0) & (c("run") % 3 == 0) & (p == 6), p + 1).otherwise(p)
    return items, sizes.select("run", p.cast("long").alias("page"), total.cast("long").alias("total"), of.cast("long").alias("total_pages"), last.alias("last"), actual.cast("long").alias("actual"))


@R.add(
    f"""WITH RECURSIVE items AS MATERIALIZED {_ITEMS}, pages AS MATERIALIZED {_PAGES},
    p AS MATERIALIZED (SELECT run, page, total, total_pages, last, actual, coalesce(list_sort(ids), []) AS ids FROM pages LEFT JOIN (SELECT run, page, list(item) AS ids FROM items GROUP BY 1, 2) USING (run, page)),
    s AS (SELECT run, 0::BIGINT AS page, []::BIGINT[] AS seen, []::VARCHAR[] AS sigs, NULL::BIGINT AS total, NULL::BIGINT AS pages, 'none' AS terminal, []::VARCHAR[] AS reasons, false AS stop FROM (SELECT DISTINCT run FROM pages)
    UNION ALL
    SELECT run, page, CASE WHEN error IS NULL THEN now ELSE seen END, list_append(sigs, sig), CASE WHEN error IN ('actual_page_mismatch', 'total_changed') THEN total ELSE coalesce(told, total) END, coalesce(told_pages, pages),
      CASE WHEN error IS NOT NULL OR dup OR over OR torn THEN 'none' WHEN len(ids) = 0 THEN 'empty_page' WHEN is_last OR declared THEN 'last_page' WHEN len(now) = told THEN 'response_total_reached' ELSE 'none' END,
      CASE WHEN error IS NOT NULL THEN [error] WHEN dup THEN list_filter([CASE WHEN rep THEN 'repeated_page' END, CASE WHEN len(now) < len(seen) + len(ids) THEN 'duplicate_item_ids' END], lambda x: x IS NOT NULL) WHEN over THEN ['collected_count_exceeds_total']
        WHEN torn THEN ['last_page_total_pages_mismatch'] WHEN len(ids) = 0 THEN CASE WHEN page < told_pages THEN ['empty_page_before_last'] ELSE [] END WHEN is_last OR declared THEN []
        WHEN len(now) = told THEN list_filter([CASE WHEN told_pages IS NOT NULL THEN 'total_reached_before_last_page' END, CASE WHEN marked AND NOT is_last THEN 'total_reached_without_last_marker' END], lambda x: x IS NOT NULL) ELSE [] END,
      coalesce(error IS NOT NULL OR dup OR over OR torn OR len(ids) = 0 OR is_last OR declared OR len(now) = told, false)
    FROM (SELECT *, coalesce(len(now) > told, false) AS over, told_pages IS NOT NULL AND ((is_last AND NOT declared) OR (declared AND marked AND NOT is_last)) AS torn FROM
     (SELECT s.run, p.page, s.seen, s.sigs, s.total, s.pages, p.total AS told, p.total_pages AS told_pages, p.ids, p.last IS NOT NULL AS marked, coalesce(p.last, false) AS is_last, list_distinct(s.seen || p.ids) AS now,
       array_to_string(p.ids, ',') AS sig, len(p.ids) > 0 AND list_contains(s.sigs, array_to_string(p.ids, ',')) AS rep,
       (len(p.ids) > 0 AND list_contains(s.sigs, array_to_string(p.ids, ','))) OR len(list_distinct(s.seen || p.ids)) < len(s.seen) + len(p.ids) AS dup, coalesce(p.page = p.total_pages, false) AS declared,
       CASE WHEN p.actual <> p.page THEN 'actual_page_mismatch' WHEN p.total <> s.total THEN 'total_changed' WHEN p.total_pages <> s.pages THEN 'total_pages_changed' WHEN p.page > greatest(1, p.total_pages) AND p.total_pages IS NOT NULL THEN 'page_exceeds_total_pages' END AS error
      FROM s JOIN p ON p.run = s.run AND p.page = s.page + 1 WHERE NOT s.stop)))
    SELECT run, page AS pages_seen, len(seen)::BIGINT AS collected, total, terminal, array_to_string(all_reasons, ',') AS reasons, terminal <> 'none' AND len(all_reasons) = 0 AS list_complete FROM
     (SELECT *, reasons || CASE WHEN NOT stop AND page >= 12 THEN ['max_pages_reached'] ELSE [] END || CASE WHEN len(seen) <> total THEN ['total_count_mismatch'] ELSE [] END AS all_reasons FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY page DESC) = 1)"""
)
def q_pagination_proof(t):
    """Whether each list's pages prove that it is complete, page by page as they were read."""
    items, pages = _list_tables(t)
    return pagination.proof(items, pages, max_pages=12)


def _payload_tables(t):
    """The pages of five kinds of lists as JSON, and a configuration for each kind."""
    c = F.col
    kind = c("run") % 5
    # One shuffle by run serves all that follows.
    line = t.lineitem.select(c("l_suppkey").alias("run"), (c("l_orderkey") % 7 + 1).alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").repartition("run")
    # One line stands for each id, so that no id is there twice.
    line = line.groupBy("run", "page", F.when(c("l_linenumber").isNotNull(), c("l_orderkey")).alias("order"), "l_linenumber").agg(F.min("l_returnflag").alias("mode"), F.min("l_partkey").alias("part"))
    line = line.select("run", "page", F.concat("order", F.lit("-"), "l_linenumber").alias("id"), "mode", "part")
    item = F.struct("id", F.struct(F.struct(c("mode").alias("name")).alias("inner")).alias("t"), F.when(c("part") % 3 == 0, "暂无").when(c("part") % 3 == 1, "does things").alias("d"), F.concat(F.lit("needs "), c("part")).alias("r"))
    pages = line.groupBy("run", "page").agg(F.array_sort(F.collect_list(item)).alias("list"), F.count("*").alias("n"))
    runs = pages.groupBy("run").agg(F.sum(F.when(c("page").isNotNull(), c("n"))).alias("n"), F.map_from_entries(F.filter(F.collect_list(F.struct("page", "list")), lambda x: x["page"].isNotNull())).alias("lists"))
    every = runs.select("run", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("page"), "lists").select("run", "n", "page", F.try_element_at("lists", c("page")).alias("list"))
    rows = F.to_json(c("list"))
    some = F.coalesce(rows, F.lit("[]"))
    body = (
        F.when(kind == 0, F.concat(F.lit('{"data":{"total":'), c("n"), F.lit(',"list":'), some, F.lit("}}")))
        .when(kind == 1, F.concat(F.lit('{"r":[{"rows":'), some, F.lit(',"end":'), (c("page") == 8).cast("string"), F.lit("}]}")))
        .when(kind == 2, F.concat(F.lit('{"data":{"total":"'), c("n"), F.lit('","list":'), F.coalesce(rows, F.lit("null")), F.lit("}}")))
        .when(kind == 3, F.when(c("page") == 3, F.lit('{"data":{"total":1}}')).otherwise(F.concat(F.lit('{"data":{"list":'), some, F.lit("}}"))))
        .otherwise(F.concat(F.lit('{"ok":'), (c("page") < 4).cast("string"), F.lit(',"data":{"list":'), some, F.lit("}}")))
    )
    base = {"url": "https://lists.example.com/", "method": "GET", "location": "query", "page_path": "page", "items_path": "data.list", "id_path": "id", "success_path": None, "success_value": None, "actual_path": None, "total_path": None,
            "total_pages_path": None, "last_path": None, "null_items_are_empty": None, "fields": {"title": "t.inner.name", "description": "d", "requirements": "r", "url": "u"}, "company": "c", "scope": "s"}
    own = [{"total_path": "data.total"}, {"items_path": "r.0.rows", "last_path": "r.0.end", "id_path": None}, {"total_path": "data.total", "null_items_are_empty": True}, {}, {"success_path": "ok", "success_value": "true"}]
    names = [x.split()[0] for x in listing.CONFIG.split(", ")]
    configs = t.spark.createDataFrame([tuple({**base, "source": str(i), **x}[n] for n in names) for i, x in enumerate(own)], listing.CONFIG)
    return every.select(kind.cast("string").alias("source"), "run", "page", body.alias("body")), configs


# By kind: how many pages are read. A page without items ends a list unless the total is there first; kinds 3 and 4 end in errors.
_LISTS = """WITH line AS (SELECT l_suppkey AS run, l_orderkey % 7 + 1 AS page, l_orderkey || '-' || l_linenumber AS id, min(l_returnflag) AS mode, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2, 3),
    every AS (SELECT run, page, coalesce(k, 0) AS k, sum(coalesce(k, 0)) OVER (PARTITION BY run ORDER BY page)::BIGINT AS so_far, sum(coalesce(k, 0)) OVER (PARTITION BY run)::BIGINT AS n FROM (SELECT run, unnest(range(1, 9)) AS page FROM (SELECT DISTINCT run FROM line)) LEFT JOIN (SELECT run, page, count(*) AS k FROM line GROUP BY 1, 2) USING (run, page)),
    ends AS (SELECT run, min(page) AS stop FROM every WHERE k = 0 OR (run % 5 IN (0, 2) AND so_far = n) OR (run % 5 = 1 AND page = 8) OR (run % 5 = 3 AND page = 3) OR (run % 5 = 4 AND page = 4) GROUP BY 1),
    read AS (SELECT run, stop, run % 5 = 3 AND stop = 3 AS torn, run % 5 = 4 AND stop = 4 AS refused FROM ends)"""


@R.add(
    f"""{_LISTS} SELECT run, page, row_number() OVER (PARTITION BY run, page ORDER BY id) - 1 AS raw_index, CASE WHEN run % 5 <> 1 THEN id END AS id, mode AS title, CASE part % 3 WHEN 0 THEN '暂无' WHEN 1 THEN 'does things' END AS description,
    'needs ' || part AS requirements, part % 3 <> 1 AS needs_details, 'missing' AS url_provenance FROM line JOIN read USING (run) WHERE page < stop OR (page = stop AND NOT torn AND NOT refused)"""
)
def q_list_records(t):
    """The records of lists that are saved as JSON, mapped by each source's configuration."""
    records, _ = listing.collect(*_payload_tables(t), max_pages=8)
    return records.select("run", "page", F.col("raw_index").cast("long"), "id", "title", "description", "requirements", "needs_details", "url_provenance")


@R.add(
    f"""{_LISTS} SELECT run, stop::BIGINT AS pages_seen, got AS collected, CASE WHEN torn THEN 'none' WHEN refused THEN 'none' WHEN k = 0 THEN 'empty_page' WHEN run % 5 = 1 THEN 'last_page' ELSE 'response_total_reached' END AS terminal,
    CASE WHEN torn THEN 'items_not_objects' WHEN refused THEN 'success_marker_mismatch' WHEN run % 5 IN (0, 2) AND got <> n THEN 'total_count_mismatch' ELSE '' END AS reasons FROM
    (SELECT read.run, stop, torn, refused, n, k, CASE WHEN torn OR refused THEN so_far - k ELSE so_far END AS got FROM read JOIN every ON every.run = read.run AND every.page = read.stop)"""
)
def q_list_coverage(t):
    """How far each saved list was read, and what speaks against it."""
    _, coverage = listing.collect(*_payload_tables(t), max_pages=8)
    return coverage.select("run", "pages_seen", "collected", "terminal", "reasons")


_LINKS = """(SELECT page_id, url, v.i, CASE v.i WHEN 0 THEN h WHEN 1 THEN '..' || h WHEN 2 THEN '../.././' || substr(h, 2) || '/../x/' WHEN 3 THEN '?b=2&utm_x=1&Spm=2&a=' || page_id ELSE h || '/.?q=a.b&src=1&q=A#f' END AS ref FROM
    (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS h FROM pages), (VALUES (0), (1), (2), (3), (4)) v(i))"""
_WALKED = """list_reduce(string_split(merged, '/')[2:], lambda x, y: CASE y WHEN '..' THEN regexp_replace(x, '/[^/]*$', '') WHEN '.' THEN x ELSE x || '/' || y END, '') || CASE WHEN regexp_matches(merged, '/\\.\\.?$') THEN '/' ELSE '' END"""


@R.add(
    rf"""WITH r AS (SELECT page_id, url, i, ref, regexp_extract(url, '^(https?://[^/?#]*)([^?#]*)([?][^#]*)?', ['origin', 'path', 'query']) AS u, regexp_extract(ref, '^([^?#]*)([?][^#]*)?(#.*)?$', ['path', 'query', 'fragment']) AS f FROM {_LINKS}),
    m AS (SELECT *, CASE WHEN f.path = '' THEN u.path WHEN f.path LIKE '/%' THEN f.path ELSE regexp_replace(u.path, '[^/]*$', '') || f.path END AS merged FROM r),
    w AS (SELECT *, CASE WHEN f.path = '' THEN merged ELSE {_WALKED} END AS path FROM m)
    SELECT page_id, i, ref, u.origin || CASE WHEN path = '' THEN '/' ELSE path END || f.query || f.fragment AS resolved, lower(u.origin) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical
    FROM (SELECT *, list_sort(list_filter(string_split(substr(f.query, 2), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|from|source|src|track|tracking|spm)='))) AS q FROM w)"""
)
def q_resolved_links(t):
    """The links of pages as they are written, resolved against their page, and as one identity."""
    links = t.pages.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("h"))
    h = F.col("h")
    refs = (h, F.concat(F.lit(".."), h), F.concat(F.lit("../.././"), F.substr(h, F.lit(2)), F.lit("/../x/")), F.concat(F.lit("?b=2&utm_x=1&Spm=2&a="), "page_id"), F.concat(h, F.lit("/.?q=a.b&src=1&q=A#f")))
    each = links.select("page_id", "url", F.posexplode(F.array(*refs)).alias("i", "ref"))
    return each.select("page_id", "i", "ref", U.resolve(F.col("url"), F.col("ref")).alias("resolved"), U.canonical_static(F.col("ref"), F.col("url")).alias("canonical"))


_QUERY = "list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '')"


@R.add(
    f"""SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), ':(80|443)$', '') || CASE WHEN p = '' THEN '/' ELSE p END
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS p,
    list_sort(list_transform(list_filter({_QUERY}, lambda p: NOT regexp_matches(lower(p), '^(utm_[^=]*|from|source|src|track|tracking|spm)(=|$)')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)) AS q FROM pages)"""
)
def q_canonical_static_url(t):
    """Pages' URLs as static topics compare them: tracking parameters gone, the rest sorted, no fragment."""
    return t.pages.select("page_id", U.canonical_static(F.col("url")).alias("canonical"))


QUERIES, ORACLE_SQL = R.queries, R.sql
