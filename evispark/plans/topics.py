"""Bounded reading over the driver's tables: pages are captured pages, line items images of runs, events attempts of tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import static
from ..streaming import events as streams
from ..streaming import retries
from .base import Registry

R = Registry()

_SOURCE = """concat(html, '<script>var a = {"value":"研发","attr2":" Job  ', page_id, '","attr4":"上海","attr5":"/apply/', page_id, '?b=1&from=x","n":{"title":"inner"}}; {broken {"title":"plain }{ ', page_id % 7, '","city":"北京"}, {"name":5}</script>')"""


@R.add("""SELECT page_id, 'Job ' || page_id AS title, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || '/apply/' || page_id || '?b=1' AS url, '研发' AS category, '上海' AS location FROM pages
    UNION ALL SELECT page_id, 'plain }{ ' || page_id % 7, NULL, '', '北京' FROM pages""")
def q_embedded_records(t):
    """The job records that stand as JSON in scripts of pages."""
    sources = t.pages.select("page_id", "url", F.expr(_SOURCE).alias("source"))
    return static.records(sources, "page_id", "source", "url").select("page_id", "title", "url", "category", "location")


_EDGES = """(SELECT page_id::VARCHAR AS url, i::INT AS place, ((length(h[i]) * 31 + page_id * 7 + i) % (SELECT count(*) FROM pages))::VARCHAR AS target FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)))"""


@R.add(f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, a AS MATERIALIZED (SELECT url, list(target ORDER BY place) AS targets FROM e GROUP BY 1),
    s AS (SELECT page_id::VARCHAR AS root, [page_id::VARCHAR] AS queue, []::VARCHAR[] AS seen FROM pages
    UNION ALL SELECT root, queue[2:] || CASE WHEN list_contains(seen, queue[1]) THEN [] ELSE list_filter(first, lambda x: NOT list_contains(seen, x) AND x <> queue[1] AND NOT list_contains(queue, x)) END, CASE WHEN list_contains(seen, queue[1]) THEN seen ELSE list_append(seen, queue[1]) END
      FROM (SELECT s.*, coalesce(list_filter(targets, lambda x, i: list_position(targets, x) = i), []) AS first FROM s LEFT JOIN a ON a.url = s.queue[1]) WHERE len(queue) > 0 AND len(seen) < 12)
    SELECT root, unnest(seen) AS url, unnest(range(1, len(seen) + 1))::BIGINT AS nth FROM s QUALIFY row_number() OVER (PARTITION BY root ORDER BY len(seen) DESC, len(queue)) = 1""")
def q_frontier(t):
    """The first twelve pages that are read from each page, breadth first."""
    n = t.pages.count()
    links = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("i", "h"))
    place = F.col("i") + 1
    target = (F.char_length("h") * 31 + F.col("page_id") * 7 + place) % n
    edges = links.select(F.col("page_id").cast("string").alias("url"), place.alias("place"), target.cast("string").alias("target"))
    found = static.frontier(t.pages.select(F.col("page_id").cast("string").alias("root")), edges, 12)
    return found.where("not beyond").select("root", "url", "nth")


@R.add("""WITH i AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place, l_partkey % 40 AS url, l_partkey % 40 * 3 AS size FROM lineitem),
    f AS (SELECT run, url, min(place) AS place, any_value(size) AS size FROM i GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY place) AS n FROM f),
    g AS (SELECT run, list(url ORDER BY n) AS urls, list_reduce([[0]] || list([size] ORDER BY n), lambda x, y: [x[1] + CASE WHEN x[1] < 900 AND y[1] <= least(90, 900 - x[1]) THEN y[1] ELSE 0 END] || x[2:] || [CASE WHEN x[1] >= 900 THEN 0 WHEN y[1] <= least(90, 900 - x[1]) THEN 1 ELSE 2 END]) AS told FROM r WHERE n <= 25 GROUP BY 1),
    u AS (SELECT run, unnest(urls) AS url, unnest(told[2:]) AS s FROM g)
    SELECT i.run, place, i.url, CASE s WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'skipped' END AS status FROM i LEFT JOIN u ON u.run = i.run AND u.url = i.url""")
def q_image_bounds(t):
    """What becomes of each supplier's images within bounds of number and bytes; a URL's later places have its outcome."""
    from pyspark.sql import Window

    c = F.col
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    images = t.lineitem.select(c("l_suppkey").alias("run"), place.alias("place"), (c("l_partkey") % 40).cast("string").alias("url"), (c("l_partkey") % 40 * 3).alias("size"))
    return static.image_outcomes(images, 25, 90, 900).select("run", "place", c("url").cast("long").alias("url"), "status")


def _attempts(events):
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").cast("int").alias("attempt_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "view").alias("repeatable"))


_SCHEDULE = """WITH a AS (SELECT user_id AS task_id, (epoch_us(ts) // 1000) AS ms, event_type <> 'view' AS again, row_number() OVER w AS n, lead((epoch_us(ts) // 1000)) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id)),
    d AS (SELECT task_id, (n + 1)::INT AS attempt, (ms + 1000 * least(3600, 300 * 2 ** (n - 1)))::BIGINT AS due_ms, next FROM a WHERE again AND n < 20)
    SELECT task_id, attempt, due_ms FROM d WHERE (next IS NULL OR next >= due_ms)"""


@R.add(_SCHEDULE)
def q_retry_schedule(t):
    """Retries that come due before the next attempt, from the table of all attempts."""
    return retries.retry_schedule(_attempts(t.events), most=20, base=300.0, longest=3600.0)


@R.add(f"{_SCHEDULE} AND due_ms <= (SELECT max((epoch_us(ts) // 1000)) FROM events)")
def q_streamed_retries(t):
    """The same from a stream with keyed state and timers, up to the time of its last attempt."""
    retries.use_rocksdb(t.spark)
    table = t.events
    stream = t.spark.readStream.schema(table.schema).parquet(f"{t.folder}/events.parquet*")
    return streams.drained(retries.due_retries(_attempts(stream), most=20, base=300.0, longest=3600.0), "append").drop("batch")


QUERIES, ORACLE_SQL = R.queries, R.sql
