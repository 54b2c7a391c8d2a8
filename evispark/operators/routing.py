"""Where a URL goes and which row stands for it: rules by priority, routers, lookups with defaults, and ordered listings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.rules import choose
from .ranges import positions

#: Hosts that have rules of their own, and names of platforms by the end of their hosts.
RESERVED = ("51job.com", "jobs.feishu.cn", "zhiye.com", "hotjob.cn", "wjx.cn", "wjx.top")
RESERVED_EXACT = ("mp.weixin.qq.com", "app.mokahr.com")
PLATFORMS = (
    ("wjx.cn", "WJX"), ("wjx.top", "WJX"), ("tupu360.com", "Tupu360"), ("xinrenxinshi.com", "Xinrenxinshi"), ("hotjob.cn", "Hotjob"),
    ("51job.com", "51job"), ("moseeker.com", "Moseeker"),
)
#: Query parameters of public article images.
IMAGE_PARAMETERS = ("wx_fmt", "wxfrom", "wx_lazy", "wx_co", "from", "tp")


def below(host: Column, suffix: str) -> Column:
    """Whether a host is ``suffix`` or a part of it."""
    return (host == suffix) | F.endswith(host, F.lit("." + suffix))


def reserved(url: Column) -> Column:
    host = F.rtrim(U.host(url), F.lit("."))
    out = host.isin(*RESERVED_EXACT)
    for suffix in RESERVED:
        out = out | below(host, suffix)
    return out


def platform(host: Column) -> Column:
    """The platform of a host; the host itself where none is known."""
    low = F.lower(host)
    return choose([(F.lit(name), below(low, suffix)) for suffix, name in PLATFORMS], low)


def is_list_route(url: Column) -> Column:
    """Whether path or fragment end in the list of positions."""
    fragment = F.rtrim(F.substring_index(F.substring(U.part(url, 5), 2, (1 << 31) - 1), "?", 1), F.lit("/"))
    return F.rtrim(U.part(url, 3), F.lit("/")).rlike("/position/list$") | fragment.rlike("/position/list$")


def is_landing(url: Column) -> Column:
    """Whether a URL is a portal's first page: no path or /campus, and no route in the fragment."""
    return F.lower(F.rtrim(U.part(url, 3), F.lit("/"))).isin("", "/campus") & U.part(url, 5).isin("", "#", "#/")


def job_identity(url: Column) -> Column:
    """The id of an explicit detail URL: jobAdId, jobId, or what follows job/ in the fragment; null for others."""
    given = lambda k: F.nullif(F.trim(F.regexp_extract(U.part(url, 4), f"[?&]{k}=([^&]*)", 1)), F.lit(""))
    route = F.nullif(F.regexp_extract(U.part(url, 5), "(?i)(?:^#?|/)job/([^/?#]+)", 1), F.lit(""))
    return F.coalesce(given("jobAdId"), given("jobId"), route)


def public_image(url: Column, hosts: dict[str, Iterable[str]]) -> Column:
    """Whether an image may be fetched: https, a known host and path, no user, port or fragment, and known parameters only."""
    place = F.lit(False)
    for host, paths in hosts.items():
        for path in paths:
            place = place | ((U.host(url) == host) & F.startswith(U.part(url, 3), F.lit(path)))
    params = F.filter(F.split(F.substring(U.part(url, 4), 2, (1 << 31) - 1), "&", -1), lambda p: p != "")
    known = F.forall(params, lambda p: p.rlike(f"^(?:{'|'.join(IMAGE_PARAMETERS)})=[A-Za-z0-9_-]{{1,20}}$"))
    plain = ~F.contains(U.part(url, 2), F.lit("@")) & U.part(url, 2).rlike("^[^:]*(?::443)?$") & (U.part(url, 5) == "")
    return F.coalesce((F.lower(U.part(url, 1)) == "https") & place & plain & known, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A named choice with a priority; ``matches`` makes a condition of a URL column."""

    name: str
    priority: int
    matches: object


def _mokahr(url: Column) -> Column:
    return U.part(url, 3).rlike("/(?:campus-recruitment|social-recruitment|campus_apply)/[^/]+/\\d+")


def _zhiye_detail(url: Column) -> Column:
    return F.lower(U.part(url, 3)).rlike("/(?:detail|jobdetails)(?:/|$)")


def _static_topic(url: Column) -> Column:
    path = U.part(url, 3)
    return (F.lower(U.part(url, 1)) == "https") & (U.host(url) == "campus.51job.com") & ~path.isin("", "/") & (F.endswith(path, F.lit("/")) | F.lower(path).rlike("\\.html?$"))


#: Rules in the order of their registration, which tells those of one priority apart.
RULES = [
    Rule("WechatImage", 100, U.is_article),
    Rule("Job51XYZ", 110, lambda u: (F.lower(U.part(u, 1)) == "https") & (U.host(u) == "xyz.51job.com") & (F.rtrim(U.part(u, 3), F.lit("/")) == "/consumer/pc/home/index") & U.part(u, 4).rlike("^[^#]*[?&]ctmid=[1-9]\\d{5,11}(?:&|$)")),
    Rule("WjxPublicForm", 95, lambda u: below(F.rtrim(U.host(u), F.lit(".")), "wjx.cn") | below(F.rtrim(U.host(u), F.lit(".")), "wjx.top")),
    Rule("Job51StaticTopic", 95, _static_topic),
    Rule("MokahrJobDetailPortal", 95, lambda u: _mokahr(u) & job_identity(u).isNotNull()),
    Rule("MokahrPublicPortal", 90, _mokahr),
    Rule("HotjobPublicPortal", 90, lambda u: below(U.host(u), "hotjob.cn")),
    Rule("ZhiyeJobDetailPortal", 85, lambda u: F.endswith(U.host(u), F.lit(".zhiye.com")) & _zhiye_detail(u)),
    Rule("ZhiyePublicPortal", 80, lambda u: F.endswith(U.host(u), F.lit(".zhiye.com")) & ~_zhiye_detail(u)),
    Rule("FeishuPublicPortal", 50, lambda u: below(U.host(u), "jobs.feishu.cn") & (is_list_route(u) | is_landing(u))),
    Rule("genericweb", -100, lambda u: ~reserved(u)),
]


class Registry:
    """Rules by name; the one of the highest priority that matches is chosen, the first registered on a tie."""

    def __init__(self, rules: Iterable[Rule] = RULES):
        self.rules = list(rules)

    def register(self, rule: Rule, replace: bool = False) -> None:
        names = [r.name for r in self.rules]
        if rule.name in names:
            if not replace:
                raise ValueError(f"{rule.name} is registered already")
            self.rules[names.index(rule.name)] = rule
        else:
            self.rules.append(rule)

    def describe(self) -> list[dict]:
        return [{"name": r.name, "priority": r.priority} for r in sorted(self.rules, key=lambda r: -r.priority)]

    def chosen(self, url: Column, explicit: Column | None = None, listed: Column | None = None) -> Column:
        """The name of the rule for a URL: the one asked for, else the configured list's, else by priority; null for none."""
        by_rule = choose([(F.lit(r.name), F.coalesce(r.matches(url), F.lit(False))) for r in sorted(self.rules, key=lambda r: -r.priority)])
        out = F.when(U.is_web(url), by_rule)
        out = out if listed is None else F.when(listed, "ConfiguredPublicList").otherwise(out)
        return out if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), out)


def partitioned(rows: DataFrame, url: str, order: list[str]) -> DataFrame:
    """Rows with ``route`` web, deferred (articles) or invalid, and why; of rows with one canonical URL the first stays, and all
    rows without a valid URL do."""
    raw = F.trim(F.coalesce(F.col(url), F.lit("")))
    same = U.canonical(raw)
    best = rows.where(same.isNotNull()).groupBy(same.alias("_same")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    first = best.select(*(F.col(f"_r.`{c}`").alias(c) for c in rows.columns)).unionByName(rows.where(same.isNull()))
    why = F.when(raw == "", "missing_url").when(same.isNull(), "invalid_url").when(U.is_article(raw), "articles_disabled")
    return first.withColumns({"route": F.when(same.isNull(), "invalid").when(U.is_article(raw), "deferred").otherwise("web"), "reason": why})


def admitted(rows: DataFrame, company: str, nature: str, industry: str, location: str, industry_pattern: str, location_pattern: str, state_owned: str) -> DataFrame:
    """Candidates with a name that aren't state-owned, of the industry (by its field, or by field and name together) and the place."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return rows.where((F.trim(c(company)) != "") & ~c(nature).rlike(state_owned) & F.concat_ws(" ", c(industry), c(company)).rlike(industry_pattern) & c(location).rlike(location_pattern))


def with_default(rows: DataFrame, documents: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Rows with the columns of their document; those without one have ``defaults``."""
    joined = rows.join(documents.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_inventory(rows: DataFrame, inventory: DataFrame, key: str, role: str, none: str) -> DataFrame:
    """A row for each known role of a row's key, numbered from 1; rows without any have one row with the role ``none``."""
    numbered = inventory.select(key, role).distinct().withColumn("role_index", F.row_number().over(Window.partitionBy(key).orderBy(role)))
    return rows.join(numbered, key, "left").withColumns({role: F.coalesce(role, F.lit(none)), "role_index": F.coalesce("role_index", F.lit(1))})


def template_of(companies: DataFrame, pending: DataFrame, errors: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Companies with the columns of their error row, else of their pending row; ``origin`` is null where there is neither."""
    side = lambda df, name: df.select(key, F.struct(F.lit(name).alias("origin"), *columns).alias(f"_{name}"))
    joined = companies.join(side(pending, "pending"), key, "left").join(side(errors, "error"), key, "left")
    return joined.select(*companies.columns, F.coalesce("_error", "_pending").alias("_t")).select(*companies.columns, "_t.*")


def without_fragment(report: DataFrame, stored: DataFrame, url: str, value: str) -> DataFrame:
    """``value`` of the stored row with the same URL, else of the one whose URL is the same but for the fragment."""
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    exact = stored.select(url, F.col(value).alias("_exact"))
    loose = stored.groupBy(bare(F.col(url)).alias("_bare")).agg(F.min_by(value, url).alias("_loose"))
    joined = report.join(exact, url, "left").withColumn("_bare", bare(F.col(url))).join(loose, "_bare", "left")
    return joined.withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "_bare")


def inherited(bridge: DataFrame, children: DataFrame) -> DataFrame:
    """(source, task) of children (task, parent), each with the sources (source, task) of its parent, once."""
    return children.join(bridge.select("source", F.col("task").alias("parent")), "parent").select("source", "task").distinct()


def url_companies(rows: DataFrame, urls: list[str], company: str, order: str, otherwise: str | None = None) -> DataFrame:
    """(url, company): of rows that name one URL in any of ``urls`` the last counts; blank companies have a default."""
    name = F.col(company) if otherwise is None else F.coalesce(F.nullif(F.trim(F.col(company)), F.lit("")), F.lit(otherwise))
    each = rows.select(F.explode(F.array_distinct(F.array(*urls))).alias("url"), name.alias("company"), order).where("coalesce(url, '') <> ''")
    return each.groupBy("url").agg(F.max_by("company", F.struct(order, "company")).alias("company"))


def latest_parent(tasks: DataFrame, prefix: str, url: str, at: str, done: Column) -> DataFrame:
    """The latest finished task whose URL begins with ``prefix``: one row, or none."""
    return tasks.where(F.startswith(F.col(url), F.lit(prefix)) & done).orderBy(F.col(at).desc(), F.col(url)).limit(1)


def recoverable(tasks: DataFrame, queue: DataFrame, url: str) -> DataFrame:
    """Tasks that wait for recognition, whose URL is in the queue, that have gaps and a manifest among their evidence kinds."""
    waiting = (F.col("status") == "pending_ocr") & (F.col("gaps") > 0) & F.exists("kinds", lambda k: k == "manifest")
    return tasks.where(waiting).join(queue.select(url).distinct(), url, "left_semi")


def run_plan(asked: DataFrame, done: DataFrame, stopped: DataFrame, key: str, order: list[str], budget: int) -> DataFrame:
    """Requested ids with what happens to them: cached, stopped, run (the first ``budget`` in order) or deferred.

    The rows still to run are counted within range-sorted cuts, so only their best ``budget`` are ranked together.
    """
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    joined = asked.join(mark(done, "_done"), key, "left").join(mark(stopped, "_stopped"), key, "left")
    open_ = joined.where("_done is null and _stopped is null")
    first = open_.orderBy(*order, key).limit(budget).select(key).withColumn("_run", F.lit(True))
    route = F.when(F.col("_done"), "cached").when(F.col("_stopped"), "stopped").when(F.col("_run"), "run").otherwise("deferred")
    return joined.join(first, key, "left").withColumn("route", route).drop("_done", "_stopped", "_run")


def next_positions(rows: DataFrame, taken: DataFrame, position: str, order: list[str]) -> DataFrame:
    """New rows with positions that follow those taken, in order."""
    last = taken.agg(F.coalesce(F.max(position), F.lit(0)).alias("_last"))
    return positions(rows, [], order, "_place").join(F.broadcast(last)).withColumn(position, F.col("_last") + F.col("_place")).drop("_last", "_place")


def company_order(priority: str, company: str) -> list[Column]:
    """By priority, blank last, then company."""
    return [F.col(priority).asc_nulls_last(), F.lower(company).asc(), F.col(company).asc()]


def shortlist_order(bucket: str, direct: str, score: str, tie: str) -> list[Column]:
    """Best buckets first, direct applications first, then by score; ``tie`` keeps the earlier order."""
    return [F.startswith(F.col(bucket), F.lit("A-")).desc(), (F.col(direct) == "direct").desc(), F.col(score).desc(), F.col(tie).asc()]


def contained_names(names: DataFrame, titles: DataFrame, name: str, title: str, order: str, width: int = 2) -> DataFrame:
    """Each row of ``names`` with ``contained_in``, the first title by ``order`` that contains its name, in any script; null where none does.

    A name is looked up by the one of its pieces of ``width`` characters that the fewest titles have, shorter ones by all of their
    characters, and then compared as a whole: two names that begin alike meet different titles. A name with a piece that no title has
    isn't looked up at all. Blank and null names are in no title. Names may be repeated; order ties go to the smaller title.
    """
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - n + 1, F.lit(1))), lambda at: F.substr(c, at, F.lit(n))))
    told = titles.where(F.char_length(title) > 0).select(F.col(title).alias("_title"), F.col(order).alias("_order"))
    grams = told.select("_title", "_order", F.explode(F.array_distinct(F.flatten(F.array(*(pieces(F.col("_title"), n) for n in range(1, width + 1)))))).alias("_gram"))
    counts = grams.groupBy("_gram").agg(F.count("*").alias("_titles"))
    wanted = names.where(F.char_length(name) > 0).select(F.col(name).alias("_name")).distinct()
    own = wanted.select("_name", F.explode(pieces(F.col("_name"), width)).alias("_gram")).join(counts, "_gram", "left")
    rarest = own.groupBy("_name").agg(F.min(F.struct(F.coalesce("_titles", F.lit(0)).alias("n"), "_gram")).alias("_r")).where("_r.n > 0").select("_name", F.col("_r._gram").alias("_gram"))
    hits = grams.join(rarest, "_gram").where(F.contains("_title", F.col("_name")))
    best = hits.groupBy("_name").agg(F.min_by("_title", F.struct("_order", "_title")).alias("contained_in"))
    return names.join(best, names[name] == best["_name"], "left").drop("_name")


def source_fidelity(source: DataFrame, output: DataFrame, key: str, fields: list[str], garbled) -> DataFrame:
    """Where an output differs from its source rows: (key, problem) for rows that are missing, extra, repeated, changed or garbled."""
    a = source.select(key, F.struct(*fields).alias("_a"))
    b = output.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*fields)).alias("_b"))
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.coalesce(garbled(F.col(f"_b.{f}")), F.lit(False))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_n") > 1, "repeated").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").when(bad, "garbled")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def report_problems(reports: DataFrame, name: str, body: str, required: list[str], garbled) -> DataFrame:
    """(name, problem): required reports that are missing or empty, and reports whose text is garbled."""
    wanted = reports.sparkSession.createDataFrame([(n,) for n in required], f"{name} string")
    joined = wanted.join(reports.select(name, body), name, "full_outer")
    needed = F.col(name).isin(*required)
    problem = F.when(F.col(body).isNull() & needed, "missing").when((F.trim(body) == "") & needed, "empty").when(garbled(F.col(body)), "garbled")
    return joined.select(name, problem.alias("problem")).where("problem is not null")
