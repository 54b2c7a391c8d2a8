"""Saved JSON: jobs at any depth, totals under any alias, and lists mapped by configured paths."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import urls as U
from ..session import materialise

OBJECT, ARRAY = "OBJECT", "ARRAY"


def is_object(value: Column) -> Column:
    """Whether a VARIANT is an object; false where it is missing. Its members aren't looked at."""
    return F.try_variant_get(value, F.lit("$"), "struct<>").isNotNull()


def is_list(value: Column) -> Column:
    """Whether a VARIANT is a list; false where it is missing. What its elements hold isn't looked at."""
    return F.try_variant_get(value, F.lit("$"), "array<struct<>>").isNotNull()


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def kind(value: Column) -> Column:
    """What a VARIANT is: OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, VOID (JSON's null) and so on; null where it is missing."""
    # A schema is read from all that lists and objects hold, so they are known before it.
    return F.when(is_object(value), OBJECT).when(is_list(value), ARRAY).otherwise(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def members(value: Column) -> Column:
    """An object's members as a map of VARIANTs, JSON's nulls among them; null for everything else."""
    return F.try_variant_get(value, F.lit("$"), "map<string,variant>")


def member(value: Column, name: str) -> Column:
    """A member of a VARIANT object as VARIANT; null where it is missing, JSON's null where it is null."""
    return F.try_variant_get(value, F.lit(f"$.{name}"), "variant")


def as_text(value: Column) -> Column:
    """A VARIANT as text: strings as they are, everything else as JSON."""
    return F.when(~is_object(value) & is_string(value), F.try_variant_get(value, F.lit("$"), "string")).otherwise(F.to_json(value))


def _is_among(names: tuple, value: Column) -> Column:
    return value.isin(*names)


def _is_whole(value: Column) -> Column:
    return (kind(value) == "BIGINT") | F.schema_of_variant(value).rlike(r"^DECIMAL\(\d+,0\)$")


def truthy(value: Column) -> Column:
    """Whether a value says something: not missing, null, false, zero, or an empty text, list or object."""
    said = F.to_json(value)
    return F.coalesce(~said.isin("null", "false", "0", '""', "[]", "{}") & ~said.rlike(r"^-?0(\.0*)?(E.*)?$"), F.lit(False))


#: Levels of a tree that are opened in one pass over its texts.
LEVELS = 8


def _below(node: Column) -> Column:
    """The lists and objects right below a node (path, value), as nodes; objects' members in the order of their names."""
    value, path = node["value"], node["path"]
    inner = F.when(is_object(value), F.map_values(members(value))).otherwise(F.try_variant_get(value, F.lit("$"), "array<variant>"))
    nodes = F.transform(F.coalesce(inner, F.array().cast("array<variant>")), lambda x, i: F.struct(F.array_append(path, i).alias("path"), x.alias("value")))
    return F.filter(nodes, lambda n: is_object(n["value"]) | is_list(n["value"]))


def objects(bodies: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """``keep``, ``path`` (array of positions from the root) and ``value`` (VARIANT) of every object at any depth of JSON texts, or of VARIANTs.

    A tree is opened some LEVELS at a time, and what is left below them is stored and opened in turn until nothing is left, so the
    depth may be any and no row limit applies, as it would in a recursive query. ``path`` in order gives an object before those
    in it, and lists in their order; members go by name, as VARIANT keeps no other order. Texts that aren't JSON have no object.
    """
    c = F.col
    parsed = c(body) if dict(bodies.dtypes)[body] == "variant" else F.try_parse_json(c(body))
    root = F.struct(F.array().cast("array<int>").alias("path"), parsed.alias("value"))
    rows = bodies.select(*keep, F.filter(F.array(root), lambda n: is_object(n["value"]) | is_list(n["value"])).alias("_0"))
    found = None
    while True:
        for i in range(LEVELS):
            rows = rows.withColumn(f"_{i + 1}", F.flatten(F.transform(f"_{i}", _below)))
        last = F.transform(f"_{LEVELS}", lambda n: F.struct(n["path"].alias("path"), n["value"].alias("value"), F.lit(True).alias("open")))
        above = F.flatten(F.array(*(F.filter(f"_{i}", lambda n: is_object(n["value"])) for i in range(LEVELS))))
        above = F.transform(above, lambda n: F.struct(n["path"].alias("path"), n["value"].alias("value"), F.lit(False).alias("open")))
        # Texts without any give a row of null here: a condition before the explosion would open the trees once more.
        each = rows.select(*keep, F.explode_outer(F.concat(above, last)).alias("_n")).where("_n is not null").select(*keep, "_n.path", "_n.value", "_n.open")
        level = materialise(each, "json-levels")
        here = level.where("not open").drop("open")
        found = here if found is None else found.unionByName(here)
        left = level.where("open")
        if left.isEmpty():
            return found
        rows = left.select(*keep, F.array(F.struct("path", "value")).alias("_0"))


def reported_totals(found: DataFrame, key: list[str]) -> DataFrame:
    """The largest total that objects (see ``objects``) of a key report under any alias; keys without one are left out."""
    number = lambda v: F.when(_is_whole(v), F.try_variant_get(v, F.lit("$"), "decimal(38,0)"))
    told = F.transform(F.map_values(F.map_filter(members(F.col("value")), lambda k, _: k.isin(*rules.TOTAL_KEYS))), number)
    each = F.array_max(F.filter(told, lambda x: x >= 0))
    return found.groupBy(*key).agg(F.max(each).cast("long").alias("total")).where("total is not null")


def json_jobs(found: DataFrame, base: str = "base") -> DataFrame:
    """The jobs among objects (see ``objects``; with the column ``base``, the URL they came from): id, title, url, text and raw are added.

    A job has a title and an id or link, and a member that only jobs have. Its own link is resolved; on one platform that
    gives none it is made from the id. Members that hold no text come into ``text`` as JSON.
    """
    jobs = _valued_jobs(found, base)
    return jobs.select(*[n for n in jobs.columns if n not in ("value", "id")], F.to_json("value").alias("raw"), "id")


def _valued_jobs(found: DataFrame, base: str) -> DataFrame:
    """``json_jobs`` with ``value`` (VARIANT) in the place of raw, which costs more than all else and may not be asked for."""
    c = F.col
    names = sorted({*rules.JOB_TITLE_KEYS, *rules.JOB_ID_KEYS, *rules.JOB_LINK_KEYS, *rules.JOB_BODY_KEYS, *rules.JOB_ONLY_KEYS, "Category"})
    # Of an object's members only those that matter are read, each once; what follows reads them from there.
    says_so = lambda t: F.when(t["kind"] == "STRING", t["text"] != "").otherwise(~t["text"].isin("null", "false", "0", "[]", "{}") & ~t["text"].rlike(r"^-?0(\.0*)?(E.*)?$"))
    shape = lambda v: F.when(is_object(v), OBJECT).when(is_list(v), ARRAY).otherwise(F.schema_of_variant(v))
    shown = lambda t: F.when(t["kind"] == "STRING", F.try_variant_get(t["v"], F.lit("$"), "string")).otherwise(F.to_json(t["v"]))
    read = lambda v: U.let(F.struct(shape(v).alias("kind"), v.alias("v")), lambda t: F.struct(t["kind"].alias("kind"), shown(t).alias("text")))
    told = lambda t: F.struct(t["kind"].alias("kind"), t["text"].alias("text"), says_so(t).alias("says"), ((t["kind"] == "BIGINT") | t["kind"].rlike(r"^DECIMAL\(\d+,0\)$")).alias("whole"))
    own = F.map_filter(members(c("value")), lambda k, _: k.isin(*names))
    looked_up = F.transform_values(own, lambda _, v: U.let(read(v), told))
    # Whoever lacks one of these by name alone is no job.
    needed = (rules.JOB_TITLE_KEYS, (*rules.JOB_ID_KEYS, *rules.JOB_LINK_KEYS), (*rules.JOB_ONLY_KEYS, *rules.JOB_BODY_KEYS))
    likely = U.let(F.map_keys(members(c("value"))), lambda keys: functools.reduce(lambda x, y: x & y, (F.exists(keys, functools.partial(_is_among, among)) for among in needed)))
    any_of = lambda among, holds: functools.reduce(lambda x, y: x | y, (F.coalesce(holds(n), F.lit(False)) for n in among))

    def job(held):
        m = lambda n: F.try_element_at(held, F.lit(n))
        text = lambda n: m(n)["text"]
        says = lambda n: m(n)["says"]
        has = lambda n: m(n)["kind"].isNotNull()
        is_text = lambda n: m(n)["kind"] == "STRING"
        is_id = lambda n: m(n)["kind"].isin("STRING", "BOOLEAN") | m(n)["whole"]
        first = lambda among, fits, value: F.coalesce(*(F.when(fits(n), value(n)) for n in among))
        by = first(rules.JOB_TITLE_KEYS, is_text, F.lit)
        shown_id = first(rules.JOB_ID_KEYS, is_id, lambda n: F.when(m(n)["kind"] == "BOOLEAN", F.initcap(text(n))).otherwise(text(n)))
        link = F.coalesce(first(rules.JOB_LINK_KEYS, is_text, text), F.lit(""))
        named = (by == "name") & any_of(("responsibility", "claim"), says)
        fits = named | any_of(rules.JOB_ONLY_KEYS, has) | ((by != "name") & any_of(rules.JOB_BODY_KEYS, has))
        return F.struct(
            first(rules.JOB_TITLE_KEYS, is_text, text).alias("title"), shown_id.alias("id"), link.alias("link"), F.coalesce(text("Category"), F.lit("")).alias("category"),
            F.concat_ws("\n", *(F.when(says(n), text(n)) for n in rules.JOB_BODY_KEYS)).alias("text"), (fits & (shown_id.isNotNull() | (link != ""))).alias("fits"),
        )

    # The explosion keeps the conditions behind it, which would else work out the job once more.
    jobs = F.filter(F.transform(F.array(looked_up), job), lambda j: j["fits"] & (j["title"] != ""))
    rows = found.where(likely).select("*", F.explode_outer(jobs).alias("_job")).where("_job is not null")
    section = F.when(F.contains("_job.category", F.lit("校园")), "campus").when(F.contains("_job.category", F.lit("实习")), "intern").otherwise("social")
    made = F.concat(F.lit("/"), section, F.lit("/jobdetails?jobId="), c("_job.id"))
    link = F.when((c("_job.link") == "") & c("_job.id").isNotNull() & F.endswith(U.host(c(base)), F.lit("zhiye.com")), made).otherwise(c("_job.link"))
    target = F.coalesce(U.absolute(link, c(base)), F.lit(""))
    rows = rows.select(*found.columns, c("_job.title").alias("title"), target.alias("url"), c("_job.text").alias("text"), c("_job.id").alias("_id"))
    job_id = F.substring(F.sha2(F.concat(U.split(c(base))["authority"], F.lit(":"), F.coalesce("_id", "url")), 256), 1, 24)
    return rows.withColumn("id", job_id).drop("_id")


def stale_job(title: Column, raw: Column) -> Column:
    """Whether an earlier parse took a plain named object for a job: its name is the title and nothing else says that it is one."""
    v = F.try_parse_json(raw)
    says = F.exists(F.array(*(truthy(member(v, n)) for n in ("responsibility", "claim"))), lambda x: x)
    special = F.exists(F.array(*(member(v, n).isNotNull() for n in rules.JOB_ONLY_NAMES)), lambda x: x)
    return F.coalesce((kind(v) == OBJECT) & (as_text(member(v, "name")) == title) & ~says & ~special, F.lit(False))


def reparse(results: DataFrame, jobs: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, coverage) of results after their saved JSON is read again, without any request.

    ``results`` has result, url, total and detail_urls (array); ``jobs`` result, nth, id, title, url, text and raw (JSON);
    ``artifacts`` result, nth and body, a saved record with the response under ``body`` and its own ``url``, or the response alone.
    Stale jobs go; jobs found anew follow those that stay, each new id once, the first; ``nth`` numbers them from 0. Coverage
    has result, total (the largest told), detail_urls (in order, each once) and reparsed, the artifacts that gave jobs.
    Artifacts that aren't JSON say nothing; those of unknown results are left out.
    """
    c = F.col
    known = artifacts.join(results.select("result", F.col("url").alias("_url")), "result").withColumn("_record", F.try_parse_json("body"))
    own = member(c("_record"), "url")
    base = F.coalesce(F.when(is_string(own), F.try_variant_get(c("_record"), F.lit("$.url"), "string")), "_url", F.lit(""))
    bodies = known.select("result", "nth", base.alias("base"), F.coalesce(member(c("_record"), "body"), "_record").alias("body"))
    found = objects(bodies, ["result", "nth", "base"])
    anew = materialise(_valued_jobs(found, "base").drop("base"), "json-jobs").withColumn("raw", F.to_json("value"))
    order = lambda late, nth, path: F.struct(F.lit(late).alias("late"), nth.alias("nth"), path.alias("path"))
    fields = ("id", "title", "url", "text", "raw")
    kept = jobs.where(~stale_job(F.col("title"), F.col("raw"))).select("result", order(0, F.col("nth").cast("long"), F.array().cast("array<int>")).alias("_at"), *fields)
    at = order(1, F.col("nth").cast("long"), F.col("path"))
    # A window instead of a struct, so that fields that nobody reads aren't shuffled.
    nth = F.row_number().over(Window.partitionBy("result", "id").orderBy("nth", "path"))
    once = anew.withColumn("_n", nth).where("_n = 1").join(kept.select("result", "id").distinct(), ["result", "id"], "left_anti").select("result", at.alias("_at"), *fields)
    every = kept.unionByName(once)
    first = Window.partitionBy("result").orderBy("_at", "id")
    merged = every.select("result", (F.row_number().over(first) - 1).cast("long").alias("nth"), *fields)
    urls = merged.where("url <> ''").groupBy("result").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "url"))), lambda x: x["url"]).alias("_urls"))
    gave = anew.select("result", "nth").distinct().groupBy("result").agg(F.array_sort(F.collect_list("nth")).alias("reparsed"))
    totals = reported_totals(found, ["result"]).withColumnRenamed("total", "_told")
    coverage = results.join(urls, "result", "left").join(gave, "result", "left").join(totals, "result", "left")
    none = F.array().cast("array<string>")
    return merged, coverage.select(
        "result",
        F.greatest("total", "_told").alias("total"),
        F.array_distinct(F.concat(F.coalesce("detail_urls", none), F.coalesce("_urls", none))).alias("detail_urls"),
        F.coalesce("reparsed", F.array().cast(artifacts.select(F.array("nth")).schema[0].dataType)).alias("reparsed"),
    )
