"""Lists of records from saved payloads, mapped by paths that are data: each source has a row of configuration.

Paths are dotted (``data.list.0.name``), a figure being a position where it meets a list. What is missing and what is null are
told apart all along, as VARIANT does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import urls as U
from ..session import materialise
from . import pagination
from .payloads import as_text, is_object, is_string, kind, members

#: The columns of a configuration; paths and markers may be null, and then aren't looked at.
CONFIG = (
    "source string, url string, method string, location string, page_path string, items_path string, id_path string, success_path string, success_value string, "
    "actual_path string, total_path string, total_pages_path string, last_path string, null_items_are_empty boolean, fields map<string,string>, company string, scope string"
)
#: The fields of a record that have columns of their own.
FIELDS = ("title", "category", "location", "dept", "description", "requirements", "url")


def config_problems(configs: DataFrame) -> DataFrame:
    """(source, problem) for each thing that a configuration (see CONFIG) gets wrong; sound ones have no row."""
    blank = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    found = (
        (~F.coalesce(F.col("url"), F.lit("")).rlike("^(?i)https?://"), "url must use HTTP or HTTPS"),
        (~F.upper(F.coalesce(F.col("method"), F.lit("GET"))).isin("GET", "POST"), "method must be GET or POST"),
        (blank("page_path"), "pagination.path is required"),
        (~F.coalesce(F.col("location"), F.lit("query")).isin("query", "body"), "pagination.location must be query or body"),
        (blank("items_path"), "response.items_path is required"),
    )
    problems = F.array_compact(F.array(*(F.when(cond, F.lit(text)) for cond, text in found)))
    return configs.select("source", F.explode(problems).alias("problem"))


def _in_list(at: Column, key: Column) -> Column:
    return F.when(key.rlike(r"^\d{1,9}$"), F.get(F.try_variant_get(at, F.lit("$"), "array<variant>"), key.cast("int")))


def _follow(at: Column, keys: Column) -> Column:
    return F.aggregate(keys, at, lambda x, key: F.coalesce(F.try_element_at(members(x), key), _in_list(x, key)))


def walk(value: Column, path: Column) -> Column:
    """What a dotted path leads to in a VARIANT: null where it is missing or there is no path, JSON's null where it is null."""
    return F.when(path.isNotNull(), _follow(value, F.split(path, r"\.")))


def walk_all(value: Column, paths: list[Column]) -> list[Column]:
    """``walk`` along several paths, each an array of its keys; ``value`` is to be a map of an object's members (see ``members``)."""
    first = [F.try_element_at(value, F.get(p, F.lit(0))) for p in paths]
    return [F.when(F.size(p) == 1, x).otherwise(_follow(x, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))) for p, x in zip(paths, first, strict=True)]


def _walk_whole(value: Column, path: Column) -> Column:
    """``walk`` for a whole payload: plain paths are looked up at once, so what lies beside them isn't copied at each step."""
    keys = F.concat(F.lit("$['"), F.replace(path, F.lit("."), F.lit("']['")), F.lit("']"))
    at_once = F.try_variant_get(value, F.regexp_replace(keys, r"\['(\d{1,9})'\]", "[$1]"), "variant")
    # Figures are first read as positions; they may be members' names.
    named = F.when(path.rlike(r"(?:^|\.)\d{1,9}(?:\.|$)"), walk(value, path))
    return F.when(path.rlike(r"^[^.'?\[\]\s]+(?:\.[^.'?\[\]\s]+)*$"), F.coalesce(at_once, named)).otherwise(walk(value, path))


def canonical(value: Column) -> Column:
    """A VARIANT as JSON with members by name, so equal values have equal texts."""
    return F.to_json(value)


def placeholder(value: Column) -> Column:
    """Whether a mapped value says nothing: missing, null, empty, or a word for "to follow"."""
    said = F.coalesce(F.try_variant_get(value, F.lit("$"), "string"), F.lit(""))
    return said.isin("[]", "{}", "") | (F.lower(F.trim(said)).isin(*rules.LIST_PLACEHOLDERS) & F.coalesce(is_string(value), F.lit(False)))


def _whole(value: Column, floor: int = 0) -> Column:
    """A VARIANT as a whole number of at least ``floor``, also from text; null for everything else."""
    number = F.when(kind(value).isin("BIGINT", "STRING") & F.trim(as_text(value)).rlike(r"^[+-]?\d{1,18}$"), F.trim(as_text(value)).try_cast("long"))
    return F.when(number >= floor, number)


def read_pages(payloads: DataFrame, configs: DataFrame) -> DataFrame:
    """Payloads (source, run, page, body) with what each page says by its source's configuration.

    Adds items (array of VARIANT), identities (a digest of each item's id, or without an id path of its content), total, total_pages,
    last, actual, error and late_error (see ``pagination.proof``). A body that
    isn't JSON, a success marker that differs, items that aren't an array of objects (missing ones too; null ones are
    empty where the configuration says so), numbers and markers of a wrong kind are errors. Payloads of unknown sources
    are left out. There is a configuration for each source, so they are joined as Spark sees fit.
    """
    c = F.col
    v = F.try_parse_json(c("body"))
    rows = payloads.select("source", "run", "page", v.alias("_v")).join(configs.select(*_config_names()), "source")
    rows = rows.withColumns({f"_{n}": _walk_whole(c("_v"), c(f"{n}_path")) for n in ("items", "success", "actual", "total", "total_pages", "last")})
    given = lambda n: c(f"{n}_path").isNotNull()
    wanted = F.coalesce("success_value", F.lit("true"))
    as_empty = F.is_variant_null("_items") & F.coalesce("null_items_are_empty", F.lit(False))
    rows = rows.withColumn("items", F.when(as_empty, F.array().cast("array<variant>")).otherwise(F.try_variant_get(c("_items"), F.lit("$"), "array<variant>")))
    rows = rows.withColumn("_told", F.when(c("id_path").isNotNull(), F.transform("items", lambda x: walk(x, c("id_path")))).otherwise(c("items")))
    objects = as_empty | F.coalesce(F.forall(F.try_variant_get(c("_items"), F.lit("$"), "array<struct<>>"), lambda x: x.isNotNull()), F.lit(False))
    last = F.when(kind(c("_last")) == "BOOLEAN", F.try_variant_get(c("_last"), "$", "boolean"))
    id_missing = F.exists("_told", placeholder_id)
    # Only texts of strings begin with a quotation mark, so these are told apart from other values without being escaped.
    same = lambda x: F.when(~is_object(x) & is_string(x), F.concat(F.lit('"'), F.try_variant_get(x, F.lit("$"), "string"))).otherwise(canonical(x))
    identities = F.transform("_told", lambda x: F.unhex(F.sha2(same(x), 256)))
    error = (
        F.when(c("_v").isNull(), "not_json")
        .when(given("success") & ~F.coalesce(F.to_json(c("_success")) == wanted, F.lit(False)), "success_marker_mismatch")
        .when(~objects, "items_not_objects")
        .when(given("actual") & _whole(c("_actual")).isNull(), "actual_page_not_integer")
        .when(given("total") & _whole(c("_total")).isNull(), "total_not_integer")
    )
    late = (
        F.when(given("total_pages") & _whole(c("_total_pages")).isNull(), "total_pages_not_integer")
        .when(given("last") & last.isNull(), "last_marker_not_boolean")
        .when(given("id") & id_missing, "missing_item_id")
    )
    return rows.select(
        "source", "run", "page", "items", identities.alias("identities"), as_empty.alias("null_items_as_empty"), _whole(c("_actual")).alias("actual"), _whole(c("_total")).alias("total"),
        _whole(c("_total_pages")).alias("total_pages"), last.alias("last"), error.alias("error"), late.alias("late_error"), "id_path", "fields", "company", "scope",
    )


def placeholder_id(value: Column) -> Column:
    """Whether an id is missing, null or an empty text."""
    return F.coalesce(F.try_variant_get(value, F.lit("$"), "string"), F.lit("")) == ""


def _config_names() -> list[str]:
    return ["source", "items_path", "id_path", "success_path", "success_value", "actual_path", "total_path", "total_pages_path", "last_path", "null_items_are_empty", "fields", "company", "scope"]


def collect(payloads: DataFrame, configs: DataFrame, max_pages: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(records, coverage) of the lists in saved payloads (see ``read_pages``).

    Records have run, source, page, raw_index, id, company, scope, the mapped FIELDS as text, url_provenance, needs_details and raw (JSON);
    an item that a run has had before (same id, or without an id path same content) isn't recorded again, and pages after
    a run's end don't count. Coverage is ``pagination.proof`` with needs_details (count) and jd_complete. Mapped values that
    are lists or objects are JSON texts, missing and null ones null. Empty tables give empty results.
    """
    c = F.col
    # Bodies are parsed once: records and the proof both read what is stored.
    read = materialise(read_pages(payloads, configs), "list-pages")
    each = read.select("run", "page", F.explode("identities").alias("item"))
    runs = materialise(pagination.proof(each, read.select("run", "page", "total", "total_pages", "last", "actual", "error", "late_error"), max_pages), "list-runs")
    # Pages are narrow here; only those that were read give records, and not one that ended in an error.
    numbered = read.select("run", "page").withColumn("_at", F.row_number().over(Window.partitionBy("run").orderBy("page")))
    reasons = F.split("reasons", ",")
    failed = F.exists(reasons, lambda x: ~x.isin(*pagination.REASONS, ""))
    ended = runs.select("run", "pages_seen", failed.alias("_failed"), F.arrays_overlap(reasons, F.array(F.lit("repeated_page"), F.lit("duplicate_item_ids"))).alias("_again"))
    used = numbered.join(ended, "run").where((c("_at") < c("pages_seen")) | ((c("_at") == c("pages_seen")) & ~c("_failed"))).groupBy("run").agg(F.max("page").alias("_upto"), F.first("_again").alias("_again"))
    used = materialise(used, "list-used")
    split = lambda x: F.split(x, r"\.")
    paths = F.struct(*(split(F.try_element_at("fields", F.lit(f))).alias(f) for f in FIELDS), split(c("id_path")).alias("id"))

    def items_of(runs, *more):
        pages = read.join(runs, "run").where(c("page") <= c("_upto"))
        return pages.select("run", "source", "page", "company", "scope", paths.alias("_paths"), F.posexplode(F.arrays_zip("items", *more)).alias("raw_index", "_i"))

    # A page that brings an item again ends its run, so only such runs can have an item twice; elsewhere nothing is shuffled.
    plain = items_of(used.where("not _again")).withColumn("_item", c("_i.items"))
    first = Window.partitionBy("run", "_i.identities").orderBy("page", "raw_index")
    again = items_of(used.where("_again"), "identities").withColumn("_item", c("_i.items")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    kept = plain.drop("_i").unionByName(again.drop("_i"))
    names = (*FIELDS, "id")
    found = lambda m: F.struct(*(x.alias(n) for n, x in zip(names, walk_all(m, [c(f"_paths.{n}") for n in names]), strict=True)))
    kept = kept.withColumn("_f", U.let(members(c("_item")), found))
    text = lambda n: F.when(~F.is_variant_null(c(f"_f.{n}")), as_text(c(f"_f.{n}"))).alias(n)
    records = kept.select(
        "run", "source", "page", "raw_index", text("id"), "company", "scope", *map(text, FIELDS), F.when(placeholder_id(c("_f.url")), "missing").otherwise("response").alias("url_provenance"),
        (placeholder(c("_f.description")) | placeholder(c("_f.requirements"))).alias("needs_details"), F.to_json(c("_item")).alias("raw"),
    )
    needs = records.groupBy("run").agg(F.count_if("needs_details").alias("_needs"), F.count("*").alias("_records"))
    coverage = runs.join(needs, "run", "left").withColumn("needs_details", F.coalesce("_needs", F.lit(0)))
    return records, coverage.withColumn("jd_complete", F.coalesce(c("_records") > 0, F.lit(False)) & (c("needs_details") == 0)).drop("_needs", "_records")
