"""Joins with fallbacks, replacement by key, and matches of names and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..session import materialise
from .dedup import best_by


def fallback_join(rows: DataFrame, row_key: list[str], probes: list[Column], table: DataFrame, table_key: str) -> DataFrame:
    """Rows left-joined to the table's row that the first probe with a match finds; ``probe`` says which (null: none)."""
    each = rows.select(*row_key, F.posexplode(F.array(*probes)).alias("probe", "_value")).where(F.col("_value").isNotNull())
    hit = each.join(table, each["_value"] == table[table_key])
    found = best_by(hit, row_key, [F.col("probe")], ["probe", *table.columns])
    return rows.join(found, row_key, "left")


def task_lookup(rows: DataFrame, row_key: list[str], url_columns: list[str], tasks: DataFrame) -> DataFrame:
    """The task of each row: by the first of its URLs that is stored. Where that task hasn't run and is an article, one of
    the same host and path that has run takes its place. Rows without a task get the status ``not_started``."""
    stored = tasks.withColumn("_url", U.canonical(F.col("url")))
    joined = fallback_join(rows, row_key, [U.canonical(F.col(c)) for c in url_columns], stored, "_url")
    waiting = F.col("status").isin("pending", "not_started")
    done = stored.where(~waiting & U.is_article(F.col("url"))).withColumn("_article", U.article_key(F.col("url")))
    same = best_by(done, ["_article"], [F.col("url")], ["url", "status"]).select("_article", F.col("url").alias("_same_url"), F.col("status").alias("_same_status"))
    keyed = joined.withColumn("_article", F.when(waiting & U.is_article(F.col("url")), U.article_key(F.col("url"))))
    out = keyed.join(same, "_article", "left")
    return out.withColumns(
        {"url": F.coalesce("_same_url", "url"), "status": F.coalesce("_same_status", "status", F.lit("not_started"))}
    ).drop("_same_url", "_same_status", "_article", "_url")


def keyed_fallback(rows: DataFrame, exact: DataFrame, key: list[str], loose: list[str], value: str) -> DataFrame:
    """``value`` of the row with the same ``key``, else of the one with the ``loose`` key whose rest is blank."""
    rest = [c for c in key if c not in loose]
    general = exact.where(" and ".join(f"coalesce(cast({c} as string), '') = ''" for c in rest)).select(*loose, F.col(value).alias("_general"))
    special = exact.select(*key, F.col(value).alias("_special"))
    return rows.join(special, key, "left").join(general, loose, "left").withColumn(value, F.coalesce("_special", "_general")).drop("_special", "_general")


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows of keys that ``new`` doesn't have, and all of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def backfill(rows: DataFrame, source: DataFrame, key: list[str], column: str) -> DataFrame:
    """Blank values of a column taken from the other table's row of the same key; of several values the least counts."""
    known = source.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*key).agg(F.min(column).alias("_known"))
    return rows.join(known, key, "left").withColumn(column, F.coalesce(F.when(F.col(column) != "", F.col(column)), "_known")).drop("_known")


def pending(queue: DataFrame, tasks: DataFrame, key: str, valid: Column) -> DataFrame:
    """Queue rows without a valid stored result."""
    return queue.join(tasks.where(valid).select(key).distinct(), key, "left_anti")


def augment(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Rows and those of ``more`` whose key isn't there yet."""
    return rows.unionByName(more.join(rows.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def applied_companies(rows: DataFrame, company: str, history: DataFrame, recorded: str) -> DataFrame:
    """Mark rows whose company is among recorded ones: an equal name, one that begins the other, or one (3 or more) inside.

    Equal names, names that begin another, and names inside others are found by equi joins over parts of names, so there is no
    nested loop however long the history is. Only parts of lengths that recorded names have are looked at.
    """
    tokens = rows.select(company).distinct().select(company, F.explode(T.company_tokens(F.col(company))).alias("token"))
    known = materialise(history.select(F.explode(T.company_tokens(F.col(recorded))).alias("known")).distinct(), "names")
    many = known.agg(F.array_sort(F.collect_set(F.length("known")))).first()[0]  # a few dozen lengths
    lengths = F.array(*map(F.lit, many)).cast("array<int>")
    # A part that begins the token counts from two characters, one inside it from three.
    places = lambda n: F.sequence(F.lit(1), F.when(n >= 3, F.length("token") - n + 1).otherwise(1))
    parts = F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length("token")), lambda n: F.transform(places(n), lambda at: F.substr("token", at, n))))
    forward = tokens.select(company, F.explode(F.array_distinct(parts)).alias("known"))
    own = materialise(tokens.select(F.length("token").alias("n")).distinct(), "lengths").agg(F.array_sort(F.collect_set("n"))).first()[0]
    starts = F.transform(F.filter(F.array(*map(F.lit, own)).cast("array<int>"), lambda n: n <= F.length("known")), lambda n: F.substr("known", F.lit(1), n))
    backward = known.select(F.explode(starts).alias("token")).distinct()
    hits = forward.join(known, "known", "left_semi").select(company).union(tokens.join(backward, "token", "left_semi").select(company)).distinct()
    return rows.join(hits.withColumn("_hit", F.lit(True)), company, "left").withColumn("applied", F.coalesce("_hit", F.lit(False))).drop("_hit")


def applied_urls(rows: DataFrame, url: str, history: DataFrame, recorded: str) -> DataFrame:
    """Mark rows whose URL shares a key with a recorded URL."""
    known = history.select(F.explode(U.keys(F.col(recorded))).alias("key")).distinct()
    hits = rows.select(url).distinct().select(url, F.explode(U.keys(F.col(url))).alias("key")).join(known, "key", "left_semi").select(url).distinct()
    return rows.join(hits.withColumn("_hit", F.lit(True)), url, "left").withColumn("applied", F.coalesce("_hit", F.lit(False))).drop("_hit")


def descendants(edges: DataFrame, roots: DataFrame, stored: int = 4) -> DataFrame:
    """(root, id, depth) for what hangs below roots by edges (parent, id); each id keeps its shortest way to a root.

    One join a level; it ends when a level adds nothing. What each ``stored`` levels add is written, which cuts the lineage.
    """
    frontier = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    before, recent, depth = None, frontier, 0
    while True:
        found = recent if before is None else before.unionByName(recent)
        depth += 1
        below = frontier.select("root", F.col("id").alias("parent")).join(edges, "parent").select("root", "id", F.lit(depth).alias("depth")).distinct()
        frontier = below.join(found.select("root", "id"), ["root", "id"], "left_anti")
        if frontier.isEmpty():
            return found
        recent = recent.unionByName(frontier)
        if depth % stored == 0:
            part = materialise(recent, "descendants")
            before = part if before is None else before.unionByName(part)
            frontier, recent = part.where(F.col("depth") == depth), part.where("false")
