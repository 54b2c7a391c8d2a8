"""WARC fixity audit with Merkle trees: records and ordered ranges of offsets are hashed into a tree for each archive, the
roots of two replicas are compared, and only branches that differ are descended to find the records at fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import bucket_count

#: Bits of an offset below the lowest ranges (64 KiB), and bits that each level above takes more (16 ranges in one).
LEAF_BITS, FAN_BITS, LEVELS = 16, 4, 4
#: The date that records without one of their own have, so that reruns agree.
DATE = "1970-01-01T00:00:00Z"


def records_of(pages: DataFrame, pages_per_archive: int = 2000) -> DataFrame:
    """Pages as WARC resource records: page_id, archive, length and record, in archives of about so many pages.

    A page's archive goes by a hash of its id, url and text, so archives are dealt evenly, whatever ids repeat, and reruns
    agree. Null urls and pages count as empty, and an id that is no whole number as null; equal rows are records of their own. Other columns are left out.
    """
    rows = pages.count()
    archives = bucket_count(rows, pages_per_archive)
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    record = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    )
    named = pages.select(
        F.col("page_id").try_cast("long").alias("page_id"),
        F.pmod(F.xxhash64("page_id", url, html), F.lit(archives)).cast("int").alias("archive"),
        record.alias("record"),
    )
    return named.withColumn("length", F.octet_length("record").cast("long"))


def placed(records: DataFrame) -> DataFrame:
    """Add each record's offset: an archive's records lie in order of id, null ids first, then of content, without gaps."""
    order = [F.col("page_id").asc_nulls_first(), F.col("record")]
    before = Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def warc_records(pages: DataFrame, pages_per_archive: int = 2000) -> DataFrame:
    """The records of ``pages`` with their offsets."""
    return placed(records_of(pages, pages_per_archive))


def leaves(records: DataFrame) -> DataFrame:
    """The records' digests, without the records."""
    digest = F.sha2("record", 256) if "record" in records.columns else F.col("digest")
    return records.select("archive", "offset", "length", "page_id", digest.alias("digest"))


def tree(hashed: DataFrame) -> dict[int, DataFrame]:
    """For each level, 0 the lowest and LEVELS the roots, a table (archive, node, digest) of the ranges of offsets.

    A lowest range holds the records that begin in it, a higher one the sixteen ranges below, a root its archive; each
    digest is over what lies below in order. A group is a range, or sixteen rows; a root has one row more for each 4 GiB of its archive
    beyond the first four levels' reach. All levels are stored.
    """

    def over(rows: DataFrame, node, parts: list[str]) -> DataFrame:
        inner = F.array_sort(F.collect_list(F.struct(*parts)))
        text = F.array_join(F.transform(inner, lambda x: F.concat_ws(":", *(x[p].cast("string") for p in parts))), "\n")
        return rows.groupBy("archive", node.alias("node")).agg(F.sha2(text, 256).alias("digest"))

    levels = {0: materialise(over(hashed, F.shiftright("offset", LEAF_BITS), ["offset", "length", "digest"]), "fixity-level")}
    for level in range(1, LEVELS + 1):
        node = F.shiftright("below", FAN_BITS) if level < LEVELS else F.lit(0).cast("long")
        levels[level] = materialise(over(levels[level - 1].withColumnRenamed("node", "below"), node, ["below", "digest"]), "fixity-level")
    return levels


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """The nodes whose digests differ or that only one replica has."""
    a, b = left.withColumnRenamed("digest", "a"), right.withColumnRenamed("digest", "b")
    return a.join(b, ["archive", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """The records at which two replicas (archive, offset, length, page_id, and record or its digest) differ.

    ``status`` is altered, missing (from the second) or extra (in the second); digests and lengths are of either replica.
    Equal replicas give an empty result, as do empty tables. Where several records claim one offset, they are compared in
    order of their digests. Trees are stored in the shared folder, then compared from the roots down: each level opens
    only the children of nodes that differ above, and what it opens is stored for the next.
    """
    sides = [materialise(leaves(x), "fixity-leaves") for x in (first, second)]
    trees = [tree(side) for side in sides]
    open_nodes = materialise(differing(trees[0][LEVELS], trees[1][LEVELS]), "fixity-open")
    for level in reversed(range(LEVELS)):
        parent = F.shiftright("node", FAN_BITS) if level < LEVELS - 1 else F.lit(0).cast("long")
        above = open_nodes.withColumnRenamed("node", "_parent")
        below = [t[level].withColumn("_parent", parent).join(above, ["archive", "_parent"], "left_semi").drop("_parent") for t in trees]
        open_nodes = materialise(differing(*below), "fixity-open")
    within = Window.partitionBy("archive", "offset").orderBy("digest", F.col("page_id").asc_nulls_first())
    opened = []
    for side, name in zip(sides, "ab", strict=True):
        found = side.withColumn("node", F.shiftright("offset", LEAF_BITS)).join(open_nodes, ["archive", "node"], "left_semi")
        opened.append(found.withColumn("_nth", F.row_number().over(within)).select("archive", "offset", "_nth", *(F.col(c).alias(f"{name}_{c}") for c in ("page_id", "length", "digest"))))
    both = opened[0].join(opened[1], ["archive", "offset", "_nth"], "full_outer").where(~F.col("a_digest").eqNullSafe(F.col("b_digest")))
    status = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra").otherwise("altered")
    return both.select(
        F.coalesce("a_page_id", "b_page_id").alias("page_id"),
        "archive",
        "offset",
        status.alias("status"),
        F.col("a_length").alias("length"),
        F.col("a_digest").alias("digest"),
        F.col("b_length").alias("found_length"),
        F.col("b_digest").alias("found_digest"),
    )


def changed(record):
    """A record with its first byte changed."""
    return F.concat(F.lit("X"), F.substr(record, F.lit(2)))


def damaged(records: DataFrame) -> DataFrame:
    """A replica (page_id, offset, record and others) with known damage, for audits of the audit: of ids that leave 3 by 97
    one byte is changed, those that leave 5 by 89 are missing, and those that leave 7 by 83 are there a second time, one
    byte further."""
    page = F.col("page_id")
    kept = records.where(page.isNull() | (F.pmod(page, F.lit(89)) != 5))
    kept = kept.withColumn("record", F.when(F.pmod(page, F.lit(97)) == 3, changed(F.col("record"))).otherwise(F.col("record")))
    twice = F.sequence(F.lit(0), F.when(F.pmod(page, F.lit(83)) == 7, 1).otherwise(0))
    return kept.withColumn("_more", F.explode(twice)).withColumn("offset", F.col("offset") + F.col("_more")).drop("_more")


def index(records: DataFrame) -> DataFrame:
    """The index of a replica (archive, page_id, digest, length, n, offset) from its records' digests.

    Records alike are counted first and lie side by side, so no group of copies is ever sorted; ``offset`` is the first's.
    """
    alike = records.groupBy("archive", "page_id", "digest", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return alike.withColumn("offset", F.coalesce(F.sum(F.col("n") * F.col("length")).over(before), F.lit(0).cast("long")))


def audited(pages: DataFrame) -> DataFrame:
    """The audit of all pages' records against a stored replica with planted damage (see ``damaged``).

    The replica's records are written to the shared folder and read back, so the bytes of both sides are hashed on their own.
    What the replica says of itself is only whence each record came (its name in the first one's index), not its digest; its offsets are
    the index's. Records are hashed where they are read, and only digests are shuffled.
    Null ids, urls and pages and repeated rows are records like others; other columns, whatever their names, are left out.
    An empty table gives an empty result.
    """
    records = records_of(pages)
    digest = F.sha2("record", 256)
    first = materialise(index(records.select("archive", "page_id", digest.alias("digest"), "length")), "fixity-index")
    replica = damaged(records.select("archive", "page_id", digest.alias("name"), F.lit(0).cast("long").alias("offset"), "record"))
    stored = materialise(replica, "fixity-replica")
    read = stored.select("archive", "page_id", "name", "offset", digest.alias("digest"), F.octet_length("record").cast("long").alias("length"))
    # Copies of a record are alike on both sides, so they are counted and matched as one row, then told apart by their places.
    counted = read.groupBy("archive", "page_id", "name", "offset", "digest", "length").agg(F.count("*").alias("found"))
    known = first.select("archive", F.col("page_id").alias("_page"), F.col("digest").alias("name"), F.col("length").alias("_step"), F.col("offset").alias("_at"))
    matched = counted.join(known, ["archive", "name"]).where(F.col("page_id").eqNullSafe(F.col("_page")))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = first.withColumn("_i", copies("n")).select("archive", (F.col("offset") + F.col("_i") * F.col("length")).alias("offset"), "length", "page_id", "digest")
    right = matched.withColumn("_i", copies("found")).select("archive", (F.col("_at") + F.col("_i") * F.col("_step") + F.col("offset")).alias("offset"), "length", "page_id", "digest")
    return audit(left, right)
