"""Document fingerprints: a homomorphic multiset hash of a text's passages, in DataFrame functions only.

Each paragraph (line) is hashed to a wide vector of sixteen components drawn over all of 0 to 2**32 - 1, and a document's
fingerprint is the sum of its paragraphs' vectors modulo 2**32, with their number. So the order of paragraphs doesn't matter,
paragraphs can be added and taken away later, and the difference of two fingerprints is that of the two multisets.

Sums over the whole modulus tell whether multisets are equal, not how alike they are. For that, the fingerprint has 128 more
components, one bit of a passage each, summed modulo 2**20: a passage is a part of a paragraph, which is cut after punctuation
and after words that end in one of the letters a to h, so that a change moves no boundaries beyond the next one. They add up
and are taken away in the same manner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, bucket_of, long_array, quantile_edges

CUT = r"(?<=[.!?,;:a-h*&$#%])[\x20\x09-\x0D]+"
#: Components of a paragraph's vector, and their modulus.
WIDE, FULL = 16, (1 << 32) - 1
#: Two components a long, 32 bits apart, so that sums of up to 2**31 passages don't run into each other.
BITS, HALF, WIDTH = 20, 32, 64
PAIR = (1 << HALF) | 1
KEEP = PAIR * ((1 << BITS) - 1)
SPARE = PAIR << BITS
COUNT = (1 << 40) - 1


def passages(paragraph: Column) -> Column:
    """The passages of a paragraph; those without anything but white space are left out by ``fingerprints``."""
    return F.split(paragraph, CUT, -1)


def _real(text: Column) -> Column:
    return F.coalesce(F.length(F.btrim(text, F.lit(" \t\n\x0b\f\r"))) > 0, F.lit(False))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``mark``, the fingerprint of each key's text, as an array of longs.

    Null and empty texts have the zero fingerprint. Rows of one key are one multiset. Where the rows already lie together
    by some of the keys, there is no shuffle. Paragraphs and passages of white space only don't count.
    """
    lines = texts.select(*keys, F.explode_outer(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_line"))
    # A paragraph's own hashes stand beside its first passage only.
    named = lines.select(*keys, "_line", F.when(_real(F.col("_line")), F.xxhash64("_line")).alias("_x"), F.xxhash64(F.lit(2), "_line").alias("_y"))
    each = named.select(*keys, "_x", "_y", F.posexplode_outer(passages(F.col("_line"))).alias("_at", "_p"))
    real, first = _real(F.col("_p")), (F.col("_at") == 0) & F.col("_x").isNotNull()
    hashed = each.select(
        *keys,
        F.when(real, F.xxhash64("_p")).otherwise(0).alias("_a"),
        F.when(real, F.xxhash64(F.lit(1), "_p")).otherwise(0).alias("_b"),
        real.cast("long").alias("_n"),
        *(F.when(first, F.xxhash64("_x", "_y", F.lit(i))).otherwise(0).alias(f"_w{i}") for i in range(WIDE // 2)),
        first.cast("long").alias("_m"),
    )
    sums = [
        F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR))).alias(f"{h}{i}") for h in ("_a", "_b") for i in range(HALF)
    ]
    wide = [F.sum(half).alias(f"{h}{k}") for h in (f"_w{i}" for i in range(WIDE // 2)) for k, half in (("l", F.col(h).bitwiseAND(F.lit(FULL))), ("h", F.shiftrightunsigned(h, 32)))]
    summed = hashed.groupBy(*keys).agg(*sums, F.sum("_n").alias("_n"), *wide, F.sum("_m").alias("_m"))
    lanes = [F.col(f"{h}{i}").bitwiseAND(F.lit(KEEP)) for h in ("_a", "_b") for i in range(HALF)]
    more = [F.col(f"_w{i}{k}").bitwiseAND(F.lit(FULL)) for i in range(WIDE // 2) for k in "lh"]
    count = lambda c: F.col(c).bitwiseAND(F.lit(COUNT))
    return summed.select(*keys, F.array(*lanes, count("_n"), *more, count("_m")).alias("mark"))


def _by_part(left: Column, right: Column, lanes, single) -> Column:
    """Two fingerprints put together: the bit components by ``lanes``, what follows by ``single`` and its modulus."""
    pair = lambda at, n, f: F.zip_with(F.slice(left, at, n), F.slice(right, at, n), f)
    count = lambda at: pair(at, 1, lambda x, y: single(x, y).bitwiseAND(F.lit(COUNT)))
    wide = pair(WIDTH + 2, WIDE, lambda x, y: single(x, y).bitwiseAND(F.lit(FULL)))
    return F.concat(pair(1, WIDTH, lanes), count(WIDTH + 1), wide, count(WIDTH + WIDE + 2))


def combine(left: Column, right: Column) -> Column:
    """The fingerprint of both multisets together."""
    return _by_part(left, right, lambda x, y: (x + y).bitwiseAND(F.lit(KEEP)), lambda x, y: x + y)


def remove(whole: Column, part: Column) -> Column:
    """The fingerprint of ``whole`` without the paragraphs of ``part``."""
    return _by_part(whole, part, lambda x, y: (x.bitwiseOR(F.lit(SPARE)) - y).bitwiseAND(F.lit(KEEP)), lambda x, y: x - y)


def as_text(mark: Column) -> Column:
    """A fingerprint as lowercase hex."""
    return F.lower(F.array_join(F.transform(mark, lambda x: F.lpad(F.hex(x), 13, "0")), ""))


def signs(mark: Column) -> Column:
    """For each component, passages that have its bit set less those without; near zero, so read modulo 2**20."""
    half, full = 1 << (BITS - 1), (1 << BITS) - 1
    shift = F.lit(half) - F.try_element_at(mark, F.lit(WIDTH + 1))

    def near(ones: Column) -> Column:
        return ((ones * 2 + shift).bitwiseAND(F.lit(full)) - half).cast("double")

    lanes = F.slice(mark, 1, WIDTH)
    return F.concat(
        F.transform(lanes, lambda x: near(x.bitwiseAND(F.lit(full)))),
        F.transform(lanes, lambda x: near(F.shiftrightunsigned(x, HALF))),
    )


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def tanimoto(both: Column, left: Column, right: Column) -> Column:
    share = both / F.nullif(left + right - both, F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), F.lit(0.0))


def likeness(left: Column, right: Column) -> Column:
    """The estimated share of passages that two multisets have in common, from 0 to 1, from their fingerprints alone.

    Equal fingerprints have 1; an empty multiset has 0 with any other. The bits act as random signs, so products of
    sign sums estimate how many passages are shared, with a standard error of about 0.09 of the larger size.
    """
    a, b = signs(left), signs(right)
    return F.when(left == right, 1.0).otherwise(tanimoto(dot(a, b), dot(a, a), dot(b, b)))


def with_next(df: DataFrame, columns: list[str], id_column: str = "doc_id", per_bucket: int = 250) -> DataFrame:
    """Add ``next_<column>``: the values of the row that follows in descending order of the ids; after the last, the first.

    Ids are cut into ranges at quantiles; the row at a cut goes to both its ranges, so that no range needs another.
    The result lies together by ``range``, another new column, and ``_row`` numbers the rows of a range. Null ids come last; rows of one id are ordered by
    ``columns``; equal rows may follow one another in any order.
    """
    keyed = df.withColumn("_id", F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))))
    ids = keyed.select("_id")
    edges = quantile_edges(ids, "_id", bucket_count(ids.count(), per_bucket, 1 << 14))
    if not edges:
        return keyed.drop("_id").withColumns({f"next_{c}": F.col(c) for c in columns} | {"range": F.lit(0), "_row": F.lit(0)})
    own = keyed.withColumn("_bucket", bucket_of(F.col("_id"), edges))
    bucket, first, last = F.col("_bucket"), F.col("_id") == edges[0], F.col("_id") == edges[-1]
    place = lambda where, kind: F.struct(where.cast("int").alias("range"), F.lit(kind).alias("kind"))
    # A row is given out by the range below the cut it stands on and closes the range above; the lowest is in range 1.
    places = (
        F.when(F.lit(len(edges) == 1), F.array(place(F.lit(1), "own"), place(F.lit(1), "wrap")))
        .when(first, F.array(place(F.lit(1), "own")))
        .when(last, F.array(place(bucket - 1, "own"), place(F.lit(1), "wrap")))
        .when(F.try_element_at(long_array(edges), bucket) == F.col("_id"), F.array(place(bucket - 1, "own"), place(bucket, "close")))
        .otherwise(F.array(place(bucket, "own")))
    )
    placed = own.withColumn("_place", F.explode(places)).withColumns({"range": F.col("_place.range"), "_kind": F.col("_place.kind")})
    order = Window.partitionBy("range").orderBy(
        (F.col("_kind") == "wrap").asc(), F.col("_id").desc(), *(F.col(c).asc_nulls_first() for c in columns)
    )
    beside = {f"next_{c}": F.lead(c).over(order) for c in columns} | {"_row": F.row_number().over(order)}
    found = placed.drop("_place", "_bucket").withColumns(beside)
    return found.where(F.col("_kind") == "own").drop("_id", "_kind")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text, and their likeness.

    The edited text ends in the beginning of the next document (descending doc_id, cyclic) instead of its last third.
    Null texts count as empty. Empty texts have the zero fingerprint and the likeness 1 to each other. Other columns,
    whatever their names, are left out. An empty table gives an empty result. Texts are shuffled once, to their ranges of
    ids; all sums stay within a range.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, part = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    near = with_next(base, ["text"]).withColumn("edited", F.concat(F.left("text", size - part), F.left("next_text", part)))
    keys = ["range", "_row", "doc_id", "n_chars", "edited_sha256"]
    texts = near.select(
        "range",
        "_row",
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited", "next_text")).alias("which", "text"),
    )
    marks = fingerprints(texts, [*keys, "which"])
    mark = lambda i: F.max(F.when(F.col("which") == i, F.col("mark"))).alias(f"m{i}")
    rows = marks.groupBy(*keys).agg(mark(0), mark(1), mark(2))
    signed = rows.withColumns({f"s{i}": signs(F.col(f"m{i}")) for i in range(3)})
    pairs = {"00": (0, 0), "11": (1, 1), "22": (2, 2), "01": (0, 1), "02": (0, 2)}
    dots = signed.withColumns({f"d{k}": dot(F.col(f"s{i}"), F.col(f"s{j}")) for k, (i, j) in pairs.items()})
    c = F.col
    return dots.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(c("m0")).alias("fingerprint"),
        as_text(c("m1")).alias("edited_fingerprint"),
        F.when(c("m0") == c("m1"), 1.0).otherwise(tanimoto(c("d01"), c("d00"), c("d11"))).alias("near_edited"),
        F.when(c("m0") == c("m2"), 1.0).otherwise(tanimoto(c("d02"), c("d00"), c("d22"))).alias("near_next"),
    )
