"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are dealt to ranges, and
overfull ranges are subdivided. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import bucket_count, bucket_of, long_array, running_start

#: Samples for each range, on average.
SAMPLES = 32


def size_of(text="text"):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def weighted_splitters(sized: DataFrame, key: str, size: str, ranges: int, total: int) -> list[int]:
    """Quantiles of a key sample in which a record appears once for each ``total / (SAMPLES * ranges)`` of its size.

    What is left over of its size decides by a hash of the key and size whether it appears once more, so reruns agree.
    The driver gets about SAMPLES * ranges keys at most, however many records there are.
    """
    share = F.col(size) * F.lit(SAMPLES * ranges / max(1, total))
    chance = F.pmod(F.xxhash64(key, size, F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = sized.select(F.col(key).alias("k"), F.floor(share + chance).alias("n")).where("n > 0").groupBy("k").agg(F.sum("n").alias("n"))
    sample = sorted((r["k"], r["n"]) for r in drawn.collect())
    weight, passed, out = sum(n for _, n in sample), 0, []
    for k, n in sample:
        # A key becomes a splitter when the sample before it crosses into a new quantile.
        if passed and passed * ranges // weight > (out and out[-1][1] or 0):
            out.append((k, passed * ranges // weight))
        passed += n
    return [k for k, _ in out]


def _lookup(values: dict[int, int], key):
    """The value that a bounded map of literals has for a long; null for others."""
    if not values:
        return F.lit(None).cast("long")
    keys = sorted(values)
    at = F.array_position(long_array(keys), key)
    return F.when(at > 0, F.try_element_at(long_array([values[k] for k in keys]), F.greatest(at, F.lit(1)).cast("int")))


def place(sized: DataFrame, shards: int = 8, ranges_per_shard: int = 128, id_column: str = "doc_id", rows_per_range: int = 20_000) -> DataFrame:
    """Add shard and slot to records that have a ``size`` and a ``_key`` (equal for records that should stay together).

    ``sized`` is read several times. Ranges of keys lie between sampled splitters. A range that holds more than twice its
    share is subdivided: keys that are larger than a range by themselves (a hot group, a very long text) get ranges of their
    own, and only these are split further, by a hash of the id; what else is in the range is split by the key, so no other
    group comes apart. Ranges go to shards in order, by where their middle lies in the running size, and slots number a
    shard's records from 0 in that order. The driver gets splitters, and one row for each range and each such key.
    """
    narrow = sized.select("_key", "size")
    rows, total = narrow.agg(F.count("*"), F.sum("size")).first()
    rows, total = rows or 0, total or 1
    ranges = max(1, min(rows or 1, max(shards * ranges_per_shard, bucket_count(rows, rows_per_range, 1 << 14))))
    splitters = weighted_splitters(narrow, "_key", "size", ranges, total)
    share = total / ranges
    ranged = narrow.withColumn("_range", bucket_of(F.col("_key"), splitters))
    loads = {r["_range"]: r["_load"] for r in ranged.groupBy("_range").agg(F.sum("size").alias("_load")).collect()}
    over = [r for r, load in loads.items() if load > 2 * share]
    parts: dict[int, int] = {}
    if over:
        # Keys of overfull ranges that fill a range alone: ``ranges`` at most, as their sizes add up to the total at most.
        inside = ranged.where(F.array_contains(long_array(over), F.col("_range").cast("long"))).groupBy("_key").agg(F.sum("size").alias("_load"), F.count("*").alias("_rows"))
        hot = inside.where(F.col("_load") > share).collect()
        parts = {r["_key"]: int(min(max(1, r["_load"] // share), r["_rows"], 1 << 12)) for r in hot}
        # A cut before and after each such key, and cuts by the key where more than twice the share is left between cuts.
        heavy = {r["_key"]: r["_load"] for r in hot}
        cuts = sorted({*splitters, *parts, *(k + 1 for k in parts if k < (1 << 63) - 1)})
        extra = []
        for r in over:
            low = splitters[r - 1] if r else -(1 << 63)
            high = splitters[r] if r < len(splitters) else (1 << 63) - 1
            left = loads[r] - sum(load for k, load in heavy.items() if low <= k and (k < high or r == len(splitters)))
            pieces = min(1 << 12, int(left // share))
            extra += [low + (high - low) * i // pieces for i in range(1, pieces)] if pieces > 2 else []
        splitters = sorted({*cuts, *extra})
    dealt = sized.withColumn("_range", bucket_of(F.col("_key"), splitters).cast("long"))
    spread = F.coalesce(_lookup(parts, F.col("_key")), F.lit(1))
    dealt = dealt.withColumn("_cell", F.col("_range") * (1 << 12) + F.pmod(F.xxhash64(id_column, F.lit(11)), spread))
    cells = dealt.groupBy("_cell").agg(F.sum("size").alias("_load"))
    until = F.sum("_load").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    middle = F.coalesce(until, F.lit(0)) + F.col("_load") / 2
    placed = cells.select(F.col("_cell"), F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total)))).cast("int").alias("shard"))
    dealt = dealt.join(F.broadcast(placed), "_cell").withColumn("_one", F.lit(1).cast("long"))
    order = [F.col("_key"), F.col(id_column).asc_nulls_first(), F.col("size")]
    return running_start(dealt, ["shard"], "_cell", order, {"slot": "_one"}).drop("_key", "_range", "_cell", "_one")


def shard(records: DataFrame, shards: int = 8, ranges_per_shard: int = 128, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Add size, shard and slot to each record; the shards' sizes are near equal.

    The key is the text's hash, so equal texts lie together and share a shard, unless a shard's boundary falls into a
    group that is larger than a range by itself.
    Null texts have the size 1 and form one group with empty ones. Equal rows get slots of their own. An empty table gives an
    empty one. Columns that start with an underscore are dropped; ``size``, ``shard`` and ``slot`` are replaced.
    """
    kept = [c for c in records.columns if not c.startswith("_") and c not in ("size", "shard", "slot")]
    return place(records.select(*kept, size_of(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key")), shards, ranges_per_shard, id_column)


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The shard table of ``docs`` under the law ``bytes``. Texts are read once; what is placed and read again is narrow.

    Nulls, ties, repeated rows and empty tables are as for ``shard``; other columns are left out.
    """
    body = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.crc32(body).alias("text_crc32"), size_of("text").alias("size"), F.xxhash64(body).alias("_key"))
    return place(materialise(narrow, "sizes"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
