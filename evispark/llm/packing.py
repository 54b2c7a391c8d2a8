"""Best-two-fit packing of token pieces into sequences of bounded length.

What fits with what depends on lengths alone, so the plan is made from the number of pieces of each length, of which there
are as many as a sequence has places, whatever the corpus' size. Spark cuts and counts the pieces, numbers those of each
length, and gives every piece the place that the plan has for its number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import give_back, long_array, running_start
from .tokens import END_ID, default_tokenizer, encoder

CAPACITY = 4096


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many alike, pieces of each length in one of them); ``counts`` has the pieces of each length.

    A bin is filled greedily with the longest piece that fits. Then its shortest piece is taken out, and if two pieces
    that aren't packed fill the gap so made more tightly, the tightest two take its place. The bin so found is repeated
    as often as its pieces last. Every round leaves fewer pieces of some length than its bin took of it, so there are
    fewer than about capacity * (1 + ln capacity) rounds, however many pieces there are.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {capacity}")
        left[length] = n
    index = np.arange(capacity + 1)
    plan = []

    def largest(free: np.ndarray) -> np.ndarray:
        """The largest length that is free, up to each length."""
        return np.maximum.accumulate(np.where(free > 0, index, 0))

    while (longest := int(largest(left)[-1])) > 0:
        free, took, gap = left.copy(), {}, capacity
        upto = largest(free)
        while (length := int(upto[gap])) > 0:
            n = min(gap // length, int(free[length]))
            took[length] = took.get(length, 0) + n
            free[length] -= n
            gap -= n * length
            if free[length] == 0:
                upto = largest(free)
        if gap and len(took) + max(took.values()) > 1:
            short = min(took)
            room = gap + short
            upto = largest(free)
            firsts = index[1 : room][free[1:room] > 0] if room > 1 else index[:0]
            if firsts.size:
                seconds = upto[room - firsts]
                # Two of one length need two of them; else the next shorter one is the second.
                alone = (seconds == firsts) & (free[firsts] < 2)
                seconds = np.where(alone, upto[np.maximum(np.minimum(seconds, room - firsts) - 1, 0)], seconds)
                sums = np.where(seconds > 0, firsts + seconds, 0)
                best = int(np.argmax(sums))
                if sums[best] > short:
                    took[short] -= 1
                    for length in (int(firsts[best]), int(seconds[best])):
                        took[length] = took.get(length, 0) + 1
                    took = {k: v for k, v in took.items() if v}
        times = min(int(left[k]) // v for k, v in took.items())
        for k, v in took.items():
            left[k] -= v * times
        plan.append((times, took))
        assert longest
    return plan


class Places:
    """Where the plan puts the n-th piece of a length."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        rows, used, sequence = [], {}, 0
        for times, took in plan:
            offset = 0
            for length in sorted(took, reverse=True):
                each = took[length]
                at = used.get(length, 0)
                rows.append((length, at, sequence, each, offset))
                used[length] = at + times * each
                offset += length * each
            sequence += times
        rows.sort()
        self.table = np.asarray(rows, dtype=np.int64).reshape(-1, 5)
        self.keys = (self.table[:, 0] << 48) | self.table[:, 1]
        self.sequences = sequence

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, sequence, each, offset = self.table[np.searchsorted(self.keys, (lengths << 48) | ranks, side="right") - 1].T
        turn, within = np.divmod(ranks - first, each)
        return sequence + turn, offset + within * lengths


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: its ids and END_ID, cut only where they exceed ``capacity``. Null texts count as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.asarray([END_ID], dtype="<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1)), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def place(cut: DataFrame, capacity: int = CAPACITY, per_bucket: int = 200) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length``; ``cut`` is read several times and should be stored.

    The driver gets one count for each length. Pieces of one length are numbered bucket by bucket, with more buckets for
    lengths that have more pieces, so no task holds all pieces of a length. An empty table gives an empty one.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = cut.sparkSession.sparkContext.broadcast(Places(best_two_fit(counts, capacity)))
    buckets = long_array([min(1 << 16, 1 + counts.get(i, 0) // per_bucket) for i in range(capacity + 1)])
    order = [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    keyed = cut.withColumns({"_bucket": F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(buckets, F.col("length").cast("int") + 1)), "_one": F.lit(1).cast("long")})
    ranked = running_start(keyed, ["length"], "_bucket", order, {"_rank": "_one"}).drop("_bucket", "_one")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            lengths, ranks = (batch.column(at(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = places.value.of(lengths, ranks)
            rest = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in rest), "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*cut.columns, "_rank").mapInArrow(put, f"{kept}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` with its place.

    Rows with equal ids or texts are packed each on its own; null texts are empty ones, whose only piece is the end id. Other
    columns, whatever their names, are left out. An empty table gives an empty result.
    """
    return place(materialise(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces"), capacity)
