"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one class. A class's prefix is the part of its set that any linked class must share
some shingles with: all but 80 % of its shingles, and ``must_share`` more, in an order from rare to frequent. Classes that
share so many with others of fitting sizes are put into groups by the most shared one, and the matrix has a row for each shingle and group in whose
prefixes it is, the groups' token unions. Two groups that share a row are opened: a class of one is compared with the
members of the other only if the other's whole token union covers 80 % of it.

First every group is compared within itself and with the first group of its kind, and links are joined to components.
Then groups are formed anew, each of one large component or of small ones, and only pairs that can join two components are
opened. So a family of near copies costs in proportion to its size once it hangs together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import give_back
from .tokens import texts

WIDTH = 5
#: Counters of shingles; a counter is shared by all shingles of equal low bits, which changes their order and nothing else.
COUNTERS, BLOCK = 1 << 22, 1 << 16
#: Bits of the bitmap of ids.
SLOTS = 1 << 24
#: Classes and shingles of a group, about.
MEMBERS, TOKENS = 48, 100_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
_NONE = np.empty(0, dtype=np.uint64)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(bodies: list[bytes]) -> list[np.ndarray]:
    """For each text, its distinct shingles as ascending 64-bit hashes.

    Texts are hashed word by word in pieces of about PIECE bytes, many short ones or a part of a long one, so beside its words'
    hashes no text needs more memory than a piece.
    """
    words: list[list[np.ndarray]] = [[] for _ in bodies]
    held, size = [], 0
    for i, body in enumerate(bodies):
        for part in _parts(body):
            held.append((i, part))
            size += len(part) + 1
            if size >= PIECE:
                _hash_words(held, words)
                held, size = [], 0
    if held:
        _hash_words(held, words)
    return [_shingles(w[0] if len(w) == 1 else np.concatenate(w) if w else _NONE) for w in words]


def _parts(body: bytes) -> Iterator[bytes]:
    """A text in pieces that end at white space."""
    at = 0
    while len(body) - at > PIECE:
        end = at + PIECE
        while end < len(body) and not _SPACES[body[end]]:
            end += 1
        yield body[at:end]
        at = end
    yield body[at:]


def _hash_words(held: list[tuple[int, bytes]], words: list[list[np.ndarray]]) -> None:
    """Add to each text's list the hashes of the words of its pieces."""
    data = _LOWER[np.frombuffer(b" ".join(part for _, part in held) + b" ", dtype=np.uint8)]
    space = _SPACES[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edges[0::2], edges[1::2]
    if not starts.size:
        return
    first = np.searchsorted(starts, np.cumsum([0, *(len(part) + 1 for _, part in held)]))
    # A word's hash: its bytes mixed with their places, summed, and its length, mixed again.
    place = np.zeros(len(data), dtype=np.int64)
    place[starts] = starts
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data)), place, out=place)
    mixed = _mix((place.view(np.uint64) << np.uint64(8)) + data + np.uint64(0x9E3779B97F4A7C15))
    mixed[space] = 0
    hashes = _mix(np.add.reduceat(mixed, starts) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for (i, _), lo, hi in zip(held, first[:-1], first[1:], strict=True):
        if hi > lo:
            words[i].append(hashes[lo:hi])


def _shingles(w: np.ndarray) -> np.ndarray:
    n = len(w)
    if not n:
        return _NONE
    wide = min(WIDTH, n)
    h = np.full(n - wide + 1, wide, dtype=np.uint64)
    for k in range(wide):
        h = _mix(h * np.uint64(0x9FB21C651E98DF25) + w[k : n - wide + 1 + k])
    return np.unique(h)


def need(n):
    """How many shingles a set of n must share with any that it links with."""
    return -(-4 * n // 5)


def must_share(n):
    """Shingles of its prefix that a set of n shares with any that it links with and that isn't smaller."""
    return np.minimum(need(n), 1 + n // 32)


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def survey(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, key) and rows of shingle counters (block, counts), in one pass over the texts.

    ``key`` is a hash of the set; with n it stands for the class.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counters = np.zeros(COUNTERS, dtype=np.uint32)
        names, kinds = ["doc_id", "n", "key", "block", "counts"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        make = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        for batch in batches:
            sets = shingle_sets(list(texts(batch)))
            for some in (sets[i : i + 500] for i in range(0, len(sets), 500)):
                low, times = np.unique(np.concatenate(some) & np.uint64(COUNTERS - 1), return_counts=True)
                counters[low.astype(np.int64)] += times.astype(np.uint32)
            rows = len(sets)
            yield make(batch.column(0), [len(s) for s in sets], [_key(s) for s in sets], [None] * rows, [None] * rows)
        pack = zstandard.ZstdCompressor(level=1)
        blocks = [i for i in range(COUNTERS // BLOCK) if counters[i * BLOCK : (i + 1) * BLOCK].any()]
        packed = [pack.compress(np.minimum(counters[i * BLOCK : (i + 1) * BLOCK], 65535).astype("<u2").tobytes()) for i in blocks]
        yield make(*([None] * len(blocks) for _ in range(3)), blocks, packed)
        del counters
        give_back()

    schema = "doc_id long, n long, key long, block int, counts binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, schema)


def shingle_counts(surveyed: DataFrame) -> np.ndarray:
    """The sums of the counters: COUNTERS numbers, however large the corpus is."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(unpack.decompress(packed.as_py()), dtype="<u2").astype(np.uint64)
                sums[block] = sums[block] + counts if block in sums else counts
        done = [np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(done, pa.binary())], ["block", "counts"])

    rows = surveyed.where("block is not null").select("block", "counts").repartition(16, "block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(COUNTERS, dtype=np.uint32)
    for row in rows.collect():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(bytes(row["counts"]), dtype="<u4")
    return out


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Rows (token, key, n) of each class's prefix, rare shingles first; a class comes once from each task at most."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    give_back()  # what sums and their copies took from the driver

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            tokens, keys, sizes = [], [], []
            for s in shingle_sets(list(texts(batch))):
                n = len(s)
                if not n or (key := (_key(s), n)) in seen:
                    continue
                seen.add(key)
                rarity = shared.value[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                tokens.append(s[np.argsort(rarity, kind="stable")[: n - need(n) + must_share(n)]].view(np.int64))
                keys.append(key[0])
                sizes.append(n)
            many = [len(t) for t in tokens]
            if many:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.asarray(keys, dtype=np.int64), many)), pa.array(np.repeat(np.asarray(sizes, dtype=np.int64), many))], ["token", "key", "n"])
        give_back()

    return docs.select("text").mapInArrow(read, "token long, key long, n long")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """The rows (token, key, n) whose token another class of fitting size has in its prefix too, without repeats, and how ``many`` classes have it.

    Linked sets differ in size by a quarter at most, and if any class fits, the one next in size does.
    """
    by = Window.partitionBy("token").orderBy("n", "key")
    n, key = F.col("n"), F.col("key")
    same = (F.lag("key").over(by) == key) & (F.lag("n").over(by) == n)
    # Repeats stand together; they go first, so that no class is taken for its own neighbour.
    once = rows.withColumn("_repeat", F.coalesce(same, F.lit(False))).where("not _repeat").drop("_repeat")
    fits = F.coalesce(5 * F.lag("n").over(by) >= 4 * n, F.lit(False)) | F.coalesce(5 * n >= 4 * F.lead("n").over(by), F.lit(False))
    marked = once.withColumns({"_fits": fits, "many": F.count("*").over(Window.partitionBy("token"))})
    return marked.where("_fits").select("token", "key", "n", "many")


def likely(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, n, kind, tokens) of the classes that share as many shingles of their prefixes as they must, if they link at all.

    ``tokens`` are those shingles, ``kind`` the one that most classes have. They are gathered where the join with ``classes``
    (key, n, id) has dealt them, so each crosses to another task once, and from here on a class is one row.
    """
    m = F.floor((4 * F.col("n") + 4) / 5)  # the smallest size that fits
    must = F.least(F.floor((4 * m + 4) / 5), 1 + F.floor(m / 32))
    of_class = shared.join(classes, ["key", "n"]).groupBy("key", "n")
    found = of_class.agg(F.min("id").alias("id"), F.max(F.struct("many", "token")).getField("token").alias("kind"), F.collect_list("token").alias("tokens"))
    return found.where(F.size("tokens") >= must).select("id", "n", "kind", "tokens")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, comp) for each of ``nodes`` (id): the smallest id that edges (a, b) reach, by repeated halving of the paths.

    Each round takes, for every node, the smallest label about it and the label's own label; it ends when none changes.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialise(nodes.select("id", F.col("id").alias("comp")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("_near"))
        hop = labels.select(F.col("id").alias("comp"), F.col("comp").alias("_up"))
        # The label of a label carries a node on by as many links as the label has come.
        stepped = labels.join(around, "id", "left").join(hop, "comp", "left")
        found = stepped.select("id", F.col("comp").alias("_was"), F.least("comp", "_near", "_up").alias("comp"))
        stored = materialise(found, "labels")
        labels = stored.select("id", "comp")
        if stored.where("comp < _was").isEmpty():
            return labels


def joined_on(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, comp), components themselves, with those joined that more ``links`` (a, b) lead between.

    Only links between components count, and rounds go over the components that have any.
    """
    of = lambda side: labels.select(F.col("id").alias(side), F.col("comp").alias(f"_{side}"))
    across = links.join(of("a"), "a").join(of("b"), "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    across = materialise(across, "links")
    if across.isEmpty():
        return labels
    nodes = across.select(F.col("a").alias("id")).union(across.select("b")).distinct()
    over = components(across, nodes).select(F.col("id").alias("comp"), F.col("comp").alias("_over"))
    return materialise(labels.join(over, "comp", "left").select("id", F.coalesce("_over", "comp").alias("comp")), "labels")


def _links(members: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]] | None) -> list[tuple[int, int]]:
    """Links between members (others is None), or between members and others: enough to join what is linked.

    Whatever hangs together is linked to its smallest id itself, so that ``components`` has few rounds.
    """
    every = members + (others or [])
    ids = [c for c, _ in every]
    tokens, flat = np.unique(np.concatenate([s for _, s in every]), return_inverse=True)
    sizes = np.asarray([len(s) for _, s in every])
    owner = np.repeat(np.arange(len(every)), sizes)
    cut = len(members)
    parent = list(range(len(every)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # The union of the tokens of each side, and how much of every set on the other side it covers.
    if others:
        in_left, in_right = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
        in_left[flat[owner < cut]] = True
        in_right[flat[owner >= cut]] = True
        cover = np.bincount(owner, weights=np.where(owner < cut, in_right[flat], in_left[flat]), minlength=len(every))
        asked = np.flatnonzero(cover >= need(sizes))
        left, right = asked[asked < cut], asked[asked >= cut]
    else:
        left = right = np.arange(len(every))
    if not left.size or not right.size:
        return []
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(tokens), bool)
    spans = [flat[bounds[i] : bounds[i + 1]] for i in right]
    joined, starts = np.concatenate(spans), np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])
    for i in left:
        mark[:] = False
        mark[flat[bounds[i] : bounds[i + 1]]] = True
        common = np.add.reduceat(mark[joined].astype(np.int64), starts)
        union = sizes[i] + sizes[right] - common
        for j in right[100 * common >= 80 * union]:
            if i != j and root(int(i)) != root(int(j)):
                parent[root(int(i))] = root(int(j))
    least: dict[int, int] = {}
    for i, c in enumerate(ids):
        least[root(i)] = min(c, least.get(root(i), c))
    return sorted({(c, least[root(i)]) for i, c in enumerate(ids) if least[root(i)] < c})


def _read_side(row, name: str) -> list[tuple[int, np.ndarray]]:
    return [(i, np.frombuffer(data, dtype=np.uint64)) for i, data in {(x["id"], x["set"]) for x in row[name]}]


def verified(pairs: DataFrame) -> DataFrame:
    """Links (a, b) from rows with ``members`` and ``others`` (null: within the members)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(("members", "others"))}
                found += _links(_read_side(row, "members"), _read_side(row, "others") if row["others"] is not None else None)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        give_back()

    return pairs.select("members", "others").mapInArrow(read, "a long, b long")


def compared(pairs: DataFrame) -> DataFrame:
    """The links, stored. A row holds the sets of two groups, a few megabytes at most; Spark bounds a batch by its bytes."""
    return materialise(verified(pairs), "links")


def grouped(classes: DataFrame, kind: str) -> DataFrame:
    """Deal classes (id, n, <kind>) to groups of about MEMBERS classes and TOKENS shingles: adds ``part`` and ``grp``."""
    classes = materialise(classes, "dealt")  # read twice
    parts = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / TOKENS))
    loads = materialise(classes.groupBy(kind).agg(parts.alias("_parts")), "loads")  # so that a hot kind's join can be split
    dealt = classes.join(loads, kind).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_parts")))
    return dealt.withColumn("grp", F.xxhash64(kind, "part")).drop("_parts")


def class_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, key, set) of the rows of ``docs`` whose id is among ``ids``, and of few others.

    Ids are looked up in a bitmap of SLOTS bits, whatever their number, so that the other texts needn't be shuffled.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)) + 1
    slots = ids.select(slot(F.col("id").cast("long")).alias("s"))
    rows = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    bitmap = np.zeros(SLOTS // 8, dtype=np.uint8)
    for r in rows:
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False) - 1
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7)) & 1 == 1))
            sets = shingle_sets(list(texts(batch)))
            columns = [batch.column(0), pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "set"])
        give_back()

    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").select("id", slot(F.col("id")).alias("slot"), "text")
    return named.mapInArrow(read, "id long, key long, set binary")


def class_links(docs: DataFrame, found: DataFrame, counts: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(classes, labels): classes (key, n, id) with the smallest doc_id as id, and (id, comp) of those with a candidate."""
    classes = materialise(found.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("id")), "classes")
    chosen = materialise(likely(shared_tokens(prefixes(docs, counts)), classes), "prefixes")
    del counts  # as many as there are counters; a large part of a small driver
    groups = materialise(grouped(chosen.select("id", "n", "kind"), "kind"), "groups")

    wanted = groups.join(classes.select("id", "key", "n"), ["id", "n"]).select("id", "key", "grp")
    sets = class_sets(docs, wanted.select("id")).join(wanted, ["id", "key"])
    inside = materialise(sets.groupBy("grp").agg(F.collect_list(F.struct("id", "set")).alias("members")), "members")
    hubs = groups.select("kind", "part", "grp").distinct()
    first = hubs.where("part = 0").select("kind", F.col("grp").alias("hub"))
    with_hub = materialise(hubs.where("part > 0").join(first, "kind").select("grp", F.col("hub").alias("other")), "pairs")
    own = inside.select("members", F.lit(None).cast(inside.schema["members"].dataType).alias("others"))
    links = compared(own.unionByName(open_pairs(with_hub, inside)))
    labels = components(links, groups.select("id").distinct())

    # Formed anew: large components alone, small ones together by kind; then whatever can still join two components.
    sized = labels.join(labels.groupBy("comp").agg(F.count("*").alias("_size")), "comp").join(groups.select("id", "n", "kind", F.col("grp").alias("was")), "id")
    again = sized.withColumn("kind", F.when(F.col("_size") >= MEMBERS // 4, F.xxhash64("comp", F.lit(9))).otherwise(F.col("kind")))
    regrouped = materialise(grouped(again.select("id", "n", "kind", "comp", "was"), "kind"), "groups")
    alone = regrouped.groupBy("grp").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.min("was") < F.max("was")).alias("new")
    )
    matrix = crossing(chosen, regrouped).distinct().join(alone.select("grp", "lo", "hi"), "grp")
    open_tokens = matrix.groupBy("token").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.count("*").alias("_many")).where("_lo < _hi and _many > 1").select("token")
    rows = materialise(matrix.join(open_tokens, "token"), "matrix")
    other = rows.select("token", F.col("grp").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = rows.join(other, "token").where("grp < other and not (lo = hi and lo2 = hi2 and lo = lo2)").select("grp", "other").distinct()
    pairs = materialise(pairs, "pairs")
    fresh = alone.where("lo < hi and new").select("grp")
    asked = materialise(pairs.select("grp").union(pairs.select("other")).union(fresh).distinct(), "asked")
    again = materialise(regrouped.select("id", "grp").join(asked, "grp", "left_semi").distinct(), "asked")
    dealt = inside.select(F.explode("members").alias("m")).select(F.col("m.id").alias("id"), F.col("m.set").alias("set")).join(again, "id")
    members = materialise(dealt.groupBy("grp").agg(F.collect_list(F.struct("id", "set")).alias("members")), "members")
    own = members.join(fresh, "grp", "left_semi").select("members", F.lit(None).cast(members.schema["members"].dataType).alias("others"))
    more = compared(own.unionByName(open_pairs(pairs, members)))
    return classes, joined_on(labels, more)


def crossing(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """(token, grp) of the classes whose shingle some class of another component has in its prefix too, stored.

    Only such a shingle can join two components; most are of one family and needn't be dealt out by group. ``tokens`` has
    (id, token), or a class's ``tokens`` in one row.
    """
    each = F.explode("tokens").alias("token") if "tokens" in tokens.columns else F.col("token")
    named = tokens.join(groups.select("id", "grp", "comp"), "id").select(each, "grp", "comp")
    several = named.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("token")
    return materialise(named.join(several, "token", "left_semi").select("token", "grp"), "crossing")


def open_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The contents of pairs of groups (grp, other).

    Only groups of a pair are shuffled: where ``pairs`` is stored and small beside the sets, it is sent to them.
    """
    paired = members.join(pairs.select(F.col("other").alias("grp")), "grp", "left_semi")
    other = paired.select(F.col("grp").alias("other"), F.col("members").alias("others"))
    return pairs.join(members, "grp").join(other, "other").select("members", "others")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``.

    Two texts link when 100 * shared shingles >= 80 * shingles of either; component_id is the smallest doc_id that links
    reach. Null texts and texts without words have no shingles, link with nothing, and have their own doc_id. Rows with a
    null doc_id belong to their text's component, which is null where no doc_id is in it. Rows of one doc_id with different
    texts are compared by each text's smallest doc_id. Equal rows give equal rows; an empty table gives an empty one.
    Counts, candidates and comparisons cover all texts in full; shingles are told apart by 64-bit hashes.
    """
    surveyed = materialise(survey(docs), "survey")
    found = surveyed.where("block is null").select("doc_id", "n", "key")
    classes, labels = class_links(docs, found, shingle_counts(surveyed))
    joined = classes.join(labels, "id", "left").select("key", "n", F.coalesce("comp", "id").alias("component_id"))
    stored = materialise(joined, "components")
    return found.join(stored, ["key", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
