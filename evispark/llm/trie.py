"""A trie of conversations that share their first turns, merged by family first.

Conversations are dealt by their base id, so a family of at most twenty lies together in one sorted stream. There its
conversations are rebuilt and the family's small trie is built level by level, all conversations in lockstep, so the state
is one node for each of the twenty and never a family's turns. Only the combined nodes of families are shuffled, to be
merged into the nodes of all families.

Sums over subtrees need no walk by depth over the whole trie: each node counts in one family only, the one of its smallest
conversation, which has all ancestors of the node too. So a family sums up its own trie from the leaves to the root,
and a node's sum is that of its families' sums.

Turns are told apart by 128 bits of SHA-256 over role and text, nodes by those over their path; texts aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD

#: Ids in a family; a conversation takes fewer than SHARED first turns from its family's base.
SIBLINGS, SHARED = 20, 4
#: Families whose ids make one piece of a node's list of ends.
PIECE = 256
#: A node in more than this share of all rows is joined by broadcast; there are at most so many.
HOT = 4096

ROOT = hashlib.sha256(b"").digest()[:16]
NONE = hashlib.sha256(b"").hexdigest()


def family_of(conv_id: Column) -> Column:
    """The smallest id of the twenty that a conversation belongs with; ids below zero are rounded down too."""
    return conv_id - F.pmod(conv_id, F.lit(SIBLINGS))


def rebuilt(conversations: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """family, conv_id, depth and ``payload`` of each turn of each rebuilt conversation, and a row at depth 0 without payload.

    A conversation c has the first h turns of conversation c - c % 20 (all if it has fewer, none if there is no such one), then
    its own turns after its first h, with h = crc32 of c in decimal % 4. ``payload`` is computed before rows are dealt, and is all
    that is dealt. Turns go by ``turn``, null first; of equal ones those with the smaller payload come first, so repeated rows
    stay side by side. Rows without a conv_id belong to no conversation and are left out; other columns don't matter.
    """
    name = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id is not null").select(
        family_of(name).alias("family"), name.alias("conv_id"), F.col("turn").alias("turn"), F.struct(*(c.alias(k) for k, c in payload.items())).alias("payload")
    )
    order = Window.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "payload")
    placed = rows.repartition("family").withColumn("place", F.row_number().over(order))
    of_base = F.when((F.col("conv_id") == F.col("family")) & (F.col("place") < SHARED), F.struct("place", "payload"))
    # At most three turns, once for each family.
    placed = placed.withColumn("ahead", F.sort_array(F.collect_list(of_base).over(Window.partitionBy("family"))))
    kept = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    placed = placed.withColumn("kept", kept).withColumn("taken", F.least("kept", F.size("ahead")))
    turn = lambda depth, x: F.struct(depth.cast("long").alias("depth"), x.alias("payload"))
    none = F.array().cast(f"array<struct<depth:bigint,payload:{rows.schema['payload'].dataType.simpleString()}>>")
    taken = F.transform(F.slice("ahead", F.lit(1), F.col("taken")), lambda x: turn(x["place"], x["payload"]))
    top = F.array(turn(F.lit(0), F.lit(None).cast(rows.schema["payload"].dataType)))
    first = F.when(F.col("place") == 1, F.concat(top, taken)).otherwise(none)
    own = F.when(F.col("place") > F.col("kept"), F.array(turn(F.col("place") - F.col("kept") + F.col("taken"), F.col("payload")))).otherwise(none)
    each = placed.select("family", "conv_id", F.explode(F.concat(first, own)).alias("row"))
    return each.select("family", "conv_id", "row.depth", *(F.col(f"row.payload.{k}").alias(k) for k in payload))


FAMILY_NODES = "family long, depth long, node binary, parent binary, conv_id long, n_convs long, words long, ends array<long>"


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _in_batches(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]], most: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _table(held, schema)
            held = []
    yield _table(held, schema)


def family_nodes(turns: Iterator[tuple]) -> Iterator[tuple]:
    """The nodes of each family's trie from its turns (family, depth, conv_id, digest, words) in that order.

    ``ends`` are the conversations whose last turn a node is. A level is closed when the next one begins, so only two
    levels of one family are held, with at most twenty nodes each.
    """
    family, depth, level, at = None, None, [], {}
    open_nodes: dict[bytes, tuple] = {}  # of the level before: parent, conversations, words

    def close() -> Iterator[tuple]:
        nonlocal at, open_nodes
        going_on = {c for c, _, _ in level}
        for node, (parent, convs, words) in open_nodes.items():
            yield family, depth - 1, node, parent, convs[0], len(convs), words, [c for c in convs if c not in going_on]
        found: dict[bytes, tuple] = {}
        now = {}
        for conv, digest, words in level:
            parent = at.get(conv)
            node = ROOT if parent is None else hashlib.sha256(parent + digest).digest()[:16]
            now[conv] = node
            found.setdefault(node, (parent, [], words))[1].append(conv)
        at, open_nodes = now, found

    for f, d, conv, digest, words in turns:
        if (f, d) != (family, depth):
            if family is not None:
                yield from close()
                level = []
                if f != family:
                    depth += 1
                    yield from close()
                    at, open_nodes = {}, {}
            family, depth = f, d
        level.append((conv, digest, words or 0))
    if family is not None:
        yield from close()
        level, depth = [], depth + 1
        yield from close()


def family_sums(nodes: Iterator[tuple]) -> Iterator[tuple]:
    """What each family adds to its nodes, from rows (family, depth, node, parent, words, conv_id, n_convs, n_ends), deepest first.

    conv_id, n_convs and n_ends are those of the whole trie. A row is (node, n_leaves, saved_tokens, n_children, conv_id,
    depth, parent_conv_id, n_convs), the last four only from the family that the node counts in.
    """
    below: dict[bytes, list[int]] = {}
    waiting: dict[bytes, list[tuple]] = {}  # finished children, until the parent tells its conv_id
    for family, depth, node, parent, words, conv, n_convs, n_ends in nodes:
        counts_here = conv - conv % SIBLINGS == family
        leaves, saved, children = below.pop(node, (0, 0, 0))
        for row in waiting.pop(node, ()):
            yield (*row[:6], conv if row[4] is not None else None, row[7])
        if counts_here:
            leaves += n_ends == n_convs
            saved += (n_convs - 1) * words
        told = (conv, depth, None, n_convs) if counts_here else (None, None, None, None)
        row = (node, leaves, saved, children, *told)
        if parent is None:
            yield row
            continue
        waiting.setdefault(parent, []).append(row)
        up = below.setdefault(parent, [0, 0, 0])
        up[0] += leaves
        up[1] += saved
        up[2] += counts_here


def _digests(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """(node, digest) from rows (node, piece, ids) in order; the pieces of a node stream through one hash."""
    last, state = None, None
    for node, _, ids in pieces:
        if node != last:
            if last is not None:
                yield last, state.hexdigest()
            last, state = node, hashlib.sha256()
        else:
            state.update(b",")
        state.update(ids.encode())
    if last is not None:
        yield last, state.hexdigest()


def _streamed(df: DataFrame, step, schema: str, columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(step(_rows(batches)), columns)

    return df.mapInArrow(run, schema)


def family_tries(conversations: DataFrame) -> DataFrame:
    """The nodes of all families' tries, stored (see FAMILY_NODES)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substr(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(1), F.lit(32)))
    turns = rebuilt(conversations, {"digest": digest, "words": F.regexp_count(text, F.lit(WORD)).cast("long")})
    sorted_turns = turns.select("family", "depth", "conv_id", "digest", "words").sortWithinPartitions("family", "depth", "conv_id")
    columns = [("family", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("ends", pa.list_(pa.int64()))]
    return materialise(_streamed(sorted_turns, family_nodes, FAMILY_NODES, columns), "trie-families")


def ends_of(tries: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end: SHA-256 over their ids, ascending, in decimal with commas.

    Ids are put together in pieces of PIECE families first. One hash has to see a node's pieces in order, so they stream
    through one task, a row for up to 5,120 ids; nothing is held but a piece.
    """
    ending = tries.where(F.size("ends") > 0).select("node", F.floor(F.col("family") / (SIBLINGS * PIECE)).cast("long").alias("piece"), "ends")
    pieces = ending.groupBy("node", "piece").agg(F.sort_array(F.collect_list("ends")).alias("lists"))
    named = pieces.select("node", "piece", F.array_join(F.transform(F.flatten("lists"), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = named.repartition("node").sortWithinPartitions("node", "piece")
    return _streamed(dealt, _digests, "node binary, ends_sha256 string", [("node", pa.binary()), ("ends_sha256", pa.string())])


def trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of all rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty texts, so a null and an empty turn are the same. Conversations without turns of their own
    left over are members of the root. Equal turns, repeated rows and null turns are in ``rebuilt``. Turns may be of any
    length: a family's turns stream through one task. An empty table has no node. Other columns, whatever their names,
    are left out.
    """
    tries = family_tries(conversations)
    merged = tries.groupBy("node").agg(F.min("conv_id").alias("_conv"), F.sum("n_convs").alias("_convs"), F.sum(F.size("ends")).alias("_ends"), F.count("*").alias("_families"))
    merged = materialise(merged, "trie-nodes")
    # A node of many families would be one hot key of the join: these are at most HOT, and narrow.
    bound = max(16, tries.count() // HOT)
    hot = F.broadcast(merged.where(F.col("_families") > bound))
    rest = merged.where(F.col("_families") <= bound)
    wanted = ["family", "depth", "node", "parent", "words", "_conv", "_convs", "_ends"]
    told = tries.join(hot, "node").select(*wanted).union(tries.join(hot, "node", "left_anti").join(rest, "node").select(*wanted))
    upwards = told.repartition("family").sortWithinPartitions("family", F.col("depth").desc(), "node")
    names = ["n_leaves", "saved_tokens", "n_children", "conv_id", "depth", "parent_conv_id", "n_convs"]
    sums = _streamed(upwards, family_sums, "node binary, " + ", ".join(f"{n} long" for n in names), [("node", pa.binary()), *((n, pa.int64()) for n in names)])
    how = {n: F.sum if n in ("n_leaves", "saved_tokens", "n_children") else F.max for n in names}
    nodes = sums.groupBy("node").agg(*(how[n](n).alias(n) for n in names))
    found = nodes.join(ends_of(tries), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` (conv_id, depth and others) with the role and text of their last turn; both are null at the root."""
    payload = {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}
    turns = rebuilt(conversations, payload).select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), "role", "text")
    return nodes.join(turns, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") == F.col("_depth"))).drop("_conv", "_depth")
