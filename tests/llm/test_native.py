"""Fingerprints, quality rules, sharding and mixing against brute force."""

import collections
import hashlib
import re
import zlib

from pyspark.sql import functions as F

from evispark.llm import fingerprints, mixing, quality, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_fingerprints(docs, texts):
    found = table(fingerprints.document_fingerprints(docs))
    ids = sorted(texts, reverse=True)
    for this, following in zip(ids, ids[1:] + ids[:1]):
        a, b = texts[this], texts[following]
        k = len(a) // 3
        edited = a[: len(a) - k] + b[:k]
        assert found[this]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[this]["n_chars"] == len(a) and 0 <= found[this]["near_next"] <= 1
    marks = {texts[i]: found[i]["fingerprint"] for i in ids}
    assert all(marks[texts[i]] == found[i]["fingerprint"] for i in ids) and len(set(marks.values())) == len(marks)
    mean = lambda c: sum(r[c] for r in found.values()) / len(found)
    assert mean("near_edited") > 0.45 and mean("near_next") < 0.2


def test_fingerprints_add_and_take_away(spark):
    df = spark.createDataFrame([(1, "a fine day.\nb was here.\nc"), (2, "c\nb was here.\na fine day."), (3, "a fine day."), (4, "b was here.\nc")], "k int, text string")
    marks = table(fingerprints.fingerprints(df, ["k"]), "k")
    assert marks[1]["mark"] == marks[2]["mark"] != marks[3]["mark"]
    both = spark.createDataFrame([(marks[1]["mark"], marks[3]["mark"], marks[4]["mark"])], "w array<bigint>, a array<bigint>, b array<bigint>")
    row = both.select((fingerprints.combine(F.col("a"), F.col("b")) == F.col("w")).alias("sum"), (fingerprints.remove(F.col("w"), F.col("a")) == F.col("b")).alias("rest"), fingerprints.likeness(F.col("w"), F.col("w")).alias("same")).first()
    assert row["sum"] and row["rest"] and row["same"] == 1.0


def test_wide_components_use_the_whole_modulus(spark):
    df = spark.range(400).select(F.floor(F.col("id") / 2).alias("k"), F.concat(F.lit("line "), "id").alias("text"))
    marks = [r["mark"] for r in fingerprints.fingerprints(df, ["k"]).collect()]
    wide = [m[65:81] for m in marks]
    assert all(m[64] == 4 and m[81] == 2 for m in marks) and all(0 <= x < 1 << 32 for w in wide for x in w)
    # Sums of two random components wrap half of the time, and are spread over the whole modulus.
    assert all(1.7e9 < sum(w[i] for w in wide) / len(wide) < 2.6e9 and max(w[i] for w in wide) > 4e9 for i in range(16))
    split = fingerprints.fingerprints(spark.createDataFrame([(1, "a fine day. it was"), (2, "a fine day.\nit was")], "k int, text string"), ["k"])
    one, two = (r["mark"] for r in split.orderBy("k").collect())
    assert one[:64] == two[:64] and one[65:81] != two[65:81]


def exact_likeness(a, b):
    cut = lambda t: collections.Counter(p for line in t.split("\n") for p in re.split(fingerprints.CUT, line) if p.strip(" \t\n\x0b\f\r"))
    x, y = cut(a), cut(b)
    dot = lambda u, v: sum(n * v[k] for k, n in u.items())
    return dot(x, y) / max(1, dot(x, x) + dot(y, y) - dot(x, y))


def test_likeness_of_each_row_is_near_the_exact_one(docs, texts):
    found = table(fingerprints.document_fingerprints(docs))
    ids = sorted(texts, reverse=True)
    off = []
    for this, following in zip(ids, ids[1:] + ids[:1]):
        a, b = texts[this], texts[following]
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        off += [abs(found[this]["near_edited"] - exact_likeness(a, edited)), abs(found[this]["near_next"] - exact_likeness(a, b))]
    # The standard error is about 0.09 of the larger size; no row may be six times that off.
    assert max(off) < 0.55 and sum(off) / len(off) < 0.1


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprints.document_fingerprints(odd).collect()
    assert len(rows) == odd.count() and all(r["n_chars"] is not None for r in rows)
    blank = [r["fingerprint"] for r in rows if r["doc_id"] in (0, 1, 2)]
    assert len(set(blank)) == 1 and set(blank[0]) == {"0"}
    assert fingerprints.document_fingerprints(empty).count() == 0
    one = odd.where("doc_id = 3").limit(1)
    assert fingerprints.document_fingerprints(one).first()["near_next"] == 1.0


def measures(text):
    w = WORDS.findall(text or "")
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, texts, odd, empty):
    for r in quality.judged(docs).collect():
        n = measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])
    out = quality.judged(odd).collect()
    assert len(out) == odd.count()
    for r in out:
        if r["doc_id"] in (0, 1, 2):
            assert r["n_words"] == 0 and not r["kept"]
    assert quality.judged(empty).count() == 0


def test_ablation_equals_recounting(docs):
    ledger = quality.ledger(docs).cache()
    bits = [r["fail_bits"] & quality.mask("v1") for r in ledger.collect()]
    for r in quality.ablation(ledger).collect():
        bit = next(1 << x.bit for x in quality.rules() if x.name == r["rule"])
        assert (r["fails"], r["rejected_alone"]) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))
        assert r["kept_without"] == sum(not b & ~bit for b in bits)


def test_sharding(docs, texts, odd, empty):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == len(texts)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean, most = sum(sizes.values()) / 8, max(len(t) for t in texts.values())
    assert all(abs(s - mean) <= most for s in sizes.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(tuple, sharding.sharded(docs.repartition(5)).collect())) == sorted(map(tuple, rows))
    out = sharding.sharded(odd).collect()
    assert len(out) == odd.count() and sharding.sharded(empty).count() == 0


def test_a_hot_text_is_spread(spark):
    df = spark.range(3000).withColumn("text", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id")))).withColumnRenamed("id", "doc_id")
    sizes = [r["s"] for r in sharding.sharded(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_small_groups_stay_whole_beside_long_texts(spark):
    long = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("long"), F.floor(F.col("id") / 2)), 4000).alias("text"))
    short = spark.range(2000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("text"))
    rows = sharding.sharded(long.unionByName(short)).collect()
    shards = collections.defaultdict(set)
    for r in rows:
        shards[r["text_crc32"], r["size"]].add(r["shard"])
    assert not [k for k, v in shards.items() if len(v) > 1 and k[1] < 1000] and len(rows) == 2040
    assert sum(len(v) > 1 for v in shards.values()) <= 7


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, out, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        rest, total = goal - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            free.discard(s)


def test_mixing(docs, texts, odd, empty):
    for frame in (docs, odd):
        rows = mixing.mixed(frame).collect()
        source = {r["doc_id"]: r["source"] for r in frame.select("doc_id", "source").collect()}
        assert len(rows) == frame.count()
        sizes, taken, told = collections.Counter(), collections.Counter(), {}
        for r in rows:
            s = source[r["doc_id"]] if r["doc_id"] is not None else None
            sizes[s] += r["size"]
            taken[s] += r["taken"]
            told[s] = r["target"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        for s, goal in targets({k: v for k, v in sizes.items()}).items():
            assert abs(told[s] - goal) < 1e-6 and abs(taken[s] - goal) <= 1
    assert sorted(map(str, mixing.mixed(docs.repartition(7)).collect())) == sorted(map(str, mixing.mixed(docs).collect()))
    assert mixing.mixed(empty).count() == 0


def test_training_order(docs):
    placed = mixing.curriculum(docs)
    rows = mixing.training_order(placed, ["doc_id", "text"]).collect()
    words = sum(len(WORDS.findall(r["text"])) for r in rows)
    assert words == sum(r["taken"] for r in placed.select("taken").collect())
    positions = [r["position"] for r in rows]
    assert positions == sorted(positions)
