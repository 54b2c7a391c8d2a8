"""Token files and packing against the tokenizer itself."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evispark.llm import packing, tokens

PATH = tokens.default_tokenizer()


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Z'.\n\t\x0b\x1c\x85\xa0 éÉßİıſŉ12²ªσΣς'sllve<|endoftext|>你😀ﬁ́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_encode_as_the_whole_text_does(text):
    full = Tokenizer.from_file(PATH) if not hasattr(test_words_encode_as_the_whole_text_does, "t") else test_words_encode_as_the_whole_text_does.t
    test_words_encode_as_the_whole_text_does.t = full
    expected = full.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encoder(PATH).ids(text.encode()), dtype="<u4").tolist() == expected
    new = tokens.Encoder.__new__(tokens.Encoder)
    new.__dict__ |= tokens.encoder(PATH).__dict__ | {"by_word": {}, "old_words": {}, "MOST": 3, "BLOCK": 30}
    found = [np.frombuffer(x, dtype="<u4").tolist() for x in new.many(pa.array([text, None, "", text + " Abc, abc!", text]))]
    assert found == [expected, [], [], full.encode(text + " Abc, abc!", add_special_tokens=False).ids, expected]


def test_long_texts_cross_in_small_batches(spark, whole):
    from pyspark.sql import functions as F

    df = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("Word "), "id", F.lit(", ")), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    found = df.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 300 and max(r["bytes"] for r in found) < 5 << 20
    out = {r["doc_id"]: r for r in packing.pieces(df.where("doc_id < 3"), PATH, 1 << 30).collect()}
    for i in range(3):
        ids = whole.encode(f"Word {i}, " * 10_000, add_special_tokens=False).ids + [tokens.END_ID]
        assert (out[i]["length"], out[i]["ids_crc32"]) == (len(ids), crc(ids))


def test_token_files(docs, texts, whole, odd, empty):
    rows = {r["doc_id"]: r for r in tokens.token_table(docs).collect()}
    start = 0
    for i in sorted(texts):
        ids = whole.encode(texts[i], add_special_tokens=False).ids + [tokens.END_ID]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    out = sorted(tokens.token_table(odd).collect(), key=lambda r: r["start"])
    assert len(out) == odd.count() and [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    assert tokens.token_table(empty).count() == 0


def test_a_hot_id_has_several_files(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(900).select(F.when(F.col("id") < 500, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    files = tokens.write_token_files(df, f"file://{tmp_path}", PATH, docs_per_file=50).cache()
    assert files.agg(F.sum("n_docs"), F.max("n_docs")).first()[0] == 900 and files.agg(F.max("n_docs")).first()[0] < 150
    rows = sorted(tokens.read_token_files(files, 2).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [7] * 500 + list(range(500, 900)) and [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()


def test_frames_are_read_one_by_one_and_checked():
    out = io.BytesIO()
    docs = [(7, np.arange(5, dtype="<u4").tobytes()), (9, b""), (9, np.arange(3, dtype="<u4").tobytes())]
    assert tokens.write_frames(out, docs) == (3, 8)
    data = out.getvalue()
    reader = tokens.FrameReader(io.BytesIO(data), len(data))
    assert reader.find(9) == [1, 2] and reader.document(2).tolist() == [0, 1, 2] and reader.document(0).tolist() == [0, 1, 2, 3, 4]
    import zstandard

    assert zstandard.ZstdDecompressor().decompressobj().decompress(data) == docs[0][1]
    broken = bytearray(data)
    broken[int(reader.offsets[2]) + 8] ^= 255
    with pytest.raises(Exception):
        tokens.FrameReader(io.BytesIO(bytes(broken)), len(data)).document(2)
    with pytest.raises(ValueError):
        tokens.FrameReader(io.BytesIO(data[:-1]), len(data) - 1)


def test_packing(docs, texts, whole, odd, empty):
    for frame in (docs, odd):
        rows = packing.packed(frame).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 4096
        total = sum(r["length"] for r in rows)
        assert len(bins) <= 1.03 * total / 4096 + 2
    ids = {i: whole.encode(t, add_special_tokens=False).ids + [tokens.END_ID] for i, t in texts.items()}
    seen = {i: 0 for i in ids}
    for r in packing.packed(docs).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert crc(part) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
        seen[r["doc_id"]] += r["length"]
    assert all(seen[i] == len(ids[i]) for i in ids)
    assert packing.packed(empty).count() == 0


def test_two_take_the_place_of_one():
    # 60 + 30 leaves 10; 25 + 15 fill what 30 leaves.
    plan = packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert (1, {60: 1, 25: 1, 15: 1}) in plan


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randint(1, 200): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        plan = packing.best_two_fit(counts, 200)
        used = {}
        for times, took in plan:
            assert sum(k * v for k, v in took.items()) <= 200
            for k, v in took.items():
                used[k] = used.get(k, 0) + v * times
        assert used == counts


def test_lookup_reads_the_documents_it_is_asked_for(spark, odd, whole):
    from evispark.session import materialise, shared_path

    rows = odd.select("doc_id", "text")
    folder = shared_path(spark, "lookup-files").removeprefix("file://")
    import os

    os.makedirs(folder)
    files = materialise(tokens.write_token_files(rows, f"file://{folder}", PATH), "lookup-table")
    paths = [r["path"] for r in files.select("path").distinct().collect()]
    wanted = spark.createDataFrame([(p, i) for p in paths for i in (5, None, 12_345)] + [("file:///nowhere", 5)], "path string, doc_id long")
    found = tokens.lookup(files, wanted).collect()
    expected = [(r["doc_id"], whole.encode(r["text"] or "", add_special_tokens=False).ids + [tokens.END_ID]) for r in rows.collect() if r["doc_id"] in (5, None)]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found) == sorted((str(i), ids) for i, ids in expected)
