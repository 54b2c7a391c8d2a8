import pytest

#: Columns whose names the operators use inside.
CLASH = ["size", "mark", "range", "fail_bits", "_key", "_bucket", "shard", "slot", "taken", "target", "id", "key", "n", "token", "grp", "length", "severity", "toxic", "file", "slope", "weight", "cap", "source_size", "first_taken", "second_taken", "first_position", "second_position", "position", "p_toxic", "grade", "piece", "sequence_id", "offset", "component_id", "n_shingles"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(6000))
    base = " ".join(f"near{i}" for i in range(60))
    texts = [None, "", "   \n\t ", "one", "one", base, base + " tail", base.upper(), long, long, "a b c a b c a b c", "grün Ärger 你好 😀 words\nwords\nwords", "x" * 5000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *(["clash"] * len(CLASH))) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
