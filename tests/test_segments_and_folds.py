"""OCR folds, role segments and agent records against plain Python."""

import random
import re

from pyspark.sql import functions as F

from evispark.functions import rules
from evispark.operators import agents, ocr, segments

NAMES = ("slice_index", "line_index", "text", "confidence", "left", "top", "width", "height")


def shows_the_same(a, b):
    """Whether two lines of different slices share half the smaller box, counted point by point."""
    if a["slice_index"] == b["slice_index"] or a["text"] != b["text"]:
        return False
    points = lambda x: {(p, q) for p in range(x["left"], x["left"] + x["width"]) for q in range(x["top"], x["top"] + x["height"])}
    p, q = points(a), points(b)
    return 2 * len(p & q) >= max(1, min(len(p), len(q)))


def plain_fold(lines):
    sure = lambda x: -1 if x["confidence"] is None else x["confidence"]
    slots = []
    for line in sorted(lines, key=lambda x: tuple(x[k] for k in ("top", "left", "slice_index", "line_index"))):
        slot = next((s for s in slots if shows_the_same(line, s[0])), None)
        if slot is None:
            slots.append([line])
        elif sure(line) > sure(slot[0]):
            slot[0] = line
    return [s[0] for s in slots]


def test_ocr_survivors_equal_a_fold(spark):
    rng = random.Random(3)
    rows = []
    for image in range(40):
        for i in range(rng.randint(1, 40)):
            rows.append((image, rng.randint(0, 3), i, rng.choice(["a", "b", ""]), rng.choice([None, 0.1, 0.5, 0.9, 0.9]), rng.randint(0, 12), rng.randint(0, 60), rng.choice([0, 4, 10]), rng.choice([3, 6, 12])))
    # Three in a chain: the first and the last stay.
    rows += [(99, 1, 0, "x", 0.9, 0, 0, 10, 10), (99, 2, 0, "x", 0.8, 0, 4, 10, 10), (99, 3, 0, "x", 0.7, 0, 8, 10, 10)]
    rows += [(100, 1, 0, "x", 0.9, 0, 0, 10, 10), (100, 2, 0, "x", 0.8, None, None, None, None), (100, 2, 1, "x", 0.8, 0, 0, 10, 10)]
    df = spark.createDataFrame(rows, "image long, slice_index int, line_index int, text string, confidence double, left int, top int, width int, height int")
    found = sorted((r["image"], r["slice_index"], r["line_index"]) for r in ocr.survivors(df.withColumn("_run", F.lit("clash"))).collect())
    expected = []
    for image in {r[0] for r in rows}:
        lines = [dict(zip(NAMES, r[1:], strict=True)) for r in rows if r[0] == image]
        kept = lines if image == 100 else plain_fold(lines)
        expected += [(image, x["slice_index"], x["line_index"]) for x in kept]
    assert found == sorted(expected) and [(i, s) for i, s, _ in found if i == 99] == [(99, 1), (99, 3)]
    assert ocr.survivors(df.where("false")).count() == 0
    assert {r["image"]: r["mean_confidence"] for r in ocr.mean_confidence(df.where("image >= 99"), ["image"]).collect()}[99] - 0.8 < 1e-9
    box = spark.createDataFrame([([[3, 1], [9, 2], [8, 7], [2, 6]],)], "p array<array<int>>").select(ocr.box_of(F.col("p")).alias("b")).first()["b"]
    assert tuple(box) == (2, 1, 7, 6)
    assert [r["line_index"] for r in df.where("image = 99").orderBy(*ocr.reading_order()).collect()] == [0, 0, 0]


def mention(title, segment):
    if re.search(rules.AI_MENTION, title):
        return True
    return any(re.search(rules.AI_MENTION, x) and (not re.search(rules.COMPANY_COPY, x) or re.search(rules.ROLE_COPY, x)) for x in segment.splitlines())


def plain_segment(title, titles, text):
    """By the rule's words, place by place."""
    forms = lambda t: {t, t[: min((t + "（(").index(c) for c in "（(")]} - {""}
    own = set()
    for form in forms(title):
        free = 0
        for p in range(len(text)):
            if p >= free and text.startswith(form, p):
                own.add(p)
                free = p + len(form)
    stops = {p for other in titles if other != title for form in forms(other) for p in range(len(text)) if text.startswith(form, p)}
    lines = {m.start() for m in re.finditer(f"(?m){rules.ROLE_LINE}", text)}
    cut = lambda p: text[p : min([len(text), p + 2200, *(q for q in stops if q > p), *(q for q in lines if q > p + len(title))])]
    every = [cut(p) for p in sorted(own)]
    telling = [x for x in every if mention(title, x)]
    return (telling or every or [title])[0]


def test_role_segments(spark):
    rng = random.Random(9)
    pool = ["AI工程师", "销售实习生", "数据工程师（上海）", "数据工程师", "产品经理(校招)", "a.b*c", "研究员"]
    bits = ["维护内部系统", "公司看好人工智能", "用过大模型的开发", "人工智能企业等你", "\n", "\n", " ", "x" * 600, "😀", "要求 Python\n", "数据分析工程师\n", " ", "\r\n"]
    rows = [(0, "秋招\n岗位\nAI工程师\n维护内部系统\n销售实习生\n人工智能企业等你", ["AI工程师", "销售实习生"]), (1, None, ["x"]), (2, "text", None), (3, "text", [None, " ", ""]), (4, "", ["AI工程师"])]
    for i in range(5, 150):
        rows.append((i, "".join(rng.choice([*bits, *pool]) for _ in range(rng.randint(1, 25))), rng.sample(pool, rng.randint(1, 4)) + [pool[0]]))
    df = spark.createDataFrame(rows, "k long, text string, titles array<string>")
    found = {(r["k"], r["title"]): r["segment"] for r in segments.role_segments(df, "k", "text", "titles").collect()}
    expected = {(k, t): plain_segment(t, list(dict.fromkeys(titles)), text or "") for k, text, titles in rows for t in titles or [] if t and t.strip()}
    wrong = {x: (found.get(x), expected[x]) for x in expected if found.get(x) != expected[x]}
    assert not wrong and len(found) == len(expected), list(wrong.items())[:3]
    assert found[0, "AI工程师"] == "AI工程师\n维护内部系统\n" and found[0, "销售实习生"].startswith("销售实习生")
    cells = spark.createDataFrame([(["a, b、c;;", None, "b\nd  e；"],)], "c array<string>")
    assert cells.select(segments.source_titles(F.col("c"))).first()[0] == ["a", "b", "c", "d e"]


JOB = "task_id string, nth int, id string, raw_job_id string, title string, url string, location string, department string, company string, requirements string, description string, text string, evidence_ids array<string>"
PACKET = "task_id string, title string, compact_text string, document_context string, evidence_ids array<string>"


def job(task, nth, **x):
    return tuple({**dict.fromkeys(("id", "raw_job_id", "title", "url", "location", "department", "company", "requirements", "description", "text")), "evidence_ids": [f"e{nth}"], **x}.get(k, {"task_id": task, "nth": nth}.get(k)) for k in ("task_id", "nth", "id", "raw_job_id", "title", "url", "location", "department", "company", "requirements", "description", "text", "evidence_ids"))


def test_agent_records(spark):
    packets = spark.createDataFrame([("t1", "T", "compact", "c" * 2000, ["x"]), ("t2", "D", "y" * 7000, None, ["h"]), ("t2", "D", "y" * 7000, None, ["h"]), ("t3", None, None, None, None)], PACKET)
    jobs = spark.createDataFrame(
        [
            job("t1", 0, id="a", title="A", requirements="r" * 4000, description="d" * 3000, text="extra"), job("t1", 1, id="a", title="A", requirements="r" * 4000, description="d" * 3000, text="extra"),
            job("t1", 2, id="a", title="A", requirements="other", description="d", text="d"), job("t1", 3, title="N"), job("t1", 4, title="N"), job("none", 0, id="z"),
        ],
        JOB,
    )
    found = agents.agent_records(packets, jobs).collect()
    by = {}
    for r in found:
        by.setdefault(r["task_id"], []).append(r)
    assert {t: len(r) for t, r in by.items()} == {"t1": 4, "t2": 1, "t3": 1} and len({r["record_id"] for r in found}) == 6
    long = next(r for r in by["t1"] if r["evidence_ids"] == ["e0"])
    assert {k: len(v) for k, v in long["texts"].items()} == {"requirements": 4000, "description": 2000, "text": 0, "document_context": 0}
    assert long["truncated_fields"] == ["description", "text", "document_context"] and long["original_chars"] == 9005 and long["included_chars"] == 6000
    alias = next(r for r in by["t1"] if r["evidence_ids"] == ["e2"])
    assert alias["field_aliases"] == {"text": "description"} and "text" not in alias["texts"] and len(alias["texts"]["document_context"]) == 512
    assert by["t2"][0]["kind"] == "document" and by["t2"][0]["truncated_fields"] == ["compact_text"] and by["t3"][0]["texts"] == {"compact_text": ""}
    assert agents.agent_records(packets.where("false"), jobs).count() == 0


def test_batches_fold_and_unfold(spark):
    rng = random.Random(5)
    fields = ["a", "b", "c", "own"]
    rows = []
    for batch in [None, *range(30)]:
        base = {f: rng.choice(["1", "2", None]) for f in fields}
        for n in range(rng.randint(1, 5)):
            rows.append((batch, n, {f: v if rng.random() < 0.8 else rng.choice(["9", None]) for f, v in base.items() if rng.random() < 0.9}))
    df = spark.createDataFrame(rows, "task int, nth int, record map<string,string>")
    contexts, residuals = agents.fold(df, "task", "record", ["a", "b", "c"])
    shared = {r["task"]: r["context"] for r in contexts.collect()}
    for batch in {r[0] for r in rows}:
        mine = [r[2] for r in rows if r[0] == batch]
        assert shared[batch] == {f: mine[0][f] for f in ("a", "b", "c") if all(f in m for m in mine) and len({m[f] for m in mine}) == 1}
    key = lambda r: (str(r[0]), r[1])
    for r in residuals.collect():
        assert not set(r["record"]) & set(shared[r["task"]])
    back = agents.unfold(contexts, residuals, "task", "record").collect()
    assert sorted(((r["task"], r["nth"], dict(r["record"])) for r in back), key=key) == sorted(rows, key=key)
    assert agents.fold(df.where("false"), "task", "record", ["a"])[0].count() == 0
