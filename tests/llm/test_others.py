"""Licences, near duplicates, toxicity, fixity and the pipeline against brute force."""

import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evispark.llm import fixity, jaccard, licences, toxicity

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = WORDS.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}, {i: len(s) for i, s in sets}


def check_components(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    comp, n = brute_components(rows)
    found = jaccard.near_duplicates(df).collect()
    assert len(found) == df.count()
    for r in found:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (n[r["doc_id"]], comp[r["doc_id"]])
    return found


def test_near_duplicates(docs, odd, empty):
    check_components(docs)
    found = check_components(odd)
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {5, None}
    assert jaccard.near_duplicates(empty).count() == 0


def test_a_family_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in rng.choice(200, size=rng.integers(1, 6), replace=False):
            words[p] = f"v{i}x{p}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:60] + [f"own{i}x{k}" for k in range(50 + 3 * i)])) for i in range(40)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string"))


def shuffled_scans(df):
    """Exchanges of a plan that take a table as it is stored."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [re.sub(r"^[\s:+\-|*(0-9)]+", "", x) for x in lines]
    at = [i for i, x in enumerate(below) if x.startswith("Exchange")]
    return sum(next(x for x in below[i + 1 :] if re.match(r"FileScan|\w*Join", x)).startswith("FileScan") for i in at)


def test_few_pairs_do_not_shuffle_all_groups(spark):
    sets = F.transform(F.sequence(F.lit(0), F.lit(200)), lambda k: F.xxhash64("grp", k))
    members = jaccard.materialise(spark.range(400).select(F.col("id").alias("grp")).select("grp", F.array(F.struct(F.col("grp").alias("id"), F.array_join(sets, "").cast("binary").alias("set"))).alias("members")))
    pairs = jaccard.materialise(spark.createDataFrame([(1, 2), (1, 3), (7, 3), (8, 9)], "grp long, other long").coalesce(1))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        opened = jaccard.open_pairs(pairs, members)
        assert shuffled_scans(opened) == 0
        found = sorted((r["members"][0]["id"], r["others"][0]["id"], len(r["members"][0]["set"]) > 1000) for r in opened.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert found == [(1, 2, True), (1, 3, True), (7, 3, True), (8, 9, True)]


def test_shingles_of_one_component_are_not_dealt_out(spark):
    tokens = spark.createDataFrame([(5, 1), (5, 2), (6, 1), (6, 3), (7, 3), (8, 3), (8, 4)], "token long, id long")
    groups = spark.createDataFrame([(1, 10, 1), (2, 11, 1), (3, 12, 3), (4, 12, 4)], "id long, grp long, comp long")
    assert sorted(map(tuple, jaccard.crossing(tokens, groups).collect())) == [(6, 10), (6, 12), (8, 12), (8, 12)]


def test_shingles_of_prefixes_are_shuffled_twice(spark):
    """Once by shingle and once by class, beside the classes themselves; copies of a class in two tasks aren't two classes."""
    # Classes 1 and 2 share three shingles, 3 has a copy only, 4 is too large for 1 and 2, and 5 shares fewer shingles than it must.
    own = {1: (40, [1, 2, 3, 7]), 2: (44, [1, 2, 3, 8]), 3: (40, [4, 5, 6]), 4: (90, [1, 2, 3]), 5: (41, [8, 9])}
    rows = [(t, k, n) for k, (n, tokens) in own.items() for t in tokens]
    rows += [r for r in rows if r[1] in (1, 3)]
    rows = spark.createDataFrame(rows, "token long, key long, n long")
    classes = spark.createDataFrame([(k, n, 10 * k) for k, (n, _) in own.items()], "key long, n long, id long")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shared = jaccard.shared_tokens(rows)
        assert sorted((r["token"], r["key"]) for r in shared.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (8, 2), (8, 5)]
        found = jaccard.likely(shared, classes)
        assert len(re.findall(r"Exchange hashpartitioning", found._jdf.queryExecution().executedPlan().toString())) == 3
        assert sorted((r["id"], r["n"], r["kind"], sorted(r["tokens"])) for r in found.collect()) == [(10, 40, 3, [1, 2, 3]), (20, 44, 3, [1, 2, 3, 8])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_links_lead_to_the_smallest_id():
    span = lambda a: np.arange(a, a + 100, dtype=np.uint64)
    chain = [(50 - i, span(5 * i)) for i in range(5)] + [(7, span(1000))]
    assert jaccard._links(chain, None) == [(i, 46) for i in (47, 48, 49, 50)]
    assert jaccard._links(chain[:2], chain[2:]) == [(i, 47) for i in (48, 49, 50)]
    assert jaccard._links(chain[1:2], chain[2:3] + [(9, span(5))]) == [(48, 9), (49, 9)]


def test_later_links_join_components_alone(spark, monkeypatch):
    labels = jaccard.materialise(spark.createDataFrame([(i, i // 10 * 10) for i in range(100)], "id long, comp long"))
    join = lambda links: dict(map(tuple, jaccard.joined_on(labels, spark.createDataFrame(links, "a long, b long")).collect()))
    assert join([(35, 72), (79, 51), (12, 15)]) == {i: 30 if i // 10 in (3, 5, 7) else i // 10 * 10 for i in range(100)}
    monkeypatch.setattr(jaccard, "components", None)
    assert join([(12, 15), (90, 99)]) == {i: i // 10 * 10 for i in range(100)} == join([])


def test_a_chain_of_near_copies_takes_few_rounds(spark, monkeypatch):
    rounds, store = [], jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, label="step": rounds.append(label) or store(df, label))
    words = [f"w{i}" for i in range(400)]
    check_components(spark.createDataFrame([(i * 37 % 101, " ".join(words[2 * i : 2 * i + 60])) for i in range(101)], "doc_id long, text string"))
    assert rounds.count("labels") <= 20, rounds.count("labels")


def test_copies_with_an_added_passage(spark):
    rows = []
    for i, (size, ratio, ahead) in enumerate((s, r, a) for s in (40, 64, 200, 333, 1000) for r in (1.18, 1.2, 1.22, 1.24, 1.25) for a in (False, True)):
        body, own = [f"b{i}x{k}" for k in range(size + 4)], [f"own{i}x{k}" for k in range(int(size * ratio + 1e-6) - size)]
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(own + body if ahead else body + own))]
    found = check_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found)


def test_shingle_hashes_tell_texts_apart():
    texts = ["a b c d e f", "A B C D E F", "a b c d e  f\n", "ab c d e f", "a", "b", "", "a b", "b a", "a b c d e", "e d c b a", "é b c d e", "É b c d e"]
    sets = [tuple(s.tolist()) for s in jaccard.shingle_sets([t.encode() for t in texts])]
    expected = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert (sets[i] == sets[j]) == (expected[i] == expected[j]) and len(sets[i]) == len(expected[i])


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)).encode() for n in (0, 1, 4, 5, 200, 3000)] + [b"x" * 500, b" \n ", b"a" * 90 + b" b"]
    whole = jaccard.shingle_sets(texts)
    monkeypatch.setattr(jaccard, "PIECE", 64)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, jaccard.shingle_sets(texts), strict=True))
    assert [len(s) for s in whole] == [len(shingles(t.decode())) for t in texts]


def test_random_containment(spark):
    """Pairs of which one holds the other, with Jaccard from 0.75 to 0.9, beside texts that share boilerplate."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        size = int(np.exp(rng.uniform(np.log(5), np.log(3000))))
        body = [f"b{i}x{k}" for k in range(size + 4)]
        own = [f"o{i}x{k}" for k in range(int(size / rng.uniform(0.75, 0.9)) - size)]
        at = int(rng.integers(0, len(own) + 1))
        shared = ["the", "same", "words", "stand", "here", "and", "there"] if i % 3 == 0 else []
        rows += [(2 * i, " ".join(shared + body)), (2 * i + 1, " ".join(shared + own[:at] + body + own[at:]))]
    check_components(spark.createDataFrame(rows, "doc_id long, text string"))


def test_licences(spark, odd, empty):
    texts = {
        1: "Prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.",
        2: "This work is licensed under the GNU General Public License, version 3. And Released under the MIT License.",
        3: "Permission is hereby granted, free of charge, to any person obtaining a copy of it.\nThe above copyright notice and this permission notice shall be included in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, express or implied.',
        4: "Licensed under CC BY-NC 4.0.",
        5: "Permission is hereby granted, free of charge, to any person obtaining a copy of it.\nNothing follows.",
        6: "A licence of our own.",
        7: "No such thing.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["licences"], r["n_unknown"]) for r in licences.scan(df).collect()}
    assert found == {1: ("Apache-2.0", 0), 2: ("GPL-3.0,MIT", 0), 3: ("MIT", 0), 4: ("CC-BY-NC", 0), 5: ("", 1), 6: ("", 1)}
    assert licences.scan(odd).count() == 0 and licences.scan(empty).count() == 0


def test_known_licence_sentences_that_do_not_say_licence(spark):
    bsd = "Redistribution and use in source and binary forms are permitted. Redistributions of source code must retain the above copyright notice. "
    bsd += "Redistributions in binary form must reproduce the above copyright notice. "
    texts = {
        1: ("Copyright 2020 Foo. All rights reserved.", "all-rights-reserved", 0),
        2: (bsd + "Neither the name of Google Inc. nor the names of its contributors may be used to endorse products.", "BSD-3-Clause", 0),
        3: ("(c) 2020 Foo", "", 1),
        4: ("CC0 1.0", "CC0-1.0", 0),
        5: ("Apache-2.0", "Apache-2.0", 0),
        6: ("It is under BSD 3-Clause.", "BSD", 0),
        7: ("(c) 2020 Foo.\nSome prose.\nAll rights reserved.", "all-rights-reserved", 0),
    }
    df = spark.createDataFrame([(i, t[0]) for i, t in texts.items()], "doc_id long, text string")
    found = {r["doc_id"]: (r["licences"], r["n_unknown"]) for r in licences.scan(df).collect()}
    assert found == {i: t[1:] for i, t in texts.items()}


MIT = """MIT License

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD3 = """Copyright 2008 Google Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

    * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
    * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""


def test_wrapped_licence_texts(spark):
    texts = {
        1: (MIT, "MIT,MIT"),
        2: (BSD3, "all-rights-reserved,BSD-3-Clause"),
        3: (GPL, "GPL-3.0-notice"),
        4: ("/*\n" + "\n".join(f" * {x}" for x in GPL.split("\n")) + "\n */\nint x;", "GPL-3.0-notice"),
        5: (GPL.replace("version 3", "version 2").replace("\n", "\r\n"), "GPL-2.0-notice"),
        6: ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        7: ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\n(c) 2020 Foo", "GPL-2.0-only WITH Linux-syscall-note"),
        8: ("Licensed under CC BY-NC 4.0\nReleased under the MIT License", "CC-BY-NC,MIT"),
        9: ("This work is under the GNU General Public\nLicense, version 3", "GPL-3.0"),
        10: ("A heading\nCopyright (c) 2020 Foo\nAll rights reserved.\nProse", "all-rights-reserved"),
        11: (MIT.split("\n\n", 2)[2].replace("\n\n", "\n"), "MIT"),
    }
    df = spark.createDataFrame([(i, t[0]) for i, t in texts.items()], "doc_id long, text string")
    found = {r["doc_id"]: r["licences"] for r in licences.scan(df).collect()}
    assert found == {i: t[1] for i, t in texts.items()}


def test_licences_of_the_table(docs, texts):
    told = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT",
    }
    found = {r["doc_id"]: r["licences"] for r in licences.scan(docs).collect()}
    for i, text in texts.items():
        assert found.get(i, "") == ",".join(told[x] for x in text.split("\n") if x in told)


def labelled(spark):
    rng = np.random.default_rng(1)
    plain, bad = [f"plain{i}" for i in range(300)], ["vile", "nastyness", "nastyly"]
    rows = []
    for i in range(600):
        words = list(rng.choice(plain, size=40))
        k = int(rng.integers(1, 7)) if i % 3 == 0 else 0
        words[:k] = rng.choice(bad, size=k)
        rng.shuffle(words)
        rows.append((i, " ".join(map(str, words)), int(k > 0), k))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, k int")


def test_frequent_words_stay_remembered(monkeypatch):
    worked_out = []
    monkeypatch.setattr(toxicity, "zlib", SimpleNamespace(crc32=lambda data, *start: worked_out.append(bytes(data)) or zlib.crc32(data, *start)))
    words, half = toxicity.Words(), toxicity.SPACE // 2
    monkeypatch.setattr(toxicity.Words, "MOST", 60)
    for i in range(40):
        text = [f"often{k}" for k in range(20)] + [f"New{i}x{k}." for k in range(20)] + ["often3", "ärger", "--", "a"]
        times = {}
        for word in text:
            bare = word.lower().strip(toxicity.STRIP)
            for x in ["w" + bare, *(f"p{n}{bare[:n]}" for n in (4, 5, 6, 7, 8) if len(bare) > n)] if bare else []:
                f = zlib.crc32(x.encode()) % half
                times[f] = times.get(f, 0) + 1
        assert words.features(" ".join(text).encode()).tolist() == sorted(times) + sorted(f + half for f in times if times[f] > 1)
    assert not words.features(b"").size
    assert sum(x.endswith(b"often7") for x in worked_out) == 1


def test_toxicity_on_held_out_rows(spark, odd, empty):
    df = labelled(spark)
    model = toxicity.fit(df, df.where("doc_id % 4 <> 1").select("doc_id", "toxic"))
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.score(df.withColumnRenamed("toxic", "y"), model, ["doc_id", "y", "k"]).where("doc_id % 4 = 1").collect()
    assert sum(bool(r["y"]) == r["toxic"] for r in rows) > 0.95 * len(rows)
    by = lambda low, high: np.mean([r["severity"] for r in rows if low <= r["k"] <= high])
    assert by(0, 0) < by(1, 2) < by(5, 6)
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and not any(r["toxic"] for r in out)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(df, df.where("false").select("doc_id", "toxic"))
    assert not any(r["toxic"] for r in toxicity.score(df, none).collect())


def test_ordinal_gradient():
    rng = np.random.default_rng(2)
    flat, owner = rng.integers(0, 5, 400), np.repeat(np.arange(100), 4)
    hits = np.bincount(owner, weights=flat == 0, minlength=100).astype(int)
    model = toxicity.fit_ordinal(flat, owner, np.minimum(hits, 3), steps=400)
    chances = model.chances(np.bincount(owner, weights=model.weights[flat], minlength=100))
    assert np.allclose(chances.sum(axis=1), 1) and np.corrcoef(chances @ np.arange(4), np.minimum(hits, 3))[0, 1] > 0.9


def test_ordinal_fit_equals_a_dense_one():
    """The fit in blocks takes the steps of a plain one over a dense matrix with numerical gradients."""
    rng = np.random.default_rng(4)
    n, m = 60, 6
    rows = [np.flatnonzero(rng.random(m) < 0.5) for _ in range(n)]
    grades = np.minimum([(r < 2).sum() + (rng.random() < 0.2) for r in rows], 3).astype(int)
    x = np.zeros((n, m))
    for i, r in enumerate(rows):
        x[i, r] = 1
    value = np.concatenate([np.zeros(m), [1.0, 0.0, 0.0]])

    def loss(v):
        edge = np.concatenate([[-60.0], np.cumsum([v[m], *np.exp(v[m + 1 :])]), [60.0]])
        s = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        mass = s(edge[grades + 1] - x @ v[:m]) - s(edge[grades] - x @ v[:m])
        return -np.log(np.maximum(mass, 1e-9)).mean() + 0.5e-3 * (v[:m] ** 2).sum()

    first, second = np.zeros(m + 3), np.zeros(m + 3)
    for step in range(1, 31):
        grad = np.array([(loss(value + h) - loss(value - h)) / 2e-6 for h in np.eye(m + 3) * 1e-6])
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        value = value - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model = toxicity.fit_ordinal(np.concatenate(rows).astype(np.int32), np.repeat(np.arange(n), [len(r) for r in rows]), grades, steps=30)
    assert np.allclose(model.weights[:m], value[:m], atol=2e-3) and np.allclose(model.thresholds, np.cumsum([value[m], *np.exp(value[m + 1 :])]), atol=2e-3)


def test_fitting_holds_entries_once_more_at_most():
    rng = np.random.default_rng(5)
    flat, grades = rng.integers(0, 5000, 12_000_000, dtype=np.int32), np.arange(3000) % 4
    owner = np.repeat(np.arange(3000, dtype=np.int32), 4000)
    tracemalloc.start()
    try:
        toxicity.fit_ordinal(flat, owner, grades, steps=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.9 * flat.nbytes, peak / flat.nbytes
    # Marked rows alone are the same as a table of these rows; a model of them is that of a fold.
    own = np.arange(3000) % 3 > 0
    many = np.where(np.arange(3000) % 7 == 0, 0, 40)
    starts = np.concatenate([[0], np.cumsum(many)])
    few = toxicity.fit_rows(flat, starts, grades, own, steps=5)
    mine = np.repeat(own, many)
    same = toxicity.fit_ordinal(flat[: len(mine)][mine], np.repeat(np.cumsum(own) - 1, many)[mine], grades[own], steps=5)
    assert (few.weights == same.weights).all() and (few.thresholds == same.thresholds).all()


def test_features_in_order():
    rows = [np.array(x, dtype=np.int32) for x in ([5, 6], [], [7], [1, 2, 3])]
    chunks = pa.chunked_array([pa.array([b"?", *(r.tobytes() for r in part)], pa.binary()).slice(1) for part in (rows[:1], rows[1:])])
    flat, starts = toxicity.in_order(chunks, np.array([3, 1, 0, 2]))
    assert flat.tolist() == [1, 2, 3, 5, 6, 7] and starts.tolist() == [0, 3, 3, 5, 6]


def test_grades_of_the_table_on_held_out_rows(spark):
    """Nine in ten toxic rows of a fold that a fit on some 350 toxic rows did not see are found, and one in fifty clean ones flagged at most."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(5)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    told = toxicity.score(docs, model).drop("p_toxic").withColumnRenamed("toxic", "found").join(labels.where(held), "doc_id").collect()
    bad, clean = [r["found"] for r in told if r["toxic"]], [r["found"] for r in told if not r["toxic"]]
    assert sum(bad) >= 0.9 * len(bad) and sum(clean) <= 0.02 * len(clean) and len(bad) > 50


def test_scores_equal_brute_force(docs, texts, spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).collect():
        s = model.weights[toxicity._WORDS.features(texts[r["doc_id"]].encode())].sum()
        upto = [0, *(1 / (1 + np.exp(s - t)) for t in model.thresholds), 1]
        p = np.diff(upto)
        assert abs(r["severity"] - (p * np.arange(4)).sum()) < 1e-5 and abs(r["p_toxic"] - 1 + p[0]) < 1e-5 and r["toxic"] == (r["p_toxic"] >= model.cut)


def test_an_id_on_many_documents_stays_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 0)], "doc_id long, toxic int")
    found = toxicity.sample_labelled(docs, labels, per_class=20).groupBy("toxic").count().collect()
    assert {r["toxic"]: r["count"] for r in found} == {True: 20, False: 40}


def test_marking_words_equal_brute_force(spark):
    rows = [(i, " ".join(["Vile!" if k < i % 7 else f"w{k}" for k in range(20)]) if i % 2 else "calm words. here", bool(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "row long, text string, toxic boolean")
    found = {r["row"]: r["hits"] for r in toxicity.marking_words(df).collect()}
    for i, text, toxic in rows:
        # Words that toxic rows alone have mark them: all but those of the calm text.
        assert found[i] == (20 if toxic else 0)


def test_toxicity_keeps_clashing_columns_apart(odd, empty, spark, data):
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.scored(odd, labels)
    assert out.count() == odd.count() and toxicity.scored(empty, labels).count() == 0
    model = toxicity.fit(odd, labels)
    wide = toxicity.score(odd, model, odd.columns)
    assert len(set(wide.columns)) == len(wide.columns) and wide.count() == odd.count()


def test_fixity(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    ids = [r["page_id"] for r in pages.select("page_id").collect()]
    records = fixity.warc_records(pages, pages_per_archive=10).cache()
    assert fixity.audit(records, records).count() == 0
    found = {(r["page_id"], r["status"]) for r in fixity.audit(records, fixity.damaged(records)).collect()}
    gone = {i for i in ids if i % 89 == 5}
    assert found == {(i, "missing") for i in gone} | {(i, "altered") for i in ids if i % 97 == 3 and i not in gone} | {(i, "extra") for i in ids if i % 83 == 7 and i not in gone}
    spans = [(r["archive"], r["offset"], r["length"]) for r in records.orderBy("archive", "offset").collect()]
    for (a, at, n), (b, following, _) in zip(spans, spans[1:]):
        assert following == at + n if a == b else following == 0


def test_fixity_of_odd_pages(spark):
    df = spark.createDataFrame([(1, None, "x", "c"), (None, "u", None, "c"), (2, "u", "same", "c"), (2, "u", "same", "c"), (3, "", "", "c")], "page_id long, url string, html string, archive string")
    records = fixity.warc_records(df)
    assert records.count() == 5 and fixity.audit(records, records).count() == 0
    less = records.where("page_id is null or page_id <> 1")
    assert [(r["page_id"], r["status"]) for r in fixity.audit(records, less).collect()] == [(1, "missing")]
    assert fixity.audit(records.where("false"), records.where("false")).count() == 0


def test_audited_equals_brute_force(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(None, "u", "x"), (None, "u", "x"), (3, None, None), (5, "u", "gone"), (7, "u", "twice"), (7, "u", "twice"), (100, "", "changed")], "page_id long, url string, html string")
    for frame in (pages, odd.withColumn("digest", F.lit("clash")).withColumn("offset", F.lit(1))):
        expected = []
        for r in frame.collect():
            i = r["page_id"]
            if i is not None:
                gone = i % 89 == 5
                more = 1 if i % 83 == 7 and not gone else 0
                expected += [(i, "missing")] * gone + [(i, "altered")] * (i % 97 == 3 and not gone) + [(i, "extra")] * more
        found = [(r["page_id"], r["status"]) for r in fixity.audited(frame).collect()]
        assert sorted(found) == sorted(expected) and expected
    assert fixity.audited(pages.where("false")).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "source mix", "packing"]
    out = corpus_pipeline.run(spark, data)
    before = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < before.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_stages_on_odd_rows(spark, data, odd):
    import corpus_pipeline

    docs = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, data)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() > 0
    assert corpus_pipeline.drop_low_quality(spark, docs, data).count() >= 0
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()]
    assert sorted(i for i in kept if i is not None) == [0, 1, 2, 3, 5, 8, 10, 11, 12]


def test_pipeline_stages_equal_brute_force(spark, data, docs, texts):
    """Each stage over the whole table, row by row against plain Python."""
    import collections
    import zlib

    import corpus_pipeline
    from evispark.llm import packing, tokens
    from test_native import measures, targets

    labels = spark.read.parquet(f"{data}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("toxic").collect()}
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(stage["toxicity"](spark, docs, data)) == sorted(set(texts) - bad)

    def good(text):
        n, chars, symbols, dup, repeat = measures(text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or (len(lines) >= 4 and 2 * dup > len(lines)) or 5 * text.count("!") > n)

    assert ids(stage["quality rules"](spark, docs, data)) == sorted(i for i, t in texts.items() if good(t or ""))
    comp, n = brute_components(sorted(texts.items()))
    assert ids(stage["near duplicates"](spark, docs, data)) == sorted(i for i in texts if comp[i] == i or not n[i])

    mixed = stage["source mix"](spark, docs, data).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken, words = collections.Counter(), collections.Counter(), re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in texts.items():
        sizes[source[i]] += len(words.findall(t or ""))
    for r in mixed:
        taken[source[r["doc_id"]]] += len(words.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert all(abs(taken[s] - goal) <= 1 for s, goal in targets(dict(sizes)).items())

    encode, bins, whole = tokens.encoder(tokens.default_tokenizer()), collections.defaultdict(list), collections.defaultdict(int)
    for r in stage["packing"](spark, docs, data).collect():
        part = (encode.ids((texts[r["doc_id"]] or "").encode()) + (1).to_bytes(4, "little"))[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"] and len(part) == 4 * r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]] += r["length"]
    for parts in bins.values():
        parts.sort()
        assert sum(x for _, x in parts) <= packing.CAPACITY and [o for o, _ in parts] == np.cumsum([0] + [x for _, x in parts])[:-1].tolist()
    assert set(whole) == set(texts)


def test_pipeline_stages_on_empty_tables(spark, data, empty):
    import corpus_pipeline

    docs = empty.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_rows_of_one_id_with_different_texts_stay(spark, data):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, b), (2, a), (None, b), (None, b), (3, a), (4, ""), (4, ""), (5, b + " more"), (5, b + " more")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, data).collect())
    assert out == [(1, a), (2, b), (4, ""), (4, "")]


OFFICIAL = {
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": 'ISC License\n\nCopyright (c) 2019 A. Nyone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,\nINDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM\nLOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR\nOTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR\nPERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\nclaim that you wrote the original software.",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",
    "CC-BY-SA": "Text is available under CC-BY-SA-4.0 unless noted.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT": "Released under the MIT License.",
}
MENTIONED = [
    "Unlike code under the MIT License, this one may not be copied.", "This work is not licensed under the Apache License, Version 2.0.", "We chose BSD rather than the GNU General Public License version 3.",
    "It is no longer available under the Mozilla Public License, version 2.0.", "The terms are similar to the ISC License.", "This is compatible with the Eclipse Public License 2.0.", "Never assume the zlib license here.",
    "Terms other than the Boost Software License, Version 1.0 hold.", "It differs from the CC BY-SA 4.0 deed.", "This isn't under the MIT License.",
]


def test_official_notices_and_mere_mentions(spark):
    rows = [(i, t) for i, t in enumerate([*OFFICIAL.values(), *MENTIONED])]
    found = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(OFFICIAL):
        assert name in found[i]["licences"].split(","), (name, found[i])
        assert set(found[i]["licences"].split(",")) == {name}, (name, found[i])
    for i in range(len(OFFICIAL), len(rows)):
        assert found[i]["licences"] == "" and found[i]["n_unknown"] > 0, (rows[i], found[i])
