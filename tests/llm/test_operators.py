"""The training-data operators against plain versions, round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import arrays as A
from symloom.llm import bpe, fingerprints, licenses, line_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, suffix_dedup, warc
from symloom.llm.common import new_path, ship
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return cases.texts()


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return cases.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return cases.frame(spark, [])


def by(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# ---- near-dedup ----


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, k):
    got = by(minhash_dedup.near_duplicates(docs, words=k), "doc_id", "n", "component_id")
    group = cases.groups(rows, k)
    least = defaultdict(list)
    for (i, _), g in zip(rows, group):
        least[g].append(i)
    lead = {g: min((x for x in v if x is not None), default=None) for g, v in least.items()}
    want = sorted(((i, len(cases.shingles(t, k)), lead[g]) for (i, t), g in zip(rows, group)), key=str)
    assert got == want


def test_one_of_each_group_stays(docs, rows):
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(cases.groups(rows, 5)))


def test_near_dedup_of_a_large_group(spark):
    rng = np.random.default_rng(2)
    base, rows = [str(x) for x in range(120)], []
    for i in range(700):  # chains and stars around the threshold
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 9)):
            w[j] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    got = by(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=4), "doc_id", "component_id")
    assert got == sorted(((i, g) for (i, _), g in zip(rows, cases.groups(rows, 4))), key=str)


def test_near_dedup_where_low_similarity_abounds(spark):
    """Texts of one template, each some 0.3 like every other, meet in few bands and are not compared as sets."""
    rng = np.random.default_rng(7)
    template = [f"t{k}" for k in range(60)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(64)])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 400, 40)]
    docs = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "doc_id long, text string").repartition(4)
    got = by(minhash_dedup.near_duplicates(docs, words=4), "doc_id", "component_id")
    assert got == sorted(((i, i - 1000 if i >= 1000 else i) for i, _ in rows), key=str)


def test_near_dedup_of_nothing(empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert minhash_dedup.keep_one(empty).columns == empty.columns


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    pool = A.mix(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[1000:]
    first = np.array([0, 2000, 4000, 7000])
    regs = minhash_dedup.set_sketch(np.concatenate([a, b, pool]), first)
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    j = minhash_dedup.likeness(regs[:1], regs[1:2], np.array([2000]), np.array([2000]))[0]
    assert abs(j - 1 / 3) < 0.15


# ---- tokens ----


def test_bpe_against_the_library(docs, rows):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    library = Tokenizer.from_file(path)
    got = by(docs.select("doc_id", bpe.bpe_digest(F.col("text"), path).alias("t")).select("doc_id", "t.*"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_bpe_odd_words():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.vocabulary()), bpe.tokenizer(bpe.vocabulary())
    rng = np.random.default_rng(4)
    odd = ["".join(map(chr, rng.integers(32, 0x2FFF, 30))) for _ in range(300)]
    odd += ["".join(rng.choice(list("etaoinshr' <|>"), 60)) for _ in range(500)] + ["x" * 999, "<|startoftext|>a<|endoftext|>", "I'LL don't"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(odd, add_special_tokens=False)]
    assert own.encode(odd) == want


def test_bpe_speculation_is_checked():
    own = bpe.tokenizer(bpe.vocabulary())
    for word in ("unhappiness", "tionerthe", "aaaaaaaa"):
        symbols = [*word.encode()[:-1], word.encode()[-1] + 256]
        assert own._long(symbols) == own.merge(symbols)


# ---- licences ----

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.\n The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'


@pytest.mark.parametrize(
    "text, found",
    [
        (None, ""),
        ("", ""),
        ("Words.\nReleased under the MIT License.", "MIT"),
        ("# Licensed under the Apache License, Version 2.0.  All rights\n  reserved", "Apache-2.0"),
        ("Licensed  under\tCC BY-NC 4.0. All rights reserved!", "CC-BY-NC-4.0,proprietary"),
        (f"The MIT License (MIT)\n{MIT}", "MIT"),
        ("This program is distributed in the hope that it will be useful, but without any warranty.", ""),
        ("licensed under the mit license agreement of ours.", ""),
        ("x" * 100000, ""),
    ],
)
def test_licences(spark, text, found):
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licences == found


MIT_TEXT = """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE_TEXT = """Copyright 2015 The Authors. All Rights Reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD_TEXT = """Copyright (c) 2020, A Person. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3_TEXT = BSD_TEXT + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize(
    "text, ids, found",
    [
        (MIT_TEXT, "mit-title,mit-grant,mit-notice,as-is", "MIT"),
        (APACHE_TEXT, "all-rights,apache-ref,apache-comply,apache-copy,apache-as-is", "Apache-2.0"),
        (GPL_TEXT, "gpl3-grant,gpl-warranty", "GPL-3.0-or-later"),
        (GPL_TEXT.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2"), "gpl2-grant,gpl-warranty", "GPL-2.0-or-later"),
        (BSD_TEXT, "all-rights,bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause"),
        (BSD3_TEXT, "all-rights,bsd-grant,bsd-source,bsd-binary,bsd-endorse", "BSD-3-Clause"),
        ("Licensed under the\n// Apache License, Version 2.0.", "apache-ref", "Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "spdx-gpl-2.0-or-later", "GPL-2.0-or-later"),
        ("<!-- SPDX-License-Identifier: MIT -->", "spdx-mit", "MIT"),
        ("SPDX-License-Identifier: MIT OR Foo", "", ""),
        ("We are not licensed under the\nApache License, Version 2.0.", "", ""),
        (MIT_TEXT.replace("without restriction,", "without restriction, save for trade,"), "mit-title,mit-notice,as-is", "MIT"),
    ],
)
def test_whole_licence_texts(spark, text, ids, found):
    comment = lambda sign: "\n".join(f"{sign} {x}" for x in text.split("\n"))
    rows = [(0, text), (1, comment("#")), (2, comment(" *")), (3, text.replace("\n", "\r\n")), (4, f"Words.\n\n{text}\n\nWords.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.sentence_ids, r.licences) for r in got] == [(i, ids, found) for i, _ in rows]


@pytest.mark.parametrize("pad", [" ", "#", "/* ", "\t"])
def test_padded_licence_sentences(spark, pad):
    known = "Released under the MIT License."
    rows = [(1, pad * 900 + known), (2, known + pad * 900), (3, known.replace(" ", " " * 300)), (4, "license " + "#" * 300000 + " x"), (5, "..#license;.!*/ ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.sentence_ids for r in licenses.scan(docs).collect()}
    assert found == {1: "mit-ref", 2: "mit-ref", 3: "mit-ref", 4: "", 5: ""}
    assert docs.where("doc_id = 5").select(licenses.normal(F.col("text"))).first()[0] == "..#license"


@pytest.mark.parametrize("table", [{"quux frob": "a", "frob": "b", "zig zag": "c"}, {"...": "dots"}, licenses.SENTENCES | {"hands off": "x"}])
def test_any_table_of_sentences_is_found(spark, table):
    rows = [(i, f"Words. {k.upper()}. More\n# {k}\n") for i, k in enumerate(table)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", licenses.sentence_ids(F.col("text"), table).alias("ids")).collect()
    for (k, x), r in zip(table.items(), sorted(got)):
        assert r.ids.count(x) == 2 or k == "..." and not r.ids
    words = licenses.stems(list(table))
    assert all(any(w in k for w in words) for k in table) or not words


def test_long_padded_sentences_agree_with_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "#" * 420 + " MIT License"), (2, "Released under" + " " * 420 + "the MIT License."), (3, "#" * 3000 + "\n" + "x" * 3000 + ". The MIT License (MIT)"), (4, None)]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == {r[0]: r[3] for r in con.execute(licenses.oracle()).fetchall()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: ""}


def test_licence_rows(docs, empty, rows):
    assert licenses.scan(docs).count() == len(rows)
    assert licenses.scan(empty).count() == 0


# ---- archives ----


def test_warc(spark):
    page = "<p>" + "é" * 80
    rows = [(5, "http://a/\r\nX: y", page), (3, None, page), (3, "http://b", page), (9, "u", "short"), (8, "u", "short"), (7, "u", None), (6, "u", ""), (None, "v", "z" * 200), (None, "w", "z" * 200), (4, "c", "q" * 300000), (4, "d", "r" * 300)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int").repartition(3)
    uri = new_path(spark, "warc-test")
    manifest = warc.write_warc(pages, uri, roll=200)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 2
    got = by(warc.read_warc(spark, uri), "page_id", "payload_digest", "payload_bytes", "record_type", "refers_to")
    lead, told, want = {}, Counter(), []
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for i, _, t in rows:
        if len((t or "").encode()) >= 100:
            lead[sha(t)] = min([x for x in (lead.get(sha(t)), i) if x is not None], default=None)
    for i, _, t in rows:
        again = sha(t) in lead and (lead[sha(t)] != i or told[sha(t), i] > 0)
        told[sha(t), i] += 1
        want.append((i, sha(t), len((t or "").encode()), "revisit" if again else "response", lead[sha(t)] if again else None))
    assert got == sorted(want, key=str)
    other = new_path(spark, "warc-test")
    again = warc.write_warc(pages.repartition(2), other, roll=200)
    assert by(again, "file", "sha256") == by(manifest, "file", "sha256")


def test_warc_cuts_depend_on_the_pages_alone(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abc <>", k=rng.randrange(50, 900)))) for i in range(400)]
    rows += [(None, f"u{i}", f"page {i} " * 40) for i in range(200)] + [(7, f"v{i}", f"other {i} " * 40) for i in range(200)] + [(1 << 60, "far", "x" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for setting, parts in (("8", 2), ("24", 5)):
        spark.conf.set("spark.sql.shuffle.partitions", setting)
        uri = new_path(spark, "warc-test")
        manifest = warc.write_warc(pages.repartition(parts), uri, shard_bytes=20000)
        found.append(by(manifest, "file", "records", "sha256"))
        assert warc.read_warc(spark, uri).count() == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    records = Counter()
    for file, n, _ in found[0]:
        records[file[:12]] += n
    assert len(records) > 10 and max(records.values()) < len(rows) / 4  # neither the far id, nor one id, nor none is a shard's load
    assert len(found[0]) > 2 * len(records)  # files roll by compressed size


def test_warc_damage_is_seen():
    raw = warc.record(1, "u", b"x" * 200, None, False)
    assert warc.parse(raw)[0] == 1
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"xxx", b"xyx", 1))


def test_warc_of_nothing(spark):
    uri = new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), uri)
    assert warc.read_warc(spark, uri).count() == 0


# ---- lines ----


def test_line_dedup(docs, rows):
    out = line_dedup.drop_lines(docs)
    lines, kept = out.columns[-2:]
    digest = F.sha2(F.encode(F.array_join(kept, "\n"), "UTF-8"), 256)
    got = by(out.select("doc_id", F.size(lines).alias("n"), (F.size(lines) - F.size(kept)).alias("d"), digest.alias("s")), "doc_id", "n", "d", "s")
    assert got == sorted(cases.line_drops(rows, 10), key=str)
    assert any(r[2] for r in got)


def test_line_stage_keeps_columns(docs, empty):
    assert line_dedup.without_lines(docs).columns == docs.columns
    assert line_dedup.without_lines(empty).count() == 0


def line_batch(spark, *ks):
    return spark.createDataFrame([(k, -k, 1) for k in ks], "h1 long, h2 long, n_docs long")


def test_line_runs_find_what_is_new(spark):
    runs = line_dedup.LineRuns(spark, fan_out=2)
    batch = lambda *ks: line_batch(spark, *ks)
    assert by(runs.add(batch(1, 2, 2)), "h1", "n_docs") == [(1, 1), (2, 2)]
    assert by(runs.add(batch(2, 3)), "h1") == [(3,)]
    assert by(runs.add(batch(1, 4, 2, 2)), "h1") == [(4,)]
    assert len(runs.keys[1]) == 1 and len(runs.keys[0]) == 1 and len(runs.more[1]) == 1
    held = sorted(r.h1 for x in runs.runs() for r in spark.table(x).collect())
    assert held == [1, 2, 3, 4]  # each key in one run
    assert by(runs.counts(), "h1", "n_docs") == [(1, 2), (2, 5), (3, 1), (4, 1)]
    runs.close()


@pytest.mark.parametrize("broken", [lambda self, batch: batch, lambda self, batch: batch.limit(0)])
def test_line_counts_rest_on_the_anti_join(spark, docs, rows, monkeypatch, broken):
    monkeypatch.setattr(line_dedup.LineRuns, "unseen", broken)
    out = line_dedup.drop_lines(docs)
    lines, kept = out.columns[-2:]
    got = by(out.select("doc_id", F.size(lines).alias("n"), (F.size(lines) - F.size(kept)).alias("d")), "doc_id", "n", "d")
    assert got != sorted((r[:3] for r in cases.line_drops(rows, 10)), key=str)


def test_line_runs_are_not_shuffled(spark):
    runs = line_dedup.LineRuns(spark)
    for k in range(4):
        runs.add(line_batch(spark, k, k + 1, k + 2))
    for rows in (runs.unseen(spark.table(runs.runs()[0])), runs.counts(), runs._merged(runs.runs())):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.close()


# ---- quality ----


def test_classifier_held_out(spark):
    got = quality_classifier.op6_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = got.join(labels, "doc_id")
    good, bad = both.where("quality = 1"), both.where("quality = 0")
    assert good.where("predicted = 1").count() >= 0.98 * good.count()
    assert bad.where("predicted = 0").count() >= 0.7 * bad.count()


def test_classifier_long_texts(spark):
    docs, labels = (quality_classifier.table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(quality_classifier.held_out()).where("length(text) > 0").orderBy("doc_id").collect()
    for quality in (1, 0):
        text = "\n".join(r.text for r in held if r.quality == quality).encode()
        got = quality_classifier.scores(model, [(text * (size // len(text) + 1))[:size] for size in (1 << 16, 1 << 18, 1 << 20, 1 << 21)])
        assert ((got >= 0.5) == quality).all(), (quality, got)


def test_classifier_scores_a_long_text_as_its_blocks():
    random.seed(4)
    say = lambda words: " ".join(random.choices(words, k=1600)).encode()[: quality_classifier.BLOCK]
    good, bad = ["river", "stone", "house", "walks", "green"], ["click", "stone", "house", "cheap", "green"]
    model = quality_classifier.fit_model([say(good) for _ in range(40)], [say(bad) for _ in range(40)])
    text = say(good + bad)
    one, many, none = quality_classifier.scores(model, [text, text * 200, b""])
    assert abs(one - many) < 1e-9 and none == model.prior


def test_classifier_is_the_plain_one(spark):
    """The sample drawn, the model and the scores against loops over all labelled texts."""
    import zlib

    docs, labels = (quality_classifier.table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    marks = {}
    for r in labels.where("quality IN (0, 1)").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            marks[r.doc_id] = min(r.quality, marks.get(r.doc_id, 1))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    blocks = []
    for i, q in marks.items():
        raw = texts.get(i, b"")
        k = -(-len(raw) // quality_classifier.BLOCK)
        blocks += [(q, i, len(raw), j, raw[len(raw) * j // k : len(raw) * (j + 1) // k]) for j in range(k)]
    keyed = spark.createDataFrame([(i, n, j, f"{i}:{n}:{j}") for _, i, n, j, _ in blocks], "doc_id long, n long, block long, k string")
    rank = {(r.doc_id, r.block): r.h for r in keyed.select("*", F.xxhash64(F.lit(11), "k").alias("h")).collect()}
    blocks.sort(key=lambda b: (rank[b[1], b[3]], b[1], b[2], b[3]))
    sides = [[b[4] for b in blocks if b[0] == q][: quality_classifier.FIT_BLOCKS] for q in (1, 0)]
    model, plain = quality_classifier.fit(docs, labels), quality_classifier.fit_model(*sides)
    good = sum(marks.values())
    plain.weights[0] += float(np.log(good / (len(marks) - good) / (len(sides[0]) / len(sides[1]))))
    assert (model.good, model.bad, model.weights) == (plain.good, plain.bad, plain.weights) and model.prior == good / len(marks)
    got = {r.doc_id: r.score for r in quality_classifier.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    to_good, to_bad = model.compressors()
    for i in sorted(texts)[:200]:
        raw = texts[i]
        k, odds = -(-len(raw) // quality_classifier.BLOCK), 0.0
        for j in range(k):
            b = raw[len(raw) * j // k : len(raw) * (j + 1) // k]
            d = (len(to_bad.compress(b)) - len(to_good.compress(b))) / (len(b) + 100)
            odds += (model.weights[0] + model.weights[1] * d) * len(b) / len(raw)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-odds)) if raw else model.prior)


def test_classifier_edges(spark, docs, empty, rows):
    labels = spark.createDataFrame([(7, 1), (7, 1), (10, None), (None, 0)], "doc_id long, quality int")
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert quality_classifier.keep_good(empty, labels).count() == 0
    model = quality_classifier.fit_model([b"good words here "] * 9, [b"!!! ### $$$"] * 9)
    assert quality_classifier.scores(model, [b""])[0] == model.prior
    long = quality_classifier.scores(model, [b"good words here " * 100000])
    assert 0 <= long[0] <= 1


def test_rules(docs, rows, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = by(docs.select("doc_id", quality_rules.quality_rules(F.col("text")).alias("q")).select("doc_id", "q.*"), "doc_id", *names)
    assert got == sorted(((i, *cases.base_rules(t)) for i, t in rows), key=str)
    assert empty.select(quality_rules.quality_rules(F.col("text")).alias("q")).count() == 0


def repetitive(share: float, unit: int, words: int = 600) -> str:
    """Fresh words with a passage of unit words said twice or more, up to about share of all words."""
    rng = random.Random(unit)
    say = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    passage, out = say(unit), []
    for _ in range(round(share * words / unit)):
        out += passage + say(3)
    return " ".join(out + say(max(words - len(out), 0)))


def test_coverage_decides(spark, docs, rows):
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choices("klmnopq", k=5)) for _ in range(9))
    twice = [line() for _ in range(20)]
    extra = [(100 + k, repetitive(x, n)) for k, (x, n) in enumerate([(0.05, 12), (0.15, 12), (0.24, 12), (0.29, 12), (0.1, 5), (0.45, 5), (0.33, 5), (0.27, 7), (0.2, 4)])]
    extra += [(110, "\n".join(twice + [line() for _ in range(70)] + twice)), (111, "\n".join(twice[:4] + [line() for _ in range(70)] + twice[:4]))]
    extra += [(112, "# $ % & " * 20 + " ".join(line() for _ in range(9))), (113, " ".join(line().upper() for _ in range(9)))]
    more = spark.createDataFrame(extra, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    names = ["gram4_share", "gram6_share", "gram10_share", "line_share"]
    got = sorted(more.select("doc_id", "text", quality_rules.quality_rules(F.col("text")).alias("q")).select("doc_id", "text", "q.*").collect(), key=lambda r: str((r.doc_id, r.text)))
    assert len(got) == len(extra) + len(rows)
    decided = set()
    for r in got:
        shares, failed = cases.coverage(r.text), cases.base_rules(r.text)[-1]
        assert [r[x] for x in names] == pytest.approx([shares[x] for x in names])
        over = {x for x in names if shares[x] > {**{f"gram{n}_share": v for n, v in quality_rules.RULES["grams"].items()}, "line_share": quality_rules.RULES["lines"]}[x]}
        assert r.kept == (not failed and not over)
        decided |= over if not failed else set()
    assert decided == set(names)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[100] and kept[101] and kept[104] and kept[111] and kept[112] and kept[113] and not kept[103] and not kept[105] and not kept[110]


def test_rules_keep_good_labels(spark):
    got = quality_rules.op7_quality_rules(spark, "/root/testdata/sf0.01")
    both = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    assert both.where("quality = 1 AND NOT kept").count() <= 0.01 * both.where("quality = 1").count()


# ---- mixing ----


def test_mixing(docs, rows, empty):
    out = mixing.select(mixing.draws(docs.drop("row")).withColumn("row", F.monotonically_increasing_id())).collect()
    sizes = Counter()
    for r in out:
        sizes[r.source] += r["size"]
    assert len(out) == len(rows)
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = {}, set(sizes)
    while True:  # shares, cap, share again
        rest = 1.5 * total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left.discard(s)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert mine[0].target == pytest.approx(target[s])
        taken = sum(r.times * r["size"] for r in mine)
        assert taken <= target[s] + 1e-6 and max(r.times for r in mine) <= 2
        open_ = [r["size"] for r in mine if r.times < max(x.times for x in mine)]
        assert target[s] - taken < max(r["size"] for r in mine) + 1 and len(open_) <= len(mine)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_mixing_reruns_agree(docs):
    assert by(mixing.mix(docs), "doc_id", "text") == by(mixing.mix(docs.repartition(5)), "doc_id", "text")


# ---- fingerprints ----


def test_fingerprints(spark, docs, rows, empty):
    got = {(r.doc_id, r.edited_sha256): r for r in fingerprints.with_edited(docs).collect()}
    hashes = {t: h for t, h in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.lit(5), F.coalesce("text", F.lit("")))).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(t) and 0 <= r.near_edited <= 1
        a, b = cases.shingles(t, 5), cases.shingles(edited, 5)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - true) < 0.2
        if nxt == t:
            assert r.near_next == 1
    assert fingerprints.with_edited(empty).count() == 0
    assert fingerprints.with_edited(cases.frame(spark, [(1, "abc")])).first().near_next == 1


def test_fingerprint_groups(docs, rows):
    """No group holds texts that no chain of links joins; nearly all links are found."""
    got = Counter((r.doc_id, r.edited_sha256, r.group_id) for r in fingerprints.with_edited(docs).collect())
    assert sum(got.values()) == len(rows)
    group = cases.groups(rows, 5)
    least = defaultdict(list)
    for (i, _), g in zip(rows, group):
        least[g].append(i)
    lead = Counter((i, min((x for x in least[g] if x is not None), default=None)) for (i, _), g in zip(rows, group))
    assert Counter((i, g) for i, _, g in got.elements()) == lead


def test_fingerprint_recall(spark):
    """Against all pairs of a corpus with copies around the threshold."""
    rng, rows = np.random.default_rng(12), []
    for base in range(40):
        words = [f"w{base}x{k}" for k in range(150)]
        for _ in range(12):
            w = list(words)
            for j in rng.integers(0, 150, rng.integers(0, 5)):
                w[j] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.group_id for r in fingerprints.with_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = [cases.shingles(t, 5) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    true = dict(enumerate(cases.groups(rows, 5)))
    assert len(links) > 500 and np.mean([got[i] == got[j] for i, j in links]) >= 0.95
    assert all(true[i] == true[g] for i, g in got.items())


def test_fingerprint_links_at_the_threshold(spark):
    """of pairs just above the threshold none is left out."""
    texts = []
    for p in range(300):
        words = [f"w{p}x{k}" for k in range(104)]
        texts += [" ".join(words), " ".join(words[:-11] + [f"e{p}x{k}" for k in range(11)])]  # 89 of 111 shingles
    got = {r.doc_id: r.group_id for r in fingerprints.with_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_neighbours_of_one_id(spark):
    """Rows of one id, or of none, are split among ranges and tasks."""
    rows = [(None if i % 2 else 5, f"text {i} " * 20) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ship(spark)
    slim = docs.withColumn("h", F.xxhash64(F.lit(5), "text"))
    uri = new_path(spark, "fingerprint-test")
    dealt = fingerprints._neighbours(fingerprints.sketches(slim, uri, 5)).collect()
    assert len({(r.next_chunk, r.next_idx) for r in dealt}) == 600  # a circle: each is the neighbour of one
    after, at, seen = {(r.chunk, r.idx): (r.next_chunk, r.next_idx) for r in dealt}, (dealt[0].chunk, dealt[0].idx), 0
    while seen == 0 or at != (dealt[0].chunk, dealt[0].idx):
        at, seen = after[at], seen + 1
    assert seen == 600


# ---- substrings ----


def removed_rows(docs, **more):
    out = suffix_dedup.repeated_spans(docs, **more)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return by(out.select("doc_id", "n_bytes", gone.alias("g"), F.size("spans").alias("k"), "kept_sha256"), "doc_id", "n_bytes", "g", "k", "kept_sha256")


@pytest.mark.parametrize("length, hot", [(400, 2000), (50, 2000), (400, 3), (50, 0)])
def test_repeated_spans(docs, rows, length, hot):
    assert removed_rows(docs, length=length, hot=hot) == sorted(cases.removed(rows, length), key=str)


@pytest.mark.parametrize("texts", [["short"], [None, None, ""], ["a b " * 30, "".join(chr(97 + i * i % 26) + str(i) for i in range(400))], [], ["x" * 401], ["x" * 400], ["x" * 500, "y" * 399, None]])
def test_repeated_spans_of_odd_tables(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed_rows(docs) == sorted(cases.removed(rows, 400), key=str)


def test_passages_of_fifty_words(docs, rows):
    got = by(suffix_dedup.repeated_spans(docs), "doc_id", "kept_sha256", "n_shared_words")
    words = [cases.WORD.findall((t or "").translate(cases.LOW)) for _, t in rows]
    seen = defaultdict(set)
    for k, w in enumerate(words):
        for n in (50, 32):
            for i in range(len(w) - n + 1):
                seen[tuple(w[i : i + n])].add(k)
    shares = [[any(len(seen[tuple(w[i : i + n])]) > 1 for i in range(len(w) - n + 1)) for n in (50, 32)] for w in words]
    plain = sorted(((i, d, fifty, some) for (i, *_, d), (fifty, some) in zip(cases.removed(rows, 400), shares)), key=str)
    assert any(r[2] for r in plain) and not all(r[3] for r in plain)
    for g, (i, d, fifty, some) in zip(got, plain):
        assert g[:2] == (i, d) and (g[2] > 0 or not fifty) and (g[2] == 0 or some)


def test_refined_buckets_tell_windows_apart():
    rng = np.random.default_rng(6)
    for length in (15, 50, 64, 400):
        runs, phase, count = [], [], []
        pool = rng.integers(97, 99, 900).astype(np.uint8).tobytes()
        for _ in range(40):
            windows, at = int(rng.integers(1, 60)), int(rng.integers(0, 400))
            raw = bytearray(pool[at : at + windows + length - 1])
            if rng.random() < 0.5:
                raw[int(rng.integers(0, len(raw)))] = 100
            runs.append(bytes(raw))
            phase.append(-at % 8)  # an anchor's offset depends on the text alone
            count.append(len(raw) - length + 1)
        got = suffix_dedup.refine(runs, np.array(phase), np.array(count), length)
        seen = Counter((raw[i : i + length], (p - i) % 8) for raw, p, c in zip(runs, phase, count) for i in range(c))
        assert [g.tolist() for g in got] == [[seen[raw[i : i + length], (p - i) % 8] > 1 for i in range(c)] for raw, p, c in zip(runs, phase, count)]


def test_repeated_spans_of_nothing(empty):
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_refined_identifiers_tell_strings_apart():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 2, 5000).astype(np.uint8)
    for length in (1, 3, 16, 37, 400):
        ids = suffix_dedup.gram_ids(data, length)
        strings = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        assert len(set(zip(ids.tolist(), strings))) == len(set(strings)) == len(set(ids.tolist()))


def test_segments_agree(monkeypatch):
    rng = np.random.default_rng(9)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    offsets, skip = np.array([0, 2500, 2500, 6000]), np.zeros(3, bool)
    whole = suffix_dedup.anchors(data, offsets, skip, 60, 20)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 257)
    part = suffix_dedup.anchors(data, offsets, skip, 60, 20)
    assert all((a == b).all() for a, b in zip(whole, part))


# ---- pipeline ----


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mixing", "bpe"]
    kept = P.quality(spark, docs, sf).cache()
    lined = P.lines(spark, kept, sf).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = {(i, d) for i, _, _, d in cases.line_drops(rows, 10)}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in lined.collect()} == want
    one = P.near_dedup(spark, lined, sf).cache()
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    assert one.count() == len(set(cases.groups(rows, 5)))
    mixed = P.mixing(spark, one, sf).cache()
    assert mixed.columns == docs.columns
    out = P.tokens(spark, mixed, sf)
    run = P.run(spark, sf)
    assert by(run, "doc_id", "n_tokens") == by(out, "doc_id", "n_tokens")


@pytest.mark.parametrize("odd", [True, False])
def test_pipeline_of_odd_tables(spark, docs, empty, rows, odd):
    """Null ids and texts, repeated rows, clashing columns; and no rows at all."""
    import corpus_pipeline as P

    held, sf = docs if odd else empty, "/root/testdata/sf0.001"
    names = held.columns
    for name, stage in P.STAGES:
        held = stage(spark, held, sf)
        if name != P.STAGES[-1][0]:
            assert held.columns == names
            held = held.cache()
    out = held.collect()
    assert held.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"] and (len(out) > 10 if odd else not out)
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)


def test_bpe_of_nothing(spark, empty):
    assert empty.select(bpe.bpe_digest(F.col("text"), bpe.vocabulary())).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t")], "doc_id long, text string").select("doc_id", bpe.bpe_digest(F.col("text"), bpe.vocabulary()).alias("t"))
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.t.n_tokens == 0 and r.t.ids_sha256 == r.t.decoded_sha256 == nothing for r in none.collect())


def test_bpe_merges_together_as_one_by_one():
    own = bpe.WordBpe(bpe.vocabulary())
    rnd = random.Random(3)
    words = [[rnd.choice([*range(97, 123), rnd.randrange(256)]) for _ in range(rnd.randrange(1, 40))] for _ in range(2000)]
    words += [[97] * n for n in (1, 2, 3, 64, 199)] + [[*w[:-1], w[-1] + 256] for w in words[:1000]]
    assert own.merge_all(words) == [b"".join(i.to_bytes(4, "little") for i in own.merge(w)) for w in words]
    assert own.merge_all([]) == []
    proposed = {i for i, s in own.parts.items() if len(s) == 1 or own.merge(s) == [i]}
    assert proposed == {t for t in own.token.tolist() if t >= 0}
