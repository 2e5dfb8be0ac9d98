"""The operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
import sentencepiece
from evalloom.llm import chat, gam, langid, licenses, line_dedup, line_rules, mixing, sentencepiece_viterbi, topk
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, size long, key string, h string, fp string, line string, score double, layout string"
LONG = "word another third fourth\n" * 20_000
ROWS = [(1, "one two three four five", "a"), (2, None, "a"), (3, "", None), (4, LONG, "b"), (5, "x " * 40, "b"), (5, "x " * 40, "b"), (None, "no id at all", "c"), (6, " \n \t", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, None, 9, "k", "h", "f", "l", 0.5, "z") for i, t, s in ROWS], DOCS)


def against_oracle(spark, module):
    import glob
    import os

    c = duckdb.connect()
    for q in glob.glob(SF + "/*.parquet"):
        c.sql(f"create view {os.path.basename(q)[:-8]} as select * from '{q + '/*.parquet' if os.path.isdir(q) else q}'")
    got, want = module.query(spark, SF).toPandas(), c.sql(module.ORACLE).df()
    k = sorted(want.columns)
    assert sorted(got.columns) == k
    assert sorted(map(str, got[k].values.tolist())) == sorted(map(str, want[k].values.tolist()))


@pytest.mark.parametrize("module", [mixing, topk, line_rules, licenses, chat, line_dedup])
def test_query_against_sql(spark, module):
    against_oracle(spark, module)


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() >= 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_takes_no_row_too_often(spark):
    """A source at its cap: rows without words are taken as often as the others, whatever their hash."""
    rows = [(i, "" if i % 3 else "one two three", "small") for i in range(200)] + [(1000 + i, "w " * 50, "big") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs, weights=(1, 9)).groupBy("doc_id").count().collect()}
    assert max(times.values()) <= mixing.MAX_REPEATS and {times[i] for i in range(200)} == {2}
    taken = {r.source: (r.t, r.target) for r in mixing.mix(docs, weights=(1, 9)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    assert taken["small"] == (402, 402.0) and abs(taken["big"][0] - taken["big"][1]) <= 50


def test_line_dedup_shuffle_path_equals_broadcast(spark, docs):
    long = "a passage that is clearly longer than forty characters, again"
    rows = [(i, f"{long}\nown line {i}\n  {long.upper()} ", "a") for i in range(1, 8)]
    df = docs.unionByName(spark.createDataFrame([(i, t, s, None, 9, "k", "h", "f", "l", 0.5, "z") for i, t, s in rows], DOCS))
    one, other = (sorted(map(str, line_dedup.dedup_lines(df, broadcast_keys=n).select("doc_id", "text", "_ld_lines", "_ld_dropped").collect())) for n in (10**6, 0))
    assert one == other
    dropped = {r.doc_id: r._ld_dropped for r in line_dedup.dedup_lines(df).collect() if r.text and r.text.startswith("own")}
    assert set(dropped.values()) == {2} and 7 not in dropped
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_lines(rows, min_docs=5):
    """(doc_id, kept text, lines, dropped) of each row by a plain reading of the contract."""
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= 40:
                holders.setdefault(low(x), set()).add(i)
    rank = lambda i: -(10**9) if i is None else i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(low(x)) < 40 or len(h := holders[low(x)]) < min_docs or rank(i) == max(map(rank, h))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [10**6, 0])
def test_line_dedup_by_brute_force(spark, keys):
    """Many batches over several levels, documents of several rows, rows without an id, ties, empty texts."""
    rng = np.random.default_rng(3)
    stock = [f"passage number {i} that goes on for more than forty characters" for i in range(60)] + ["\u00e9" * 39, "\u00e9" * 40, "x" * 39]
    rows = [(int(i), "\n".join(str(stock[j]) if rng.random() < 0.8 else f"  {stock[j].upper()}\t" for j in rng.integers(0, len(stock), rng.integers(0, 9)) ** 2 // len(stock))) for i in rng.integers(0, 150, 260)]
    rows += [(None, stock[0]), (None, f"{stock[0]}\n{stock[1]}"), (7, None), (8, ""), (1, stock[59]), (1, stock[59]), (1, stock[59]), (1, stock[59]), (2, stock[59])]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, _ld_lines int")
    got = line_dedup.dedup_lines(docs, batches=7, fanout=2, broadcast_keys=keys)
    assert got.columns == ["doc_id", "text", "_ld_lines", "_ld_dropped"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows)


def test_line_runs_merge_without_shuffle_and_open_again(spark, tmp_path):
    part = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.unhex(F.md5((F.col("id") % 100).cast("string"))).alias("h"))
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
    runs.add(part(0, 150))
    runs.add(part(150, 220))
    with runs._ordered():
        plan = runs.joined(part(220, 300))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == plan.count("Sort [") == 1  # the batch's own aggregate
    assert plan.count("Bucketed: true") == 2
    again = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
    again.add(part(220, 300))
    got = {bytes(r.h): r.last_doc for r in again.repeated(3).collect()}
    assert len(got) == 100 and sorted(got.values()) == list(range(200, 300))
    assert again.repeated(4).count() == 0 and sum(r.where("NOT seen").count() for r in again.runs()) == 100
    again.clear()


def test_line_rules_of_lines(spark):
    menu = "Startseite\n\u00dcber uns\nProdukte\nKontakt\nAnmelden"
    prose = "This is a plain sentence of quite ordinary words."
    bad = ["Alle Rechte vorbehalten", "Bitte lesen Sie unsere Datenschutzerkl\u00e4rung", "Accepter tous les cookies", "Pol\u00edtica de privacidad", "Home | News | Sport | Login", "----- 123", "BUY THIS NOW"]
    rows = [(0, prose + "\n" + menu), (1, "\n".join([prose, *bad])), (2, "One.\nTwo.\nThree.\nFour.\n" + prose), (3, "One\nTwo\nThree\n" + prose), (4, "One\n\nTwo\n \nThree\nFour\n" + prose)]
    rows += [(5, menu + "\n" + prose), (6, "a b c d e\n" * 4), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (5, menu + "\n" + prose)]
    out = [r for r in line_rules.judge(spark.createDataFrame([(i, t, 3) for i, t in rows], "i int, text string, _lr int")).orderBy("i").collect()]
    clean = [r._lr.clean_text for r in out]
    assert clean[0] == clean[1] == prose and clean[2] == rows[2][1] and clean[3] == rows[3][1] and clean[4] == prose
    assert out[5] == out[6] and clean[5] == prose
    assert (out[7]._lr.n_repeat_words, out[7]._lr.n_dup_lines) == (20, 3) and out[8]._lr.base_failed


def test_line_rules_and_licenses(docs):
    assert {r.doc_id: r._lr.n_words for r in line_rules.judge(docs).collect()}[2] == 0
    long = next(r._lr for r in line_rules.judge(docs.where("doc_id = 4")).collect())
    assert long.n_repeat_words == long.n_words == 80_000 and long.n_dup_lines == 19_999 and long.base_failed
    assert licenses.scan(docs).where("size(_lic_found) > 0").count() == 0
    assert line_rules.judge(docs.limit(0)).count() == licenses.scan(docs.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSE = "3. Neither the name of the Example Foundation nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_license_notices_wrapped_and_commented(spark):
    import textwrap

    notices = [("MIT", MIT), ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + "\n\n" + ENDORSE), ("GPL-3.0-or-later", GPL), ("Apache-2.0", APACHE), ("MPL-2.0", MPL), ("ISC", ISC)]
    notices += [("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."), ("MIT", "// SPDX-License-Identifier: MIT"), ("", "It is not licensed under the MIT License."), ("", "SPDX-License-Identifier: MIT-0"), ("LGPL-3.0-or-later", GPL.replace("General", "Lesser General"))]
    rows = []
    for name, text in notices:
        wrapped = "\n".join(textwrap.fill(x, 78) for x in text.split("\n"))
        rows += [(name, text), (name, wrapped), (name, "\n".join(f" * {x}" for x in wrapped.split("\n"))), (name, "\r\n".join(f"# {x}" for x in wrapped.split("\n")))]
    out = licenses.scan(spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "i int, want string, text string")).collect()
    assert [(r.i, ",".join(r._lic_names)) for r in out] == [(r.i, r.want) for r in out]
    lines = licenses.scan(spark.createDataFrame([("x\n" + rows[1][1],)], "text string")).first()._lic_found
    assert [r.id for r in lines] == ["mit.grant", "mit.notice", "mit.warranty"] and [r.line for r in lines][0] == 2


def test_chat_layouts(spark):
    rows = [
        '{"messages": [{"role": "user", "content": "a\\\\b</s>"}, {"role": "assistant", "content": "[INST] x"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "w"}]}',
        '{"instruction": "i", "input": "", "output": "o"}', '{"prompt": "p", "response": "r", "id": 7}', '{"question": "q", "answer": null}', "no json", None, '{"other": 1}',
        '{"prompt": "", "response": "r"}', '{"data": {"system": null, "prompt": "p", "response": "r"}}',
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}', "{}",
    ]
    df = spark.createDataFrame([(i, r, "old", [1], "kept") for i, r in enumerate(rows)], "i int, r string, _cf_layout string, _cf_turns array<int>, formatted string")
    out = chat.format_turns(chat.canonical_turns(df, "r")).withColumn("back", chat.read_turns(F.col("_cf_formatted"))).withColumn("loss", chat.read_loss(F.col("_cf_formatted"), F.col("_cf_loss_spans"))).orderBy("i").collect()
    assert [r._cf_layout for r in out] == ["messages", "conversations", "instruction_input_output", "prompt_response", "question_answer", None, None, None, "prompt_response", "system_prompt_response_in_data", "messages", None]
    assert all(r._cf_turns == r.back and r.formatted == "kept" for r in out)
    assert [r.loss for r in out] == ["[INST] x", "w", "o", "r", "", "", "", "", "r", "r", "c", ""]
    assert "</s>" not in out[0]._cf_formatted and "[INST]" not in out[0]._cf_formatted
    assert [tuple(t) for t in out[2]._cf_turns] == [("user", "i"), ("user", ""), ("assistant", "o")]  # an empty text is a turn
    assert [tuple(t) for t in out[8]._cf_turns] == [("user", ""), ("assistant", "r")] and [t.text for t in out[9]._cf_turns] == ["", "p", "r"] and out[10]._cf_turns[0].text == "ab"


def test_chat_query_cases(spark, tmp_path):
    """Nulls, ties, repeated rows, roles that a layout would rename, and that all plain layouts are dealt."""
    rows = [(1, 0, "user", "q"), (1, 0, "user", "a"), (1, None, "assistant", None), (1, 0, "user", "q"), (None, 1, None, None), (2, 0, "human", "x"), (2, 1, "gpt", "y")]
    shapes = [["user", "assistant"], ["system", "user", "assistant"], ["user", "user", "assistant"], ["user", "assistant", "user"], ["tool"]]
    rows += [(10 + 5 * i + j, t, role, f"\u00e9 \\ [INST] {i} {t}") for i in range(40) for j, shape in enumerate(shapes) for t, role in enumerate(shape)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    want = {}
    for c, t, role, text in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    dealt = {r._cf_layout for r in chat.formatted(df).collect()}
    assert {x.name for x in chat.PLAIN} <= dealt and any(x.endswith("_parts_in_data") for x in dealt)
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_very_long_texts(spark, tmp_path):
    long = F.repeat(F.lit("x"), F.lit(21_000_000))
    rows = spark.range(2).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, long).otherwise("a").alias("text"))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert (got[5].n_turns, got[5].loss_chars, got[5].formatted_chars) == (2, 1, 21_000_000 + 1 + len("userassistant") + 2 * 32)
    record = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), long.alias("content"))).alias("messages")))
    out = chat.canonical_turns(spark.range(1).select(record.alias("r")), "r").select("_cf_layout", F.length(F.col("_cf_turns")[0]["text"]).alias("n")).first()
    assert tuple(out) == ("messages", 21_000_000)
    huge = spark.range(1).select(F.concat(F.lit('{"messages":"'), F.repeat(F.lit("y"), F.lit(140_000_000)), F.lit('"}')).alias("r"))
    with pytest.raises(Exception, match="over the limit of a variant"):
        chat.canonical_turns(huge, "r").select("_cf_layout").collect()


def test_sentencepiece_equals_library():
    model = sentencepiece_viterbi.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL_PATH)
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet/*.parquet'").fetchall()] if __import__("os").path.isdir(f"{SF}/documents.parquet") else [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    texts = [t or "" for t in texts] + ["", "  lead", " a\nb \tc", " " * 37 + "z", "日本語 💩", "<s> </s> <0x0A>", "a" * 300, "\n\n", "x = {1: 2}  # ok"]
    encoder, decoder = sentencepiece_viterbi.Encoder(model), sentencepiece_viterbi.Decoder(model)
    got = encoder.encode(texts)
    assert [g.tolist() for g in got] == sp.encode(texts)
    assert [decoder.decode(g) for g in got] == texts


def test_classifiers(spark, docs):
    p = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert p.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    empty = langid.train(docs)
    assert {r.p.lang_pred for r in docs.select(langid.predictions(empty)(F.col("text")).alias("p")).collect()} == {"und"}
    q = gam.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert q.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93
    none = gam.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.s for r in docs.select(gam.scores(none)(F.col("text")).alias("s")).collect()} == {0.5}


def test_topk_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 8)))]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)] + [(5000, None), (5001, [math.nan] * 8), (5002, [math.inf] + [0.0] * 7), (5003, [None] + [0.0] * 7), (5004, [])]
    df = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = [tuple(r) for r in topk.top_k(df, df.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    vec = {r.id: list(r.v) + [0] * (8 - len(r.v)) for r in df.collect()}
    want = []
    for q in sorted(i for i in vec if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), df).count() == 0


def test_topk_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(100, [9, 9, 0, 0])] * 1_100 + [(i, [int(x) for x in rng.integers(-5, 5, 4)]) for i in range(1, 8)]  # each vector is a pivot
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = [tuple(r) for r in topk.top_k(df, df.where("id = 100").limit(1), 10).orderBy("rank").collect()]
    best = sorted((-sum(a * b for a, b in zip([9, 9, 0, 0], v)), i) for i, v in rows if i != 100)
    assert got == [(100, k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_topk_large_components_raise(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        topk.scaled(df, "vec_id", "embedding").collect()
    far = spark.createDataFrame([(0, [2**31 - 1] * 4), (1, [2**31 - 1] * 4)], "id long, v array<long>")
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(far, far.where("id = 0"), 1).collect()
    big = spark.createDataFrame([(0, [2**30, 3]), (1, [2**31 - 1, 1]), (2, [2**31 - 2, 5])], "id long, v array<long>")
    assert [r.score for r in topk.top_k(big, big.where("id = 0"), 2).orderBy("rank").collect()] == [2**30 * (2**31 - 1) + 3, 2**30 * (2**31 - 2) + 15]
    assert topk.top_k(big, big.limit(0)).count() == 0


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from evalloom.llm import _shared

    conf = SimpleNamespace(get=lambda name, default=None: default)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        _shared.scratch_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="none", master="spark://host:7077")))


def test_language_training_chooses_rows_that_share_an_id(spark):
    rows = [(1, f"the cat and the dog number {i} of them", "en") for i in range(50)] + [(1, f"der hund und die katze nummer {i} sind", "de") for i in range(50)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20)
    assert model.predict([b"the dog and the cat", b"die katze und der hund", b"", b"123 ..."])[0] == ["en", "de", "und", "und"]
    one = langid.train(spark.createDataFrame(rows[:50], "doc_id long, text string, lang string"))
    assert one.predict([b"etwas", b""]) == (["en", "und"], [1.0, 0.0])
    both = spark.createDataFrame([(1, "the cat", 0.5), (1, "the cat", 0.5), (2, None, 0.5)], "doc_id long, text string, score double")
    assert [r.p.lang_pred for r in both.select(langid.predictions(model)(F.col("text")).alias("p")).collect()] == ["en", "en", "und"]
    assert both.limit(0).select(langid.predictions(model)(F.col("text"))).count() == 0


def test_language_votes_by_hand():
    """The hierarchical decision against a plain loop over dense vectors."""
    rng = np.random.default_rng(5)
    langs = np.array(["en", "de", "nl", "fr", "es"] * 30)
    base = {c: rng.normal(size=langid.DIMS).astype(np.float32) for c in set(langs)}
    x = np.array([base[c] + rng.normal(size=langid.DIMS) * 0.5 for c in langs], np.float32)
    model = langid.fit(x / np.linalg.norm(x, axis=1, keepdims=True), langs)
    assert model.families == [["de", "en", "nl"], ["es", "fr"]]
    texts = [w.encode() for w in ("hello there", "wie geht es", "le chat noir", "el gato negro", "de kat zwart")]
    for text, lang, score in zip(texts, *model.predict(texts), strict=True):
        v = [*langid.trigrams(text).tolist(), 1.0]
        chance = lambda w: 1 / (1 + math.exp(-4 * sum(a * float(b) for a, b in zip(v, w, strict=True))))  # noqa: B023, E731
        family = [chance(w) for w in model.family_w]
        best = max(range(2), key=family.__getitem__)
        members = model.families[best]
        votes = {m: sum(chance(w) if a == m else 1 - chance(w) for (a, b), w in model.pair_w.items() if m in (a, b)) for m in members}
        assert lang == max(members, key=votes.__getitem__)
        assert score == pytest.approx(family[best] / sum(family) * votes[lang] / (len(members) - 1), abs=1e-4)


def test_gam_scores_are_sums_of_table_entries(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    model = gam.fit(x, y)
    for row, score in zip(x[:25], model.score(x[:25]), strict=True):
        z = model.bias + sum(t[sum(c < v for c in cuts)] for v, cuts, t in zip(row, model.cuts, model.tables, strict=True))
        z += sum(t[sum(c < row[i] for c in model.pair_cuts[i]), sum(c < row[j] for c in model.pair_cuts[j])] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
    assert np.mean((model.score(x) > 0.5) == y) > 0.9
    docs = spark.createDataFrame([(1, "a b c", 0.1), (2, None, 0.1), (2, None, 0.1), (3, "", 0.1)], "doc_id long, text string, score double")
    got = [r.s for r in docs.select(gam.scores(model)(F.col("text")).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in got) and got[1] == got[2] == got[3]
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    one = gam.train(docs, labels([(1, 1), (1, 1), (2, 1), (9, 1), (None, 1), (3, None)]))
    assert len(one.tables) == 0 and gam.Gam.score(one, np.zeros((1, 18)))[0] == pytest.approx(4.5 / 5)  # row 1 twice, rows of 2
    assert gam.train(docs.limit(0), labels([(1, 1)])).bias == 0.0


def brute_unigram(text, pieces, unk):
    """The best segmentation by a plain Viterbi over one string."""
    best = [(0.0, [])] + [(-math.inf, [])] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            piece = text[i:j]
            score = pieces.get(piece, unk if j - i == 1 else -math.inf)
            if best[i][0] + score > best[j][0]:
                best[j] = best[i][0] + score, [*best[i][1], piece]
    return best[-1]


def test_unigram_viterbi_against_brute_force():
    """A hand-made unigram model (nothing is trained): the maximum over all segmentations, at each word."""
    rng = np.random.default_rng(7)
    names = sorted({"".join(rng.choice(list("abcd\u2581"), rng.integers(1, 5))) for _ in range(60)} | set("abc\u2581"))
    names = [n for n in names if "\u2581" not in n[1:]]
    scores = {n: -float(rng.integers(1, 400)) / 16 for n in names}
    model = sentencepiece_viterbi.Model(["<unk>", *names], np.array([0.0, *scores.values()]), np.array([False] + [True] * len(names)), None, 0, False).prepare()
    encoder = sentencepiece_viterbi.Encoder(model)
    texts = ["".join(rng.choice(list("abcd e"), rng.integers(1, 40))) for _ in range(80)] + ["", "a" * 200, "zz"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        marked = ("\u2581" + text.replace(" ", "\u2581")) if text else ""
        want, _ = brute_unigram(marked, scores, encoder.floor)
        got, at = 0.0, 0
        for i in ids:
            n = len(model.pieces[i]) if i else 1
            assert i == 0 or marked[at : at + n] == model.pieces[i]
            got += scores[model.pieces[i]] if i else encoder.floor
            at += n
        assert at == len(marked) and got == pytest.approx(want)


def test_sentencepiece_in_spark(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL_PATH)
    out = sentencepiece_viterbi.encoded(docs)
    assert out.columns == [*docs.columns, "_sp_ids"]
    both = out.select("text", "_sp_ids", sentencepiece_viterbi.decode_column(spark)(F.col("_sp_ids")).alias("back")).collect()
    assert len(both) == len(ROWS)
    for r in both:
        assert r._sp_ids == sp.encode(r.text or "") and r.back == (r.text or "")
    trip = docs.select(sentencepiece_viterbi.round_trip_column(spark)(F.col("text")).alias("r")).select("r.*").collect()
    for r, row in zip(trip, both, strict=True):
        assert r.round_trip and r.n_tokens == len(row._sp_ids) and r.ids_sha256 == hashlib.sha256(np.array(row._sp_ids, "<i4").tobytes()).hexdigest()
    assert sentencepiece_viterbi.encoded(docs.limit(0)).count() == 0


def test_more_licences(spark):
    lesser = GPL.replace("program", "library").replace("General", "Lesser General").replace("version 3 of", "version 2.1 of")
    rows = [(lesser, "LGPL-2.1-or-later"), (GPL.replace("General", "Affero General"), "AGPL-3.0-or-later"), ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Unlicense")]
    rows += [("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), (None, ""), ("", "")]
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "i int, text string, _lic_names string")
    assert [",".join(r._lic_names) for r in licenses.scan(df).orderBy("i").collect()] == [w for _, w in rows]
    order = spark.createDataFrame([("\n\n".join(BSD.split("\n\n")[::-1]),)], "text string")  # the sentences in another order are no notice
    assert licenses.scan(order).first()._lic_names == [] and len(licenses.scan(order).first()._lic_found) == 3
