"""Rows that once crashed an operator or lost something: roles with a line's end, near layouts, hot label ids, clashing columns."""

import json
import tracemalloc

import numpy as np
import pytest
from evalloom.llm import chat, gam, licenses, line_rules, mixing, simhash, topk


def test_roles_with_a_line_end(spark):
    """A role that looks like a shape's roles joined stays one turn of an array layout."""
    rows = [(1, 0, "user\nassistant", "x"), (2, 0, "system\nuser\nassistant", "y"), (3, 0, "user", "q"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.t] for r in chat.formatted(df).select("conv_id", chat.read_turns(chat.F.col("_cf_formatted")).alias("t")).collect()}
    assert got == {1: [("user\nassistant", "x")], 2: [("system\nuser\nassistant", "y")], 3: [("user", "q"), ("assistant", "a")]}


CASES = [
    ({"messages": [["user", "q"], ["assistant", "a"]]}, None, []),
    ({"messages": [{"role": "user", "content": "q"}], "system": "be good"}, "system_messages", [("system", "be good"), ("user", "q")]),
    ({"messages": [{"role": "user", "content": "q"}], "system": "be good", "id": 4}, "system_messages", [("system", "be good"), ("user", "q")]),
    ({"prompt": "p", "response": "r", "history": [["a", "b"]]}, None, []),
    ({"prompt": "p", "response": "r", "history": None}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"messages": [{"role": "user", "content": {"text": "q"}}], "n": 1}, None, []),
    ({"messages": [{"role": "user", "content": "q", "weight": 1}], "n": 1}, "messages", [("user", "q")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "n": 1}, "messages", [("user", "ab")]),
    ({"prompt": [{"role": "user", "content": "q"}], "response": "r"}, None, []),
    ({"prompt": "p", "chosen": "c", "rejected": "r"}, None, []),
    ({"prompt": "p", "response": "r", "n": {"deep": [1, 2]}}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": 5, "response": 1.5, "n": 1}, "prompt_response", [("user", "5"), ("assistant", "1.5")]),
    ({"inputs": "i", "targets": "t"}, "inputs_targets", [("user", "i"), ("assistant", "t")]),
    ({"query": "i", "answer": "t"}, "query_answer", [("user", "i"), ("assistant", "t")]),
    ({"data": {"query": "i", "response": "t", "lang": "x"}}, "query_response_in_data", [("user", "i"), ("assistant", "t")]),
    ({"messages": []}, None, []),
    ({"messages": "text"}, None, []),
]


def test_near_layouts_lose_no_turn(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(CASES)], "i int, r string")
    out = chat.canonical_turns(df, "r").orderBy("i").collect()
    assert [(r._cf_layout, [tuple(t) for t in r._cf_turns]) for r in out] == [(n, t) for _, n, t in CASES]


def test_native_near_layouts(spark):
    good = spark.createDataFrame([((1, "p", "r"),)], "r struct<id: int, prompt: string, response: string>")
    assert chat.native_turns(good, "r").first()._cf_layout == "prompt_response"
    for kind, row in (("struct<messages: array<array<string>>>", ([["user", "q"]],)), ("struct<prompt: string, response: string, history: array<string>>", ("p", "r", ["a"]))):
        assert chat.native_turns(spark.createDataFrame([(row,)], f"r {kind}"), "r").first()._cf_layout is None


def test_rows_that_reach_the_driver_are_bounded(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    seen = []
    monkeypatch.setattr(gam, "fit", lambda x, y: seen.append((x.shape, y.shape)))
    gam.train(docs, spark.createDataFrame([(7, 1)], "doc_id long, quality int"), max_rows=10)
    assert seen == [((10, len(gam.FEATURES)), (10,))]
    seen.clear()
    few = spark.createDataFrame([(i, f"words {i}") for i in range(8)] + [(3, "words 3")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    monkeypatch.setattr(gam, "fit", lambda x, y: seen.append((x, y)))
    for _ in range(2):
        gam.train(few.repartition(3), labels)
    assert np.array_equal(seen[0][0], seen[1][0]) and np.array_equal(seen[0][1], seen[1][1]) and len(seen[0][1]) == 9


@pytest.mark.parametrize("extra", ["_sh_id", "_sh_a", "root"])
def test_clashing_columns(spark, extra):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, 5), (2, text, 6), (3, "another text of its own words here", 7)], f"doc_id long, text string, {extra} long")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(1, text, 5), (3, "another text of its own words here", 7)]


def test_mix_of_rows_that_share_an_id(spark):
    """Each source's taken words come near its target, also where most rows are equal, or share only an id or none."""
    words = " ".join(["w"] * 12)
    equal = [(7, words, "a")] * 300 + [(i, words, "a") for i in range(1000, 1100)]
    null = [(None, f"{words} {i}", "b") for i in range(400)]
    docs = spark.createDataFrame(equal + null + [(i, "x " * 10, "c") for i in range(2000, 2200)], "doc_id long, text string, source string").repartition(6)
    rows = mixing.mix(docs).collect()
    for source in "abc":
        own = [r for r in rows if r.source == source]
        longest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= longest
    taken = lambda x: sorted((r.source, r.doc_id is None, r.doc_id or 0, r.size, r.taken) for r in x)
    assert taken(rows) == taken(mixing.mix(docs.repartition(3)).collect())
    out = mixing.mixed_documents(docs)
    times = out.groupBy("source").count().collect()
    words_of = {r.source: r["count"] for r in times}
    assert words_of["c"] * 10 == sum(r.taken for r in rows if r.source == "c") and words_of["a"] * 12 == sum(r.taken for r in rows if r.source == "a")


def test_mix_touches_no_other_column(spark):
    names = ["_mix_copies", "_mix_key", "copies", "key", "part", "in0", "target"]
    docs = spark.createDataFrame([(i // 2, "some words here", "s", *[6] * 7) for i in range(40)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {(6,) * 7}


def test_prose_that_speaks_of_boilerplate_stays(spark):
    """A phrase counts where it makes up much of a line; unspaced scripts are no menus; other languages' phrases."""
    prose = "The old charter, with all rights reserved to the crown for as long as the river ran, was read aloud in the square on the first of May."
    stays = [f"{prose}\nYou should click here only after you have read the whole of the manual and understood it.\n{prose}", "\n".join(["今日は天気がとてもいいです。", "公園で友達と一緒に遊びました。", "そのあと家に帰って本を読みました。", "夜は早く寝るつもりです。"]), "这是一个没有句号但是很长的句子它应该被当作普通的文字而不是菜单里面的一个短短的项目\n" * 4]
    goes = ["Tutti i diritti riservati", "Read more", "Share on Facebook", "Click here to subscribe", "(c) 2019 Some Firm. All rights reserved.", "Privacy Policy | Terms of Use | Contact"]
    plain = "A plain sentence with enough ordinary words in it to be kept by every rule."
    rows = [(i, t) for i, t in enumerate(stays)] + [(10 + i, f"{plain}\n{x}\n{plain} More of it.") for i, x in enumerate(goes)]
    out = {r.i: (r.text, r._lr.clean_text) for r in line_rules.judge(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert all(out[i][0] == out[i][1] for i in range(len(stays)))
    assert all(out[10 + i][1] == f"{plain}\n{plain} More of it." for i in range(len(goes)))


def test_memory_of_the_query_side():
    """2,048 pivots and 10,000 queries that meet every group: what is held at once stays bounded, and no pair is lost."""
    rng = np.random.default_rng(1)
    pivots, dims, k = 2048, 16, 10
    space = topk.Space(dims, 100.0, rng.normal(size=(pivots, dims + 1)))
    ids, blocks = np.arange(pivots), rng.integers(1, 4, pivots)
    plan = topk.Plan(space, k, ids, blocks, np.zeros(pivots), np.full(pivots, 1e9), rng.random(pivots * (k + 1)), np.repeat(ids, k + 1))
    x = rng.normal(size=(10_000, dims))
    tracemalloc.start()
    sent = sum(len(who) for who, _, _ in plan.sends(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 10_000 * blocks.sum() and peak < 300 << 20
    few = topk.Plan(space, k, ids, blocks, rng.random(pivots) * 3, 3 + rng.random(pivots) * 3, rng.random(pivots * (k + 1)), np.repeat(ids, k + 1))
    got = {(int(q), int(b)) for who, at, _ in few.sends(x[:500]) for q, b in zip(who, at, strict=True)}
    _, need = few.bounds(space.to_pivots(x[:500], False))
    assert got == {(int(q), int(b)) for q, g in zip(*np.nonzero(need), strict=True) for b in range(few.starts[g], few.starts[g + 1])}


LICENCES = [
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n"),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"),
    ("EPL-2.0", "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM"), ("Apache-2.0", "Licensed under Apache 2.0"),
    ("Apache-2.0,MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("GPL-3.0-or-later", "Distributed under the GNU General Public License version 3 or later."),
    ("Zlib", "1. The origin of this software must not be misrepresented; you must not claim that you wrote it.\n\n2. Altered source versions must be plainly marked as such, and must not be\n   misrepresented as being the original software."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-3.0", "Available as Creative Commons Attribution 3.0 Unported, see the site."), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A"), ("MIT", "MIT License\n\nCopyright (c) 2020 A"),
    ("GPL-3.0-or-later", "// SPDX-License-Identifier: GPL-3.0+"), ("GPL-3.0-only", "# SPDX-License-Identifier: GPL-3.0"), ("LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("", "We do not use the MIT licensed parts, nor general public transport version 3."), ("", "It is not licensed under Apache 2.0."),
]


def test_licence_titles_and_statements(spark):
    out = licenses.scan(spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(LICENCES)], "i int, want string, text string")).orderBy("i").collect()
    assert [(r.i, ",".join(x for x in r._lic_names)) for r in out] == [(r.i, r.want) for r in out]
