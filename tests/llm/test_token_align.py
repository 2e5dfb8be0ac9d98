"""Cross-tokenizer alignment against a brute-force version on the libraries' own encodings of whole texts."""

import hashlib
from collections import Counter, defaultdict
from functools import cache

import pytest
import sentencepiece
from evalloom.llm import token_align
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@cache
def libraries():
    a, b = Tokenizer.from_file(token_align.PATH_A), sentencepiece.SentencePieceProcessor(model_file=token_align.PATH_B)
    a.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_byte = {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in kept)}
    spell_a = {i: bytes(as_byte[c] for c in t) for t, i in a.get_vocab().items() if not t.startswith("<|end")}
    spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    return a, b, spell_a, spell_b, token_align.Pair(*token_align.read_files(token_align.PATH_A, token_align.PATH_B))


def groups_of(text):
    """[(A ids, B ids)], or None where the text has no tokens."""
    a, b, spell_a, spell_b, _ = libraries()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if not text or b"".join(spell_a[i] for i in ids_a) != raw or b"".join(spell_b[i] for i in ids_b) != raw:
        return None
    ends_a, ends_b, at = {}, {}, 0
    for k, i in enumerate(ids_a):
        ends_a[at := at + len(spell_a[i])] = k + 1
    at = 0
    for k, i in enumerate(ids_b):
        ends_b[at := at + len(spell_b[i])] = k + 1
    out, i, j = [], 0, 0
    for e in sorted(ends_a.keys() & ends_b.keys()):
        out.append((ids_a[i : ends_a[e]], ids_b[j : ends_b[e]]))
        i, j = ends_a[e], ends_b[e]
    return out


def brute(rows):
    found = [(d, groups_of(t or "")) for d, t in rows]
    count = Counter((a[-1], b[-1]) for _, g in found for a, b in g or ())
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for doc, g in found:
        if g is None:
            yield doc, 0, 0, 0, 0, 0, 0, ""
            continue
        links = [(a[-1], b[-1]) for a, b in g]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(spelled.encode()).hexdigest(),
        )


ODD = [
    None, "", " ", "\n", "x", "  two  blanks ", "tab\t \n mixed\r\n\x0b ends \t", "a literal ▁ here", "<|endoftext|> <s></s> <unk> <0x0A>", "naïve café 東京 日本語　全角 😀👩‍👩‍👧   x\x85y\xa0z",
    "don't we'll I'M it's 'tis", "!!! ... ??? --- ===", "\x1c\x1d x\x1f \x00 nul", "0123456789 12,345.67", "a" * 5000, "ab " * 4000, "é" * 300, "　　 x", "x ​ y ﻿ z",
]


def check(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, n_a int, chunk string").repartition(5)
    got = [tuple(r[f] for f in FIELDS) for r in token_align.align(docs, **how).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_awkward_rows(spark):
    check(spark, [*enumerate(ODD), (3, "the same id"), (None, "no id"), (None, "no id"), (77, "copy of a copy"), (78, "copy of a copy")])


def test_many_chunks_and_salts(spark, monkeypatch):
    """Hot pairs over many chunks, each cell dealt to several salts."""
    rows = [(i, "the end of the line, the end\n" * (1 + i % 4) + f"number {i} of the rest") for i in range(300)]
    check(spark, rows, cells=3, salt_postings=200)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stT19 \t\n\r\x0b\x1c\x85\xa0é▁　 !?.😀́"), max_size=25), min_size=1, max_size=6))
def test_segments_align_as_whole_texts(texts):
    """Encoding by joined segments gives what the libraries give for whole texts."""
    pair = libraries()[-1]
    first, *blocks = token_align.aligned_chunk(pair, list(range(len(texts))), [t.encode() for t in texts], 7, 4)
    want = [x[:5] + x[7:] for x in brute(enumerate(texts))]
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in first["rows"]] == want
    assert sum(sum(memoryview(b["counts"]).cast("I")) for b in blocks) == sum(r["n_links"] for r in first["rows"])


def test_vocabulary_map(spark):
    rows = [(i, f"the tokens of text {i}, and the rest") for i in range(20)]
    count = Counter((a[-1], b[-1]) for _, t in rows for a, b in groups_of(t))
    got = {(r.a, r.b): (r.n, r.best) for r in token_align.vocabulary_map(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == count
    assert all(best == (n == max(m for (_, y), m in count.items() if y == b)) for (_, b), (n, best) in got.items())


def test_empty_table(spark):
    assert token_align.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r[f] for f in FIELDS) for r in token_align.query(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(brute(map(tuple, docs)), key=str)


def test_other_models_are_refused():
    with pytest.raises((ValueError, KeyError)):
        token_align.Pair(b'{"model": {"type": "WordPiece"}, "pre_tokenizer": {}, "normalizer": null, "added_tokens": []}', b"")
