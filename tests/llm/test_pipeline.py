"""The pipeline as a whole against a plain version of its five stages, and its edge cases."""

from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece
from evalloom.llm import gam, mixing, sentencepiece_viterbi
from test_operators import brute_lines
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_near(rows):
    """One row of each component: the least id, null last."""
    fps = [brute_fingerprint(r["text"]) for r in rows]
    first = lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0)
    return [rows[i] for i, group in enumerate(brute_components(fps)) if i == min(group, key=first)]


def plain_mix(rows):
    """Copies of each row, by DuckDB's reading of op1 over these rows."""
    import pandas as pd

    documents = pd.DataFrame({"doc_id": [r["doc_id"] for r in rows], "source": [r["source"] for r in rows], "text": [r["text"] for r in rows]})  # noqa: F841
    taken = {r[0]: (r[1], r[2]) for r in duckdb.sql(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall()}
    out = []
    for r in rows:
        size, words = taken[r["doc_id"]]
        assert size  # rows without words don't get past the classifier
        out += [r] * (words // size)
    return out


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = gam.quality_model(spark, SF, docs)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r, s in zip(rows, model.score(gam.matrix([(r["text"] or "").encode() for r in rows])), strict=True) if s >= gam.THRESHOLD]
    assert 0 < len(rows) < docs.count()
    cleaned = {i: t for i, t, _, _ in brute_lines([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r | {"text": cleaned[r["doc_id"]], "n_chars": len(cleaned[r["doc_id"]])} for r in rows]
    rows = plain_mix(plain_near(rows))
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL_PATH)
    want = Counter((r["doc_id"], r["source"], tuple(sp.encode(r["text"]))) for r in rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.source, tuple(r.token_ids)) for r in got) == want
    assert all(r.n_tokens == len(r.token_ids) for r in got)


def awkward(spark):
    long = "a passage that more than four documents hold, of over forty characters"
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"{text(i)}\n{long}", "en", "s", 1) for i in range(6)]
    rows += [(6, text(0) + " ", None, None, None), (None, text(70), "en", "t", 3), (None, None, None, None, None), (8, "", "en", "s", 0), (9, text(9), "en", "t", 0), (9, text(9), "en", "t", 0), (10, "z " * 50_000, "en", "u", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    out = corpus_pipeline.lines(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_lines(rows)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((i, t) for i, t, _, _ in want), key=str)
    assert all(r.n_chars == len(r.text) for r in out.collect())
    near = corpus_pipeline.near(spark, docs, SF)
    assert near.schema.names == docs.schema.names
    want = Counter((r["doc_id"], r["text"] or "") for r in plain_near([r.asDict() for r in docs.collect()]))
    assert Counter((r.doc_id, r.text or "") for r in near.collect()) == want
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.schema.names == docs.schema.names
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id, r.source] += 1
    assert all(n <= 2 * (2 if k[0] in (None, 9) else 1) for k, n in times.items())
    ids = corpus_pipeline.encode(spark, docs, SF)
    assert ids.columns == ["doc_id", "source", "n_tokens", "token_ids"] and ids.count() == docs.count()
    assert {r.n_tokens for r in ids.where("doc_id = 8").collect()} == {0}


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, stage):
    none = spark.createDataFrame([], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[stage](spark, none, SF)
    assert out.count() == 0 and (stage == "encode" or out.columns == none.columns)


def test_quality_keeps_by_score(spark):
    docs = awkward(spark)
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.schema == docs.schema
    model = gam.quality_model(spark, SF, docs)
    rows = docs.collect()
    scores = model.score(gam.matrix([(r.text or "").encode() for r in rows]))
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r, s in zip(rows, np.asarray(scores), strict=True) if s >= gam.THRESHOLD)
