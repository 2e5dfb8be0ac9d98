"""Substring dedup against a plain version: shared passages, hot passages and prefixes, awkward rows, whole query against SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from evalloom.llm import substring_dedup
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute(rows, window=50):
    """(doc_id, words, removed, kept) of each row, by a dictionary of windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = lambda d: (d is not None, d or 0)
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k not in first or rank(doc) < first[k]:
                first[k] = rank(doc)
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(doc):
                gone |= {*range(i, i + window)}
        yield doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def check(spark, rows, slices=4, **how):
    docs = spark.createDataFrame([(d, t, "keep", 5) for d, t in rows], "doc_id long, text string, _sd_doc string, cell int").repartition(slices)
    out = substring_dedup.dedup_substrings(docs, **how)
    assert out.columns == ["doc_id", "text", "cell", "_sd_words", "_sd_removed"]
    got = sorted(((r.doc_id, r._sd_words, r._sd_removed, r.text) for r in out.collect()), key=str)
    assert got == sorted(brute(rows, how.get("window", 50)), key=str)
    return got


def passage(seed: int, n: int, vocabulary: int = 1000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_awkward_rows(spark):
    shared, copy = passage(1, 60), passage(2, 200)
    rows = [
        (1, f"{passage(3, 30)} {shared} {passage(4, 30)}"), (2, f"{shared}\n\t{passage(5, 10)}"), (7, shared.replace(" ", "\x0b\r\n ")), (8, shared.upper()), (9, passage(6, 49)), (10, passage(6, 49)), (11, passage(7, 50)), (12, passage(7, 50)),
        (13, copy), (13, copy), (12, copy), (None, copy), (None, passage(1, 60)), (3, None), (4, ""), (5, " \n "), (20, f"{copy} {copy} {passage(8, 5)} {copy}"), (21, copy + " é 東京　x\x85y"), (22, copy + " é 東京　x\x85y"), (-5, copy),
        (30, "the " * 5000), (31, "the " * 700), (32, "no " * 200), (40, passage(9, 30_000)), (41, passage(9, 30_000)[-40_000:]),
    ]
    got = check(spark, rows)
    assert any(g[2] for g in got) and next(g for g in got if g[0] == 20)[3] == passage(8, 5)


@pytest.mark.parametrize("group", [40, 400, 10**6])
def test_hot_prefixes_and_passages(spark, group):
    """One prefix of 12 and one of 30 words under many windows, one passage in most documents; groups down to a few suffixes."""
    start, longer, common = passage(11, 12), passage(12, 30), passage(13, 55)
    rows = [(i, f"{passage(100 + i, 20)} {start} {passage(200 + i % 40, 60)} {longer} {passage(300 + i % 30, 45)}" + f" {common}" * (i % 3 > 0)) for i in range(120)]
    random.Random(5).shuffle(rows)
    check(spark, rows, slices=6, group=group)


def test_groups_stay_small(spark):
    """A frequent prefix is split by the next longer ones; only equal windows stay together."""
    start = passage(11, 30)
    docs = spark.createDataFrame([(i, f"{start} {passage(500 + i, 60)}") for i in range(200)], "doc_id long, text string").repartition(4)
    cells = substring_dedup.cells_of(docs, 60)
    assert cells.more[0] and cells.more[1]
    most = substring_dedup.suffixes(docs, cells, 50).groupBy("cell").agg(F.sum(F.octet_length("hashes") / 8).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 60


@pytest.mark.parametrize(("window", "prefixes"), [(3, (1, 2)), (5, (2,)), (8, (1, 3, 6))])
def test_short_windows_on_random_words(spark, window, prefixes):
    """Few different words, so that windows repeat in and over documents in all ways."""
    rng = random.Random(window)
    rows = [(rng.randrange(40), passage(rng.randrange(10**6), rng.randrange(40), 3)) for _ in range(80)]
    check(spark, rows, window=window, prefixes=prefixes, group=25)


def test_chunks_and_pieces(spark, monkeypatch):
    """Words are the same wherever a long text is cut, and hashes of prefixes wherever a document stands."""
    text = ("ab c\n" * 50_000 + "x" * 2_500_000 + " tail\t").encode()
    parts = [len(p) for p in substring_dedup.pieces(text)]
    assert sum(parts) == len(text) and b"".join(substring_dedup.pieces(text)) == text
    known = substring_dedup.Words()
    assert len(substring_dedup.word_hashes(text, known)) == len(text.split())
    docs = [passage(i, 80).encode() for i in range(4)]
    together, alone = substring_dedup.Windows(docs, known), substring_dedup.Windows(docs[2:3], known)
    for k in (10, 25, 50):
        assert np.array_equal(together.prefix(k)[together.doc == 2], alone.prefix(k))


def test_empty_table_and_bad_prefixes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup_substrings(empty).count() == 0
    for bad in ((), (50,), (25, 10)):
        with pytest.raises(ValueError):
            substring_dedup.dedup_substrings(empty, prefixes=bad)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(substring_dedup.ORACLE)
    got = substring_dedup.query(spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_kept_text_is_what_is_hashed(spark):
    out = substring_dedup.dedup_substrings(spark.read.parquet(f"{SF}/documents.parquet")).limit(50).collect()
    known = {r.doc_id: r.kept_sha256 for r in substring_dedup.query(spark, SF).collect()}
    assert all(known[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest() for r in out)
