"""Fill-in-middle: units and cuts against a regular expression, round trips, awkward rows, whole query against SQL."""

import hashlib
import re

import duckdb
import pytest
from evalloom.llm import fill_middle
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
FOUND = fill_middle.automaton_of((fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab \t\n\x0b\x85　é😀<P>SM"), max_size=40), st.integers(1, 50))
def test_units_at_any_block_size(text, block):
    scan, ends = fill_middle.Scan(FOUND, text, block), [0]
    for unit in UNIT.findall(text):
        ends.append(ends[-1] + len(unit))
    assert scan.n == len(ends) - 1 and [scan.end(k) for k in range(len(ends))] == ends
    assert bool(scan.sentinels) == any(s in text for s in ("<P>", "<S>", "<M>"))


def plain(text: str, doc_id, rate=50, spm=80) -> tuple:
    """The contract's words, without the operator's code."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


TEXTS = ["one two three four", None, "", " \n\t ", "x", " lead and trail ", "has <P> inside", "a < P > b <", "<", "S> M>", "é　ü 😀 \x85 z", "w " * 200_000, "no-blank" * 50_000, "ends with <P"]


@pytest.mark.parametrize("rate", [50, 100])
def test_rows_against_brute_force(spark, rate):
    rows = [(i if i != 5 else None, t, "n", "f") for i in range(40) for t in TEXTS if len(t or "") < 1000 or i < 4]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, _fim string").repartition(8)
    out = fill_middle.fim_documents(docs, rate=rate)
    assert out.columns == docs.columns
    got = out.withColumn("back", fill_middle.restored(F.col("_fim.output"), F.col("_fim.form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r["_fim"]) == plain(r.text or "", r.doc_id, rate)
        assert r.back == (r.text or "")
    assert {r["_fim"].form for r in got} == {"plain", "spm", "psm"}


def test_empty_table_and_odd_sentinels(spark):
    assert fill_middle.fim_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("a b", "<S>", "<M>"), ("P", "<S>", "<M>"), ("<PP<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.automaton_of(bad)
    with pytest.raises(Exception, match="don't fit"):
        spark.createDataFrame([("no sentinel", "psm")], "o string, f string").select(fill_middle.restored(F.col("o"), F.col("f"))).collect()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(fill_middle.ORACLE)
    got = fill_middle.query(spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
