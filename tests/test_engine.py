"""Every registered query with SQL against DuckDB, the sources, and that the rest works without the llm folders."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from evalloom.plans import catalog, records, scored  # noqa: F401
from evalloom.sources import results
from evalloom.streaming import logs
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def oracle(sql, sf=SF):
    c = duckdb.connect()
    for q in glob.glob(sf + "/*.parquet"):
        c.sql(f"create view {os.path.basename(q)[:-8]} as select * from '{q + '/*.parquet' if os.path.isdir(q) else q}'")
    return c.sql(sql).df()


def rows(pdf):
    k = sorted(pdf.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted(map(str, [tuple(plain(v) for v in r) for r in pdf[k].astype(object).itertuples(index=False)]))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = oracle(catalog.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_strict_and_torn_logs(spark, tmp_path):
    good = '{"idx": "1", "rec_no": 0, "correct": true}\n{"idx": "2", "rec_no": 1, "error": "timeout"}\n'
    (tmp_path / "good.jsonl").write_text(good)
    (tmp_path / "torn.jsonl").write_text(good + '{"idx": "3", "re')
    (tmp_path / "bad.jsonl").write_text('{"idx": \n' + good)
    (tmp_path / "twice.jsonl").write_text(good + good)
    read = lambda f, n: f(spark, str(tmp_path / n))
    assert read(results.read_strict, "good.jsonl").count() == 2
    assert read(results.read_resumable, "torn.jsonl").select("idx").collect() == [("1",), ("2",)]
    assert read(results.read_tolerant, "bad.jsonl").where("idx is not null").count() == 2
    with pytest.raises(ValueError):
        read(results.read_strict, "twice.jsonl")
    with pytest.raises(Exception, match="bad line"):
        read(results.read_resumable, "bad.jsonl").collect()


def test_discovery_hashes_reports(spark, tmp_path):
    (tmp_path / "config2_F16__textvqa.jsonl").write_text("{}\n")
    (tmp_path / "config2_F16__textvqa_poison.jsonl").write_text("{}\n")
    found = results.discover(spark, str(tmp_path)).select("config", "short", "dataset").collect()
    assert [tuple(r) for r in found] == [("2", "F16", "textvqa")]
    assert len(results.file_hashes(spark, str(tmp_path)).first().sha256) == 64
    df = spark.createDataFrame([(1, -0.0), (2, None)], "a int, b double")
    assert results.markdown(df.orderBy("a")).splitlines()[2:] == ["| 1 | 0.00 |", "| 2 | - |"]
    results.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"rec_no": 1}\n{"rec_no": 2, "error_type": "ServerUnavailable"}\n{"rec_no": 1}\n')
    q = logs.resumed(spark, str(tmp_path / "in"), results.RESULT).writeStream.format("memory").queryName("resumed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("resumed").select("rec_no").collect() == [(1,)]
    ev = spark.createDataFrame([("2024-01-01 00:10:00", 1, 5.0), ("2024-01-01 00:50:00", 1, 7.0)], "t string, server_id int, wall_ms double").withColumn("t", F.to_timestamp("t"))
    assert [tuple(r)[1:] for r in logs.request_windows(ev, "t").collect()] == [(1, 2, 7.0)]


def test_entry_without_llm(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'paired_delta' in n and 'pipeline' not in n and not any(k.startswith('op') for k in n) and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
