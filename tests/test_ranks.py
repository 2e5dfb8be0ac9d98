"""Exact ranks against numpy; image headers; pivoted reports."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import Row

from evalloom.operators import latency, ranks
from evalloom.sources import images, results


def test_percentiles_of_uneven_groups(spark):
    rng = random.Random(5)
    groups = {"a": [rng.gauss(0, 1) for _ in range(2000)], None: [1e6 + i for i in range(700)], "ties": [2.5] * 400 + [7.0] * 3, "one": [-4.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    points = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.k: r for r in ranks.percentiles(df, ["k"], "v", points).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert [got[k][p] for p in points] == pytest.approx(list(np.percentile(vs, [5, 50, 95, 100])), abs=1e-9)


def test_ranks_are_a_permutation(spark):
    df = spark.range(3000).selectExpr("id % 3 as g", "(id * 7919) % 3001 as v")
    placed = ranks.placed(df, ["g"], "v").collect()
    for g in range(3):
        mine = sorted((r.v, r._before, r._total) for r in placed if r.g == g)
        assert [r[1] for r in mine] == list(range(1000)) and {r[2] for r in mine} == {1000}


def test_empty_tables_and_groups(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert ranks.percentiles(empty, ["k"], "v", {"m": 0.5}).collect() == []
    assert ranks.placed(empty, ["k"], "v").count() == 0
    log = spark.createDataFrame([("a", False, 3.0), (None, True, 4.0)], "k string, valid boolean, wall_ms double")
    assert {(r.k, r.n_valid, r.n_invalid, r.median) for r in latency.summary(log, "k").collect()} == {("a", 0, 1, None), (None, 1, 0, 4.0)}


def test_no_task_sorts_a_whole_group(spark, monkeypatch):
    df = spark.range(100).selectExpr("1 as g", "id as v")
    monkeypatch.setattr(ranks, "ROWS", 50)
    plan = ranks.percentiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "_rows" in line]
    assert windows and all("_range" in line.split("], [")[1] for line in windows)


PNG = images.PNG + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
JPEG = images.JPEG + b"\xff\xe0\x00\x04ab" + b"\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 33, 44) + bytes(6)


@pytest.mark.parametrize(("data", "size"), [(PNG, (640, 480)), (JPEG, (44, 33)), (b"GIF89a" + struct.pack("<HH", 5, 6), (5, 6)), (PNG[:18], (None, None)), (JPEG[:12], (None, None)), (b"", (None, None)), (b"text", (None, None)), (None, (None, None))])
def test_size_of(data, size):
    assert tuple(images.size_of(data)) == size


def test_image_headers(spark, tmp_path):
    for name, data in (("a.png", PNG), ("b.jpg", JPEG), ("c.bin", b"zz")):
        (tmp_path / name).write_bytes(data)
    got = {r.file.rsplit("/", 1)[1]: (r.mime, r.width, r.height) for r in images.image_headers(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("image/png", 640, 480), "b.jpg": ("image/jpeg", 44, 33), "c.bin": ("application/octet-stream", None, None)}


def test_pivoted_report(spark):
    rows = [(2, "x", 70.0, 124, 0), (2, "y", 82.344, 40, 3), (5, "x", 71.5, 124, 0), (5, "z", 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "config int, dataset string, accuracy_pct double, n_valid long, n_error long")
    text = results.pivoted(df, ["config"], "dataset", {"y": "Y", "x": "X"}, results.accuracy_cell)
    assert text.splitlines() == ["| config | Y | X |", "|---|---|---|", "| 2 | 82.34 (n=40) | 70.00 |", "| 5 | - | 71.50 |"]
    with pytest.raises(ValueError, match="two cells"):
        results.pivoted(df.union(df), ["config"], "dataset", {"x": "X"}, results.accuracy_cell)
    with pytest.raises(ValueError, match="too many"):
        results.pivoted(df, ["config"], "dataset", {"x": "X"}, results.accuracy_cell, max_rows=1)


def test_delta_cells():
    assert results.delta_cell(Row(delta_pts=-0.0, ci_lo=-1.0, ci_hi=2.0)) == "+0.00 [-1.00, +2.00]"
    assert results.delta_cell(Row(delta_pts=-1.984, ci_lo=-2.86, ci_hi=-1.15)) == "-1.98 [-2.86, -1.15]*"
