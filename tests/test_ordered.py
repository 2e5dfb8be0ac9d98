"""Ordered folds over segments, ends of groups, runs paired by several baselines, accuracy from scores, spread bootstrap, pre-flight checks."""

import random

import numpy as np
import pytest
from evalloom.functions import stats, text
from evalloom.operators import latency, ordered, paired, preflight, ranks
from evalloom.sources import ranges, results
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def log(spark):
    """One server with nearly all rows, ties in time, nulls in the group and the order."""
    rng = random.Random(3)
    rows = [(1 if i % 9 else 2, rng.randrange(300), i, rng.random() < 0.8, float(rng.randrange(50)) if i % 5 else None) for i in range(2500)]
    rows += [(None, 5, 9001, True, 1.0), (None, 4, 9002, False, None), (3, None, 9003, True, 2.0)]
    return spark.createDataFrame(rows, "server_id int, us long, event_id long, valid boolean, wall_ms double").repartition(5), rows


def in_order(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for k, v in groups.items()}


@pytest.mark.parametrize("per", [60, 10**6])
def test_folds_equal_a_loop(log, per):
    df, rows = log
    folds = {"n": ordered.running(F.lit(1)), "ok": ordered.running(F.col("valid").cast("int")), "last": ordered.latest(F.when(F.col("event_id") % 40 == 0, F.col("event_id")))}
    out = ordered.folded(df, ["server_id"], latency.ORDER, folds, per)
    assert out.columns == [*df.columns, *folds]
    want = {}
    for group in in_order(rows).values():
        ok, last = 0, None
        for n, r in enumerate(group, 1):
            ok, last = ok + r[3], r[2] if r[2] % 40 == 0 else last
            want[r[2]] = (n, ok, last)
    assert {r.event_id: (r.n, r.ok, r["last"]) for r in out.collect()} == want


def test_no_task_holds_a_server(log):
    """Rows are dealt by server and segment, and a segment of the large server is small."""
    df, rows = log
    out = ordered.folded(df, ["server_id"], latency.ORDER, {"n": ordered.running(F.lit(1))}, 60)
    plan = out._jdf.queryExecution().executedPlan().toString()
    rows_windows = [line for line in plan.splitlines() if "Window" in line and "us#" in line]
    assert rows_windows and all("_segment" in line.rsplit("], [", 2)[1] for line in rows_windows)
    assert ordered.segmented(df, "us", 60).groupBy("server_id", "_segment").count().agg(F.max("count")).first()[0] <= 120


@pytest.mark.parametrize(("per", "every"), [(50, 20), (10**6, 20), (50, 0)])
def test_restart_counter_equals_a_loop(log, per, every):
    df, rows = log
    out = ordered.restart_counter(df, ["server_id"], latency.ORDER, F.col("event_id") % 31 == 0, ~F.col("valid"), every, per)
    want = {}
    for group in in_order(rows).values():
        since, block, deaths = 0, 0, 0
        for r in group:
            if since and (r[2] % 31 == 0 or 0 < every <= since):
                since, block, deaths = 0, block + 1, 0
            since, deaths = since + 1, deaths + (not r[3])
            want[r[2]] = (since, block, deaths)
    assert {r.event_id: (r.since_restart, r.block, r.restarts_in_block) for r in out.collect()} == want


def test_ends_are_cut_before_the_shuffle(log):
    df, rows = log
    found = ordered.ends(df, ["server_id"], latency.ORDER, 4)
    got = {}
    for r in found.collect():
        got.setdefault((r.server_id, r._end), set()).add(r.event_id)
    for k, group in in_order(rows).items():
        assert got[k, "first"] == {r[2] for r in group[:4]} and got[k, "last"] == {r[2] for r in group[-4:]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and plan.count("Partial") >= 2  # partial and final, at both ends
    drift = {r.server_id: (r.n, r.drift) for r in latency.drift(df, "wall_ms").collect()}
    group = [r[4] for r in in_order(rows)[1] if r[4] is not None]
    assert drift[1] == (len(group), np.median(group[-10:]) - np.median(group[:10])) and 3 not in drift


def test_pairs_of_runs(spark):
    rows = [(c, "d", i, "t", float((i * c) % 3 == 0), i % 2) for c in (2, 5, 9) for i in range(30) if (c, i) != (5, 3)]
    valid = spark.createDataFrame(rows, "config int, dataset string, idx int, task string, score double, predicted int")
    wanted = [(2, 5), (5, 9), (9, 2), (2, 77)]
    got = {(r.baseline, r.other, r.idx): (r.base_score, r.score, r.task) for r in paired.pairs_of_runs(valid, wanted).collect()}
    score = {(c, i): s for c, _, i, _, s, _ in rows}
    assert got == {(a, b, i): (score[a, i], score[b, i], "t") for a, b in wanted for i in range(30) if (a, i) in score and (b, i) in score}
    plan = paired.pairs_of_runs(valid, wanted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_accuracy_reads_scores(spark, tmp_path):
    (tmp_path / "config2_F16__textvqa.jsonl").write_text('{"idx": 1, "score": 0.6, "predicted": "a", "answers": ["b"]}\n{"idx": 2, "score": 1.0, "predicted": "b", "answers": ["b"]}\n{"idx": 3, "error": "timeout"}\n')
    rows = results.load_results(spark, str(tmp_path))
    assert tuple(paired.accuracy(rows, "config").first()) == (2, 80.0, 2, 1)
    m = paired.run_metrics(rows, "config").first()
    assert (m.attempted, m.answered, m.errors, m.score_sum, m.score_raw, m.score_answered) == (3, 2, 1, 1.6, 0.533333, 0.8)


def test_line_ends_and_commas(spark):
    ls, nel = chr(0x2028), chr(0x85)
    rows = [("B\rbecause", "B"), ("b\x0bno", "B"), (f"C{ls}x", "C"), (f"A{nel}x", "A"), ("D\r\n\r\nso", "D"), ("B because", "")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", text.parse_letter_v2(F.col("t"), F.lit(4)).alias("got")).collect())
    short = spark.createDataFrame([("cat\rdog", "cat"), (f"{ls} \x0c Answer: a  b{nel}c", "a b")], "t string, want string")
    assert all(r.got == r.want for r in short.select("want", text.parse_short(F.col("t")).alias("got")).collect())
    marks = spark.createDataFrame([("1,,2", "12"), ("1,2", "12"), ("a,b", "a b")], "t string, want string")
    assert all(r.got == r.want for r in marks.select("want", text.no_punctuation(F.col("t")).alias("got")).collect())


def test_bootstrap_spread_over_tasks(spark):
    """All differences differ: the interval is that of one draw over all, within its error; no group holds a cell."""
    n, reps = 200_000, 400
    df = spark.range(n).select((F.col("id") % 2).cast("int").alias("config"), ((F.hash("id") % 1000) / 1000.0 + F.col("id") * 1e-9).alias("diff"), F.lit(1).cast("long").alias("n"))
    run = lambda x: {r.config: r for r in stats.bootstrap_counts(x, ["config"], reps=reps, most=10_000).select("config", F.round("ci_lo", 9).alias("ci_lo"), F.round("ci_hi", 9).alias("ci_hi")).collect()}
    got = run(df)
    assert got == run(df.repartition(7))
    for c in (0, 1):
        d = 100 * np.array([r.diff for r in df.where(F.col("config") == c).select("diff").collect()])
        error = d.std() / np.sqrt(len(d))
        assert abs(got[c].ci_lo - (d.mean() - 1.96 * error)) < 0.35 * error and abs(got[c].ci_hi - (d.mean() + 1.96 * error)) < 0.35 * error
    means = stats.spread_replicates(df.withColumn("_values", F.lit(n // 2)), ["config"], 20, 1, 10_000)
    assert means.groupBy("config").agg(F.count("*").alias("n"), F.count_distinct("rep").alias("r")).where("n = 20 and r = 20").count() == 2
    mixed = df.where("config = 0").union(spark.createDataFrame([(1, -1.0, 3), (1, 1.0, 5)], "config int, diff double, n long"))
    alone = run(spark.createDataFrame([(1, -1.0, 3), (1, 1.0, 5)], "config int, diff double, n long"))
    assert run(mixed) == {0: got[0], 1: alone[1]}


def test_folder_of_images(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for name, data in (("a.png", b"x"), ("b.png", b"")):
        (tmp_path / "images" / name).write_bytes(data)
    there = str(tmp_path / "images/a.png")
    rows = [(0, "1", ["images/a.png"], "A", ["x", "y"]), (1, "2", ["images/a.png", "images/b.png"], "C", ["x", "y"]), (2, "2", ["images/c.png"], "B", ["x", "y"]), (3, "3", [there, "/no/such.png"], None, None), (4, None, None, "A", []), (5, "5", [], "A", ["x"])]
    records = spark.createDataFrame(rows, "rec_no long, idx string, image_paths array<string>, answer string, choices array<string>")
    files = ranges.listing(spark, str(tmp_path))
    problems = preflight.image_problems(records, files, str(tmp_path), need_images=True)
    assert problems.columns == list(preflight.PROBLEM)
    name = lambda p: p and p.rsplit("/", 1)[1]
    got = sorted((r.severity, r.problem, r.rec_no, name(r.path)) for r in problems.collect())
    want = [("error", "empty image", 1, "b.png"), ("error", "ground truth outside the choices", 1, None), ("error", "missing image", 2, "c.png"), ("error", "missing image", 3, "such.png"), ("error", "no images", 4, None), ("error", "no images", 5, None), ("error", "repeated idx", 1, None), ("error", "repeated idx", 2, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    legacy = preflight.image_problems(records, files, str(tmp_path), strict=False, absolute=False)
    assert sorted((r.severity, r.problem, r.n, r.records, r.first) for r in preflight.summary(legacy).collect()) == [("error", "empty image", 1, 1, [1]), ("error", "missing image", 1, 1, [2]), ("warning", "ground truth outside the choices", 1, 1, [1]), ("warning", "repeated idx", 2, 2, [1, 2])]


def test_exclusion_with_error_files(spark):
    rows = [(c, "d", i, "x" if (c, i) in {(2, 1), (5, 1), (5, 2)} else None) for c in (2, 5) for i in range(6)] + [(2, "e", 1, None), (5, "e", 1, None)]
    df = spark.createDataFrame(rows, "config int, dataset string, idx int, error string")
    named = spark.createDataFrame([("d", 2), ("d", 4), ("d", 99)], "dataset string, idx int")
    got = {r.dataset: r for r in paired.accounting(df, named).collect()}
    assert tuple(got["d"])[1:] == (6, 3, 3, 2, 1, {2: 1, 5: 2}) and tuple(got["e"])[1:] == (1, 0, 1, 0, 0, {2: 0, 5: 0})
    assert sorted({(r.dataset, r.idx) for r in paired.matched(df, named).collect()}) == [("d", 0), ("d", 3), ("d", 5), ("e", 1)]
    status = {(r.dataset, r.config): (r.n_errors, r.only_here, r.only_first, r.status) for r in paired.error_sets(df, strict=("e",)).collect()}
    assert status == {("d", 2): (1, 0, 0, "ok"), ("d", 5): (2, 1, 0, "warning"), ("e", 2): (0, 0, 0, "ok"), ("e", 5): (0, 0, 0, "ok")}
    with pytest.raises(Exception, match="differ between runs of d in config 5"):
        paired.error_sets(df, strict=("d",)).collect()
    assert paired.error_sets(df, strict=("d",), allow=True).where("status = 'warning'").count() == 1


def test_latency_points_and_settings(spark, tmp_path):
    from evalloom.functions import scoring
    from evalloom.sources import board

    (tmp_path / "latency_summary.csv").write_text("config,dataset,wall_med,wall_p95,valid\nF16,textvqa,1.5,2.5,7\nF16,scienceqa,9,9,9\nQ4,textvqa,1.25,2,7\n")
    (tmp_path / "summary.txt").write_text("== tegrastats\n F16 timed 5 6 7\n Q4 timed 5 8 7\n")
    assert sorted(map(tuple, board.latency_points(spark, str(tmp_path)).collect())) == [("F16", 1.5, 6), ("Q4", 1.25, 8)]
    (tmp_path / "summary.txt").write_text("== tegrastats\n F16 timed 5 6 7\n")
    with pytest.raises(Exception, match="no memory peak of config Q4"):
        board.latency_points(spark, str(tmp_path)).collect()
    limits = {"protocol_version": "2", "temperature": 0, "ctx_size": 4096, "n_gpu_layers": 99}
    config = {"num": 2, "short": "F16", "mmproj": "m", "model": "x"}
    old = scoring.run_settings(config, "cv_bench", scoring.DATASETS["cv_bench"], "aa", None, {"m": "h"}, limits)
    assert len(old) == 18 and (old["mmproj_sha256"], old["model_sha256"], old["max_tokens"]) == ("h", None, 16)
    new = old | {"data_sha256": "bb", "model_sha256": "z"}
    assert spark.range(1).select(scoring.fingerprint_diff(scoring.fingerprint(old), scoring.fingerprint(new)).alias("d")).first().d == ["data_sha256: aa -> bb", "model_sha256: null -> z"]


@pytest.mark.parametrize("per", [20, 10**6])
def test_phase_intervals_equal_a_loop(spark, per, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS", per)
    rng = random.Random(7)
    rows = [(rng.choice("ab") if i % 3 else None, rng.randrange(400), rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, us long, opens boolean").repartition(4)
    want = []
    for key in ("a", "b", None):
        own = sorted((us, opens) for k, us, opens in rows if k == key)
        for (us, opens), following in zip(own, [*own[1:], None], strict=True):
            if opens:
                in_time = following is not None and following[0] <= us + 5
                want.append((key, us, following[0] if in_time else us + 5, in_time and not following[1]))
    got = [tuple(r) for r in latency.phase_intervals(df, ["key"], F.col("opens"), 5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
