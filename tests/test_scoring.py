"""Formats, result rows, run figures, paired differences of soft scores, and random streams."""

import numpy as np
import pytest
from evalloom.functions import scoring, stats
from evalloom.operators import latency, metrics, paired
from pyspark.sql import functions as F


def test_registry():
    scoring.check_registry()
    for bad in (scoring.Spec("none", "x", "y", 1), scoring.Spec("mcq", "short", "v1", 1), scoring.Spec("mcq", "legacy", "short", 1), scoring.Spec("mcq", "legacy", "v1", 0)):
        with pytest.raises(ValueError, match="odd"):
            scoring.check_registry({"odd": bad})
    assert scoring.dataset_names(" textvqa , scienceqa") == ["textvqa", "scienceqa"]
    for bad in ("textvqa,textvqa", "nothing"):
        with pytest.raises(ValueError):
            scoring.dataset_names(bad)


def records(spark):
    rows = [(0, "A", None, None, False), (1, "(b)", None, None, True), (2, None, "timeout", "Timeout", False), (3, None, "down", "ServerUnavailable", False), (4, "", None, None, None)]
    body = lambda r: None if r is None else '{"choices": [{"message": {"content": "%s"}, "finish_reason": "stop"}], "timings": {"predicted_per_second": 20}}' % r
    data = [(i, i, "q", ["x", "y"], "1", body(r), e, t, again, 9) for i, r, e, t, again in rows]
    return spark.createDataFrame(data, "idx int, rec_no int, question string, choices array<string>, answer string, response string, error string, error_type string, retried boolean, mem_avail_mb int")


def test_lines_and_figures(spark):
    lines = scoring.built_lines(records(spark), "scienceqa", "F16")
    got = {r.idx: r for r in lines.collect()}
    assert [(got[i].predicted, got[i].score, got[i].correct, got[i].gt_answer) for i in range(5)] == [("A", 0.0, False, "B"), ("B", 1.0, True, "B"), ("", None, None, "B"), ("", None, None, "B"), ("", 0.0, False, "B")]
    assert got[1].pred_parser_v1 == "(" and got[1].pred_parser_v2 == "B" and got[2].tok_s == 0.0 and got[0].tok_s == 20.0 and got[2].finish_reason is None
    m = metrics.run_figures(lines, "mcq", "dataset", target=F.lit(10)).first().asDict()
    assert m == {
        "dataset": "scienceqa", "metric": "accuracy", "target": 10, "total": 4, "pending": 6, "placeholders": 1, "complete": False, "status": "partial", "answered": 3, "errors": 1, "retries": 1, "unparsed": 1,
        "correct": 1, "score_sum": 1.0, "score_raw": 0.25, "score_answered": pytest.approx(1 / 3), "avg_tok_s": 20.0, "parser_disagreements": 1,
    }
    none = metrics.run_figures(lines.where("idx = 3"), "raw_only", "dataset").first()
    assert (none.status, none.score_raw, none.correct, none.avg_tok_s) == ("not attempted", None, None, 0.0)


def test_soft_lines(spark):
    answers = ["two"] * 2 + ["a dog's"] * 8
    df = spark.createDataFrame([(0, 0, "q", answers, '{"choices": [{"message": {"content": "Answer: 2."}}]}', None, None), (1, 1, "q", answers, '{"choices": [{"message": {"content": "The dog \'s"}}]}', "", None)], "idx int, rec_no int, question string, answers array<string>, response string, error string, error_type string")
    got = scoring.built_lines(df, "textvqa", "F16").orderBy("idx").collect()
    assert [(r.predicted, r.prediction_normalized, round(r.score, 6), r.correct, r.tok_s) for r in got] == [("2.", "2", 0.6, None, 0.0), ("The dog 's", "dog 's", 1.0, None, 0.0)]
    with pytest.raises(Exception, match="exactly 10"):
        scoring.built_lines(df.withColumn("answers", F.slice("answers", 1, 9)), "textvqa", "F16").collect()


def test_scores_of_old_and_new_rows(spark):
    rows = spark.createDataFrame([(1, 0.3, True), (2, None, True), (3, None, False)], "idx int, score double, correct boolean")
    assert [r[0] for r in rows.select(scoring.record_score()).collect()] == [0.3, 1.0, 0.0]
    with pytest.raises(Exception, match="neither score nor correct in record 4"):
        spark.createDataFrame([(4, None, None)], rows.schema).select(scoring.record_score()).collect()


def test_soft_differences(spark):
    pairs = spark.createDataFrame([("d", 0.9, 0.3), ("d", 0.0, 1.0), ("d", 0.6, 0.6), ("e", 1.0, 0.0), ("e", 1.0, 0.0), ("e", 0.0, 0.0)], "dataset string, base_score double, score double")
    d, e = paired.paired_delta(pairs, "dataset").orderBy("dataset").collect()
    assert (d.delta_pts, d.worse, d.better, d.p_mcnemar) == (pytest.approx(100 * 0.4 / 3, abs=1e-6), None, None, None)
    assert (round(e.delta_pts, 3), e.worse, e.better, e.p_mcnemar) == (-66.667, 2, 0, 0.5)


def test_intervals_by_resampling_rows(spark):
    rng = np.random.default_rng(1)
    diff = rng.choice([-0.6, 0.0, 0.3, 1.0], 400, p=[0.2, 0.5, 0.2, 0.1])
    pairs = spark.createDataFrame([("a", 0.0, float(x)) for x in diff] + [("b", 0.5, 0.5)] * 3, "k string, base_score double, score double")
    got = {r.k: (r.ci_lo, r.ci_hi) for r in stats.bootstrap_pairs(pairs, ["k"], reps=4000).collect()}
    means = np.array([diff[rng.integers(0, 400, 400)].mean() for _ in range(4000)])
    assert got["b"] == (0.0, 0.0) and np.allclose(got["a"], 100 * np.percentile(means, [2.5, 97.5]), atol=1.0)
    sorted_ = stats.bootstrap_pairs(pairs, ["k"], reps=400, order_statistics=True).where("k = 'a'").first()
    assert sorted_.ci_lo < 100 * diff.mean() < sorted_.ci_hi
    again = {r.k: (r.ci_lo, r.ci_hi) for r in stats.bootstrap_pairs(pairs, ["k"], reps=4000).collect()}
    assert again == got  # streams don't depend on the process


def test_guards(spark):
    rows = spark.createDataFrame([(1, "ServerUnavailable")], "idx int, error_type string")
    with pytest.raises(Exception, match="never tried: record 1"):
        paired.no_placeholders(rows).collect()
    with pytest.raises(Exception, match="can't swap record 5"):
        scoring.swapped(spark.createDataFrame([(5, ["x"], "(A)")], "idx int, choices array<string>, answer string")).collect()
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, 2], [2, 3]))
    assert sorted(map(tuple, paired.set_differences(a, b, "k").collect())) == [(1, "first"), (3, "second")]
    r = spark.createDataFrame([(200, None, "a"), (200, "", None), (500, None, "a"), (None, None, "a"), (200, "x", "a")], "http int, error string, reply string")
    assert [x[0] for x in r.select(latency.valid_request()).collect()] == [True, False, False, False, False]
    old, new = scoring.fingerprint({"a": 1, "b": None, "c": "x"}), scoring.fingerprint({"a": 2, "c": "x", "d": "y"})
    assert spark.range(1).select(scoring.fingerprint_diff(old, new)).first()[0] == ["a: 1 -> 2", "d: null -> y"]
    keys = spark.createDataFrame([("q", None, ["1", "2"]), ("q", "B", None)], "question string, gt_answer string, answers array<string>")
    assert [r[0].truth for r in keys.select(scoring.record_key()).collect()] == ['["1","2"]', "B"]


def test_drift_is_rounded_half_even(spark):
    rows = spark.createDataFrame([(1, i, i, 0.0 if i < 10 else 2.5) for i in range(20)] + [(2, i, i, 0.0 if i < 10 else 3.5) for i in range(20)] + [(3, 1, 1, 1.0)], "server_id int, us int, event_id int, m double")
    assert sorted(map(tuple, latency.drift(rows, "m").collect())) == [(1, 20, 2.0), (2, 20, 4.0)]
