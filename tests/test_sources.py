"""Board logs, summaries, hash listings, error files, sinks and answer similarity."""

import pytest
from evalloom.functions.similarity import answer_category, similarity
from evalloom.sources import board, results, sinks
from pyspark.sql import functions as F


def test_board_samples(spark, tmp_path):
    (tmp_path / "t.log").write_text("01-02-2024 00:00:01 RAM 10/99MB SWAP 3/9MB\nnoise\n01-02-2024 00:00:01 RAM 12/99MB\n01-02-2024 00:00:02 no memory\n")
    got = board.board_samples(spark, str(tmp_path / "t.log")).orderBy("t").drop("file").collect()
    assert [tuple(r) for r in got] == [(1704153601.0, 10, 3), (1704153601.5, 12, 0)]
    east = board.board_samples(spark, str(tmp_path / "t.log"), "Europe/Berlin").agg(F.min("t")).first()[0]
    assert east == 1704153601.0 - 3600


def test_summaries(spark, tmp_path):
    (tmp_path / "s.txt").write_text("== other\n F16 timed 1 2 3\n== tegrastats x\n F16 timed 5 6 7\n F16 idle 5 6 7\n== end\n Q4 timed 1 2 3\n")
    assert [tuple(r)[1:] for r in board.strict_peaks(spark, str(tmp_path / "s.txt")).collect()] == [("F16", 6)]
    for d, config in (("a", "F16"), ("b", "Q4"), ("c", "F16")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "l.csv").write_text(f"config,dataset,wall_med,wall_p95,valid\n{config},vqa,1.5,2.5,7\n")
    got = board.latency_tables(spark, [str(tmp_path / x) for x in "ab"]).orderBy("config").drop("file").collect()
    assert [tuple(r) for r in got] == [("F16", "vqa", 1.5, 2.5, 7), ("Q4", "vqa", 1.5, 2.5, 7)]
    with pytest.raises(ValueError, match="F16"):
        board.latency_tables(spark, [str(tmp_path / x) for x in "ac"])


def test_listings_and_error_files(spark, tmp_path):
    (tmp_path / "h.txt").write_text("aa  x/y.bin\nbad\n")
    assert board.hash_listing(spark, str(tmp_path / "h.txt")).collect() == [("y.bin", "aa")]
    (tmp_path / "p.jsonl").write_text('{"idx": "1"}\n{"idx": "1"}\n')
    assert board.error_list(spark, str(tmp_path / "p.jsonl")).collect() == [("1",)]
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "idx string, predicted string")
    bad = spark.createDataFrame([("1", "timeout")], "idx string, error string")
    assert sorted(map(str, board.with_error_file(rows, bad).select("idx", "predicted", "error").collect())) == ["Row(idx='1', predicted=None, error='timeout')", "Row(idx='2', predicted='b', error=None)"]
    (tmp_path / "d.json").write_text("{")
    assert board.tolerant_document(spark, str(tmp_path / "d.json"), "a int").collect() == [(None,)]


def test_sinks(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.createDataFrame([(1, "a"), (2, "b")], "rec_no long, x string")
    sinks.write_run(df, path)
    with pytest.raises(FileExistsError):
        sinks.write_run(df, path)
    sinks.write_run(spark.createDataFrame([(2, "c"), (3, "d")], df.schema), path, "resume")
    read = lambda: sorted(map(tuple, spark.read.schema(df.schema).json(path).collect()))
    assert read() == [(1, "a"), (2, "b"), (3, "d")]
    assert sinks.replace(spark.read.schema(df.schema).json(path).where("rec_no > 1"), path) is None
    assert read() == [(2, "b"), (3, "d")]
    sinks.write_run(df, path, "overwrite")
    assert read() == [(1, "a"), (2, "b")] and len(list(tmp_path.glob("out.bak-*"))) == 1
    sinks.write_provenance(spark, str(tmp_path / "prov"), {"seed": 1}, results.file_hashes(spark, path + "/part-*"))
    assert spark.read.json(sinks.current(spark, str(tmp_path / "prov"))).first().settings == '{"seed": 1}'


def test_similarity(spark):
    rows = spark.createDataFrame([("stop", "stpo"), ("12", "19"), ("new york", "york"), ("abc", "xyz"), (None, "a"), ("a", "a")], "a string, b string")
    got = rows.select(F.round(similarity("a", "b"), 3).alias("s"), answer_category(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.s for r in got][:1] == [0.75] and [r.c for r in got] == ["misread", "number", "extent", "different", "different", "different"]


def test_discovery_refuses_two_files_of_a_run(spark, tmp_path):
    for d in ("a", "old"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "config2_F16__textvqa.jsonl").write_text("{}\n")
    assert [r.config for r in results.discover(spark, str(tmp_path), ("old",)).collect()] == ["2"]
    with pytest.raises(Exception, match="two files"):
        results.discover(spark, str(tmp_path)).collect()


def test_results_of_many_files(spark, tmp_path):
    put = lambda name, *lines: (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    put("config2_F16__Text-VQA.jsonl", '{"idx": 1, "score": 0.3, "predicted": "a", "question": "q", "answers": ["x"]}', '{"idx": 2, "error": "timeout"}')
    put("config8_Q4__Text-VQA.jsonl", '{"idx": "1", "correct": true}')
    put("config8_Q4__Text-VQA_poison.jsonl", '{"idx": "2"}')
    rows = {(r.config, r.idx): r for r in results.load_results(spark, str(tmp_path)).collect()}
    assert set(rows) == {(2, "1"), (2, "2"), (8, "1")} and {r.dataset for r in rows.values()} == {"Text-VQA"}
    assert (rows[2, "1"].score, rows[2, "2"].score, rows[8, "1"].score, rows[2, "2"].error) == (0.3, None, 1.0, "timeout")
    assert results.only_file(spark, str(tmp_path), "config2_*.jsonl").endswith("config2_F16__Text-VQA.jsonl")
    with pytest.raises(ValueError, match="exactly one"):
        results.only_file(spark, str(tmp_path), "config8_*.jsonl")
    put("config8_Q4__Text-VQA.jsonl", '{"idx": "1", "correct": true}', '{"idx": "1", "correct": true}')
    with pytest.raises(ValueError, match="twice"):
        results.load_results(spark, str(tmp_path))
    put("config8_Q4__Text-VQA.jsonl", '{"idx": "3", "error": "x", "error_type": "ServerUnavailable"}')
    with pytest.raises(Exception, match="never tried"):
        results.load_results(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        results.load_results(spark, str(tmp_path), exclude=(tmp_path.name,))


def test_strict_rows_and_resume(spark, tmp_path):
    put = lambda *lines: (tmp_path / "r.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "r.jsonl")
    put('{"idx": 1}', '{"idx": 2}')
    assert results.read_strict(spark, path).count() == 2  # rows of older files have no rec_no
    put('{"idx": 1, "rec_no": 0}', "{", '{"idx": 2, "rec_no": 1}', "")
    with pytest.raises(Exception, match="r.jsonl"):
        results.read_strict(spark, path).collect()
    lines = ['{"idx": 7, "rec_no": 0}', '{"idx": 8, "rec_no": 1, "error": "timeout"}', '{"idx": 9, "rec_no": 2, "error": "x", "error_type": "ServerUnavailable"}']
    put(*lines, '{"idx": 1, "re')
    kept, dropped, rewrite = results.resume_state(spark, path)
    assert [r.rec_no for r in kept.orderBy("rec_no").collect()] == [0, 1] and [r.rec_no for r in dropped.collect()] == [2] and rewrite
    assert results.resume_state(spark, path, retry_errors=True)[0].count() == 1
    put(lines[0], lines[1], "")
    kept, dropped, rewrite = results.resume_state(spark, path)
    assert dropped.count() == 0 and not rewrite
    put(lines[0], lines[1])
    assert results.resume_state(spark, path)[2]  # the last line has no end
    put(lines[0], lines[0], "")
    with pytest.raises(ValueError, match="rec_no"):
        results.resume_state(spark, path)
    put(lines[0], lines[1], "")  # kept reads the file when it is used
    records = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "rec_no long, idx int")
    assert [r.rec_no for r in results.todo(records, kept).collect()] == [2]
    with pytest.raises(Exception, match="record 1"):
        results.todo(records.where("rec_no <> 1").unionByName(spark.createDataFrame([(1, 99)], records.schema)), kept).collect()


def test_keyed_rows_tasks_and_logs(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"rec_no": 1, "predicted": "a", "task": "Count", "gt_answer": "B"}\n{"rec_no": 1, "predicted": "b"}\n{"rec_no": 2, "error": "x", "predicted": ""}\n')
    path = str(tmp_path / "r.jsonl")
    assert [(r.rec_no, r.predicted) for r in results.keyed(spark, path).collect()] == [(1, "b")]
    assert results.tasks(spark, path).columns == ["idx", "task", "predicted", "gt"] and results.tasks(spark, path).count() == 3
    (tmp_path / "q.jsonl").write_text('{"config": 2, "wall_ms": 5.5, "http": 200, "reply": "B"}\n')
    (tmp_path / "e.jsonl").write_text('{"event": "round_order", "order": [2, 5], "t": 1.5}\n{"event": "interval", "config": "T8", "t0": 1, "t1": 2.5}\n')
    assert results.request_log(spark, str(tmp_path / "q.jsonl")).first().config == "2"
    e = results.event_log(spark, str(tmp_path / "e.jsonl")).collect()
    assert e[0]["order"] == ["2", "5"] and (e[1].config, e[1].t0) == ("T8", 1.0)
    n = results.numbered(spark.range(0, 3000, 3).where("id % 7 <> 1"), "id", parts=9).orderBy("id").collect()
    assert [r.idx for r in n] == list(range(len(n)))
    assert results.hash_of(spark, path) == results.file_hashes(spark, path).first().sha256


def test_recovery_and_other_sinks(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.createDataFrame([(1, "a")], "rec_no long, x string")
    sinks.write_run(df, path)
    (tmp_path / "out").rename(tmp_path / "out.bak-1")
    df.select((F.col("rec_no") + 1).alias("rec_no"), "x").write.json(f"{path}.new-1")  # replace() died between its renames
    assert sinks.recover(spark, path) and not sinks.recover(spark, path)
    assert spark.read.schema(df.schema).json(path).collect() == [(2, "a")]
    with pytest.raises(Exception, match="can't be resumed"):
        sinks.write_run(spark.createDataFrame([(None, "z")], df.schema), path, "resume")
    sinks.write_run(df, path, "smoke")
    assert spark.read.schema(df.schema).json(str(tmp_path / "smoke/out")).collect() == [(1, "a")]
    figures = spark.createDataFrame([("b", 1, 0.5), ("a", 2, None)], "dataset string, n int, s double")
    sinks.write_summary(spark, str(tmp_path / "sum"), {"config": 2}, figures)
    doc = spark.read.json(sinks.current(spark, str(tmp_path / "sum"))).first()
    assert doc.config == 2 and doc.datasets.b.s == 0.5 and doc.datasets.a.n == 2
    sinks.write_dataset(df, str(tmp_path / "set"), {"seed": 249})
    assert spark.read.json(sinks.current(spark, str(tmp_path / "set")) + "/manifest").first().asDict() == {"records": 1, "seed": 249}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_dataset(df, str(tmp_path / "set"), {})


def test_streams(spark, tmp_path):
    from evalloom.streaming import logs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"rec_no": 1, "t": 100.0, "dataset": "d", "config": "2"}\n{"rec_no": 2, "error": "x", "t": 101, "dataset": "d", "config": "2"}\n{"rec_no": 1, "t": 102, "dataset": "d", "config": "2"}\n')
    run = lambda: sinks.log_stream(logs.resumed(spark, str(tmp_path / "in"), results.RESULT, retry_errors=True), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    (tmp_path / "in/b.jsonl").write_text('{"rec_no": 1, "t": 103, "dataset": "d", "config": "2"}\n{"rec_no": 2, "t": 104, "dataset": "d", "config": "2"}\n')
    run()
    assert sorted(r.rec_no for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]
    logs.may_resume({"a": 1, "b": None}, {"a": 1})
    with pytest.raises(ValueError, match="a: 1 -> 2"):
        logs.may_resume({"a": 1}, {"a": 2})
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.json").write_text('{"t": "2024-01-01T00:10:00Z", "server_id": 1, "wall_ms": 5.0}\n{"t": "2024-01-01T00:50:00Z", "server_id": 1, "wall_ms": 7.0}\n{"t": "2024-01-01T03:00:00Z", "server_id": 1, "wall_ms": 1.0}\n')
    live = spark.readStream.schema("t timestamp, server_id int, wall_ms double").json(str(tmp_path / "w"))
    q = logs.request_windows(live, "t").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "wcp")).start()
    q.awaitTermination(120)
    assert [(r.n, r.peak_ms) for r in spark.table("windows").collect()] == [(2, 7.0)]  # the open window waits for the watermark
