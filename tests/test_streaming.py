"""Streams with state against batch folds: records once, restart counters, phases and their samples."""

import json
from itertools import count

import pytest
from evalloom.operators import latency, ordered
from evalloom.streaming import logs, stateful
from pyspark.sql import functions as F

NUMBER = count()


class Log:
    """A folder of JSON lines that grows, and a query over it that writes what it gives."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.schema, self.build = spark, folder, schema, build
        (folder / "in").mkdir(parents=True)

    def put(self, *rows, name=None):
        (self.folder / "in" / (name or f"{next(NUMBER):04d}.jsonl")).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def source(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))

    def run(self):
        """All that is there; the next run goes on from the checkpoint."""
        query = self.build(self).writeStream.format("json").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        return self

    def rows(self, schema):
        return self.spark.read.schema(schema).json(str(self.folder / "out"))


def test_resumed_keeps_late_and_unnumbered_records(spark, tmp_path):
    schema = "idx string, rec_no long, dataset string, config string, error string, error_type string, t double"
    log = Log(spark, tmp_path, schema, lambda x: logs.resumed(spark, str(x.folder / "in"), schema))
    log.put({"idx": "a", "rec_no": 1, "t": 1e6, "dataset": "d", "config": "2"}, {"idx": "x", "t": 1e6}, {"idx": "y"}, {"idx": "z"}, name="a.jsonl")
    log.run()
    log.put({"idx": "b", "rec_no": 2, "t": 5e5, "dataset": "d", "config": "2"}, {"idx": "a", "rec_no": 1, "t": 1e6, "dataset": "d", "config": "2"}, {"idx": "c", "rec_no": 1, "dataset": "e", "config": "2"}, {"idx": "d", "rec_no": 1}, name="b.jsonl")
    log.put({"idx": "e", "rec_no": 1}, {"idx": "f", "rec_no": 9, "error": "x", "error_type": "ServerUnavailable"}, name="c.jsonl")
    log.run()
    assert sorted(r.idx for r in log.rows(schema).collect()) == ["a", "b", "c", "d", "e", "x", "y", "z"]


def restart_log(spark, folder):
    rows = [{"server": f"s{i % 3}", "t": float(i), "event_id": i, "k": i % 17, "valid": i % 11 != 4} for i in range(400)]
    schema = "server string, t double, event_id long, k int, valid boolean"
    reset, dead = F.col("k") == 7, ~F.col("valid")
    log = Log(spark, folder, schema, lambda x: stateful.restart_counter(x.source(), ["server"], "t", "event_id", reset, dead, 20))
    batch = ordered.restart_counter(spark.createDataFrame(rows, schema), ["server"], ["t", "event_id"], reset, dead, 20, per=70)
    return log, rows, schema + ", since_restart long, block long, restarts_in_block long, late boolean", batch


def test_restart_counter_and_rows_that_come_too_late(spark, tmp_path):
    """A row behind a later one of its server is told apart and changes nothing, after a restart from the checkpoint too."""
    log, rows, schema, batch = restart_log(spark, tmp_path)
    log.put(*reversed(rows[:200]))
    log.run()
    log.put({"server": "s1", "t": 3.5, "event_id": 1000, "k": 7, "valid": False}, *rows[200:])
    log.run()
    got, columns = log.rows(schema), ["event_id", "since_restart", "block", "restarts_in_block"]
    assert [(r.event_id, r.since_restart) for r in got.where("late").collect()] == [(1000, None)]
    assert sorted(got.where("not late").select(columns).collect()) == sorted(batch.select(columns).collect())


def test_restart_counter_equals_batch_without_late_rows(spark, tmp_path):
    log, rows, schema, batch = restart_log(spark, tmp_path)
    for start in (0, 130, 131, 300):
        log.put(*rows[start : {0: 130, 130: 131, 131: 300, 300: 400}[start]])
        log.run()
    columns = ["server", "event_id", "since_restart", "block", "restarts_in_block"]
    assert sorted(log.rows(schema).select(columns).collect()) == sorted(batch.select(columns).collect())


EVENTS = "board string, phase string, kind string, at timestamp"
SAMPLES = "board string, at timestamp, ram long"


def stamp(second: float) -> str:
    return f"2024-01-01T{int(second) // 3600:02d}:{int(second) // 60 % 60:02d}:{second % 60:06.3f}Z"


@pytest.fixture
def board(spark, tmp_path):
    events = Log(spark, tmp_path / "events", EVENTS, None)
    samples = Log(spark, tmp_path / "samples", SAMPLES, None)

    def joined(_):
        found = stateful.phases(events.source(), "board", "phase", "at", F.col("kind") == "open", 600, "10 seconds")
        return stateful.samples_in_phases(found, samples.source().withColumnsRenamed({"at": "sample_at"}), "board", "sample_at", 600, "10 seconds").select("board", "phase", "t0", "t1", "closed", "sample_at", "ram")

    samples.schema = SAMPLES
    both = Log(spark, tmp_path / "joined", EVENTS, joined)
    return events, samples, both


def test_live_join_equals_batch_interval_join(spark, board):
    """Phases from their open and close events meet the samples in them, over batches; one is never closed, one is opened twice, one sample is too late."""
    events, samples, both = board
    event = lambda second, kind, phase="load", name="b1": {"board": name, "phase": phase, "kind": kind, "at": stamp(second)}
    sample = lambda second, name="b1": {"board": name, "at": stamp(second), "ram": int(second)}
    events.put(event(10, "open"), event(40, "close"), event(45, "open", "timed"), event(20, "open", name="b2"))
    samples.put(*(sample(s) for s in range(0, 50, 4)), *(sample(s, "b2") for s in range(0, 50, 4)))
    samples.schema = SAMPLES
    both.run()
    events.put(event(100, "close", "timed"), event(110, "open"), event(130, "open"), event(160, "close"), event(170, "close", "never opened"))
    samples.put(*(sample(s) for s in range(50, 200, 4)))
    both.run()
    events.put(event(2000, "open"), event(2010, "close"), event(2000, "open", name="b2"), event(2010, "close", name="b2"))  # far ahead: ends what is still open
    samples.put(sample(2005), sample(2005, "b2"))
    both.run()
    events.put(event(4000, "open"))
    samples.put(sample(4000), sample(30), sample(35))  # behind the watermark
    both.run()
    both.run()
    got = {(r.board, r.phase, r.t0.timestamp() % 86400, r.t1.timestamp() % 86400, r.closed, r.ram) for r in both.rows("board string, phase string, t0 timestamp, t1 timestamp, closed boolean, sample_at timestamp, ram long").collect()}
    want = [("b1", "load", 10, 40, True), ("b1", "timed", 45, 100, True), ("b1", "load", 110, 130, False), ("b1", "load", 130, 160, True), ("b1", "load", 2000, 2010, True), ("b2", "load", 20, 620, False), ("b2", "load", 2000, 2010, True)]
    told = [(b, s) for b in ("b1", "b2") for s in [*range(0, 50, 4), *(range(50, 200, 4) if b == "b1" else []), 2005]]
    intervals = spark.createDataFrame([(*w[:2], int(w[2] * 1e6), int(w[3] * 1e6), w[4]) for w in want], "board string, phase string, t0 long, t1 long, closed boolean")
    batch = latency.samples_in_intervals(intervals, spark.createDataFrame([(b, int(s * 1e6)) for b, s in told], "board_ string, us long"), 60_000_000).where("board = board_")
    assert got == {(r.board, r.phase, r.t0 / 1e6, r.t1 / 1e6, r.closed, r.us // 1_000_000) for r in batch.collect()}
