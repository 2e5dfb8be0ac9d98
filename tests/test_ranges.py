"""Files read in ranges: lines over any split, headers, hashes with a cache, versions by pointer."""

import hashlib
import os
import random
import time

import pytest
from evalloom.sources import board, images, ranges, results, sinks
from pyspark.sql import functions as F

from tests.test_ranks import JPEG, PNG


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("end", ["", "\n"])
def test_lines_of_any_split(spark, tmp_path, split, end):
    rng = random.Random(split)
    files = {f"{k}.txt": "\n".join("é" * rng.randrange(4) + "x" * rng.randrange(9) + "\r" * (rng.random() < 0.3) for _ in range(12)) + end for k in "ab"} | {"c.txt": "", "d.txt": "one line" + end}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for r in ranges.numbered_lines(spark, str(tmp_path), split).orderBy("file", "at").collect():
        got.setdefault(os.path.basename(r.file), []).append((r.number, r.at, r.line, r.ended))
    for name, text in files.items():
        want, at = [], 0
        parts = text.encode().split(b"\n")
        for i, line in enumerate(parts):
            if i < len(parts) - 1 or line:
                want.append((i, at, line.decode().removesuffix("\r"), i < len(parts) - 1))
            at += len(line) + 1
        assert got.get(name, []) == want


def test_blocks_that_end_inside_a_line(spark, tmp_path, monkeypatch):
    reader = ranges.LineReader(str(tmp_path / "a.txt"), 10)
    (tmp_path / "a.txt").write_text("\n".join("y" * n for n in range(40)))
    monkeypatch.setattr(ranges, "CHUNK", 5)
    lines = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("line").to_pylist()]
    assert lines == ["y" * n for n in range(40)]
    with pytest.raises(FileNotFoundError):
        ranges.LineReader(str(tmp_path / "none"), 10).partitions()


def test_board_files_over_several_splits(spark, tmp_path):
    telemetry = "".join(f"01-02-2024 00:00:{i // 5:02d} RAM {i}/99MB SWAP 3/9MB\n" + "noise\n" * (i % 3) for i in range(50))
    (tmp_path / "t.log").write_text(telemetry)
    columns = ["t", "ram_mb", "swap_mb"]
    whole = board.board_samples(spark, str(tmp_path / "t.log")).select(columns).orderBy("t").collect()
    assert whole == board.board_samples(spark, str(tmp_path / "t.log"), split=100).select(columns).orderBy("t").collect()
    assert [r.ram_mb for r in whole] == list(range(50)) and len({r.t for r in whole}) == 50
    (tmp_path / "s.txt").write_text("== other\n F1 timed 1 2 3\n== tegrastats x\n" + "".join(f" F{i} timed 5 {i} 7\n" for i in range(60)) + "== end\n Q4 timed 1 2 3\n")
    assert sorted(r.ram_peak for r in board.strict_peaks(spark, str(tmp_path / "s.txt"), split=50).collect()) == list(range(60))


def test_torn_line_over_several_splits(spark, tmp_path):
    lines = [f'{{"idx": "{i}", "rec_no": {i}}}' for i in range(40)]
    path = str(tmp_path / "r.jsonl")
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + '\n{"idx": "x", "re')
    kept, dropped, rewrite = results.resume_state(spark, path, split=64)
    assert sorted(r.rec_no for r in kept.collect()) == list(range(40)) and dropped.count() == 0 and rewrite
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n\n")
    assert not results.resume_state(spark, path, split=64)[2]
    (tmp_path / "r.jsonl").write_text("\n".join([*lines[:20], "{", *lines[20:]]))
    with pytest.raises(Exception, match="bad line at byte"):
        results.read_resumable(spark, path, split=64).collect()


def test_headers_are_read_in_part(spark, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(ranges, "read_head", lambda path, size, f=ranges.read_head: read.append(size) or f(path, size))
    far = images.JPEG + (b"\xff\xe0\xff\xfe" + bytes(65_532)) * 2 + JPEG[2:]
    for name, data in (("a.png", PNG + bytes(10**6)), ("b.jpg", JPEG + bytes(10**6)), ("far.jpg", far), ("c.bin", bytes(10**6)), ("d.png", b"")):
        (tmp_path / name).write_bytes(data)
    found = {n: images.header_of(str(tmp_path / n))[1:] for n in ("a.png", "b.jpg", "far.jpg", "c.bin", "d.png")}
    assert found == {"a.png": (640, 480), "b.jpg": (44, 33), "far.jpg": (44, 33), "c.bin": (None, None), "d.png": (None, None)}
    assert read.count(ranges.HEADER) == 5 and len(read) == 7  # only the far one is read on
    got = {os.path.basename(r.file): (r.width, r.height, r.length) for r in images.image_headers(spark, str(tmp_path)).collect()}
    assert got == {n: (*size, (tmp_path / n).stat().st_size) for n, size in found.items()}


def test_hashes_and_their_cache(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    for n in range(5):
        (folder / f"{n}.bin").write_bytes(bytes([n]) * 10**n)
    want = lambda: {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in folder.iterdir()}
    read = lambda **how: {os.path.basename(r.file): r.sha256 for r in ranges.file_hashes(spark, str(folder), **how).collect()}
    assert read() == want() == read(cache=cache)
    hashed = lambda: spark.read.schema(ranges.HASHED).parquet(cache).count()
    assert hashed() == 5 and read(cache=cache) == want() and hashed() == 5  # nothing was read again
    time.sleep(0.01)
    (folder / "3.bin").write_bytes(b"new")
    assert read(cache=cache) == want() and hashed() == 6


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "create", "name", "after"])
def test_killed_writers_leave_old_or_new_rows(spark, tmp_path, monkeypatch, step):
    """Never neither, and the next writer goes on."""
    path = str(tmp_path / "out")
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "rec_no long")
    read = lambda: sorted(r.rec_no for r in spark.read.schema("rec_no long").json(sinks.current(spark, path)).collect())
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path)
    sinks.publish(spark, path, rows(1, 2).write.json)

    def dies(folder):
        rows(7).write.json(folder)
        if step == "write":
            raise Killed

    real = sinks._fs

    class Stream:
        def __init__(self, out):
            self.out = out

        def writeBytes(self, name):  # noqa: N802
            if step == "name":
                self.out.close()  # the file is there, and empty
                raise Killed
            self.out.writeBytes(name)

        def close(self):
            self.out.close()
            raise Killed

    class System:
        def __init__(self, fs):
            self.fs = fs

        def create(self, target, over):
            if step == "create":
                raise Killed
            return Stream(self.fs.create(target, over))

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(sinks, "_fs", lambda s, p: (System(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(Killed):
        sinks.publish(spark, path, dies)
    monkeypatch.setattr(sinks, "_fs", real)
    assert read() == ([7] if step == "after" else [1, 2])
    sinks.publish(spark, path, rows(3).write.json)
    assert read() == [3]
    sinks.prune(spark, path)
    assert read() == [3] and len(list((tmp_path / "out/versions").iterdir())) == 1


def test_frozen_prefix(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "rec_no")
    sinks.write_dataset(df, str(tmp_path / "set"), {"seed": 1}, first=4)
    folder = sinks.current(spark, str(tmp_path / "set"))
    assert spark.read.json(f"{folder}/manifest").first().asDict() == {"prefix_of": 10, "records": 4, "seed": 1}
    assert sorted(r.rec_no for r in spark.read.json(f"{folder}/data").collect()) == [0, 1, 2, 3]


def test_keyed_reads_what_is_wanted(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"rec_no": 1, "predicted": "a", "task": "x"}\n{"rec_no": 1, "predicted": "b", "task": "x"}\n{"rec_no": 2, "predicted": "c", "task": "y"}\n{"rec_no": 3, "error": "e", "task": "x"}\n')
    rows = results.keyed(spark, str(tmp_path / "r.jsonl"), columns=["predicted", "task"], where=F.col("task") == "x")
    assert rows.columns == ["rec_no", "predicted", "task"] and [tuple(r) for r in rows.collect()] == [(1, "b", "x")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "ReadSchema: struct<rec_no:bigint,task:string,predicted:string,error:string>" in scan and "EqualTo(task,x)" in scan
