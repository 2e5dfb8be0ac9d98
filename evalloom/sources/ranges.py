"""Files read in ranges by the executors: lines with their places, headers, hashes of any size.

Paths are opened through pyarrow's file systems (local, HDFS, S3, GCS), and only the bytes that are needed are read. Listings hold no contents;
unlike Spark's readers they hold empty files.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evalloom.operators import ordered

#: Bytes of a split of lines, of one read, and of an image's header that is looked at first.
SPLIT, CHUNK, HEADER = 64 << 20, 1 << 20, 1 << 10
LINES = "file string, at long, line string, ended boolean"


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (file:/x, hdfs://h/x, /x)."""
    if ":" not in path.split("/", 1)[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class Folder(InputPartition):
    """Files known by now, or a folder that a task lists."""

    def __init__(self, name: str, files: list[tuple] | None = None):
        self.name, self.files = name, files


class ListingReader(DataSourceReader):
    """The driver lists one level; each folder below it is a task's."""

    def __init__(self, paths: list[str], glob: str):
        self.paths, self.glob = paths, glob

    def kept(self, x: fs.FileInfo) -> bool:
        return x.is_file and x.base_name[0] not in "._" and fnmatch(x.base_name, self.glob)

    def partitions(self) -> list[Folder]:
        out, found = [], []
        for path in self.paths:
            folder, _, last = path.rstrip("/").rpartition("/")
            wild = any(c in last for c in "*?[")
            system, place = place_of(folder if wild else path)
            info = system.get_file_info(place)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            root = folder if wild or info.is_file else path.rstrip("/")
            here = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(place)) if not wild or fnmatch(x.base_name, last)]
            found += [row_of(root, x) for x in here if self.kept(x)]
            out += [Folder(f"{root}/{x.base_name}") for x in here if not x.is_file and x.base_name[0] not in "._"]
        return [Folder("", found), *out]

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        rows = part.files
        if rows is None:
            system, place = place_of(part.name)
            every = system.get_file_info(fs.FileSelector(place, recursive=True))
            rows = [row_of(part.name + x.path.removeprefix(place)[: -len(x.base_name) - 1], x) for x in every if self.kept(x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.timestamp("us", "UTC")), strict=True)], ["file", "length", "modified"])


def row_of(folder: str, x: fs.FileInfo) -> tuple:
    return f"{folder}/{x.base_name}", x.size, x.mtime


class ListingSource(DataSource):
    """Format `file_listing`: (file, length, modified) of files, empty ones too; contents are not read."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "file string, length long, modified timestamp"

    def reader(self, schema) -> ListingReader:
        return ListingReader(json.loads(self.options["paths"]), self.options.get("glob", "*"))


def listing(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(file, length, modified) of a file, of the files below folders, or of those whose names fit a pattern at a path's end; names that begin with a
    point or an underscore are left out."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("file_listing").option("paths", json.dumps([path] if isinstance(path, str) else list(path))).option("glob", glob).load()


class Split(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class LineReader(DataSourceReader):
    """A split owns the lines that begin in it, and reads on to the end of the last one."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        system, place = place_of(self.path)
        root = self.path.removesuffix("/")
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [(self.path, info.size)] if info.is_file else [(f"{root}/{x.base_name}", x.size) for x in system.get_file_info(fs.FileSelector(place)) if x.is_file and x.base_name[0] not in "._"]
        return [Split(f, i, min(i + self.split, n)) for f, n in sorted(files) for i in range(0, n, self.split)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, place = place_of(split.file)
        with system.open_input_file(place) as file:
            size, at, rest = file.size(), split.start, b""
            if at:  # the line that the byte before belongs to is the earlier split's
                file.seek(at - 1)
                at -= 1
                while chunk := file.read(CHUNK):
                    if (end := chunk.find(b"\n")) >= 0:
                        rest, at = chunk[end + 1 :], at + end + 1
                        break
                    at += len(chunk)
                else:
                    return
            while at < split.stop:
                chunk = file.read(CHUNK)
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop()
                if not chunk and rest:
                    lines, rest = [*lines, rest], b""
                rows = []
                for line in lines:
                    if at >= split.stop:
                        break
                    ended = at + len(line) < size
                    rows.append((at, line.removesuffix(b"\r").decode("utf-8", "replace"), ended))
                    at += len(line) + 1
                if rows:
                    places, texts, ends = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([split.file] * len(rows)), pa.array(places, pa.int64()), pa.array(texts), pa.array(ends)], ["file", "at", "line", "ended"])
                if not chunk:
                    return


class LineSource(DataSource):
    """Format `placed_lines`: (file, at, line, ended) of a file or of those in a folder; at: the byte that a line begins at, ended: whether
    a line's end stands behind it. Option split: bytes of a split."""

    @classmethod
    def name(cls) -> str:
        return "placed_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("split", SPLIT)))


def placed_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """LINES of a file of any size, or of a folder's files, cut into splits."""
    spark.dataSource.register(LineSource)
    return spark.read.format("placed_lines").option("split", str(split)).load(path)


def numbered_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """LINES with `number`, from 0 in each file: lines are counted by range of places, and numbered inside each."""
    count = ordered.folded(placed_lines(spark, path, split), ["file"], ["at"], {"number": ordered.running(F.lit(1).cast("long"))})
    return count.withColumn("number", F.col("number") - 1)


def read_head(path: str, size: int) -> bytes:
    system, place = place_of(path)
    with system.open_input_file(place) as file:
        return file.read(size)


def sha256_of(path: str) -> str:
    """Of a file of any size, some MB at a time."""
    system, place = place_of(path)
    digest = hashlib.sha256()
    with system.open_input_stream(place) as file:
        while chunk := file.read(4 * CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def spread(files: DataFrame, by: Column | str = "file") -> DataFrame:
    """Files over all tasks, however few partitions their listing has."""
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), by)


HASHED = "file string, length long, modified timestamp, sha256 string"


def file_hashes(spark: SparkSession, path: str | list[str], cache: str | None = None) -> DataFrame:
    """(file, sha256) of files of any size, each hashed where a task streams it. cache: a folder of HASHED rows; a file with the
    length and time that it was hashed with is not read again, and what is hashed now is added."""
    files = listing(spark, path)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[sha256_of(x) for x in batch["file"]])

    if cache is None:
        return spread(files).mapInPandas(hashed, HASHED).select("file", "sha256")
    key = ["file", "length", "modified"]
    spark.createDataFrame([], HASHED).write.mode("append").parquet(cache)
    known = spark.read.schema(HASHED).parquet(cache).dropDuplicates(key)
    new = files.join(known, key, "left_anti")
    spread(new).mapInPandas(hashed, HASHED).write.mode("append").parquet(cache)
    return files.join(spark.read.schema(HASHED).parquet(cache).dropDuplicates(key), key).select("file", "sha256")
