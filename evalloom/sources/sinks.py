"""Sinks that never leave half a result in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("refuse", "overwrite", "resume", "smoke")


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def replace(df: DataFrame, path: str, backup: bool = False) -> str | None:
    """Write JSON lines beside path, then put them in its place. df may read path itself. A crash between the two renames leaves
    the new rows, whole, beside it: recover() puts them in place. Returns the backup's path if one is kept."""
    spark, tag = df.sparkSession, uuid.uuid4().hex[:8]
    new, old = f"{path}.new-{tag}", f"{path}.bak-{tag}"
    df.write.json(new)
    fs, target = _fs(spark, path)
    there = fs.exists(target)
    if there and not fs.rename(target, _fs(spark, old)[1]):
        raise OSError(f"can't move {path}")
    if not fs.rename(_fs(spark, new)[1], target):
        if there:
            fs.rename(_fs(spark, old)[1], target)
        raise OSError(f"can't put {path} in place")
    if there and not backup:
        fs.delete(_fs(spark, old)[1], True)
    return old if there and backup else None


def recover(spark: SparkSession, path: str) -> bool:
    """After a crash inside replace(): if path is missing, what was whole beside it (the new rows, else the old ones) takes its place."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        return False
    for kind in ("new", "bak"):
        for x in fs.globStatus(_fs(spark, f"{path}.{kind}-*")[1]) or []:
            if fs.exists(_fs(spark, f"{x.getPath()}/_SUCCESS")[1]):
                return bool(fs.rename(x.getPath(), target))
    return False


def write_run(df: DataFrame, path: str, mode: str = "refuse", key: str = "rec_no") -> None:
    """refuse: an earlier run raises; overwrite: it is kept as a backup; resume: only records it lacks are added (a row without a
    key can't be told from the old ones and raises); smoke: below the folder smoke beside path, over what was there."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    recover(df.sparkSession, path)
    fs, target = _fs(df.sparkSession, path)
    if mode == "smoke":
        folder, _, name = path.rstrip("/").rpartition("/")
        df.write.mode("overwrite").json(f"{folder}/smoke/{name}")
    elif not fs.exists(target):
        df.write.json(path)
    elif mode == "refuse":
        raise FileExistsError(path)
    elif mode == "overwrite":
        replace(df, path, backup=True)
    else:
        done = df.sparkSession.read.schema(df.schema).json(path).select(key)
        keyless = F.raise_error(F.lit(f"a row without {key} can't be resumed")).cast(df.schema[key].dataType)
        df.withColumn(key, F.coalesce(key, keyless)).join(done, key, "left_anti").select(*df.columns).write.mode("append").json(path)


def publish(spark: SparkSession, path: str, write: Callable[[str], object]) -> str:
    """What write(folder) puts into a new folder below path becomes the current version by one file, created exclusively, that names it. A writer that
    is killed before leaves the version before, one that is killed after the new one; of two writers the later one counts. Gives the new folder."""
    name = uuid.uuid4().hex
    write(f"{path}/versions/{name}")
    at = max([n for n, _ in _pointers(spark, path)], default=-1)
    while True:
        at += 1
        fs, target = _fs(spark, f"{path}/current/{at:012d}")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            continue  # another writer was faster
        out.writeBytes(name)
        out.close()
        return f"{path}/versions/{name}"


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers; one whose writer was killed has an empty version."""
    fs, target = _fs(spark, f"{path}/current")
    if not fs.exists(target):
        return []
    found = []
    for x in fs.listStatus(target):
        stream = fs.open(x.getPath())
        try:
            found.append((int(x.getPath().getName()), spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
    return sorted(found)


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current version."""
    whole = [name for _, name in _pointers(spark, path) if len(name) == 32]
    if not whole:
        raise FileNotFoundError(f"{path}: nothing was published")
    return f"{path}/versions/{whole[-1]}"


def prune(spark: SparkSession, path: str) -> None:
    """Deletes the versions that aren't current, also those that a killed writer left; readers of an older one must be done."""
    keep = current(spark, path).rpartition("/")[2]
    fs, target = _fs(spark, f"{path}/versions")
    for x in fs.listStatus(target):
        if x.getPath().getName() != keep:
            fs.delete(x.getPath(), True)


def write_provenance(spark: SparkSession, path: str, settings: dict, hashes: DataFrame) -> None:
    """One JSON document as a version: the settings and the input files with their hashes, by name."""
    inputs = hashes.agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("inputs"))
    document = inputs.select(F.lit(json.dumps(settings, sort_keys=True)).alias("settings"), "inputs").coalesce(1)
    publish(spark, path, document.write.json)


def write_summary(spark: SparkSession, path: str, run: dict, figures: DataFrame) -> None:
    """One JSON document of a run as a version: its settings, and each dataset's figures under its name."""
    cols = [c for c in figures.columns if c != "dataset"]
    by_name = figures.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", F.struct(*cols))))).alias("datasets"))  # one row a dataset
    publish(spark, path, by_name.select(*[F.lit(v).alias(k) for k, v in run.items()], "datasets").coalesce(1).write.json)


def write_dataset(df: DataFrame, path: str, manifest: dict, first: int | None = None, order: str = "rec_no") -> None:
    """A frozen dataset as a version: data, and a manifest with the number of records. An earlier one raises. first: only so many records, by
    order; the manifest tells that it is a prefix."""
    spark = df.sparkSession
    if any(len(name) == 32 for _, name in _pointers(spark, path)):
        raise FileExistsError(f"{path} exists already")

    def write(folder: str) -> None:
        (df if first is None else df.orderBy(order).limit(first)).write.json(f"{folder}/data")
        about = manifest | {"records": spark.read.text(f"{folder}/data").count()} | ({} if first is None else {"prefix_of": df.count()})
        spark.range(1).select(F.lit(json.dumps(about, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{folder}/manifest")

    publish(spark, path, write)


def log_stream(rows: DataFrame, path: str, checkpoint: str):
    """Rows of a stream as JSON lines, once each: what a batch wrote counts from when the checkpoint has it."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
