"""What the operators of this subpackage share: table access, scratch tables, and size-checked joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side table (a few hundred bytes a row at most) up to which it is broadcast.
BROADCAST_ROWS = 50_000

#: Folders of this process's applications, by application id.
_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it wants it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_root(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir, the shared folder of the cluster; it goes when the driver ends.
    A temporary folder stands in only where Spark runs in this one process and none is set; a cluster without one raises."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="evalloom-")
        _ROOTS[app] = f"{root.rstrip('/')}/evalloom-{app}"
        fs, target = file_system(spark, _ROOTS[app])
        fs.mkdirs(target)  # what isn't there yet isn't deleted on exit
        fs.deleteOnExit(target)
    return _ROOTS[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evalloom_path = path
    return out


def discard(spark: SparkSession, *tables: str | DataFrame) -> None:
    """Delete tables by path, or what materialize() gave: those that no later result reads."""
    for x in tables:
        fs, target = file_system(spark, x if isinstance(x, str) else x._evalloom_path)
        fs.delete(target, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else the join shuffles, and AQE splits hot keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where Catalyst would repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bytes and rows of text that a Python function gets at once.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 2048


def trim() -> None:
    """Give the memory that a chunk has freed back to the system: idle Python workers stay beside the next stage's."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def over_texts(function, returns: str, limit: int = CHUNK_BYTES):
    """A column function of a text column. function: list of UTF-8 texts (null: b"") -> Arrow array of as many rows;
    it gets a few MB and a bounded number of rows at a time, however long an Arrow batch is."""
    import pyarrow as pa

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # trim() reaches its memory
        for texts in batches:
            out, chunk, held = [], [], 0
            for x in texts:
                chunk.append(t := x.as_py() or b"")
                held += len(t)
                if held >= limit or len(chunk) >= CHUNK_ROWS:
                    out.append(function(chunk))
                    chunk, held = [], 0
                    trim()
            if chunk:
                out.append(function(chunk))
            del chunk
            trim()
            yield pa.concat_arrays(out) if out else function([])

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, returns)
    return lambda column: udf(column.cast("binary"))
