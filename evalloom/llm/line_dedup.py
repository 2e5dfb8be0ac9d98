"""Line dedup over levelled sorted runs of line hashes.

LineRuns keeps, in the shared folder, sorted runs of (h, n, last_doc, seen): a line key's 128-bit hash, the number of a batch's
documents that hold it, the largest of their ids, and whether an earlier run knew the key. Runs are bucketed by h and sorted
in their buckets, so a merge join reads them without a shuffle or a sort. A new batch is reduced to one row a key and
merge-anti-joined with the runs: keys that pass are new to them, the others only bring further counts. Then the batch is
added as a run of level 0. When a level has `fanout` runs they are compacted into one run of the next level, so that a
key is rewritten once a level and not once a batch. Each key is new in exactly one run; a key's verdict needs the counts of
all batches, so `repeated` merge-joins the runs' new keys with the few further counts once all batches are in. A folder of runs can
be opened again by its path, and more batches added.

Lines then go by their verdict: up to BROADCAST_KEYS repeated keys are looked up in a table that the executors get, so texts
don't move; beyond, the lines that go are found by a join and collected for their documents.

Defined cases: a null or empty text is one empty line; a line that a document holds twice, or that several rows of one doc_id
hold, counts as one document's; rows with the largest id all keep their lines; rows without a doc_id are one document, smaller
than any other; an empty table gives an empty result; texts are whole whatever their length; other columns of the input pass
through untouched, and ones called `_ld_*` are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import discard, file_system, materialize, scratch_path, table

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 5, 4
#: Repeated keys (about 120 bytes each in a worker) up to which they go to the executors as a table; beyond, a shuffle join.
BROADCAST_KEYS = 100_000

RUN = "h binary, n long, last_doc long, seen boolean"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key (ASCII white space stripped, A-Z lower-cased); None if the key is short."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h) for each row and each different long key in it."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {k for x in (text.as_py() or b"").split(b"\n") if (k := line_key(x, min_chars))}
                ids += [doc] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "h"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(explode, "doc_id long, h binary")


class LineRuns:
    """Levelled sorted runs in a shared folder, one new run a batch."""

    NAME = re.compile(r"level(\d+)-run(\d+)-b(\d+)")

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or scratch_path(spark, "line-runs"), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a batch's aggregate is dealt likewise
        self.levels: list[dict[str, str]] = [{}]  # table by path
        self.made = 0
        fs, target = file_system(spark, self.path)
        if fs.exists(target):
            found = [m for x in fs.listStatus(target) if (m := self.NAME.fullmatch(x.getPath().getName()))]
            for m in sorted(found, key=lambda m: int(m[2])):
                run = f"{self.path}/{m[0]}"
                if fs.exists(file_system(spark, f"{run}/_SUCCESS")[1]):
                    self._known(run, int(m[1]), self._table())
                    spark.sql(f"CREATE TABLE {self.levels[int(m[1])][run]} ({RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {m[3]} BUCKETS LOCATION '{run}'")
                    self.made = int(m[2])

    @staticmethod
    def _table() -> str:
        return f"evalloom_run_{uuid.uuid4().hex}"

    def _known(self, path: str, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append({})
        self.levels[level][path] = name

    @contextmanager
    def _ordered(self) -> Iterator[None]:
        """Bucketed scans tell their order: each bucket is one sorted file."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name, "false")
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level.values()]

    def _write(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        path, name = f"{self.path}/level{level}-run{self.made}-b{self.buckets}", self._table()
        with self._ordered():
            rows.select("h", "n", "last_doc", "seen").write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self._known(path, level, name)

    def _drop(self, level: int) -> None:
        for path, name in self.levels[level].items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)
        self.levels[level] = {}

    def joined(self, lines: DataFrame) -> DataFrame:
        """A batch's lines (doc_id, h; a document's line once) as a run: one row a key, merge-anti-joined with all runs; seen tells
        the keys that the anti-join holds back."""
        own = lines.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc")).withColumn("seen", F.lit(False))
        for run in self.runs():
            known = run.where("NOT seen").select("h", F.lit(True).alias("_known")).hint("merge")
            own = own.join(known, "h", "left").withColumn("seen", F.col("seen") | F.col("_known").isNotNull()).drop("_known")
        return own

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-joins a batch's lines with the runs, adds the batch as a run, and compacts full levels."""
        self._write(self.joined(lines), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            every = self.spark.read.schema(RUN).parquet(*self.levels[level])
            # a key that is new in one of these runs takes the further counts of the others; one that is new elsewhere stays seen
            self._write(every.groupBy("h").agg(F.sum("n").alias("n"), F.max("last_doc").alias("last_doc"), F.bool_and("seen").alias("seen")), level + 1)
            self._drop(level)
            level += 1

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h, last_doc) of the keys that at least min_docs documents hold, written to the shared folder."""
        paths = [path for level in self.levels for path in level]
        if not paths:
            return materialize(self.spark.createDataFrame([], "h binary, last_doc long"), "line-repeated")
        more = self.spark.read.schema(RUN).parquet(*paths).where("seen").groupBy("h").agg(F.sum("n").alias("more"), F.max("last_doc").alias("later"))
        more = materialize(more, "line-more")
        with self._ordered():
            parts = [run.where("NOT seen").join(more.hint("merge"), "h", "left").where(F.col("n") + F.coalesce("more", F.lit(0)) >= min_docs) for run in self.runs()]
            every = parts[0]
            for part in parts[1:]:
                every = every.union(part)
            out = materialize(every.select("h", F.greatest("last_doc", "later").alias("last_doc")), "line-repeated")
        discard(self.spark, more)
        return out

    def clear(self) -> None:
        for level in range(len(self.levels)):
            self._drop(level)
        discard(self.spark, self.path)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs, all columns, with text replaced and `_ld_lines`, `_ld_dropped` (counts) added."""
    spark = docs.sparkSession
    out = "struct<text: string, n_lines: long, n_dropped: long>"
    path = scratch_path(spark, "lines")
    lines = lines_of(docs, min_chars)
    if docs.groupBy(F.col("doc_id").cast("long")).count().where("count > 1").limit(1).count():
        lines = lines.distinct()  # several rows of one document
    lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, h binary, batch long").parquet(path)
    runs = LineRuns(spark, fanout=fanout)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).select("doc_id", "h"))
    repeated = runs.repeated(min_docs)
    runs.clear()
    if repeated.count() <= broadcast_keys:
        last = spark.sparkContext.broadcast({bytes(r.h): r.last_doc for r in repeated.collect()})

        def doomed(doc: int | None, key: bytes, _own: None) -> bool:
            return key in last.value and (x := last.value[key]) is not None and (doc is None or doc < x)

        marked = docs.withColumn("_ld_own", F.lit(None).cast("array<binary>"))
    else:
        gone = lines.join(repeated, "h").where(F.col("last_doc").isNotNull() & F.coalesce(F.col("doc_id") < F.col("last_doc"), F.lit(True)))
        gone = gone.groupBy(F.col("doc_id").alias("_ld_doc")).agg(F.collect_set("h").alias("_ld_own"))  # at most a document's lines
        gone = materialize(gone, "line-gone")
        marked = docs.drop("_ld_own").join(gone, docs.doc_id.cast("long").eqNullSafe(gone["_ld_doc"]), "left").drop("_ld_doc")

        def doomed(_doc: int | None, key: bytes, own: set | None) -> bool:
            return own is not None and key in own

    discard(spark, path, repeated)

    def clean(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, docs_, owns in batches:
            rows = []
            for text, doc, own in zip(texts, docs_.to_pylist(), owns, strict=True):
                own = set(x) if (x := own.as_py()) is not None else None
                lines_ = (text.as_py() or b"").split(b"\n")
                left = [x for x in lines_ if not ((k := line_key(x, min_chars)) and doomed(doc, k, own))]
                rows.append((b"\n".join(left).decode("utf-8", "replace"), len(lines_), len(lines_) - len(left)))
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["text", "n_lines", "n_dropped"])

    clean.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    cleaned = F.arrow_udf(clean, out)(F.col("text").cast("binary"), F.col("doc_id").cast("long"), F.col("_ld_own"))
    marked = marked.withColumn("_ld", cleaned)
    columns = [F.col("_ld.text").alias("text") if c == "text" else F.col(c) for c in docs.columns if not c.startswith("_ld_")]
    return marked.select(*columns, F.col("_ld.n_lines").alias("_ld_lines"), F.col("_ld.n_dropped").alias("_ld_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, o.k IS NOT NULL AND l.doc_id < o.last_doc AS gone FROM keyed l LEFT JOIN often o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
