"""Readers of result logs, strict and tolerant, and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalloom.functions.scoring import record_key, record_score
from evalloom.operators.paired import keep_last, no_placeholders
from evalloom.sources.ranges import SPLIT, file_hashes, placed_lines

RESULT = """idx string, rec_no long, dataset string, config string, format string, task string, question string, choices array<string>, context string,
answers array<string>, predicted string, prediction_raw string, prediction_normalized string, parser string, score double, correct boolean, gt_answer string, tok_s double,
finish_reason string, retried boolean, error string, error_type string, mem_avail_mb long, image_paths array<string>, protocol_version string, pred_parser_v1 string,
pred_parser_v2 string, runtime string, latency_ms double, n_output_tokens long, wall_s double, prompt_tokens long"""
#: Fixed value: how a run's file is called.
NAME = r"/config(\d+)_([^/]+?)__([^/]+)\.jsonl$"
POISON = "_poison"


def read_strict(spark: SparkSession, path: str, schema: str = RESULT, key: str = "rec_no") -> DataFrame:
    """JSON lines; a bad line raises when the rows are used, a key that is there twice at once. Rows without a key, of older
    files, are left alone."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: a {key} is there twice")
    return rows


def read_tolerant(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """JSON lines; bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parsed_lines(spark: SparkSession, path: str, schema: str, split: int) -> DataFrame:
    """(file, at, ended, row, bad) of the lines that aren't blank."""
    lines = placed_lines(spark, path, split).where(F.trim("line") != "")
    parsed = lines.withColumn("row", F.from_json("line", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("file", "at", "ended", "row", F.col("row._corrupt").isNotNull().alias("bad"))


def read_resumable(spark: SparkSession, path: str, schema: str = RESULT, split: int = SPLIT) -> DataFrame:
    """Logs whose last line may be torn: that line is dropped, a bad line before it raises. Files of any size: lines are told apart by
    the bytes that they begin at."""
    parsed = parsed_lines(spark, path, schema, split)
    last = parsed.groupBy("file").agg(F.max("at").alias("end"))  # one row a file
    ok = F.when(F.col("bad") & (F.col("at") < F.col("end")), F.raise_error(F.concat(F.lit("bad line at byte "), F.col("at"), F.lit(" of "), F.col("file")))).otherwise(~F.col("bad"))
    checked = parsed.join(last, "file").withColumn("ok", ok.cast("boolean"))  # one expression: a filter of its own could run before the other
    return checked.where("ok").select("row.*").drop("_corrupt")


def resume_state(spark: SparkSession, path: str, schema: str = RESULT, retry_errors: bool = False, split: int = SPLIT) -> tuple[DataFrame, DataFrame, bool]:
    """(rows to keep, rows to do again, whether the file must be rewritten first). Never-tried rows are done again, other errors
    only with retry_errors; a row without a key, or one whose key is there twice, raises."""
    rows = read_resumable(spark, path, schema, split)
    odd = rows.groupBy("rec_no").count().where("rec_no is null or count > 1").limit(1).collect()
    if odd:
        raise ValueError(f"{path}: a record without or with a repeated rec_no: {odd[0].rec_no}")
    again = F.coalesce("error", F.lit("")) != ""
    if not retry_errors:
        again &= F.coalesce(F.col("error_type") == "ServerUnavailable", F.lit(False))
    torn = parsed_lines(spark, path, schema, split).where(F.col("bad") | ~F.col("ended"))  # a bad line is the last one, or rows has raised
    dropped = rows.where(again)
    return rows.where(~again), dropped, torn.limit(1).count() > 0 or dropped.limit(1).count() > 0


def todo(records: DataFrame, kept: DataFrame) -> DataFrame:
    """Records (rec_no, idx) that kept rows don't cover yet; a kept row whose idx isn't its record's raises when used."""
    k = kept.select(F.col("rec_no").alias("_no"), F.col("idx").cast("string").alias("_idx"))
    other = F.raise_error(F.concat(F.lit("the log isn't of these records: record "), F.col("_no").cast("string"))).cast("boolean")
    met = k.join(records.select("rec_no", F.col("idx").cast("string").alias("_own")), F.col("_no") == F.col("rec_no"), "left")
    done = met.where(F.when(F.col("_idx").eqNullSafe(F.col("_own")), True).otherwise(other)).select(F.col("_no").alias("rec_no"))
    return records.join(done, "rec_no", "left_anti")


def discover(spark: SparkSession, path: str | list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """(file, config, short, dataset) of the result files below path; error lists and files below folders named in exclude
    are left out, as are files that aren't called like a run's. Two files for one config and dataset raise when the rows are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "config*.jsonl").load(path).select(F.col("path").alias("file"))
    part = lambda i: F.regexp_extract("file", NAME, i)
    found = files.select("file", part(1).alias("config"), part(2).alias("short"), part(3).alias("dataset")).where((F.col("config") != "") & ~F.col("dataset").endswith(POISON))
    if exclude:
        found = found.where(~F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, exclude))))
    one = found.groupBy("config", "dataset").agg(F.min(F.struct("file", "short")).alias("f"), F.max("file").alias("other"))
    clash = F.raise_error(F.concat_ws(" ", F.lit("two files for one run:"), "f.file", "other"))
    return one.select(F.when(F.col("other") != F.col("f.file"), clash).otherwise(F.col("f.file")).alias("file"), "config", "f.short", "dataset")


def load_results(spark: SparkSession, path: str | list[str], exclude: tuple[str, ...] = (), schema: str = RESULT) -> DataFrame:
    """All runs below path as one table: config (number), dataset, idx, score, predicted, gt, question, key, error, tok_s, mem_avail_mb.
    Older rows have `correct` in place of a score. A bad line, a never-tried record, a row with neither score nor correct, and an idx that
    a file holds twice raise."""
    files = [r.file for r in discover(spark, path, exclude).select("file").collect()]  # one row a run
    if not files:
        raise FileNotFoundError(f"no result files below {path}")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(files).withColumn("_file", F.col("_metadata.file_path"))
    if twice := rows.groupBy("_file", "idx").count().where("count > 1").limit(1).collect():
        raise ValueError(f"{twice[0]['_file']}: idx {twice[0].idx} is there twice")
    part = lambda i: F.regexp_extract("_file", NAME, i)
    bad = F.coalesce("error", F.lit("")) != ""
    rows = no_placeholders(rows.withColumns({"config": part(1).cast("int"), "dataset": part(3)}))
    return rows.select("config", "dataset", "idx", "task", F.when(~bad, record_score()).alias("score"), "predicted", F.col("gt_answer").alias("gt"), "question", record_key().alias("key"), F.when(bad, F.col("error")).alias("error"), "error_type", "tok_s", "mem_avail_mb")


def only_file(spark: SparkSession, path: str, glob: str) -> str:
    """The one file below path with a name like glob; none or several raise."""
    found = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path").limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"exactly one file like {glob} is wanted, not {found}")
    return found[0]


def keyed(spark: SparkSession, path: str, key: str = "rec_no", schema: str = RESULT, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """One log's rows without an error, the last one of a key. columns: those that are read, beside the key; where: a condition on them. Both
    reach the scan here, as the last row is found behind them: where is asked of all rows, not only of last ones."""
    fields = spark.createDataFrame([], schema).schema
    wanted = fields if columns is None else StructType([f for f in fields if f.name in {key, "error", *columns}])
    ok = F.col("error").isNull() | (F.col("error") == "")
    rows = spark.read.schema(wanted).json(path).where(ok if where is None else ok & where)
    rows = rows.withColumn("_at", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    out = keep_last(rows, [key], "_at").drop("_at")
    return out if columns is None else out.select(key, *[c for c in columns if c != key])


def tasks(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """(idx, task, predicted, gt) of all rows, those with an error too; no other column is read."""
    return spark.read.schema(schema).json(path).select("idx", "task", "predicted", F.col("gt_answer").alias("gt"))


REQUEST = """round int, slot int, config string, block string, server_id int, valid boolean, retried boolean, restarts_in_block int, timings_complete boolean, dataset string, phase string, k int,
pos long, t double, wall_ms double, http int, error string, prompt_n long, prompt_ms double, cache_n long, predicted_n long, predicted_ms double, predicted_per_second double, completion_tokens long,
finish_reason string, mem_avail_mb long, swap_free_mb long, temp_c double, reply string"""
EVENT = """event string, phase string, t double, t0 double, t1 double, iso0 string, round int, slot int, config string, block string, dataset string, n int, load_s double, ok boolean, temp_end_c double,
timed_out boolean, mem_avail_mb long, swap_free_mb long, `order` array<string>, k int, server_id int, pid long, returncode int, note string"""


def request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).option("mode", "FAILFAST").json(path)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def numbered(df: DataFrame, order: str, name: str = "idx", parts: int = 200) -> DataFrame:
    """df with numbers from 0 in the order of a numeric column that tells all rows apart. Rows are cut into value ranges, numbered inside
    each and moved on by the ranges' sizes, so no task holds all of them."""
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("_part", part)
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    place = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return cut.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before")


def hash_of(spark: SparkSession, path: str) -> str:
    """A single file's SHA-256, streamed by a task."""
    return file_hashes(spark, path).first().sha256


def write_csv(df: DataFrame, path: str, decimals: int = 4) -> None:
    """A small report table: doubles with fixed decimals, one file, with a header."""
    cols = [F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, max_rows: int = 1000) -> str:
    """A report table as Markdown; reports are small, more rows than max_rows raise."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("too many rows for a report")
    cell = lambda x: "-" if x is None else f"{x + 0.0:.2f}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def pivoted(df: DataFrame, rows: list[str], column: str, labels: dict, cell: Callable[[Row], str], missing: str = "-", max_rows: int = 10_000) -> str:
    """A long report table as Markdown, one line for each different `rows`, sorted, and one column for each of labels (value of `column`: heading).
    cell writes a row's cell; where there is no row it is `missing`. Reports are small, more than max_rows raise."""
    found = df.where(F.col(column).isin(*labels)).limit(max_rows + 1).collect()
    if len(found) > max_rows:
        raise ValueError("too many rows for a report")
    cells: dict[tuple, dict] = {}
    for r in found:
        of_line = cells.setdefault(tuple(r[k] for k in rows), {})
        if r[column] in of_line:
            raise ValueError(f"two cells for {r[column]}")
        of_line[r[column]] = cell(r)
    lines = sorted(cells.items(), key=lambda x: [(v is None, v) for v in x[0]])
    text = [[*rows, *labels.values()], *([*("-" if v is None else str(v) for v in line), *(of.get(c, missing) for c in labels)] for line, of in lines)]
    head, *body = ["| " + " | ".join(x) + " |" for x in text]
    return "\n".join([head, "|" + "---|" * len(text[0]), *body])


def accuracy_cell(r: Row) -> str:
    """An accuracy in percent, with the number of records where some were left out."""
    return f"{r.accuracy_pct:.2f}" + (f" (n={r.n_valid})" if r.n_error else "")


def delta_cell(r: Row) -> str:
    """A signed change with its interval, marked where that excludes 0."""
    mark = "*" if r.ci_lo > 0 or r.ci_hi < 0 else ""
    return f"{r.delta_pts + 0.0:+.2f} [{r.ci_lo:+.2f}, {r.ci_hi:+.2f}]{mark}"
