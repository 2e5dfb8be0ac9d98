"""Readers of what surrounds the result logs: board telemetry, latency summaries, hash listings, error lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators import ordered
from evalloom.sources.ranges import SPLIT, placed_lines

# Fixed formats: a telemetry line, a row of the telemetry section of a text summary, that section's title.
STAMP, RAM, SWAP = r"^(\d\d-\d\d-\d{4} \d\d:\d\d:\d\d)", r"RAM (\d+)/\d+MB", r"SWAP (\d+)/\d+MB"
PEAKS, SECTION = r"^\s*(\S+)\s+timed\s+(\d+)\s+(\d+)\s+(\d+)", "== tegrastats"


def board_samples(spark: SparkSession, path: str, zone: str = "UTC", split: int = SPLIT) -> DataFrame:
    """(file, t, ram_mb, swap_mb): samples of one second are spread evenly over it; other lines are skipped."""
    stamp = F.regexp_extract("line", STAMP, 1)
    lines = placed_lines(spark, path, split).where((stamp != "") & F.col("line").rlike(RAM))
    local = F.to_timestamp_ntz(stamp, F.lit("MM-dd-yyyy HH:mm:ss"))
    second = F.unix_micros(F.convert_timezone(F.lit(zone), F.lit("UTC"), local).cast("string").cast("timestamp"))
    swap = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("line", SWAP, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    s = lines.select("file", "at", (second / 1e6).alias("second"), F.regexp_extract("line", RAM, 1).cast("int").alias("ram_mb"), swap.alias("swap_mb"))
    w = W.partitionBy("file", "second")
    return s.select("file", (F.col("second") + (F.row_number().over(w.orderBy("at")) - 1) / F.count("*").over(w)).alias("t"), "ram_mb", "swap_mb")


def strict_peaks(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, config, ram_peak) from the telemetry section of text summaries. A section's title is carried on over its lines."""
    title = ordered.latest(F.when(F.col("line").startswith("=="), F.col("line")))
    lines = ordered.folded(placed_lines(spark, path, split), ["file"], ["at"], {"title": title})
    part = lambda i: F.regexp_extract("line", PEAKS, i)
    return lines.where(F.col("title").startswith(SECTION) & F.col("line").rlike(PEAKS)).select("file", part(1).alias("config"), part(3).cast("long").alias("ram_peak"))


def latency_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, config, dataset, med, p95, valid) of CSV summaries; a config in the summaries of two folders raises."""
    rows = spark.read.csv(path, header=True).select(
        F.col("_metadata.file_path").alias("file"), "config", "dataset", F.col("wall_med").cast("double").alias("med"), F.col("wall_p95").cast("double").alias("p95"), F.col("valid").cast("long").alias("valid"),
    )
    twice = rows.groupBy("config").agg(F.count_distinct("file").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"configs in two summaries: {[r.config for r in twice]}")
    return rows


def latency_points(spark: SparkSession, folder: str, dataset: str = "textvqa") -> DataFrame:
    """(config, med, ram_peak) of one latency run, from its CSV and its text summary; a config whose peak is not there raises when it is used."""
    med = latency_tables(spark, f"{folder}/latency_summary.csv").where(F.col("dataset") == dataset).select("config", "med")
    peaks = strict_peaks(spark, f"{folder}/summary.txt").select("config", "ram_peak")
    missing = F.raise_error(F.concat(F.lit("no memory peak of config "), F.col("config"))).cast("long")
    return med.join(peaks, "config", "left").select("config", "med", F.coalesce("ram_peak", missing).alias("ram_peak"))


def hash_listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, expected) from lines of a hash and a path; other lines are skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    return parts.select(F.element_at(F.split(F.col("p")[1], "/"), -1).alias("name"), F.col("p")[0].alias("expected"))


def error_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of records that an error file names."""
    return spark.read.schema("idx string").json(path).select("idx").where("idx is not null").distinct()


def with_error_file(rows: DataFrame, errors: DataFrame, key: str = "idx") -> DataFrame:
    """Rows of a run and of its error file: one a key, the error file's first. One partial aggregate."""
    both = rows.withColumn("_from", F.lit(1)).unionByName(errors.withColumn("_from", F.lit(0)), allowMissingColumns=True)
    return both.groupBy(key).agg(F.min_by(F.struct(*[c for c in both.columns if c not in (key, "_from")]), "_from").alias("r")).select(key, "r.*")


def tolerant_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Single JSON documents as rows; one that can't be read is null in all columns."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")
