"""Evaluation and latency logs derived from the test tables: the stand-ins that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: config, multiplier, flips of 11: four synthetic runs; 2 is the baseline and 5 the noise floor.
CONFIGS = ((2, 7, 1), (5, 3, 1), (9, 5, 2), (8, 2, 3))
BASE, NOISE = 2, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eval_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record and config: config, dataset, idx, task, gt, predicted, error, n_chars. The runs are exploded from
    each joined row, so the documents are joined once however many configs there are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    runs = F.explode(F.array(*[F.struct(*(F.lit(x).alias(n) for x, n in zip(c, ("config", "mult", "flip"), strict=True))) for c in CONFIGS]))
    rows = rows.withColumn("c", runs)
    wrong = (F.col("doc_id") * F.col("c.mult") + F.col("c.config")) % 11 < F.col("c.flip")
    return rows.select(
        "c.config", F.col("lang").alias("dataset"), F.col("doc_id").alias("idx"), F.col("source").alias("task"), F.col("quality").alias("gt"),
        F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")).alias("predicted"), F.when((F.col("doc_id") * F.col("c.config")) % 53 == 7, "HTTP Error 400").alias("error"), "n_chars",
    )


EVAL = """
e AS (
  SELECT c.config, d.lang AS dataset, d.doc_id AS idx, d.source AS task, l.quality AS gt,
         CASE WHEN (d.doc_id * c.mult + c.config) % 11 < c.flip THEN 1 - l.quality ELSE l.quality END AS predicted,
         CASE WHEN (d.doc_id * c.config) % 53 = 7 THEN 'HTTP Error 400' END AS error, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  CROSS JOIN (VALUES (2, 7, 1), (5, 3, 1), (9, 5, 2), (8, 2, 3)) c(config, mult, flip)),
v AS (SELECT *, CAST(predicted = gt AS INT) AS score FROM e WHERE coalesce(error, '') = '')"""


def valid(rows: DataFrame) -> DataFrame:
    """Rows without an error (null and empty both mean none), with their score."""
    return rows.where(F.coalesce("error", F.lit("")) == "").withColumn("score", (F.col("predicted") == F.col("gt")).cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latency log: event_id, us (epoch microseconds), server_id, config, dataset, phase, valid, wall_ms, k."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").alias("server_id"), (F.col("user_id") % 4).alias("config"), F.when(k % 2 == 0, "scienceqa").otherwise("textvqa").alias("dataset"),
        F.when(k < 10, "warmup").otherwise("timed").alias("phase"), (F.col("event_type") != "error").alias("valid"), F.col("value").alias("wall_ms"), k.alias("k"), "event_type",
    )


REQUESTS = """
r AS (
  SELECT event_id, epoch_us(ts) AS us, user_id AS server_id, user_id % 4 AS config, CASE WHEN k % 2 = 0 THEN 'scienceqa' ELSE 'textvqa' END AS dataset,
         CASE WHEN k < 10 THEN 'warmup' ELSE 'timed' END AS phase, event_type <> 'error' AS valid, value AS wall_ms, k, event_type
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events))"""
