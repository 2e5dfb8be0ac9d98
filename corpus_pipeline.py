"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

quality: documents that the classifier rejects go; lines: repeated long lines go; near: one document of each near-duplicate
component stays; mix: rows are taken as often as the source's target asks for; encode: doc_id, source and token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import gam, line_dedup, mixing, sentencepiece_viterbi, simhash
from evalloom.llm._shared import discard, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = gam.quality_model(spark, sf_dir, docs)
    return docs.withColumn("_quality", gam.scores(model)(F.col("text"))).where(F.col("_quality") >= gam.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = sentencepiece_viterbi.encoded(docs)
    return ids.select("doc_id", "source", F.size("_sp_ids").cast("long").alias("n_tokens"), F.col("_sp_ids").alias("token_ids"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("encode", encode)]

#: The classifier and the fingerprints have no SQL form; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            discard(spark, done)
        done = path
    return docs
