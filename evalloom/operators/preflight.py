"""Checks of records and their files before a run: what is missing, empty, repeated or out of range, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators import ordered
from evalloom.operators.ranks import met

PROBLEM = ("severity", "problem", "rec_no", "idx", "path")


def resolved(path: Column, folder: str) -> Column:
    """Relative paths are below the dataset's folder."""
    return F.when(path.startswith("/") | path.rlike("^[a-z][a-z0-9]*:"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def plain(file: Column) -> Column:
    """A listed file's path without the local scheme, as records name it."""
    return F.regexp_replace(file, "^file:/+", "/")


def image_problems(records: DataFrame, files: DataFrame, folder: str, strict: bool = True, absolute: bool = True, need_images: bool = False) -> DataFrame:
    """PROBLEM rows of records (rec_no, idx, image_paths; any choices and answer) against a listing (file, length). A missing or empty image is an
    error; an idx that is there twice and a ground truth outside the choices are errors in strict datasets, warnings in older ones.
    absolute: whether absolute paths are looked up (they may be another machine's). need_images: a record without images is an error.

    Records keep their images beside them only up to one join on the path; those that meet a file with contents go at once."""
    row = lambda severity, problem, path=None: F.struct(F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), "rec_no", F.col("idx").cast("string").alias("idx"), (F.lit(None).cast("string") if path is None else path).alias("path"))
    soft = "error" if strict else "warning"
    wanted = records.select("rec_no", "idx", F.explode("image_paths").alias("_p"))
    wanted = wanted.where(F.col("_p").isNotNull() if absolute else ~F.col("_p").startswith("/"))
    there = files.groupBy(plain(F.col("file")).alias("_file")).agg(F.max("length").alias("_length"))
    looked = wanted.withColumn("_path", resolved(F.col("_p"), folder)).join(there, F.col("_path") == F.col("_file"), "left")
    out = looked.where(F.coalesce("_length", F.lit(0)) == 0).select(F.when(F.col("_length").isNull(), row("error", "missing image", F.col("_path"))).otherwise(row("error", "empty image", F.col("_path"))).alias("r"))
    twice = records.groupBy("idx").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = out.union(met(records, twice, ["idx"]).select(row(soft, "repeated idx")))
    if need_images:
        out = out.union(records.where(F.coalesce(F.size("image_paths"), F.lit(0)) <= 0).select(row("error", "no images")))
    if {"answer", "choices"} <= set(records.columns):
        from evalloom.functions.text import gt_in_range

        outside = F.col("answer").isNotNull() & (F.size("choices") > 0) & ~gt_in_range(F.col("answer"), F.col("choices"))
        out = out.union(records.where(outside).select(row(soft, "ground truth outside the choices")))
    return out.select("r.*")


def summary(problems: DataFrame, examples: int = 3) -> DataFrame:
    """(severity, problem, n, records, first): how many rows, of how many records, and the first record numbers."""
    keys = ["severity", "problem"]
    counts = problems.groupBy(*keys, "rec_no").agg(F.count("*").alias("_n"))
    n = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("records"))
    first = ordered.ends(counts.select(*keys, "rec_no"), keys, ["rec_no"], examples).where("_end = 'first'").groupBy(*keys).agg(F.array_sort(F.collect_list("rec_no")).alias("first"))
    return n.join(first, keys)
