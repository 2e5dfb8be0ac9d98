"""Logs as streams: resume without repeats, and event-time windows of phases (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.streaming import stateful


def resumed(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("dataset", "config", "rec_no"), time: str = "t", keep_days: float | None = None, retry_errors: bool = False) -> DataFrame:
    """Each record of a growing folder of JSON lines once; the checkpoint of the query that writes it holds what was done. Rows that were
    never tried don't count, nor other errors with retry_errors. A record is known by keys; where a row or the schema lacks one but
    the last, its file stands for it. Rows without a number are all let through, and a record's first row however late it comes. What was done is remembered for
    keep_days, without it for good. Needs the state store of stateful.ROCKS."""
    rows = spark.readStream.schema(schema).json(path)
    here = set(rows.columns)
    again = F.lit(False)
    if "error_type" in rows.columns:
        again |= F.coalesce("error_type", F.lit("")) == "ServerUnavailable"
    if retry_errors:
        again |= F.coalesce("error", F.lit("")) != ""
    names, number = rows.columns, keys[-1]
    file = F.col("_metadata.file_path")
    rows = rows.where(~again).withColumns({f"_key_{k}": F.coalesce(F.col(k).cast("string"), file) if k in here else file for k in keys if k != number})
    own = [c for c in rows.columns if c.startswith("_key_")]
    return stateful.first_seen(rows, [*own, number], time if time in names else None, keep_days).select(*names)


def may_resume(old: dict, new: dict) -> None:
    """The gate before a log goes on: settings that differ from those it began with raise, by name."""
    if odd := [f"{k}: {old.get(k)!r} -> {new.get(k)!r}" for k in sorted(old.keys() | new.keys()) if old.get(k) != new.get(k)]:
        raise ValueError(f"the log was begun with other settings: {odd}")


def request_windows(rows: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and peaks by tumbling window and server; state is dropped behind the watermark."""
    w = rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "server_id")
    return w.agg(F.count("*").alias("n"), F.max("wall_ms").alias("peak_ms")).select(F.col("w.start").alias("start"), "server_id", "n", "peak_ms")
