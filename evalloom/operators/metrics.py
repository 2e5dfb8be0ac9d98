"""All figures of a run from its result rows, in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.scoring import FORMATS, UNAVAILABLE


def run_figures(rows: DataFrame, fmt: str, *keys: str, target: Column | None = None) -> DataFrame:
    """rows: result rows of one format. Rows of records that were never tried are pending, neither errors nor answers. target: an
    aggregate (how many records the run has); without one, the number of rows."""
    scored, mcq = FORMATS[fmt].scorer is not None, fmt == "mcq"
    tried = F.coalesce(F.col("error_type") != UNAVAILABLE, F.lit(True))
    bad = F.coalesce("error", F.lit("")) != ""
    ok = tried & ~bad
    total = F.count("*") if target is None else target
    done, answered = F.count_if(tried), F.count_if(ok)
    points, speed = F.coalesce(F.sum(F.when(ok, F.col("score"))), F.lit(0.0)), F.when(ok & (F.col("tok_s") > 0), F.col("tok_s"))
    none = F.lit(None)
    ratio = lambda n: F.try_divide(points, n) if scored else none.cast("double")
    return rows.groupBy(*keys).agg(
        F.lit(FORMATS[fmt].metric).alias("metric"), total.alias("target"), done.alias("total"), F.greatest(total - done, F.lit(0)).alias("pending"), F.count_if(~tried).alias("placeholders"),
        (done >= total).alias("complete"), F.when(done >= total, "complete").when(done == 0, "not attempted").otherwise("partial").alias("status"),
        answered.alias("answered"), F.count_if(tried & bad).alias("errors"), F.count_if(tried & F.coalesce("retried", F.lit(False))).alias("retries"),
        F.count_if(ok & (F.coalesce("predicted", F.lit("")) == "")).alias("unparsed"), (F.count_if(ok & F.col("correct")) if mcq else none.cast("long")).alias("correct"),
        (F.round(points, 4) if scored else none.cast("double")).alias("score_sum"), ratio(done).alias("score_raw"), ratio(answered).alias("score_answered"),
        F.coalesce(F.bround(F.avg(speed), 1), F.lit(0.0)).alias("avg_tok_s"),
        (F.count_if(ok & ~F.col("pred_parser_v1").eqNullSafe(F.col("pred_parser_v2"))) if mcq else none.cast("long")).alias("parser_disagreements"),
    )
