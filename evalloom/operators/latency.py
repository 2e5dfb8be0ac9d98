"""Latency-log operators: exact percentiles, interval joins, first failures, drifts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators import ordered, ranks


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Exact, linearly interpolated percentiles of the valid timed requests; where the log tells them, requests that were sent again
    count as invalid, and the medians of the prompt's and the answer's times and of its tokens are given too."""
    ok = F.col("valid")
    if "retried" in rows.columns:
        ok &= ~F.coalesce("retried", F.lit(False))
    counts = rows.groupBy(*keys).agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))
    medians = {c: n for c, n in (("prompt_ms", "prompt_ms_med"), ("predicted_ms", "gen_ms_med"), ("predicted_n", "gen_tokens_med")) if c in rows.columns}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_measure"), F.col(c).cast("double").alias("_value")) for c in ("wall_ms", *medians)]))
    long = rows.where(ok).select(*keys, each.alias("_m")).select(*keys, "_m.*")
    points = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    found = ranks.percentiles(long, [*keys, "_measure"], "_value", points)
    of = lambda measure, point: F.round(F.max(F.when(F.col("_measure") == measure, F.col(point))), 6)
    wide = found.groupBy(*keys).agg(*(of("wall_ms", p).alias(p) for p in points), *(of(c, "median").alias(n) for c, n in medians.items()))
    return ranks.met(counts, wide, list(keys), "left")


def valid_request(http: str = "http", error: str = "error", reply: str = "reply") -> Column:
    """Answered with 200, without an error, with a text."""
    return F.coalesce((F.col(http) == 200) & (F.coalesce(error, F.lit("")) == "") & F.col(reply).isNotNull(), F.lit(False))


def samples_in_intervals(intervals: DataFrame, samples: DataFrame, bin_us: int, inset_us: int = 0) -> DataFrame:
    """Range join t0 + inset <= us <= t1 - inset, as an equi-join on time bins: an interval is exploded into the bins it
    touches, a sample falls into one, and the bounds are checked again. No nested loop at any size."""
    i = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("t0") / bin_us), F.floor(F.col("t1") / bin_us))))
    s = samples.withColumn("bin", F.floor(F.col("us") / bin_us))
    return i.join(s, "bin").where((F.col("us") >= F.col("t0") + inset_us) & (F.col("us") <= F.col("t1") - inset_us)).drop("bin")


ORDER = ["us", "event_id"]


def phase_intervals(events: DataFrame, keys: list[str], opens: Column, longest_us: int) -> DataFrame:
    """(keys, t0, t1, closed) from open and close events (us): a phase ends with the next event of its keys, a close (closed) or an open, or after
    longest_us. A close that comes first, or after a close, is left out; at one time closes come before opens."""
    told = events.select(*keys, F.col("us").alias("t0"), opens.alias("_opens"), (-F.col("us")).alias("_back"), F.when(opens, 0).otherwise(1).alias("_kind"))
    told = told.withColumn("_tie", F.struct("_kind", F.monotonically_increasing_id().alias("_id")))
    after = ordered.previous(F.struct(F.col("t0").alias("us"), F.col("_opens").alias("opens")))  # backwards, so what comes next
    met = ordered.folded(told, keys, ["_back", "_tie"], {"_next": after}).where("_opens")
    end = F.col("t0") + longest_us
    in_time = F.coalesce(F.col("_next.us") <= end, F.lit(False))
    return met.select(*keys, "t0", F.when(in_time, F.col("_next.us")).otherwise(end).alias("t1"), (in_time & ~F.coalesce("_next.opens", F.lit(True))).alias("closed"))


def first_bad(rows: DataFrame) -> DataFrame:
    """Per server, by time: valid timed requests before the first invalid one, and valid ones after it (-1: none bad)."""
    bad = F.coalesce(~F.col("valid"), F.lit(False))
    n = ordered.folded(rows, ["server_id"], ORDER, {"rn": ordered.running(F.lit(1)), "bad": ordered.running(bad.cast("int"))})
    before = F.count_if(F.col("valid") & (F.col("phase") == "timed") & (F.col("bad") == 0))
    first = F.min(F.when(bad, F.col("rn")))
    after = F.when(first.isNull(), -1).otherwise(F.count_if(F.col("valid") & (F.col("bad") > 0)))
    return n.groupBy("server_id").agg(F.count("*").alias("n"), first.cast("int").alias("first_bad"), before.alias("valid_timed_before"), after.cast("long").alias("valid_after"))


def drift(rows: DataFrame, value: str, ends: int = 10, least: int = 20, places: int = 0) -> DataFrame:
    """Per server: the median of the last `ends` values minus that of the first ones, rounded half-even."""
    told = rows.where(F.col(value).isNotNull()).select("server_id", *ORDER, value)
    n = told.groupBy("server_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    mid = lambda end: F.median(F.when(F.col("_end") == end, F.col(value)))
    change = ordered.ends(told, ["server_id"], ORDER, ends).groupBy("server_id").agg(F.bround(mid("last") - mid("first"), places).alias("drift"))
    return ranks.met(n, change, ["server_id"]).select("server_id", "n", "drift")


def error_runs(rows: DataFrame) -> DataFrame:
    """Per server: the longest run of invalid requests in a row."""
    islands = ordered.folded(rows.select("server_id", *ORDER, "valid"), ["server_id"], ORDER, {"island": ordered.running(F.col("valid").cast("int"))})
    runs = islands.where(~F.col("valid")).groupBy("server_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("server_id").agg(F.max("n").alias("longest_error_run"), F.count("*").alias("error_runs"))


def progress(rows: DataFrame, every: int = 25) -> DataFrame:
    """Per server after each `every` requests and after the last one: how many there were, and how many were valid."""
    told = rows.select("server_id", *ORDER, "valid")
    n = ordered.folded(told, ["server_id"], ORDER, {"n": ordered.running(F.lit(1)), "ok": ordered.running(F.col("valid").cast("int"))})
    total = told.groupBy("server_id").agg(F.count("*").alias("total"))
    return ranks.met(n, total, ["server_id"]).where((F.col("n") % every == 0) | (F.col("n") == F.col("total"))).select("server_id", F.col("n").cast("int").alias("n"), "ok")
