"""Statistics of paired results: exact McNemar, bootstrap intervals."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.ranks import met, placed


#: Replicates that are drawn at once.
CHUNK = 500


def mcnemar_exact(worse: Column, better: Column) -> Column:
    """min(1, 2 sum C(n, i) / 2^n) for i up to the smaller count, with terms in log space: no underflow at any n."""
    n, k = (worse + better).cast("double"), F.least(worse, better)
    zero = F.struct((-n * math.log(2)).alias("log"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = F.when(i == 0, acc["log"]).otherwise(acc["log"] + F.log((n - i + 1) / i))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), zero, step, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def bootstrap_md5(df: DataFrame, keys: list[str], order: str, diff: str, reps: int = 100) -> DataFrame:
    """Replicate means with row indices from md5(rep|draw), the same in any engine. keys, rep, mean_diff.

    The row for a draw is looked up by a join on its number, so replicates spread over the cluster; rows are numbered by ranges of
    the numeric column order, so a cell's sort does too. order must tell a cell's rows apart."""
    rows = placed(df.select(*keys, order, F.col(diff).alias("d")), keys, order).select(*keys, "d", F.col("_before").alias("i"), F.col("_total").alias("n"))
    draws = rows.select(*keys, "n", F.col("i").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    at = F.conv(F.substring(F.md5(F.concat_ws("|", "rep", "draw")), 1, 7), 16, 10).cast("long") % F.col("n")
    picked = draws.withColumn("i", at).join(rows.select(*keys, "i", "d"), [*keys, "i"])
    return picked.groupBy(*keys, "rep").agg((F.sum("d") / F.count("*")).alias("mean_diff"))


def stream_of(seed: int, values: list) -> np.random.Generator:
    """A random stream of its own for each cell: the same in every process and order. Whole numbers seed as they are, all else by CRC-32."""
    return np.random.default_rng([seed, *(int(v) if str(v).isdigit() else zlib.crc32(str(v).encode()) for v in values)])


#: Different values that one task draws from; cells with more are spread over several.
VALUES = 20_000


def interval_of(means: np.ndarray, order_statistics: bool) -> tuple[float, float]:
    means = np.sort(means)
    lo, hi = (means[int(0.025 * len(means))], means[int(0.975 * len(means))]) if order_statistics else np.percentile(means, [2.5, 97.5])
    return float(lo), float(hi)


def bootstrap_counts(df: DataFrame, keys: list[str], reps: int = 10_000, seed: int = 249, order_statistics: bool = False, most: int = VALUES) -> DataFrame:
    """Intervals of the mean paired difference, in points. df: keys, diff, n (how many pairs differ by diff). Resampling pairs
    is a multinomial draw over the different values: O(values x reps) a cell whatever its size. All differences zero give (0, 0) and draw
    nothing. order_statistics: the bounds are sorted replicates, not interpolated ones. A cell with more than `most` values is spread over tasks
    (spread_replicates), others are drawn in one; cells that share a key of nulls count as one."""

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("diff")
        d, n = pdf["diff"].to_numpy(float), pdf["n"].to_numpy(float)
        lo = hi = 0.0
        if np.abs(d).max() > 1e-8:
            rng = stream_of(seed, [pdf.iloc[0][k] for k in keys])
            draws = [rng.multinomial(int(n.sum()), n / n.sum(), size=min(CHUNK, reps - s)) @ d for s in range(0, reps, CHUNK)]
            lo, hi = interval_of(100 * np.concatenate(draws) / n.sum(), order_statistics)
        return pdf.iloc[:1].assign(ci_lo=lo, ci_hi=hi)[[*keys, "ci_lo", "ci_hi"]]

    kinds = dict(df.dtypes)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_values")).where(F.col("_values") > most)
    result = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "ci_lo double", "ci_hi double"])
    if not sizes.limit(1).count():
        return df.groupBy(*keys).applyInPandas(interval, result)
    means = spread_replicates(met(df, sizes, keys), keys, reps, seed, most)

    def from_means(pdf: pd.DataFrame) -> pd.DataFrame:  # reps rows of a cell
        lo, hi = interval_of(pdf["mean"].to_numpy(float), order_statistics)
        return pdf.iloc[:1].assign(ci_lo=lo, ci_hi=hi)[[*keys, "ci_lo", "ci_hi"]]

    small = met(df, df.groupBy(*keys).agg(F.count("*").alias("_values")).where(F.col("_values") <= most), keys).drop("_values")
    return small.groupBy(*keys).applyInPandas(interval, result).union(means.groupBy(*keys).applyInPandas(from_means, result))


def spread_replicates(df: DataFrame, keys: list[str], reps: int, seed: int, most: int) -> DataFrame:
    """(keys, rep, mean) of cells with many values. df: keys, diff, n, _values. Values are dealt to buckets by hash. A cell's draws are first dealt
    to its buckets, by one multinomial over their sums, then to the values of each bucket where that stands; a replicate's bucket totals
    add up to all its draws, as for a draw over all values at once. Each cell and bucket has a stream of its own, whatever task draws it."""
    kinds = dict(df.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    bucket = F.pmod(F.xxhash64("diff"), F.ceil(F.col("_values") / most)).cast("int")
    dealt = df.withColumn("bucket", bucket)
    totals = dealt.groupBy(*keys, "bucket").agg(F.sum("n").alias("total"))

    def draws(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        n = pdf["total"].to_numpy(float)
        rng = stream_of(seed, [pdf.iloc[0][k] for k in keys])
        share = np.concatenate([rng.multinomial(int(n.sum()), n / n.sum(), size=min(CHUNK, reps - s)) for s in range(0, reps, CHUNK)])
        return pdf.assign(all=int(n.sum()), draws=list(share.T))[[*keys, "bucket", "all", "draws"]]

    share = totals.groupBy(*keys).applyInPandas(draws, f"{named}, bucket int, all long, draws array<long>")  # a row for each bucket

    def sums(_key: tuple, values: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("diff")
        d, p = values["diff"].to_numpy(float), values["n"].to_numpy(float)
        rng = stream_of(seed + 1, [*(own.iloc[0][k] for k in keys), own.iloc[0]["bucket"]])
        p /= p.sum()
        found = [float(rng.multinomial(k, p) @ d) for k in own.iloc[0]["draws"]]
        return own[keys].assign(all=own["all"], sums=[found])

    both = dealt.select(*keys, "bucket", "diff", "n").groupBy(*keys, "bucket").cogroup(share.groupBy(*keys, "bucket"))
    parts = both.applyInPandas(sums, f"{named}, all long, sums array<double>").select(*keys, "all", F.posexplode("sums").alias("rep", "s"))
    return parts.groupBy(*keys, "rep").agg((100 * F.sum("s") / F.first("all")).alias("mean"))


def bootstrap_pairs(pairs: DataFrame, keys: list[str], **how) -> DataFrame:
    """bootstrap_counts() of pairs (keys, score, base_score)."""
    counted = pairs.groupBy(*keys, F.round(F.col("score") - F.col("base_score"), 9).alias("diff")).agg(F.count("*").alias("n"))
    return bootstrap_counts(counted, keys, **how)
