"""Exact ranks and percentiles inside groups of any size: no buffer of a group's values, no sort of a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a value range should hold, over all groups together, and ranges there are at most. A range of one group holds at most about what a range holds.
ROWS, MOST = 500_000, 512


def cuts_of(df: DataFrame, order: str, per: int | None = None) -> list:
    """Cuts of a numeric column into about equal ranges, as many as the counted rows ask for: one pass gives the count and the cuts."""
    n, cuts = df.agg(F.count("*"), F.percentile_approx(order, [i / MOST for i in range(1, MOST)], 20 * MOST)).first()  # at most MOST numbers
    parts = min(MOST, -(-n // (per or ROWS)))
    return sorted({cuts[round(i * MOST / parts) - 1] for i in range(1, parts)}) if cuts else []


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys in which null equals null; the right side's keys go."""
    other = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)]
    return left.join(other, on, how).drop(*(f"_right_{i}" for i in range(len(keys))))


def range_of(x: Column, cuts: list[float]) -> Column:
    """How many cuts are at most x, by halving: one expression that compiles, however many cuts."""

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < cuts[mid], within(lo, mid)).otherwise(within(mid + 1, hi))

    return within(0, len(cuts))


def placed(df: DataFrame, keys: list[str], order: str, weight: str | None = None, wanted: Callable[[Column], list[Column]] | None = None) -> DataFrame:
    """df with `_before`, how many rows of its group precede a row by the numeric, non-null column order, and `_total`, the group's rows; a row
    stands for `weight` rows. Rows are cut into value ranges, numbered inside each and moved on by the ranges' sizes. Ranges
    without a position of wanted(total) are left out before anything is sorted. Ties are numbered in any order."""
    cut = df.withColumns({"_range": range_of(F.col(order), cuts_of(df, order)), "_rows": F.col(weight) if weight else F.lit(1).cast("long")})
    group = W.partitionBy(*keys)
    sizes = cut.groupBy(*keys, "_range").agg(F.sum("_rows").alias("_size"))
    sizes = sizes.withColumns({"_start": F.sum("_size").over(group.orderBy("_range")) - F.col("_size"), "_total": F.sum("_size").over(group)})  # MOST rows a group
    if wanted:
        sizes = sizes.where(F.exists(F.array(*wanted(F.col("_total"))), lambda p: (p >= F.col("_start")) & (p < F.col("_start") + F.col("_size"))))
    inside = W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = met(cut, sizes, [*keys, "_range"]).withColumn("_before", F.col("_start") + F.sum("_rows").over(inside) - F.col("_rows"))
    return out.drop("_range", "_rows", "_size", "_start")


def ranked(rows: DataFrame, keys: list[str], value: str, wanted: Callable[[Column], list[Column]]) -> DataFrame:
    """(keys, _n, _v0, _v1, ...): the non-null values at the positions wanted(n), from 0, of each group by value. Equal values are counted
    before anything is sorted; groups without a value have no row."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    at = wanted(F.col("_total"))
    found = [F.max(F.when((p >= F.col("_before")) & (p < F.col("_before") + F.col("_w")), F.col(value))).alias(f"_v{i}") for i, p in enumerate(at)]
    return placed(counted, keys, value, "_w", wanted).groupBy(*keys).agg(F.max("_total").alias("_n"), *found)


def percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, a column for each name of points): exact percentiles with linear interpolation, nulls left out."""
    place = lambda n, p: (n - 1) * F.lit(float(p))
    ends = ranked(rows, keys, value, lambda n: [e(place(n, p)) for p in points.values() for e in (F.floor, F.ceil)])

    def between(i: int, p: float) -> Column:
        at, lo, hi = place(F.col("_n"), p), F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        return F.when(lo == hi, lo.cast("double")).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return ends.select(*keys, *(between(i, p).alias(name) for i, (name, p) in enumerate(points.items())))


def with_median(grouped: DataFrame, rows: DataFrame, keys: list[str], value: str, name: str, places: int) -> DataFrame:
    """grouped, one row a group, beside the rounded median of its rows' value; null where there is none."""
    return met(grouped, percentiles(rows, keys, value, {name: 0.5}), keys, "left").withColumn(name, F.round(name, places))
