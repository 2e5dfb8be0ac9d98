"""Ordered folds over groups of any size: running sums, last values, counters and the ends of a group, without a task that holds one.

A group is cut into segments by ranges of its first order column. Each segment is summed up, the few summaries of a group are folded in order, and
what precedes a segment is carried into it as one row in front: the log itself is shuffled and sorted once, by (keys, segment).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.ranks import cuts_of, range_of

@dataclass(frozen=True)
class Fold:
    """What a row takes from the rows of its group up to itself. part: an aggregate of a segment's values, given the order; earlier: an aggregate
    of the parts of earlier segments; own: an aggregate of the segment's values up to the row; both: the two together."""

    value: Column
    part: Callable[[Column, Column], Column]
    earlier: Callable[[Column], Column]
    own: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]
    upto: int = 0  # own takes rows up to this one (0) or to the one before (-1)


def running(value: Column) -> Fold:
    """The sum up to the row; nulls count 0."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    return Fold(value, lambda v, _: F.sum(v), F.sum, F.sum, lambda e, o: zero(e) + zero(o))


def latest(value: Column) -> Fold:
    """The last value up to the row that is not null."""
    last = lambda v: F.last(v, ignorenulls=True)
    return Fold(value, lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)), last, last, lambda e, o: F.coalesce(o, e))


def previous(value: Column) -> Fold:
    """The last value that is not null of the rows before the row."""
    return replace(latest(value), upto=-1)


def segmented(rows: DataFrame, order: str, per: int | None = None) -> DataFrame:
    """rows with `_segment`, by ranges of a numeric column; as many as the counted rows ask for. Nulls come first."""
    return rows.withColumn("_segment", F.when(F.col(order).isNull(), 0).otherwise(range_of(F.col(order), cuts_of(rows, order, per))))


def folded(rows: DataFrame, keys: list[str], order: list[str], folds: dict[str, Fold], per: int | None = None) -> DataFrame:
    """rows with a column for each fold. order: columns, the first one numeric, that tell a group's rows apart."""
    cut = rows if "_segment" in rows.columns else segmented(rows, order[0], per)
    at = F.struct(*order)
    parts = cut.groupBy(*keys, "_segment").agg(*[f.part(f.value, at).alias(f"_e_{n}") for n, f in folds.items()])
    before = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)  # MOST rows a group
    carried = parts.select(*keys, "_segment", *[f.earlier(F.col(f"_e_{n}")).over(before).alias(f"_e_{n}") for n, f in folds.items()], F.lit(False).alias("_is_row"))
    both = cut.withColumns({"_is_row": F.lit(True)} | {f"_v_{n}": f.value for n, f in folds.items()}).unionByName(carried, allowMissingColumns=True)
    inside = W.partitionBy(*keys, "_segment").orderBy("_is_row", *order)
    upto = lambda end: inside.rowsBetween(W.unboundedPreceding, end)
    out = both.select("*", *[f.both(F.first(f"_e_{n}", ignorenulls=True).over(upto(0)), f.own(F.col(f"_v_{n}")).over(upto(f.upto))).alias(n) for n, f in folds.items()])
    return out.where("_is_row").select(*rows.columns, *folds)


def restart_counter(rows: DataFrame, keys: list[str], order: list[str], reset: Column, dead: Column, every: int, per: int | None = None) -> DataFrame:
    """rows with since_restart (rows since the last restart, this one included), block (restarts before it) and restarts_in_block (the dead rows
    of its block so far). A row with `reset` comes right behind a restart; without one there is a restart after `every` rows, never if that is 0."""
    cut = segmented(rows, order[0], per)
    names = [*rows.columns, "_segment"]
    n = folded(cut, keys, order, {"_n": running(F.lit(1))})
    first = folded(n, keys, order, {"_first": latest(F.when(reset, F.col("_n")))})
    place = F.col("_n") - F.coalesce("_first", F.lit(1))
    since = (place % every if every > 0 else place) + 1
    begun = first.withColumn("since_restart", since.cast("long")).select(*names, "_n", "since_restart")
    blocks = folded(begun, keys, order, {"block": running(((F.col("since_restart") == 1) & (F.col("_n") > 1)).cast("long"))})
    told = dead.cast("long")
    if every > 0:
        upto = W.partitionBy(*keys, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)  # `every` rows at most
        return blocks.withColumn("restarts_in_block", F.sum(told).over(upto)).drop("_n", "_segment")
    deaths = folded(blocks, keys, order, {"_deaths": running(told)})  # a block may be a whole group
    begin = latest(F.when(F.col("since_restart") == 1, F.col("_deaths") - F.coalesce(told, F.lit(0))))
    out = folded(deaths, keys, order, {"_begin": begin})
    return out.withColumn("restarts_in_block", F.col("_deaths") - F.col("_begin")).drop("_n", "_segment", "_deaths", "_begin")


def ends(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k and the last k rows of each group, with `_end` (first, last); a row of a short group is in both. Each task passes on
    at most k rows a group and end."""
    part = W.partitionBy(*keys)
    first = rows.withColumn("_i", F.row_number().over(part.orderBy(*order))).where(F.col("_i") <= k).withColumn("_end", F.lit("first"))
    last = rows.withColumn("_i", F.row_number().over(part.orderBy(*map(F.desc, order)))).where(F.col("_i") <= k).withColumn("_end", F.lit("last"))
    return first.union(last).drop("_i")
