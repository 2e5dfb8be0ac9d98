"""Logs as streams with state by key: each record once, restart counters, phases from their open and close events.

All use Spark's arbitrary state (transformWithState), which needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = ROCKS. Rows travel through the state as JSON beside their keys (its columns
may not begin with an underscore: the frames that a processor gets lose such names).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(rows: DataFrame, **more: Column) -> DataFrame:
    """The columns of more, and `line`: all of a row's columns as JSON."""
    return rows.select(*[c.alias(n) for n, c in more.items()], F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def unpacked(rows: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.from_json("line", like.schema).alias("_r"), *more).select("_r.*", *more)


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key through."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for batch in rows:
            if not known and len(batch):
                known = True
                self.seen.update((True,))
                first = batch.sort_values(["at", "line"], kind="stable").iloc[:1]
                yield first[["line"]]

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, keys: list[str], time: str | None = None, keep_days: float | None = None) -> DataFrame:
    """Rows of a stream whose keys came for the first time, however late they are; rows with a null key are all let through. What was seen
    is kept by key, for good or, if given, for keep_days after it came; then the query looks at the clock, so a trigger of what is available never ends."""
    none = F.lit(False)
    for k in keys:
        none |= F.col(k).isNull()
    at = F.coalesce(F.col(time).cast("double"), F.lit(0.0)) if time else F.lit(0.0)
    key = F.to_json(F.struct(*keys))
    state = FirstSeen(int(keep_days * 86_400_000) if keep_days else None)
    keyed = packed(rows.where(~none), key_of=key, at=at).groupBy("key_of").transformWithStateInPandas(state, "line string", "append", "processingTime" if keep_days else "none")
    return unpacked(keyed, rows).unionByName(rows.where(none))


class Restarts(StatefulProcessor):
    """Per key: (rows since the last restart, restarts so far, dead rows in this block, time and number of the last row)."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "since long, block long, deaths long, t double, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, block, deaths, *last = self.state.get() or (0, 0, 0, float("-inf"), -(2**63))
        last = tuple(last)
        out = []
        every = pd.concat(list(rows)).sort_values(["t_", "id_"], kind="stable")  # a micro-batch's rows of one key
        for t, i, reset, dead, row in every[["t_", "id_", "resets", "dies", "line"]].itertuples(index=False):
            if (t, i) < last:
                out.append((row, None, None, None, True))
                continue
            last = (t, i)
            if since and (reset or 0 < self.every <= since):
                since, block, deaths = 0, block + 1, 0
            since, deaths = since + 1, deaths + bool(dead)
            out.append((row, since, block, deaths, False))
        self.state.update((since, block, deaths, float(last[0]), int(last[1])))
        frame = pd.DataFrame(out, columns=["line", "since_restart", "block", "restarts_in_block", "late"])
        yield frame.astype({"since_restart": "Int64", "block": "Int64", "restarts_in_block": "Int64"})

    def close(self) -> None:
        pass


def restart_counter(rows: DataFrame, keys: list[str], time: str, number: str, reset: Column, dead: Column, every: int) -> DataFrame:
    """operators.ordered.restart_counter of a log that grows: each row with since_restart, block and restarts_in_block. A log is written in the order of
    time and number; a row that comes behind a later one can't be counted any more and is `late`, with null counts."""
    false = lambda x: F.coalesce(x, F.lit(False))
    told = packed(rows, key_of=F.to_json(F.struct(*keys)), t_=F.col(time).cast("double"), id_=F.col(number).cast("long"), resets=false(reset), dies=false(dead))
    counted = told.groupBy("key_of").transformWithStateInPandas(Restarts(every), "line string, since_restart long, block long, restarts_in_block long, late boolean", "append", "none")
    return unpacked(counted, rows, "since_restart", "block", "restarts_in_block", "late")


PHASE = "key string, phase string, t0 timestamp, t1 timestamp, closed boolean"


class Phases(StatefulProcessor):
    """Pairs the open and close events of one key and phase."""

    def __init__(self, longest_ms: int):
        self.longest_ms = longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "t long")

    def interval(self, key, t0: int, t1: int, closed: bool) -> tuple:
        return (*key, pd.Timestamp(t0, unit="ms"), pd.Timestamp(t1, unit="ms"), closed)

    def forget(self) -> None:
        self.handle.deleteTimer(self.opened.get()[0] + self.longest_ms)
        self.opened.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        every = pd.concat(list(rows)).sort_values(["ms", "opens"], kind="stable")  # a close before an open of the same time
        for ms, opens in every[["ms", "opens"]].itertuples(index=False):
            held = self.opened.get()[0] if self.opened.exists() else None
            if held is not None and ms >= held:
                out.append(self.interval(key, held, min(ms, held + self.longest_ms), not opens and ms <= held + self.longest_ms))
                self.forget()
            if opens:
                self.opened.update((int(ms),))
                self.handle.registerTimer(int(ms) + self.longest_ms)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.opened.exists() and self.opened.get()[0] + self.longest_ms <= expiredTimerInfo.getExpiryTimeInMs():
            held = self.opened.get()[0]
            out.append(self.interval(key, held, held + self.longest_ms, False))
            self.opened.clear()
        yield self.frame(out)

    @staticmethod
    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "phase", "t0", "t1", "closed"]).astype({"t0": "datetime64[us]", "t1": "datetime64[us]", "closed": bool})

    def close(self) -> None:
        pass


def phases(events: DataFrame, key: str, phase: str, time: str, opens: Column, longest_s: int, late: str) -> DataFrame:
    """PHASE intervals from open and close events of a stream (time: a timestamp). A phase that is opened again, or not closed within longest_s, ends
    there with closed false; a close without an open is left out. Late by more than `late`: dropped."""
    told = events.select(F.col(key).cast("string").alias("key"), F.col(phase).cast("string").alias("phase"), F.col(time).alias("happened"), F.unix_millis(time).alias("ms"), opens.alias("opens"))
    return told.withWatermark("happened", late).groupBy("key", "phase").transformWithStateInPandas(Phases(longest_s * 1000), PHASE, "append", "eventTime", eventTimeColumnName="t1")


def samples_in_phases(intervals: DataFrame, samples: DataFrame, key: str, time: str, longest_s: int, late: str) -> DataFrame:
    """A stream of intervals (PHASE) joined with a stream of samples of the same key: t0 <= sample <= t1. Both watermarks bound the state: a sample waits
    for intervals that began up to longest_s before it, an interval for samples up to its end."""
    s = samples.withColumn("_sample_at", F.col(time)).withWatermark("_sample_at", late)
    inside = (F.col("_sample_at") >= F.col("t0")) & (F.col("_sample_at") <= F.col("t1")) & (F.col("_sample_at") >= F.col("t1") - F.expr(f"INTERVAL {longest_s} SECONDS"))
    named = intervals.withColumnRenamed("key", "_interval_key")
    return named.join(s, (F.col("_interval_key") == s[key].cast("string")) & inside).drop("_interval_key", "_sample_at")
