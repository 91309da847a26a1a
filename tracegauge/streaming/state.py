"""Stateful stages of streams: duplicates within an exact time to live, runs of errors, summaries by interval.

Each keeps a small state for each key in Spark's state store and clears it by event-time timers. Batch forms that give the same
are operators.stateful.repeats, operators.stateful.failing and operators.emit.interval_summary: rows of a micro-batch may come in any
order, and micro-batches in that of time; a row later than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Helper columns: a key, microseconds, and the place among rows of one time.
KEY, TIME, ORDER, BAD, OUTCOME = "__key", "__time", "__order", "__bad", "__outcome"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside get the state store that keyed state needs; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


class Repeats(StatefulProcessor):
    """State: until when a key's rows are repeats of the accepted one, in microseconds."""

    def __init__(self, ttl_us: int, names: list[str]):
        self.ttl_us, self.row = ttl_us, Row(*names, "duplicate")
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.until.get()[0] if self.until.exists() else None
        until = known
        for r in sorted(rows, key=lambda r: (r[TIME] is not None, r[TIME] or 0)):
            at = r[TIME]
            again = at is not None and until is not None and at < until
            if at is not None and not again:
                until = at + self.ttl_us
            yield self.row(*(r[n] for n in self.names), again)
        if until != known:
            if known is not None:
                self.handle.deleteTimer(-(-known // 1000))
            self.handle.registerTimer(-(-until // 1000))
            self.until.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def marked_repeats(stream: DataFrame, keys: list[str], at: str, ttl_s: float, late: str = "10 minutes") -> DataFrame:
    """stream with `duplicate`: the key was accepted less than ttl_s before, by the timestamp column `at`, which gets a watermark of `late`. A
    duplicate doesn't prolong the time, an age of exactly ttl_s is accepted anew. Null keys are keys."""
    schema = StructType([*stream.schema.fields, StructField("duplicate", BooleanType())])
    timed = stream.withColumn(TIME, micros(at)).withWatermark(at, late)
    return timed.groupBy(*keys).transformWithState(Repeats(round(ttl_s * 1e6), stream.columns), schema, "append", "EventTime")


#: How keys are written as text.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
CHANGES = "kind string, first long, until long, errors long, since long, summary string, troubled boolean"


def told(key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame([(*key, *r) for r in rows], columns=[KEY, *(c.split()[0] for c in CHANGES.split(", "))], dtype=object)


class Health(StatefulProcessor):
    """State of a key: its rows so far, its errors in a row, where they began; outcomes by interval until the watermark has passed its end. A
    key's open intervals are one value and have one timer, that of the first to end; with no interval there are none."""

    def __init__(self, least: int, interval_us: int | None):
        self.least, self.interval_us = least, interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "n long, errors long, first long")
        if self.interval_us:
            self.intervals = handle.getValueState("intervals", "open array<struct<since: long, outcome: string, n: long, bad: boolean>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, errors, first = self.run.get() or (0, 0, 0)
        out: list[tuple] = []
        seen: dict[tuple[int, str | None], list] = {}
        text = lambda x: x if isinstance(x, str) else None  # noqa: E731  nulls may be NaN
        # by place, as the data frames don't keep names with underscores: key, at, time, order, whether bad, outcome
        own = [r for df in rows for r in zip(*(df[c].tolist() for c in df.columns[2:]), strict=True)]
        for at, _, bad, *outcome in sorted(own, key=lambda r: (r[0], text(r[1]) or "")):
            n += 1
            if bad:
                errors, first = errors + 1, first if errors else n
            else:
                if errors >= self.least:
                    out.append(("recovered", first, n - 1, errors, None, None, None))
                errors = 0
            if self.interval_us:
                seen.setdefault((at // self.interval_us * self.interval_us, text(outcome[0])), [0, bad])[0] += 1
        if errors >= self.least:
            out.append(("failing", first, n, errors, None, None, None))
        self.run.update((n, errors, first))
        if seen:
            before = self.opened()
            now = before | {at: (before.get(at, (0,))[0] + m, bad) for at, (m, bad) in seen.items()}
            if self.first_end(now) != self.first_end(before):
                if before:
                    self.handle.deleteTimer(self.first_end(before))
                self.handle.registerTimer(self.first_end(now))
            self.keep(now)
        yield from told(key, out)

    def end_ms(self, since: int) -> int:
        return -(-(since + self.interval_us) // 1000)

    def first_end(self, intervals: dict[tuple[int, str], tuple[int, bool]]) -> int | None:
        return min((self.end_ms(since) for since, _ in intervals), default=None)

    def opened(self) -> dict[tuple[int, str], tuple[int, bool]]:
        kept = self.intervals.get()
        return {(since, outcome): (n, bad) for since, outcome, n, bad in kept[0]} if kept else {}

    def keep(self, intervals: dict[tuple[int, str], tuple[int, bool]]) -> None:
        self.intervals.update(([(*at, *x) for at, x in intervals.items()],))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        intervals, passed = self.opened(), timerValues.getCurrentWatermarkInMs()
        over: dict[int, list] = {}
        for since, outcome in sorted((at for at in intervals if self.end_ms(at[0]) <= passed), key=lambda at: (at[0], at[1] or "")):
            over.setdefault(since, []).append((outcome, *intervals.pop((since, outcome))))
        yield from told(key, [("summary", None, None, None, since, ", ".join(f"{o}={n}" for o, n, _ in own), any(bad for _, _, bad in own)) for since, own in over.items()])
        if intervals:
            self.handle.registerTimer(self.first_end(intervals))
            self.keep(intervals)
        else:
            self.intervals.clear()

    def close(self) -> None:
        pass


def health(stream: DataFrame, keys: list[str], at: str, order: Column, outcome: Column, bad: Column, least: int = 3, interval_s: float | None = 60, late: str = "1 minute") -> DataFrame:
    """What changes with a key's health, by the timestamp column `at`, then `order`:

    kind `failing`: a run of `least` errors or more, at its place `first` among the key's rows, that goes on at the end of a micro-batch (`until`,
    `errors`); `recovered`: such a run that has ended; `summary`: how often each outcome was in the interval from `since` on (microseconds), told
    once the watermark has passed its end, and whether any was an error (`troubled`). Without interval_s there are no summaries."""
    # rows come as data frames, whose columns have no nulls beside numbers: a key is one text, and its columns are made of it again
    kinds = stream.select(*keys).schema
    rows = stream.withColumns({KEY: F.to_json(F.struct(*keys), EXACT), TIME: micros(at), ORDER: order.cast("string"), OUTCOME: outcome, BAD: F.coalesce(bad, F.lit(False))}).where(F.col(TIME).isNotNull())
    rows = rows.select(KEY, at, TIME, ORDER, BAD, *([OUTCOME] if interval_s else [])).withWatermark(at, late)
    changes = rows.groupBy(KEY).transformWithStateInPandas(Health(least, round(interval_s * 1e6) if interval_s else None), f"{KEY} string, {CHANGES}", "append", "EventTime")
    return changes.withColumn(KEY, F.from_json(KEY, kinds, EXACT)).select(f"{KEY}.*", *(c for c in changes.columns if c != KEY))


def runs(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last known state of each run of errors in health's rows: as operators.stateful.failing gives them."""
    own = changes.where("kind in ('failing', 'recovered')").groupBy(*keys, "first")
    last = own.agg(F.max(F.struct("errors", (F.col("kind") == "recovered").alias("recovered"), "until")).alias("x"))
    return last.select(*keys, "first", "x.until", "x.errors", "x.recovered")
