"""Keyed state over streams: folds in event-time order, with typed state that timers reorder and end.

A row waits in its key's list until the watermark has passed it, so that rows of later micro-batches that are earlier in time
are still folded in their place. A timer at the earliest waiting time takes out what is due; once nothing waits, a timer
`idle` after the last row ends the key, and all that the state store holds of it goes. A key that comes again after that
starts anew, as it does in the batch form (`restarting`), so the stream gives what the batch gives.

State lives in the RocksDB store, beside the executors and in the checkpoint; only rows that wait and one state a key are
held in memory, while that key is worked on. Rows older than the watermark are dropped by Spark, as late; rows without a
key or a time take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocks(spark: SparkSession):
    """State of streams that start inside goes to the RocksDB store, which timers need."""
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ROCKS[0])
        else:
            spark.conf.set(ROCKS[0], before)


def restarting(start: Callable, step: Callable, at: str, idle_ms: int, key: str) -> tuple[Callable, Callable]:
    """(start, step) for a fold in batch whose key starts anew where its next row comes more than idle_ms later."""

    def stepped(state: tuple, row) -> tuple:
        last, inner = state
        now = getattr(row, at)
        if last is None or now > last + idle_ms:
            inner = start(getattr(row, key))
        inner, out = step(inner, row)
        return (now, inner), out

    return (lambda _: (None, None)), stepped


class Fold(StatefulProcessor):
    """step(state, row) -> (state, output row or None) over each key's rows by `order`, once the watermark has passed them."""

    def __init__(self, start: Callable, step: Callable, order: list[str], rows: str, columns: list[str], out: list[str], idle_ms: int, state: str, pack: Callable, unpack: Callable):
        self.start, self.step, self.order, self.rows, self.columns, self.out = start, step, order, rows, columns, out
        self.idle_ms, self.state, self.pack, self.unpack = idle_ms, state, pack, unpack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state)
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", self.rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.columns.index(self.order[0])
        first = None
        for batch in () if pd.isna(key[0]) else rows:
            batch = batch[batch[self.order[0]].notna()]
            if batch.empty:
                continue
            new = [tuple(None if pd.isna(v) else v for v in r) for r in batch[self.columns].astype(object).itertuples(index=False, name=None)]
            self.waiting.appendList(new)
            least = min(r[at] for r in new)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(int(first))
        yield pd.DataFrame([], columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        batch = pd.DataFrame(list(self.waiting.get()), columns=self.columns).astype(object)
        due = batch[batch[self.order[0]] <= now].sort_values(self.order, kind="stable")
        rest = batch[batch[self.order[0]] > now]
        last = self.last.get()[0] if self.last.exists() else None
        state = self.unpack(self.kept.get()) if self.kept.exists() else None
        out = []
        for row in due.itertuples(index=False):
            moment = int(getattr(row, self.order[0]))
            if state is None or moment > last + self.idle_ms:
                state = self.start(key[0])
            state, got = self.step(state, row)
            last = moment
            if got is not None:
                out.append(got)
        if len(rest):
            self.waiting.put([tuple(r) for r in rest.itertuples(index=False, name=None)])
            self.handle.registerTimer(int(rest[self.order[0]].min()))
        elif len(batch):
            self.waiting.clear()
        if state is not None and not len(rest) and last + self.idle_ms <= now:
            self.kept.clear()
            self.last.clear()
        elif len(due):
            self.kept.update(self.pack(state))
            self.last.update((last,))
            self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str, state: str, idle_ms: int, late: str, pack: Callable = tuple, unpack: Callable = tuple) -> DataFrame:
    """The rows that step puts out. order: the event time in milliseconds (long), then what breaks ties; state: the DDL of pack(state)."""
    rows = stream.withColumn("_at", F.timestamp_millis(F.col(order[0]))).withWatermark("_at", late)
    columns = [c for c in stream.columns if c != key] + [key]
    kinds = dict(stream.dtypes)
    fold = Fold(start, step, order, ", ".join(f"{c} {kinds[c]}" for c in columns), columns, [x.split()[0] for x in schema.split(",")], idle_ms, state, pack, unpack)
    return rows.groupBy(key).transformWithStateInPandas(fold, schema, "Append", "EventTime")


def dead_letters(failures: DataFrame, key: str, order: list[str], schema: str, idle_ms: int, late: str, attempts: int = 5) -> DataFrame:
    """The failure with which a job used up its attempts, once for each job, whatever follows; a job that rests is forgotten."""
    names = [x.split()[0] for x in schema.split(",")]

    def step(state: tuple, row) -> tuple:
        n = state[0] + 1
        return (n,), tuple(getattr(row, c) for c in names) if n == attempts else None

    return folded(failures, key, order, lambda _: (0,), step, schema, "n int", idle_ms, late)
