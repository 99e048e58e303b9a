"""Admission of calls to a budget of tokens in a rolling window: a call waits until the window has room, and later calls see when it went."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graniteleaf.config import DEFAULT
from graniteleaf.sources.tables import ship

#: Microseconds that a waiting call adds to the end of the window, and the longest it waits before it looks again.
MARGIN, NAP = 250_000, 65_000_000
_OUT = "ts timestamp, tokens long, admitted timestamp"


def admission(now: int, spent: deque, want: int, budget: float, window: int, nap: int) -> int:
    """When a call that comes at `now` goes: as soon as nothing is spent in the window, or `want` fits with it. Looks again when the oldest spending ends, or after a nap. Ended spendings leave `spent`. Microseconds."""
    while True:
        while spent and now - spent[0][0] > window:
            spent.popleft()
        if not spent or sum(t for _, t in spent) + want <= budget:
            return now
        now += min(window - (now - spent[0][0]) + MARGIN, nap)


class _Queue:
    """The calls of one key, one after the other."""

    def __init__(self, window: int, budget: float, nap: int, last: int | None = None, spent: list[tuple[int, int]] = ()):
        self.window, self.budget, self.nap, self.last, self.spent = window, budget, nap, last, deque(spent)

    def go(self, at: int, want: int, budget: float | None = None) -> int:
        self.last = admission(at if self.last is None else max(at, self.last), self.spent, want, self.budget if budget is None else budget, self.window, self.nap)
        self.spent.append((self.last, want))
        return self.last


def admitted(calls: DataFrame, key: str = "model", id_col: str = "call_id", seconds: int = DEFAULT.window_seconds, limit: float = DEFAULT.tokens_per_minute, fraction: float = DEFAULT.usage_fraction, nap: int = NAP) -> DataFrame:
    """calls(key, id_col, ts, tokens) -> the same with `admitted`, the time at which each goes; calls of a key go in the order of ts and id.

    Each waits for the one before it, so a key's calls pass through one task, but as a sorted stream: the task holds a batch and the calls of one window. Rows with a null
    key are one key, those with a null time stay without admission and spend nothing, null tokens count as 0. A call over the whole budget goes when the window is empty.
    """
    ship(calls.sparkSession)
    kinds = dict(calls.dtypes)
    rows = calls.select(F.col(key).alias("k"), F.col(id_col).alias("i"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    window, budget = seconds * 1_000_000, limit * fraction

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, queue = None, None
        for batch in batches:
            out = []
            for k, at, tokens in zip(batch["k"].tolist(), batch["at"].tolist(), batch["tokens"].tolist(), strict=True):
                k = None if k != k else k
                if queue is None or k != own:
                    own, queue = k, _Queue(window, budget, nap)
                out.append(None if at is None or at != at else queue.go(int(at), tokens))
            yield batch[["k", "i", "ts", "tokens"]].assign(admitted=pd.Series(out, index=batch.index, dtype="Int64"))

    one = rows.repartition("k").sortWithinPartitions(F.col("k"), F.col("at"), F.col("i")).mapInPandas(run, f"k {kinds[key]}, i {kinds[id_col]}, ts timestamp, tokens long, admitted long")
    return one.select(F.col("k").alias(key), F.col("i").alias(id_col), "ts", "tokens", F.timestamp_micros("admitted").alias("admitted"))


class _Admission(StatefulProcessor):
    """State of a key: calls that came, calls that have their time, spendings of the window, and the last admission. Timers stand at the times of both kinds of calls."""

    def __init__(self, window: int, budget: float, nap: int, id_kind: str):
        self.settings, self.id_kind = (window, budget, nap), id_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.came = handle.getListState("came", f"at long, id {self.id_kind}, tokens long")
        self.due = handle.getListState("due", f"admitted long, at long, id {self.id_kind}, tokens long")
        self.spent = handle.getListState("spent", "at long, tokens long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for batch in rows:
            for at, i, tokens in zip(batch["at"].tolist(), batch["id"].tolist(), batch["tokens"].tolist(), strict=True):
                self.came.appendValue((at, i, tokens))
                times.add(-(-at // 1000))
        for ms in times:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        came = sorted(tuple(r) for r in self.came.get())
        ripe = [r for r in came if r[0] <= now]
        due = [tuple(r) for r in self.due.get()]
        if ripe:
            last = self.last.get()
            queue = _Queue(*self.settings, None if last is None else last[0], [tuple(r) for r in self.spent.get()])
            for at, i, tokens in ripe:
                due.append((queue.go(at, tokens), at, i, tokens))
                self.handle.registerTimer(-(-due[-1][0] // 1000))
            self._keep(self.came, came[len(ripe) :])
            self._keep(self.spent, list(queue.spent))
            self.last.update((queue.last,))
        gone = sorted(r for r in due if r[0] <= now)
        if ripe or gone:
            self._keep(self.due, [r for r in due if r[0] > now])
        if gone:
            times = {c: pd.to_datetime(pd.Series([r[n] for r in gone]), unit="us", utc=True) for c, n in (("ts", 1), ("admitted", 0))}
            yield pd.DataFrame({"key": [key[0]] * len(gone), "id": [r[2] for r in gone], "ts": times["ts"], "tokens": [r[3] for r in gone], "admitted": times["admitted"]})

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def admission_stream(calls: DataFrame, key: str = "model", id_col: str = "call_id", late: str = "10 seconds", seconds: int = DEFAULT.window_seconds, limit: float = DEFAULT.tokens_per_minute, fraction: float = DEFAULT.usage_fraction, nap: int = NAP) -> DataFrame:
    """A stream of calls(key, id_col, ts, tokens) -> the rows of admitted(), each sent when the watermark passes its admission.

    Calls wait until the watermark has passed their own time, so they are taken in order; what comes later than `late` is dropped by Spark. State is what
    waits and one window's spendings for each key. Rows without a time, key or tokens are left out. Needs the RocksDB state store, which is set for the session where nothing else is.
    """
    spark = calls.sparkSession
    ship(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(provider):
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(calls.dtypes)
    rows = calls.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("tokens").cast("long").alias("tokens")).dropna(subset=["key", "ts", "tokens"])
    out = rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_Admission(seconds * 1_000_000, limit * fraction, nap, kinds[id_col]), f"key {kinds[key]}, id {kinds[id_col]}, {_OUT}", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.col("id").alias(id_col), "ts", "tokens", "admitted")
