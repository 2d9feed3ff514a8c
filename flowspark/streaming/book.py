"""The order book from a stream of messages.

Two stateful operators: one numbers the stretches from snapshot to snapshot of an instrument's day and
picks the messages to sample at; it looks at times and types only.  The other holds a book as state, a
map from price to size for each side, keyed by instrument, day *and* stretch: a snapshot begins a
new key with an empty book, so stretches that arrive together are rebuilt by different tasks.
State is cleared when the watermark has passed the day.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ordered import InOrder

SIDE = "array<struct<price:double,size:double>>"
MARKED = f"symbol string, dt date, stretch long, at timestamp, ts_ms long, seq long, b {SIDE}, a {SIDE}, taken boolean"
SAMPLES = f"symbol string, dt date, ts_ms long, bids {SIDE}, asks {SIDE}"


def levels(side) -> list[tuple[float, float]]:
    return [(x["price"], x["size"]) for x in side if x["price"] is not None and x["size"] is not None] if side is not None else []


class Stretches(InOrder):
    """Number the stretches and mark the messages at which a sample is due.  State: the stretch, and the
    time of the last sample."""

    def __init__(self, every_ms: int) -> None:
        super().__init__(("ts_ms", "seq"))
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", "stretch bigint, sampled bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = self.sorted_rows(key, rows)
        stretch, sampled = self.place.get() if self.place.exists() else (0, None)
        numbers, taken = [], []
        for ts_ms, kind in zip(fresh["ts_ms"].tolist(), fresh["type"].tolist(), strict=True):
            stretch += kind == "snapshot"
            due = stretch > 0 and (sampled is None or ts_ms - sampled >= self.every_ms)
            sampled = ts_ms if due else sampled
            numbers.append(stretch)
            taken.append(due)
        self.place.update((stretch, sampled))
        self.end_of_day(int(fresh["ts_ms"].iloc[-1]))
        out = fresh.assign(stretch=numbers, taken=taken)
        yield out[out["stretch"] > 0][["symbol", "dt", "stretch", "at", "ts_ms", "seq", "b", "a", "taken"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.place.clear()
        self.last.clear()
        return iter([])


class Books(StatefulProcessor):
    """Apply messages to the stretch's book.  A trigger reads the state once and writes back what changed."""

    def __init__(self, depth: int) -> None:
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sides = [handle.getMapState(name, "price double", "size double") for name in ("bids", "asks")]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        before = [{k[0]: v[0] for k, v in side.iterator()} if side.exists() else {} for side in self.sides]
        book = [dict(side) for side in before]
        out = []
        for ts_ms, b, a, taken in zip(fresh["ts_ms"], fresh["b"], fresh["a"], fresh["taken"], strict=True):
            for side, changes in zip(book, (b, a), strict=True):
                for price, size in levels(changes):
                    if size > 0:
                        side[price] = size
                    else:
                        side.pop(price, None)
            if taken:
                best = (heapq.nlargest(self.depth, book[0].items()), heapq.nsmallest(self.depth, book[1].items()))
                out.append((key[0], key[1], ts_ms, *([{"price": p, "size": s} for p, s in x] for x in best)))
        for state, old, new in zip(self.sides, before, book, strict=True):
            for price in old.keys() - new.keys():
                state.removeKey((price,))
            for price, size in new.items():
                if old.get(price) != size:
                    state.updateValue((price,), (size,))
        last = int(fresh["ts_ms"].iloc[-1])
        self.handle.registerTimer((last // 86_400_000 + 1) * 86_400_000)
        yield pd.DataFrame(out, columns=["symbol", "dt", "ts_ms", "bids", "asks"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for side in self.sides:
            side.clear()
        return iter([])

    def close(self) -> None:
        pass


def reconstruct(messages: DataFrame, every_ms: int, depth: int = 25, late: str = "1 hour") -> DataFrame:
    """(symbol, dt, ts_ms, bids, asks) from a stream of messages (symbol, dt, ts_ms, seq, type, b, a).

    The rows are those of the batch operator of the same name in ``operators.book``.  Messages of an
    instrument's day must arrive in order; a trigger sorts its own.
    """
    rows = messages.select("symbol", "dt", F.timestamp_millis("ts_ms").alias("at"), "ts_ms", "seq", "type", "b", "a").withWatermark("at", late)
    marked = rows.groupBy("symbol", "dt").transformWithStateInPandas(Stretches(every_ms), MARKED, "append", "eventTime", eventTimeColumnName="at")
    return marked.groupBy("symbol", "dt", "stretch").transformWithStateInPandas(Books(depth), SAMPLES, "append", "eventTime")
