"""Labels as they mature and thresholds as they roll, in a stream of bars."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from .ordered import InOrder


def sign(x: float) -> int:
    return (x > 0) - (x < 0)  # 0 for NaN


class Reveal(InOrder):
    """State: the predictions whose label is not known yet, at most ``most``.  Each new bar is looked at by
    all of them: the first of opposite sign closes a prediction, and so does the last of ``most`` bars."""

    def __init__(self, most: int) -> None:
        super().__init__(("bar_id",))
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "bar_id bigint, pred double, close double, side int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = self.sorted_rows(key, rows)
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        out = []
        for bar, pred, close, imbalance in zip(fresh["bar_id"].tolist(), fresh["pred"].tolist(), fresh["close"].tolist(), fresh["imbalance"].tolist(), strict=True):
            side, still = sign(imbalance), []
            for one in waiting:
                began, said, paid, mine = one
                if side == -mine or bar - began >= self.most:
                    if close > 0:
                        out.append((key[0], began, bar, bar - began, said, math.log(close / paid) * 1e4))
                else:
                    still.append(one)
            waiting = still
            if side and close > 0:
                waiting.append((bar, pred, close, side))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["symbol", "bar_id", "known_at", "hold_bars", "pred", "y_variable"])


def reveal(bars: DataFrame, most: int = 12) -> DataFrame:
    """(symbol, bar_id, known_at, hold_bars, pred, y_variable) of a stream of bars with predictions (symbol,
    bar_id, pred, close, imbalance): each prediction once, in the trigger that has the bar at which its label
    is known (``known_at``).  Labels are those of ``operators.signals.label_variable_horizon``; bars
    that never get one (no imbalance or price, or none at the exit) have no row."""
    out = "symbol string, bar_id long, known_at long, hold_bars long, pred double, y_variable double"
    return bars.select("symbol", "bar_id", "pred", "close", "imbalance").groupBy("symbol").transformWithStateInPandas(Reveal(most), out, "append", "none")


class Rolling(InOrder):
    """State: the last ``n`` scores, a ring.  A trigger keeps a sorted copy beside it, so a row costs a
    binary search and not a sort."""

    def __init__(self, n: int, q: float, least: int) -> None:
        super().__init__(("bar_id",))
        self.n, self.q, self.least = n, q, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getValueState("ring", "place bigint, scores array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = self.sorted_rows(key, rows)
        place, scores = self.ring.get() if self.ring.exists() else (0, [])
        ring = [math.nan if x is None else x for x in scores]
        ordered = sorted(x for x in ring if x == x)
        limits = []
        for x in fresh["score"].astype(float).tolist():
            if len(ring) < self.n:
                ring.append(x)
            else:
                old, ring[place] = ring[place], x
                if old == old:
                    del ordered[bisect_left(ordered, old)]
            place = (place + 1) % self.n
            if x == x:
                insort(ordered, x)
            if len(ordered) < max(1, self.least):
                limits.append(math.nan)
                continue
            at = self.q * (len(ordered) - 1)
            low = int(at)
            limits.append(ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low))
        self.ring.update((place, [None if x != x else x for x in ring]))
        out = pd.DataFrame({"symbol": key[0], "bar_id": fresh["bar_id"], "score": fresh["score"], "threshold": limits})
        out["passed"] = out["score"] >= out["threshold"]
        yield out


def rolling_threshold(bars: DataFrame, n: int, q: float, least: int = 1) -> DataFrame:
    """(symbol, bar_id, score, threshold, passed) of a stream (symbol, bar_id, score): the ``q`` quantile of the
    last ``n`` scores, the row's own included, as ``rolled`` of ``operators.features`` has it; null under
    ``least`` scores.  The ring's place is that of the oldest score, so it may be full or not."""
    out = "symbol string, bar_id long, score double, threshold double, passed boolean"
    return bars.select("symbol", "bar_id", "score").groupBy("symbol").transformWithStateInPandas(Rolling(n, q, least), out, "append", "none")
