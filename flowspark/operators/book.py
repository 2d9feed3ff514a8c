"""Order-book features and reconstruction."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import EPS


def depth(side: str, n: int) -> Column:
    """Size of the first ``n`` levels; null if one of them is missing."""
    sizes = F.transform(F.slice(side, 1, n), lambda x: x["size"])
    whole = (F.size(sizes) == n) & ~F.exists(sizes, lambda x: x.isNull())
    return F.when(whole, F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x))


def ladder_features(book: DataFrame) -> DataFrame:
    """Imbalance and depth of the first levels, spread, and the price weighted by the opposite sizes."""
    b = {n: depth("bids", n) for n in (1, 5, 10)}
    a = {n: depth("asks", n) for n in (1, 5, 10)}
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    mid = (bid + ask) / 2
    imbalance = {f"ob_imb_l{n}": (b[n] - a[n]) / (b[n] + a[n] + 2 * EPS) for n in (1, 5, 10)}
    ratio = {f"ob_depth_ratio_{n}": b[n] / (a[n] + 2 * EPS) for n in (5, 10)}
    micro = (bid * a[1] + ask * b[1]) / (b[1] + a[1] + 2 * EPS)
    rest = {"mid": mid, "ob_spread": ask - bid, "ob_spread_rel": (ask - bid) / (mid + 2 * EPS), "ob_microprice_adj": micro - mid, "ob_total_depth_5": b[5] + a[5]}
    return book.select("symbol", "ts_ms", *[c.alias(n) for n, c in (imbalance | ratio | rest).items()])


def thinned(messages: DataFrame, every_ms: int) -> DataFrame:
    """(symbol, dt, ts_ms, seq) of the messages after which a sample is taken: from a day's first snapshot
    on, each that is ``every_ms`` or more after the one taken before.  Only times are looked at."""

    def run(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values(["ts_ms", "seq"])
        day = day[(day["type"] == "snapshot").cumsum() > 0]
        last, keep = None, []
        for t in day["ts_ms"].tolist():
            keep.append(last is None or t - last >= every_ms)
            last = t if keep[-1] else last
        return day.loc[keep, ["symbol", "dt", "ts_ms", "seq"]]

    return messages.select("symbol", "dt", "ts_ms", "seq", "type").groupBy("symbol", "dt").applyInPandas(run, "symbol string, dt date, ts_ms long, seq long")


def reconstruct(messages: DataFrame, every_ms: int, levels: int = 25) -> DataFrame:
    """(symbol, dt, ts_ms, bids, asks) samples from messages (symbol, dt, ts_ms, seq, type, b, a).

    A snapshot replaces the book, a delta sets sizes (none removes a level); deltas before the first
    snapshot of a day count nothing.  After a message a sample is taken if the last one is ``every_ms``
    or more back.  A book depends on nothing before its snapshot, so each stretch from one snapshot to
    the next is a group of its own.
    """
    side = "array<struct<price:double,size:double>>"
    along = Window.partitionBy("symbol", "dt").orderBy("ts_ms", "seq")
    place = messages.select("symbol", "dt", "ts_ms", "seq", F.sum((F.col("type") == "snapshot").cast("int")).over(along).alias("_stretch"))
    marks = place.filter("_stretch > 0").join(thinned(messages, every_ms).withColumn("_taken", F.lit(True)), ["symbol", "dt", "ts_ms", "seq"], "left")
    parts = messages.join(marks, ["symbol", "dt", "ts_ms", "seq"]).withColumn("_taken", F.coalesce("_taken", F.lit(False)))

    def run(stretch: pd.DataFrame) -> pd.DataFrame:
        book: tuple[dict, dict] = ({}, {})
        out = []
        for symbol, dt, ts_ms, b, a, taken in stretch.itertuples(index=False, name=None):
            for levels_of, changes in zip(book, (b, a), strict=True):
                for change in changes if changes is not None else []:
                    if change["size"] > 0:
                        levels_of[change["price"]] = change["size"]
                    else:
                        levels_of.pop(change["price"], None)
            if taken:
                best = [heapq.nlargest(levels, book[0].items()), heapq.nsmallest(levels, book[1].items())]
                out.append((symbol, dt, ts_ms, *[[{"price": p, "size": s} for p, s in x] for x in best]))
        return pd.DataFrame(out, columns=["symbol", "dt", "ts_ms", "bids", "asks"])

    def ordered(stretch: pd.DataFrame) -> pd.DataFrame:
        return run(stretch.sort_values(["ts_ms", "seq"])[["symbol", "dt", "ts_ms", "b", "a", "_taken"]])

    return parts.groupBy("symbol", "dt", "_stretch").applyInPandas(ordered, f"symbol string, dt date, ts_ms long, bids {side}, asks {side}")
