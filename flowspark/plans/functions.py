"""Table functions for ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from flowspark.operators.ordering import running_sum

NEEDED = {"symbol", "slice", "upto", "ts_ms", "seq", "price", "lots", "is_buyer_maker"}
RESULT = "symbol string, bar_id long, ts_first long, ts_ms long, trade_count long, open double, high double, low double, close double, vwap double, taker_buy_vol double, taker_sell_vol double"
#: Bars of a slice.
BARS = 64


def by_slices(ticks: DataFrame, volume: int, bars: int = BARS) -> DataFrame:
    """Ticks with their running lots ``upto``, once for each slice of ``bars`` bars that they reach into.

    A slice knows from ``upto`` where it starts, and no bar reaches over its end, so slices are independent.
    """
    upto = running_sum(ticks.filter("lots > 0"), "lots", "upto")
    size = F.lit(volume * bars)
    slices = F.sequence(F.floor((F.col("upto") - F.col("lots")) / size), F.ceil(F.col("upto") / size) - 1)
    return upto.select("symbol", F.explode(slices).alias("slice"), "upto", "ts_ms", "seq", "price", "lots", "is_buyer_maker")


@arrow_udtf(returnType=RESULT)
class VolumeBars:
    """``volume_bars(TABLE (...) PARTITION BY (symbol, slice) ORDER BY (ts_ms, seq), volume [, bars])``: full bars
    of ``volume`` lots from a table like that of :func:`by_slices`, cut to slices of ``bars`` bars (64).

    A partition is one slice, a bounded number of lots, and is read in Arrow batches.
    """

    def __init__(self) -> None:
        self.held: list[pa.RecordBatch] = []
        self.sizes: tuple[int, int] = (0, BARS)

    def eval(self, ticks: pa.RecordBatch, volume: pa.Array, bars: pa.Array | None = None) -> Iterator[pa.Table]:
        if ticks.num_rows:
            if gaps := NEEDED - set(ticks.schema.names):
                raise ValueError(f"the table of volume_bars lacks {', '.join(sorted(gaps))}")
            if volume[0].as_py() is None or volume[0].as_py() < 1:
                raise ValueError("the volume of a bar must be a positive whole number")
            self.held.append(ticks)
            self.sizes = (volume[0].as_py(), bars[0].as_py() if bars is not None else BARS)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if not self.held:
            return
        rows, (volume, bars) = pa.Table.from_batches(self.held), self.sizes
        read = lambda c: rows.column(c).to_numpy()
        upto, lots, price, ts, maker = (read(c) for c in ("upto", "lots", "price", "ts_ms", "is_buyer_maker"))
        first = rows.column("slice")[0].as_py() * bars
        # Pieces of ticks in the bars of this slice.
        low, high = np.maximum((upto - lots) // volume, first), np.minimum((upto - 1) // volume, first + bars - 1)
        spans = np.maximum(high - low + 1, 0)
        at = np.repeat(np.arange(len(upto)), spans)
        bar = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(spans) - spans, spans)
        fill = np.minimum(upto[at], (bar + 1) * volume) - np.maximum(upto[at] - lots[at], bar * volume)
        starts = np.flatnonzero(np.concatenate([[True], bar[1:] != bar[:-1]]))
        total = lambda x: np.add.reduceat(x, starts)
        full = total(fill) == volume
        ends = np.append(starts[1:], len(bar)) - 1
        bought = total(np.where(maker[at].astype(bool), 0, fill)).astype(float)
        out = {"bar_id": bar[starts], "ts_first": ts[at][starts], "ts_ms": ts[at][ends], "trade_count": ends - starts + 1}
        out |= {"open": price[at][starts], "high": np.maximum.reduceat(price[at], starts), "low": np.minimum.reduceat(price[at], starts), "close": price[at][ends]}
        out |= {"vwap": total(price[at] * fill) / volume, "taker_buy_vol": bought, "taker_sell_vol": volume - bought}
        symbol = pa.array([rows.column("symbol")[0].as_py()] * int(full.sum()), pa.string())
        yield pa.table({"symbol": symbol} | {n: pa.array(v[full]) for n, v in out.items()})


def register(spark: SparkSession) -> None:
    spark.udtf.register("volume_bars", VolumeBars)
