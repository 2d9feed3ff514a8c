"""Row features of bars and rolling statistics; every frame has a bounded length."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .joins import within
from .ordering import EPS, at_least, in_blocks, rolling

# The features of a model in their order, those that are ranked, those with lags.
RANKED = ("ret1vb_bp", "retHvb_bp", "range1vb_bp", "cur_vol_vb_bp", "kyle_lambda", "roll_spread", "vpin_delta")
FEATURES = (
    *("ret1vb_bp", "retHvb_bp", "range1vb_bp", "close_pos1vb", "close_vs_vwap", "pde"),
    *("cur_vol_vb_bp", "vol_ratio"),
    *("taker_imb1vb", "par", "twi", "large_imb_share", "vpin_n", "vpin_delta"),
    *("rev_count_ratio", "entropy_norm", "kyle_lambda", "roll_spread"),
    *("dt_sec_z", "trade_count_z", "tca", "burst_cv"),
    *(f"{c}_pctrank" for c in RANKED),
)
LAGGED = (
    *("taker_imb1vb", "par", "twi", "large_imb_share", "vpin_delta"),
    *("ret1vb_bp", "range1vb_bp", "pde", "close_pos1vb"),
    *("vol_ratio", "dt_sec_z", "kyle_lambda", "roll_spread"),
    *("ret1vb_bp_pctrank", "range1vb_bp_pctrank", "kyle_lambda_pctrank", "roll_spread_pctrank", "vpin_delta_pctrank"),
)


# The features of rows at grid times, in the reference data's order and names.
GRID_BARS = (
    "ret1_bp", "retH_bp", "range_bp", "close_pos", "close_vs_vwap", "taker_imb", "pde", "kyle_lambda", "roll_spread", "large_imb_share", "entropy_norm",
    "burst_cv", "trade_count", "mid_size_share", "rev_count_ratio", "par", "twi", "vpin_delta", "tca", "dt_sec", "dt_sec_z", "trade_count_z",
)
GRID_ROLLING = ("cur_vol_bp", "vol_ratio", "vpin_N", "ret1_bp_pctrank", "retH_bp_pctrank", "range_bp_pctrank", "cur_vol_bp_pctrank", "kyle_lambda_pctrank", "roll_spread_pctrank", "vpin_delta_pctrank")
GRID_LAGGED = (
    "taker_imb", "pde", "kyle_lambda", "roll_spread", "ret1_bp", "range_bp", "close_pos", "close_vs_vwap", "large_imb_share", "entropy_norm",
    "burst_cv", "trade_count", "mid_size_share", "rev_count_ratio", "par", "twi", "vpin_delta", "tca",
)
GRID_BOOK = ("ob_imb_l1", "ob_imb_l5", "ob_imb_l10", "ob_depth_ratio_5", "ob_depth_ratio_10", "ob_spread", "ob_spread_rel", "ob_microprice_adj", "ob_total_depth_5")
GRID_BOOK_RANKED = ("ob_spread", "ob_spread_rel", "ob_total_depth_5", "ob_microprice_adj")


def rolled(df: DataFrame, wanted: dict[str, tuple], keys: Sequence[str] = ("symbol",), order: str = "bar_id", block: int = 8192) -> DataFrame:
    """Add rolling order statistics: name -> (statistic, column, rows, least values[, q]).

    ``rank``: average rank of the current value among the frame's, as a share of them; ``median``;
    ``quantile`` at ``q``; ``spearman`` of the frame's values of a pair of columns.  Null below the least
    number of values.  Rows are dealt to blocks of consecutive rows, each with the rows before it that its
    frames see; a block is one sorted pass with a sorted window.
    """
    at = F.col(order)
    back = max(w[2] for w in wanted.values())
    copies = df.withColumn("_block", F.explode(F.sequence(F.floor(at / block), F.floor((at + back) / block))))
    schema = StructType([*copies.schema.fields, *[StructField(name, DoubleType()) for name in wanted]])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        read = lambda c: pd.Series(part.column(c).to_numpy()).astype(float)
        for name, (kind, column, n, least, *q) in wanted.items():
            if kind == "spearman":
                found = rolling_spearman(read(column[0]).to_numpy(), read(column[1]).to_numpy(), n, least)
            else:
                frame = read(column).rolling(n, min_periods=max(1, least))
                found = frame.rank(pct=True) if kind == "rank" else frame.median() if kind == "median" else frame.quantile(q[0])
            part = part.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
        return part

    return copies.groupBy(*keys, "_block").applyInArrow(run, schema).filter(F.col("_block") == F.floor(at / block)).drop("_block")


def rolling_spearman(a: np.ndarray, b: np.ndarray, n: int, least: int, step: int = 256) -> np.ndarray:
    """Rank correlation over the pairs without a gap among the last ``n`` rows; NaN for a constant."""
    both = ~(np.isnan(a) | np.isnan(b))
    pad = lambda x: np.concatenate([np.full(n - 1, np.nan), np.where(both, x, np.nan)])
    out = np.full(len(a), np.nan)
    wa, wb = (np.lib.stride_tricks.sliding_window_view(pad(x), n) for x in (a, b))
    for at in range(0, len(a), step):
        ranks = []
        for w in (wa[at : at + step], wb[at : at + step]):
            ordered = np.sort(w, axis=1)  # gaps come last
            low = np.stack([np.searchsorted(o, v, "left") for o, v in zip(ordered, w, strict=True)])
            high = np.stack([np.searchsorted(o, v, "right") for o, v in zip(ordered, w, strict=True)])
            ranks.append(np.where(np.isnan(w), np.nan, (low + high + 1) / 2.0))
        count = (~np.isnan(ranks[0])).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            x, y = (r - (np.nansum(r, axis=1) / count)[:, None] for r in ranks)
            value = np.nansum(x * y, axis=1) / np.sqrt(np.nansum(x * x, axis=1) * np.nansum(y * y, axis=1))
        out[at : at + step] = np.where(count >= max(least, 3), value, np.nan)
    return out


def robust_z(df: DataFrame, wanted: dict[str, str], n: int, least: int) -> DataFrame:
    """Output name -> column: distance from the rolling median in scaled rolling medians of such distances."""
    mids = rolled(df, {f"_mid_{out}": ("median", c, n, least) for out, c in wanted.items()})
    away = mids.withColumns({f"_dev_{out}": F.abs(F.col(c) - F.col(f"_mid_{out}")) for out, c in wanted.items()})
    spread = rolled(away, {f"_mad_{out}": ("median", f"_dev_{out}", n, least) for out in wanted})
    z = {out: (F.col(c) - F.col(f"_mid_{out}")) / F.nullif(1.4826 * F.col(f"_mad_{out}"), F.lit(0.0)) for out, c in wanted.items()}
    return spread.withColumns(z).drop(*[f"_{k}_{out}" for out in wanted for k in ("mid", "dev", "mad")])


def pace(bars: DataFrame, scale: int = 18) -> DataFrame:
    """``dt_sec_z`` and ``trade_count_z``: robust z of the logs of a bar's time and trades."""
    n = max(10, 4 * scale)
    logs = {f"_log_{c}": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in ("dt_sec", "trade_count")}
    return robust_z(bars.withColumns(logs), {"dt_sec_z": "_log_dt_sec", "trade_count_z": "_log_trade_count"}, n, max(5, n // 4)).drop(*logs)


def volatility_ratio(bars: DataFrame, scale: int = 18) -> DataFrame:
    """``vol_ratio``: smoothed size of returns over a short span against that over a long one.  Needs
    ``ret1vb_bp``."""
    short, long = max(5, scale // 2), max(10, scale)
    df = bars.withColumn("_a", F.abs("ret1vb_bp"))
    df = ewma(ewma(df, "_a", "_short", 2.0 / (short + 1)), "_a", "_long", 2.0 / (long + 1))
    return df.withColumn("vol_ratio", F.col("_short") / (F.col("_long") + 2 * EPS)).drop("_a", "_short", "_long")


def percent_ranks(df: DataFrame, columns: Sequence[str] = RANKED, n: int = 500) -> DataFrame:
    """``<column>_pctrank`` of each column among the last ``n`` rows."""
    return rolled(df, {f"{c}_pctrank": ("rank", c, n, max(10, n // 10)) for c in columns})


def other_instrument(bars: DataFrame, other: DataFrame) -> DataFrame:
    """Bars (symbol, bar_id, ts_first, ts_ms, ...) with what another instrument's ticks did from a bar's first tick to
    its last, both included: ``other_n`` ticks, ``other_imb`` (0 without lots), ``other_ret_bp`` (0 if its first price is
    none), ``other_path`` (distance over net flow) and ``other_total`` lots; null for a bar without any.

    ``other`` has the bars' symbol: ticks meet bars by slices of time."""
    spans = bars.select("symbol", "bar_id", "ts_first", F.col("ts_ms").alias("ts_last"))
    met = within(spans, other.select("symbol", "ts_ms", "seq", "price", "lots", "is_buyer_maker"), "ts_first", "ts_last")
    bar = Window.partitionBy("symbol", "bar_id").orderBy("point_ts", "seq")
    signed = F.when(F.col("is_buyer_maker"), -F.col("lots")).otherwise(F.col("lots"))
    met = met.withColumns({"_step": F.abs(F.col("price") - F.lag("price").over(bar)), "_s": signed, "_at": F.struct("point_ts", "seq")})
    first, last, total, net = F.min_by("price", "_at"), F.max_by("price", "_at"), F.sum("lots"), F.sum("_s")
    one = met.groupBy("symbol", "bar_id").agg(
        F.count(F.lit(1)).alias("other_n"),
        F.when(total > EPS, net / total).otherwise(0.0).alias("other_imb"),
        F.when(first > EPS, (last - first) / first * 1e4).otherwise(0.0).alias("other_ret_bp"),
        (F.coalesce(F.sum("_step"), F.lit(0.0)) / (F.abs(net) + EPS)).alias("other_path"),
        total.alias("other_total"),
    )
    return bars.join(one, ["symbol", "bar_id"], "left")


def grid_feature_names(lags: int = 2, book: bool = True) -> list[str]:
    """The columns of a model of rows at grid times, in their order: bars, what rolls, the book, lags."""
    names = [*GRID_BARS, *GRID_ROLLING] + ([*(f"{c}_close" for c in GRID_BOOK), "ob_mid_price", *(f"{c}_close_pctrank" for c in GRID_BOOK_RANKED)] if book else [])
    lagged = [*GRID_LAGGED, *(f"{c}_close" for c in GRID_BOOK if book)]
    return names + [f"{c}_lag{k}" for c in lagged for k in range(1, lags + 1)]


def divergence(df: DataFrame, other_imb: str = "other_imb", other_ret: str = "other_ret_bp") -> DataFrame:
    """The other instrument's imbalance and return less a bar's own."""
    return df.withColumns({"imb_divergence": F.col(other_imb) - F.col("taker_imb1vb"), "ret_divergence": F.col(other_ret) - F.col("ret1vb_bp")})


def feature_names(lags: int = 0) -> list[str]:
    """The columns of a model in their order."""
    return [*FEATURES, *[f"{c}_lag{k}" for c in LAGGED for k in range(1, lags + 1)]]


def bar_features(bars: DataFrame, lags_: int = 0, rank_rows: int = 500, scale: int = 18) -> DataFrame:
    """``bars`` with every column of :func:`feature_names`."""
    df = current_volatility(vpin(trade_activity(returns(bars, scale), scale), scale), scale)
    df = percent_ranks(pace(volatility_ratio(df, scale), scale), RANKED, rank_rows)
    return lags(df, list(LAGGED), lags_) if lags_ else df


def ewma(df: DataFrame, column: str, out: str, alpha: float, block: int = 8192) -> DataFrame:
    """Exponentially weighted mean, seeded by the first value.

    Blocks start so many rows early that what they miss weighs less than 1e-18.
    """
    back = math.ceil(math.log(1e-18) / math.log(1 - alpha))
    at = F.col("bar_id")
    copies = df.withColumn("_block", F.explode(F.sequence(F.floor(at / block), F.floor((at + back) / block))))
    schema = StructType([*copies.schema.fields, StructField(out, DoubleType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_id")
        return part.assign(**{out: part[column].ewm(alpha=alpha, adjust=False).mean()})

    return copies.groupBy("symbol", "_block").applyInPandas(run, schema).filter(F.col("_block") == F.floor(at / block)).drop("_block")


def returns(bars: DataFrame, lag: int = 18) -> DataFrame:
    """Returns over one and ``lag`` bars in basis points, place of the close in the bar, taker imbalance,
    close against average price."""

    def step(w: WindowSpec) -> dict[str, Column]:
        def back(k: int) -> Column:
            return F.lag("close", k).over(w)

        high_low = F.col("high") - F.col("low")
        both = F.col("taker_buy_vol") + F.col("taker_sell_vol")
        return {
            "ret1vb_bp": (F.col("close") - back(1)) / (back(1) + EPS) * 1e4,
            "retHvb_bp": (F.col("close") - back(lag)) / (back(lag) + EPS) * 1e4,
            "close_pos1vb": F.when(F.abs(high_low) < EPS, 0.0).otherwise((F.col("close") - F.col("low")) / high_low - 0.5),
            "taker_imb1vb": (F.col("taker_buy_vol") - F.col("taker_sell_vol")) / (both + 2 * EPS),
            "close_vs_vwap": (F.col("close") - F.col("vwap")) / F.greatest(high_low, F.lit(EPS)),
        }

    return in_blocks(bars, step, back=lag)


def vpin(bars: DataFrame, scale: int = 18) -> DataFrame:
    """Share of one-sided volume in the last bars, and its change."""
    n = max(10, scale)
    least = max(3, n // 4)
    apart = F.abs(F.col("taker_buy_vol") - F.col("taker_sell_vol"))
    steps = [
        lambda w: {"vpin_n": at_least(apart, rolling(w, n), least, F.sum(apart).over(rolling(w, n)) / (F.sum("volume").over(rolling(w, n)) + EPS))},
        lambda w: {"vpin_delta": F.col("vpin_n") - F.lag("vpin_n").over(w)},
    ]
    return in_blocks(bars, steps, back=n + 1)


def trade_activity(bars: DataFrame, scale: int = 18) -> DataFrame:
    """Log of the trade count against its rolling mean."""
    count = F.col("trade_count").cast("double")

    def step(w: WindowSpec) -> dict[str, Column]:
        mean = at_least(count, rolling(w, scale), max(3, scale // 4), F.avg(count).over(rolling(w, scale)))
        return {"tca": F.when(mean.isNotNull(), F.log(F.greatest(count, F.lit(EPS))) - F.log(F.greatest(mean, F.lit(EPS))))}

    return in_blocks(bars, step, back=scale)


def current_volatility(bars: DataFrame, scale: int = 18) -> DataFrame:
    """The larger of the root mean square log return and the mean range, in basis points; null if either is."""
    n = max(10, scale)
    least = max(3, n // 4)
    r = F.col("_r")

    def second(w: WindowSpec) -> dict[str, Column]:
        frame = rolling(w, n)
        rms = at_least(r, frame, least, F.sqrt(F.avg(r * r).over(frame)))
        span = at_least(F.col("range1vb_bp"), frame, least, F.avg("range1vb_bp").over(frame))
        return {"cur_vol_vb_bp": F.when(rms.isNotNull() & span.isNotNull(), F.greatest(rms, span))}

    return in_blocks(bars, [lambda w: {"_r": F.log(F.col("close") / F.lag("close").over(w)) * 1e4}, second], back=n + 1).drop("_r")


def lags(bars: DataFrame, columns: list[str], n: int) -> DataFrame:
    return in_blocks(bars, lambda w: {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, n + 1)}, back=n)


def streak(df: DataFrame, column: str, out: str = "streak") -> DataFrame:
    """Rows since the sign of ``column`` last changed; 0 for no sign and for a first row.

    A streak has no greatest length, so islands are numbered by a running count of breaks over
    slices, and rows are numbered in their island.
    """
    from pyspark.sql import Window

    from .ordering import running_sum

    marked = in_blocks(df.withColumn("_s", F.signum(F.coalesce(column, F.lit(0.0)))), lambda w: {"_break": F.when((F.col("_s") != 0) & (F.col("_s") == F.lag("_s").over(w)), 0).otherwise(1)}, back=1)
    islands = running_sum(marked.withColumn("_slice", F.floor(F.col("bar_id") / 8192)), "_break", "_island", slice_by="_slice", order=("bar_id",))
    place = F.row_number().over(Window.partitionBy("symbol", "_island").orderBy("bar_id")) - 1
    return islands.withColumn(out, place.cast("long")).drop("_s", "_break", "_slice", "_island")
