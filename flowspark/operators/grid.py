"""Rows at grid times: the last bar's features, those of the bars before it, the book at each bar, and
what they miss taken from earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import GRID_BARS, GRID_BOOK, GRID_LAGGED, current_volatility, grid_feature_names, pace, percent_ranks, trade_activity, volatility_ratio, vpin
from .joins import asof, within
from .ordering import EPS, in_blocks, running_sum

GRID = ("symbol", "grid_ms")
BOOK = ("ob_imb_l1", "ob_imb_l5", "ob_imb_l10", "ob_depth_ratio_5", "ob_depth_ratio_10", "ob_spread", "ob_spread_rel", "ob_microprice_adj", "ob_total_depth_5")


def bar_columns(bars: DataFrame) -> DataFrame:
    """Bars of grid times (symbol, grid_ms, bar_idx, ...) with ``taker_imb``, ``close_pos``, ``ret1_bp``,
    ``close_vs_vwap`` and ``range_bp``; the first bar of a time has no return."""
    span = F.col("high") - F.col("low")
    before = F.lag("close").over(Window.partitionBy(*GRID).orderBy("bar_idx"))
    bought, sold = F.col("taker_buy_vol"), F.col("taker_sell_vol")
    return bars.withColumns(
        {
            "taker_imb": (bought - sold) / (bought + sold + EPS),
            "close_pos": F.when(F.abs(span) >= EPS, (F.col("close") - F.col("low")) / span - 0.5),
            "ret1_bp": F.when(before > EPS, (F.col("close") - before) / (before + EPS) * 1e4),
            "close_vs_vwap": F.when(before.isNotNull(), (F.col("close") - F.col("vwap")) / F.greatest(span, F.lit(EPS))),
            "range_bp": F.col("range1vb_bp"),
        }
    )


def book_at_bars(bars: DataFrame, ladder: DataFrame, tolerance: int, columns: Sequence[str] = BOOK) -> DataFrame:
    """Each bar with the book at its end: the last snapshot not more than ``tolerance`` ms back, as
    ``<column>_close``, and its time ``book_ts``."""
    met = asof(bars, ladder, columns, tolerance=tolerance)
    return met.withColumnsRenamed({c: f"{c}_close" for c in columns} | {"right_ts": "book_ts"})


def book_over_bars(bars: DataFrame, ladder: DataFrame, columns: Sequence[str] = BOOK) -> DataFrame:
    """``<column>_close``, ``_mean`` and ``_delta``: last, mean, and last less first snapshot from a bar's
    first tick to its last, both included; null for a bar without any."""
    met = within(bars.select("symbol", "bar_id", "ts_first", F.col("ts_ms").alias("ts_last")), ladder, "ts_first", "ts_last")
    last, first = (lambda c: F.max_by(c, "point_ts")), (lambda c: F.min_by(c, "point_ts"))
    measured = met.groupBy("symbol", "bar_id").agg(*[f for c in columns for f in (last(c).alias(f"{c}_close"), F.avg(c).alias(f"{c}_mean"), (last(c) - first(c)).alias(f"{c}_delta"))])
    return bars.join(measured, ["symbol", "bar_id"], "left")


def rows(bars: DataFrame, columns: Sequence[str], lagged: Sequence[str], lags: int) -> DataFrame:
    """One row for each grid time: ``columns`` of its last bar and ``<column>_lag<k>`` of the bars before;
    null where there are fewer bars.  ``bar_id`` numbers the rows of an instrument."""
    last = F.max("bar_idx").over(Window.partitionBy(*GRID))
    placed = bars.withColumn("_k", last - F.col("bar_idx"))
    at = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    one = placed.groupBy(*GRID).agg(*[at(c, 0).alias(c) for c in columns], *[at(c, k).alias(f"{c}_lag{k}") for c in lagged for k in range(1, lags + 1)])
    day = one.withColumns({"_day": F.floor(F.col("grid_ms") / 86_400_000), "_one": F.lit(1)})
    return running_sum(day, "_one", "bar_id", slice_by="_day", order=("grid_ms",)).withColumn("bar_id", F.col("bar_id") - 1).drop("_day", "_one")


def fill_lags(grid: DataFrame, columns: Sequence[str], lags: int) -> DataFrame:
    """``<column>_lag<k>``, where missing, from the row ``k`` grid times earlier."""

    def step(w):
        earlier = lambda c, k: F.lag(c, k).over(w)
        return {f"{c}_lag{k}": F.coalesce(F.col(f"{c}_lag{k}"), earlier(c, k)) if f"{c}_lag{k}" in grid.columns else earlier(c, k) for c in columns for k in range(1, lags + 1)}

    return in_blocks(grid, step, back=lags)


def horizon_return(grid: DataFrame, ticks: DataFrame, horizon_ms: int, gap_ms: int = 5000) -> DataFrame:
    """(symbol, grid_ms, y_horizon): log return in basis points from the last tick at a grid time to the
    last at ``horizon_ms`` later; null if that tick is ``gap_ms`` or more before the horizon."""
    now = asof(grid.select("symbol", "grid_ms", F.col("grid_ms").alias("ts_ms")), ticks, ["seq", "price"]).select("symbol", "grid_ms", F.col("price").alias("_now"), (F.col("ts_ms") + horizon_ms).alias("ts_ms"))
    then = asof(now, ticks, ["seq", "price"])
    good = (F.col("ts_ms") - F.col("right_ts") < gap_ms) & (F.col("_now") > EPS) & (F.col("price") > EPS)
    return then.select("symbol", "grid_ms", F.when(good, F.log(F.col("price") / F.col("_now")) * 1e4).alias("y_horizon"))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the columns that it lacks, null."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def grid_features(bars: DataFrame, ladder: DataFrame, lags_: int = 2, tolerance: int = 60_000, scale: int = 18, rank_rows: int = 500) -> DataFrame:
    """Rows at grid times with every column of ``features.grid_feature_names``, from bars of grid times and the
    book's features; ``bar_id`` numbers the rows of an instrument.

    Measures of a time's last bar come with it; what rolls (volatility, VPIN, pace, ranks) does so over rows.
    """
    met = book_at_bars(bar_columns(bars), ladder.withColumnRenamed("mid", "ob_mid"), tolerance, [*GRID_BOOK, "ob_mid"])
    book = [f"{c}_close" for c in GRID_BOOK]
    late = {"vpin_delta", "tca", "dt_sec_z", "trade_count_z", "retH_bp"}
    own = [c for c in GRID_BARS if c not in late]
    raw = ["open", "high", "low", "close", "vwap", "volume", "taker_buy_vol", "taker_sell_vol", "range1vb_bp"]
    lagged = [c for c in GRID_LAGGED if c not in late]
    one = rows(met, [*own, *raw, *book, "ob_mid_close"], [*lagged, *book], lags_).withColumn("ts_ms", F.col("grid_ms"))
    one = one.withColumnsRenamed({"ob_mid_close": "ob_mid_price"}).withColumn("ret1vb_bp", F.col("ret1_bp"))
    one = current_volatility(vpin(trade_activity(one, scale), scale), scale).withColumnsRenamed({"vpin_n": "vpin_N", "cur_vol_vb_bp": "cur_vol_bp"})
    one = pace(volatility_ratio(one, scale), scale)
    one = in_blocks(one, lambda w: {"retH_bp": (F.col("close") - F.lag("close", scale).over(w)) / (F.lag("close", scale).over(w) + EPS) * 1e4}, back=scale)
    ranked = [c.removesuffix("_pctrank") for c in grid_feature_names(0) if c.endswith("_pctrank")]
    one = fill_lags(percent_ranks(one, ranked, rank_rows), [c for c in GRID_LAGGED if c in late] if lags_ else [], lags_)
    return one.select(*GRID, "bar_id", *grid_feature_names(lags_))


def head(df: DataFrame, n: int, order: str = "bar_id") -> DataFrame:
    """The first ``n`` rows of each instrument, by their number."""
    return df.filter(F.col(order) < n)
