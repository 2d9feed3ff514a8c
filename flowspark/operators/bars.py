"""Volume bars: ticks cut into bars of exactly ``volume`` lots.

A tick that covers the running volume ``(C - lots, C]`` has a fragment in each bar that the interval
meets, so bars follow from the running sum alone, without walking through the ticks.  The last bar is
left out if it is not full.  Ticks without lots are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import EPS, running_sum

#: Bins of log10 of the notional between -2 and 7, and the share that counts as middle size.
BINS, LOW, SPAN, MIDDLE = 18, -2.0, 9.0, (7, 11)


def fragments(ticks: DataFrame, volume: int, start: Column | None = None) -> DataFrame:
    """(symbol, bar_id, ts_ms, seq, price, fill, is_buyer_maker) of full bars, from running lots ``start`` on."""
    summed = running_sum(ticks.filter("lots > 0"), "lots", "upto").withColumn("upto", F.col("upto") - (F.lit(0) if start is None else start))
    low, v = F.col("upto") - F.col("lots"), F.lit(volume)
    bars = F.sequence(F.floor(F.greatest(low, F.lit(0)) / v), F.ceil(F.col("upto") / v) - 1)
    pieces = summed.filter("upto > 0").withColumn("bar_id", F.explode(bars))
    fill = F.least("upto", (F.col("bar_id") + 1) * v) - F.greatest(low, F.col("bar_id") * v)
    return pieces.select("symbol", "bar_id", "ts_ms", "seq", "price", fill.alias("fill"), "is_buyer_maker")


def measures(pieces: DataFrame, volume: int, keys: tuple[str, ...] = ("symbol", "bar_id")) -> DataFrame:
    """One row for each full bar with all its measures; a bar is one small group."""
    v = float(volume)
    bar = Window.partitionBy(*keys)
    along = bar.orderBy("seq")
    sign = F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0)
    f = pieces.withColumns({"s": sign, "notional": F.col("price") * F.col("fill"), "count": F.count(F.lit(1)).over(bar), "dp": F.col("price") - F.lag("price").over(along), "gap": F.col("ts_ms") - F.lag("ts_ms").over(along)})
    slot = ((F.log10(F.greatest("notional", F.lit(EPS))) - LOW) / SPAN * BINS).cast("int")
    f = f.withColumns(
        {
            "dp0": F.lag("dp").over(along),
            "bin": F.greatest(F.lit(0), F.least(F.lit(BINS - 1), slot)),
            "top": F.row_number().over(bar.orderBy(F.desc("notional"), F.desc("seq"))) <= F.greatest(F.lit(1), F.floor(F.col("count") / 20)),
        }
    )
    in_bin = Window.partitionBy(*keys, "bin")
    share = F.count(F.lit(1)).over(in_bin) / F.col("count")
    f = f.withColumn("entropy", -F.log(share + EPS) / F.col("count"))  # summed over a bin's rows: -p ln p
    net, close = F.col("net"), F.col("close")
    clip = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    rows = f.groupBy(*keys).agg(
        F.min("ts_ms").alias("ts_first"),
        F.max("ts_ms").alias("ts_ms"),
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("notional").alias("notional"),
        F.sum("fill").alias("filled"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(F.col("is_buyer_maker"), 0).otherwise(F.col("fill"))).cast("double").alias("taker_buy_vol"),
        F.sum(F.when(F.col("is_buyer_maker"), F.col("fill")).otherwise(0)).cast("double").alias("taker_sell_vol"),
        F.sum("entropy").alias("entropy"),
        F.sum(F.when(F.col("top"), F.col("s") * F.col("fill"))).alias("large"),
        F.avg(F.col("bin").between(*MIDDLE).cast("double")).alias("mid_size_share"),
        F.sum(F.col("s") * F.col("notional")).alias("signed_notional"),
        F.sum((F.col("dp") * F.col("dp0") < 0).cast("int")).alias("flips"),
        F.sum(F.abs("dp")).alias("path"),
        F.sum(F.col("s") * F.col("fill")).alias("net"),
        F.count("dp0").alias("pairs"),
        F.covar_samp("dp0", "dp").alias("cov"),
        F.sum(F.col("s") * F.col("fill") / F.log(F.lit(2.0) + F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0)))).alias("flow"),
        F.sum((F.col("gap") > 0).cast("int")).alias("gaps"),
        F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap_mean"),
        F.stddev_samp(F.when(F.col("gap") > 0, F.col("gap").cast("double"))).alias("gap_std"),
    )
    path = F.coalesce("path", F.lit(0.0))
    return rows.filter(F.col("filled") == volume).select(
        *keys,
        "ts_first",
        "ts_ms",
        "open",
        "high",
        "low",
        "close",
        (F.col("notional") / v).alias("vwap"),
        F.lit(v).alias("volume"),
        "trade_count",
        "taker_buy_vol",
        "taker_sell_vol",
        ((F.col("ts_ms") - F.col("ts_first")) / 1000.0).alias("dt_sec"),
        ((F.col("high") - F.col("low")) / (close + EPS) * 1e4).alias("range1vb_bp"),
        F.when(F.col("trade_count") >= 5, F.col("entropy") / F.log(F.lit(float(BINS)))).alias("entropy_norm"),
        (F.col("large") / (v + EPS)).alias("large_imb_share"),
        "mid_size_share",
        (F.col("signed_notional") / (v * close + EPS)).alias("par"),
        (F.coalesce("flips", F.lit(0)) / F.col("trade_count")).alias("rev_count_ratio"),
        clip(F.abs(close - F.col("open")) / (path + EPS), 0.0, 1.0).alias("pde"),
        clip(F.col("flow") / v, -2.0, 2.0).alias("twi"),
        F.when(F.col("pairs") >= 2, 2 * F.sqrt(F.greatest(-F.col("cov"), F.lit(0.0)))).when(F.col("pairs") == 1, 0.0).alias("roll_spread"),
        (path / (F.abs(net) + EPS)).alias("kyle_lambda"),
        F.when((F.col("gaps") >= 2) & (F.col("gap_mean") > 0), F.col("gap_std") / F.col("gap_mean")).when(F.col("gaps") >= 1, 0.0).alias("burst_cv"),
    )


def volume_bars(ticks: DataFrame, volume: int) -> DataFrame:
    return measures(fragments(ticks, volume), volume)


def grid_times(ticks: DataFrame, step_ms: int, warm_ms: int = 0) -> DataFrame:
    """(symbol, grid_ms): every ``step_ms`` from the first tick's step plus ``warm_ms``, up to the last tick's step."""
    ends = ticks.groupBy("symbol").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    start = F.ceil((F.floor(F.col("a") / step_ms) * step_ms + warm_ms) / step_ms) * step_ms
    last = F.floor(F.col("b") / step_ms) * step_ms
    return ends.filter(start <= last).select("symbol", F.explode(F.sequence(start, last, F.lit(step_ms))).alias("grid_ms"))


def grid_bars(ticks: DataFrame, times: DataFrame, volume: int, bars: int) -> DataFrame:
    """Bars counted back from each grid time: (symbol, grid_ms, bar_idx, ...), the last ``bars`` of them.

    At a time with ``C`` lots so far, bars start at the first tick beyond ``C - bars * volume`` lots, which
    counts whole.  Ticks meet grid times by cells of running lots, so no task holds an instrument.
    """
    need = bars * volume
    t = running_sum(ticks.filter("lots > 0"), "lots", "upto")
    # Lots up to each grid time: times and ticks in one order.
    both = t.select("symbol", "ts_ms", F.lit(0).alias("g"), F.col("lots").alias("n")).unionByName(times.select("symbol", F.col("grid_ms").alias("ts_ms"), F.lit(1).alias("g"), F.lit(0).cast("long").alias("n")))
    both = both.withColumn("seq", F.col("g"))
    total = running_sum(both, "n", "total").filter("g = 1 and total >= " + str(need)).select("symbol", F.col("ts_ms").alias("grid_ms"), "total")
    # The last lot of a tick is in one cell; a time's window of lots meets two cells at most.
    cells = F.sequence(F.floor((F.col("total") - need) / need), F.floor((F.col("total") - 1) / need))
    wanted = total.withColumn("cell", F.explode(cells))
    met = t.withColumn("cell", F.floor((F.col("upto") - 1) / need)).join(wanted, ["symbol", "cell"]).filter("upto > total - %d and upto <= total" % need)
    one = Window.partitionBy("symbol", "grid_ms")
    based = met.withColumn("start", F.min(F.col("upto") - F.col("lots")).over(one)).withColumns({"upto": F.col("upto") - F.col("start"), "all": F.col("total") - F.col("start")})
    v = F.lit(volume)
    pieces = based.withColumn("bar", F.explode(F.sequence(F.floor((F.col("upto") - F.col("lots")) / v), F.ceil(F.col("upto") / v) - 1)))
    fill = F.least("upto", (F.col("bar") + 1) * v) - F.greatest(F.col("upto") - F.col("lots"), F.col("bar") * v)
    first = F.floor(F.col("all") / v) - bars
    pieces = pieces.select("symbol", "grid_ms", (F.col("bar") - first).alias("bar_idx"), "ts_ms", "seq", "price", fill.alias("fill"), "is_buyer_maker").filter(F.col("bar_idx").between(0, bars - 1))
    return measures(pieces, volume, ("symbol", "grid_ms", "bar_idx"))
