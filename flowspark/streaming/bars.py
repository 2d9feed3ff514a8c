"""Volume bars from a stream of ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.bars import fragments
from flowspark.session import scratch, stored

COLUMNS = ["ts_ms", "seq", "price", "lots", "is_buyer_maker"]
OUT = "symbol string, bar_id long, ts_first long, ts_ms long, open double, high double, low double, close double, vwap double, trade_count long, taker_buy_vol double, taker_sell_vol double"
#: Lots and the latest time so far of each instrument, and the pieces of its open bar.
SEEN = "symbol string, total long, last long"
OPEN = "symbol string, bar_id long, ts_ms long, seq long, price double, fill long, is_buyer_maker boolean"


def each_trigger(spark: SparkSession, home: str, volume: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of ticks: write the bars that a trigger fills under ``home``.

    A trigger is a batch job by slices of time, as in ``operators.bars``; no task holds its ticks of an instrument.
    What it leaves, lots so far and the pieces of the open bar, is written by its number, so a trigger that is
    run again gives the same.  A tick before the last one of an earlier trigger is an error.
    """

    def step(batch: DataFrame, number: int) -> None:
        arrived, path = batch.select("symbol", *COLUMNS), scratch(spark, "trigger")
        arrived.write.parquet(path)
        fresh = spark.read.schema(arrived.schema).parquet(path)  # in the caller's session, not the stream's
        seen, open_ = (spark.read.schema(s).parquet(f"{home}/{name}/{number - 1}") if number else spark.createDataFrame([], s) for name, s in (("seen", SEEN), ("open", OPEN)))
        none = F.lit(None).cast("long")
        now = fresh.groupBy("symbol").agg(F.coalesce(F.sum("lots"), F.lit(0)).cast("long").alias("total"), none.alias("_before"), F.max("ts_ms").alias("last"), F.min("ts_ms").alias("_first"))
        both = seen.select("symbol", "total", F.col("last").alias("_before"), "last", none.alias("_first")).unionByName(now)
        after = both.groupBy("symbol").agg(F.sum("total").alias("total"), F.max("_before").alias("_before"), F.max("last").alias("last"), F.min("_first").alias("_first"))
        after = stored(after, "seen")
        late = after.filter("_first < _before").first()
        if late:
            raise ValueError(f"ticks of {late['symbol']} arrived out of order")
        after.select("symbol", "total", "last").write.mode("overwrite").parquet(f"{home}/seen/{number}")
        started = seen.select(F.col("symbol").alias("_symbol"), F.col("total").alias("_passed"))
        ticks = fresh.join(started, F.col("symbol").eqNullSafe(F.col("_symbol")), "left").drop("_symbol").fillna(0, ["_passed"])
        pieces = fragments(ticks, volume, -F.col("_passed")).unionByName(open_)
        full = F.floor(F.col("total") / volume).alias("_full")
        bars = after.select(F.col("symbol").alias("_symbol"), full)
        pieces = stored(pieces.join(bars, F.col("symbol").eqNullSafe(F.col("_symbol")), "left").drop("_symbol"), "pieces")
        pieces.filter("bar_id >= _full").drop("_full").write.mode("overwrite").parquet(f"{home}/open/{number}")
        at, bought = F.struct("ts_ms", "seq"), F.sum(F.when(F.col("is_buyer_maker"), 0).otherwise(F.col("fill"))).cast("double")
        rows = pieces.filter("bar_id < _full").groupBy("symbol", "bar_id").agg(
            F.min("ts_ms").alias("ts_first"),
            F.max("ts_ms").alias("_ts"),
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            (F.sum(F.col("price") * F.col("fill")) / volume).alias("vwap"),
            F.count(F.lit(1)).alias("trade_count"),
            bought.alias("taker_buy_vol"),
            (F.lit(float(volume)) - bought).alias("taker_sell_vol"),
        )
        rows.withColumnRenamed("_ts", "ts_ms").write.mode("overwrite").parquet(f"{home}/rows/{number}")

    return step


def available_bars(ticks: DataFrame, volume: int, label: str = "bars") -> DataFrame:
    """Bars of ``volume`` lots of all ticks that have arrived; a tick is cut where a bar ends, and the last bar is left
    out if it is not full."""
    spark = ticks.sparkSession
    home = scratch(spark, f"stream-{label}")
    numbers: set[int] = set()
    step = each_trigger(spark, home, volume)

    def counted(batch: DataFrame, number: int) -> None:
        step(batch, number)
        numbers.add(number)

    ticks.select("symbol", *COLUMNS).writeStream.foreachBatch(counted).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    if not numbers:
        return spark.createDataFrame([], OUT)
    return spark.read.schema(OUT).parquet(*[f"{home}/rows/{n}" for n in sorted(numbers)])
