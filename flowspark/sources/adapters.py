"""Ticks and order books from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, dt, ts_ms, seq, price, lots, is_buyer_maker) from ``events``; ``seq`` orders equal times."""
    return as_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_ticks(events: DataFrame) -> DataFrame:
    """The same for any frame or stream of such events."""
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.lit("EV").alias("symbol"),
        F.to_date(at).alias("dt"),
        F.unix_millis(at).alias("ts_ms"),
        F.col("event_id").alias("seq"),
        (F.lit(1000.0) + F.col("value")).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("lots"),
        F.col("event_type").isin("view", "error").alias("is_buyer_maker"),
        "user_id",
    )


def book(spark: SparkSession, sf_dir: str, levels: int = 25) -> DataFrame:
    """(symbol, ts_ms, bids, asks): ladders of (price, size), best first, from ``embeddings``; they are
    a minute apart from the first of January 2024 on."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")

    def side(first: int, sign: int):
        sizes = F.slice("embedding", first + 1, levels)
        return F.transform(sizes, lambda v, i: F.struct((F.lit(1000.0) + sign * (i + F.lit(0.5))).alias("price"), F.abs(v.cast("double")).alias("size")))

    ts = F.lit(1704067200000) + F.col("vec_id") * 60000
    return rows.select(F.lit("EV").alias("symbol"), ts.alias("ts_ms"), side(0, -1).alias("bids"), side(levels, 1).alias("asks"))
