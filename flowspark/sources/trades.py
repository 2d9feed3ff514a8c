"""Readers of trade and order-book files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.ordering import running_sum


def trades_gz(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Gzipped CSV with timestamp (seconds), side, size and price; further columns are not read."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(
        F.lit(symbol).alias("symbol"),
        F.monotonically_increasing_id().alias("seq"),  # a file is one task: its lines keep their order
        (F.col("timestamp").try_cast("double") * 1000).cast("long").alias("ts_ms"),
        F.col("price").try_cast("double").alias("price"),
        F.col("size").try_cast("double").alias("qty"),
        (F.lower(F.trim("side")) == "sell").alias("is_buyer_maker"),
    )
    return finite(rows).withColumn("dt", F.to_date(F.timestamp_millis("ts_ms")))


def finite(rows: DataFrame) -> DataFrame:
    """Rows with a time and with a number as price and size: neither missing, NaN nor infinite."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.filter(F.col("ts_ms").isNotNull() & number("price") & number("qty"))


def as_lots(trades: DataFrame, step: float) -> DataFrame:
    """Sizes as whole ``lots`` of ``step``; trades of no lot are left out.  What bars are built from.

    ``seq`` is numbered anew along the time, ties by the order in the files, so that bars which reach
    over files are in order.
    """
    lots = F.round(F.col("qty") / step).cast("long")
    rows = trades.withColumn("lots", lots).filter("lots > 0").drop("qty").withColumn("_one", F.lit(1).cast("long"))
    return running_sum(rows, "_one", "_at").withColumn("seq", F.col("_at") - 1).drop("_one", "_at")


def time_range(df: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Rows with ``start_ms <= ts_ms < end_ms``; folders of other days are not read."""
    day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
    rows = df.filter((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    return rows.filter((F.col("dt") >= day(start_ms)) & (F.col("dt") <= day(end_ms - 1))) if "dt" in df.columns else rows


def date_list(spark: SparkSession, start: str, end: str, inclusive: bool = False) -> DataFrame:
    """(dt): the days from ``start`` up to ``end``, the last one only if ``inclusive``."""
    last = F.lit(end).cast("date") if inclusive else F.date_sub(F.lit(end).cast("date"), 1)
    first = F.lit(start).cast("date")
    return spark.range(1).filter(first <= last).select(F.explode(F.sequence(first, last)).alias("dt"))


def day_range(rows: DataFrame, day: str = "dt") -> DataFrame:
    """(dt): every day from the first to the last that ``rows`` have, those without rows included."""
    ends = rows.agg(F.min(day).alias("first"), F.max(day).alias("last")).filter("first is not null")
    return ends.select(F.explode(F.sequence("first", "last")).alias("dt"))


def read_days(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, symbols: list[str] | None = None) -> DataFrame:
    """What ``sinks.write_days`` wrote, for a range of times and some instruments."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("symbol").isin(symbols)) if symbols else df
    return df if start_ms is None or end_ms is None else time_range(df, start_ms, end_ms)


def union_ordered(*frames: DataFrame) -> DataFrame:
    """Ticks of several files as one relation, every trade of each: ``seq`` numbers an instrument's rows anew,
    from 0 along the time, ties by the place of their file among ``frames`` and their old ``seq``."""
    both = frames[0].withColumn("_file", F.lit(0))
    for n, more in enumerate(frames[1:], 1):
        both = both.unionByName(more.withColumn("_file", F.lit(n)))
    one = both.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, "_one", "_at", order=("ts_ms", "_file", "seq")).withColumn("seq", F.col("_at") - 1).drop("_one", "_at", "_file")


def depth_of(name: str) -> int | None:
    """The depth that the name of a book file states (``..._ob500.data.zip``)."""
    found = re.search(r"_ob(\d+)", name)
    return int(found[1]) if found else None


def trades_zip(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Zipped CSV files, with or without a header: id, price, size, two unused, time, buyer is maker.

    A zip file is no splittable format: a file is one row of a task.  Rows are read in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    names = [n for n in z.namelist() if n.endswith(".csv")] or z.namelist()
                    with z.open(names[0]) as f:
                        names7 = [f"c{i}" for i in range(7)]
                        for part in pc.open_csv(f, pc.ReadOptions(column_names=names7), convert_options=pc.ConvertOptions(column_types=dict.fromkeys(names7, pa.string()))):
                            yield part.select(["c0", "c1", "c2", "c5", "c6"])

    files = spark.read.format("binaryFile").load(path).select("content")
    raw = files.mapInArrow(run, "c0 string, c1 string, c2 string, c5 string, c6 string")
    rows = raw.select(
        F.lit(symbol).alias("symbol"),
        F.regexp_replace("c0", "﻿", "").try_cast("long").alias("agg_id"),
        F.col("c1").try_cast("double").alias("price"),
        F.col("c2").try_cast("double").alias("qty"),
        F.col("c5").try_cast("long").alias("ts_ms"),
        (F.lower(F.trim("c6")) == "true").alias("is_buyer_maker"),
    )
    rows = finite(rows.filter("agg_id is not null")).withColumn("seq", F.col("agg_id"))
    return rows.withColumn("dt", F.to_date(F.timestamp_millis("ts_ms")))


def book_messages(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """(symbol, dt, ts_ms, seq, type, b, a) from lines of JSON, in plain files or one in each zip file;
    lines that are none are left out.  ``seq`` keeps the lines' order in their file."""
    if path.endswith(".zip"):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content"):
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z, z.open(z.namelist()[0]) as f:
                        while lines := f.readlines(1 << 22):
                            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in lines])], names=["value"])

        lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
    else:
        lines = spark.read.text(path)
    rec = F.from_json("value", "type string, ts bigint, data struct<b:array<array<string>>,a:array<array<string>>>")
    rows = lines.select(rec.alias("r"), F.monotonically_increasing_id().alias("seq")).filter("r.ts is not null and r.type is not null")
    level = lambda c: F.transform(F.col(c), lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("size")))
    return rows.select(F.lit(symbol).alias("symbol"), F.to_date(F.timestamp_millis("r.ts")).alias("dt"), F.col("r.ts").alias("ts_ms"), "seq", "r.type", level("r.data.b").alias("b"), level("r.data.a").alias("a"))
