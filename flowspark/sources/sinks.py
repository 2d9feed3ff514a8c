"""Writers of ticks, bars, predictions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_days(df: DataFrame, path: str, files_a_day: int = 8, mode: str = "errorifexists") -> None:
    """Parquet in folders by instrument and day, each day in up to ``files_a_day`` files sorted by time,
    so that readers prune days and skip row groups.  Needs symbol, dt and ts_ms.

    Rows of a day are dealt by cells of a minute, so one busy day is not one task.
    """
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(F.floor(F.col("ts_ms") / 60_000)), F.lit(files_a_day)))
    out = dealt.repartition("symbol", "dt", "_cell").sortWithinPartitions("symbol", "dt", "ts_ms").drop("_cell")
    out.write.mode(mode).partitionBy("symbol", "dt").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """CSV with a header; nulls are empty fields."""
    df.write.mode(mode).option("header", True).option("compression", compression).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
