"""As-of, nearest and interval joins without one task for each instrument.

Rows meet by slices of time.  A row of the right side that is the latest of its slice is carried on
over empty slices by a window over slices, one row each; inside a slice, left and right rows stand in
one order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], ts: str = "ts_ms", keys: Sequence[str] = ("symbol",), tolerance: int | None = None, slice_ms: int = 3_600_000) -> DataFrame:
    """``left`` with the ``values`` and the time (``right_ts``) of the last right row at or before its time.

    With a tolerance, rows further back than it count as missing.  Of equal right times one is taken by
    the order of its values.
    """
    keys, values = list(keys), list(values)
    part = F.floor(F.col(ts) / slice_ms)
    r = right.select(*keys, F.col(ts).alias("_t"), part.alias("_part"), F.struct(F.col(ts).alias("t"), *values).alias("_r"))
    l = left.withColumn("_part", part)
    ends = r.groupBy(*keys, "_part").agg(F.max("_r").alias("_end")).unionByName(l.select(*keys, "_part").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(*keys, "_part").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    rows = l.withColumns({"_t": F.col(ts), "_side": F.lit(1)}).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_part").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_hit", F.last("_r", ignorenulls=True).over(upto)).filter("_side = 1").join(carried, [*keys, "_part"], "left")
    hit = F.coalesce("_hit", "_carry")
    if tolerance is not None:
        hit = F.when(F.col(ts) - hit["t"] <= tolerance, hit)
    return found.withColumn("_hit", hit).select(*[F.col(c) for c in left.columns], F.col("_hit.t").alias("right_ts"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, values: Sequence[str], ts: str = "ts_ms", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``left`` with the nearest right row in time; of two equally near ones the earlier."""
    back = asof(left, right, values, ts, keys)
    turned = asof(back.withColumn(ts, -F.col(ts)).withColumnsRenamed({"right_ts": "_bt"} | {v: f"_b_{v}" for v in values}), right.withColumn(ts, -F.col(ts)), values, ts, keys)
    fore = turned.withColumn(ts, -F.col(ts)).withColumn("_ft", -F.col("right_ts"))
    early = F.col("_ft").isNull() | (F.col(ts) - F.col("_bt") <= F.col("_ft") - F.col(ts))
    pick = lambda b, f: F.when(F.col("_bt").isNotNull() & early, F.col(b)).otherwise(F.col(f))
    return fore.select(*left.columns, pick("_bt", "_ft").alias("right_ts"), *[pick(f"_b_{v}", v).alias(v) for v in values])


def within(spans: DataFrame, points: DataFrame, start: str, end: str, ts: str = "ts_ms", keys: Sequence[str] = ("symbol",), slice_ms: int = 600_000) -> DataFrame:
    """All pairs of a span and a point with ``start <= time <= end``; spans are copied to the slices they meet."""
    keys = list(keys)
    s = spans.withColumn("_slice", F.explode(F.sequence(F.floor(F.col(start) / slice_ms), F.floor(F.col(end) / slice_ms))))
    p = points.withColumn("_slice", F.floor(F.col(ts) / slice_ms)).withColumnRenamed(ts, "point_ts")
    return s.join(p, [*keys, "_slice"]).filter((F.col("point_ts") >= F.col(start)) & (F.col("point_ts") <= F.col(end))).drop("_slice")
