"""Running sums and row frames that do not put a whole instrument into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowspark.session import stored

EPS = 1e-12
#: Milliseconds of a slice of ticks.
SLICE_MS = 3_600_000


def running_sum(df: DataFrame, value: str, out: str, keys: Sequence[str] = ("symbol",), slice_by: Column | str | None = None, order: Sequence[str] = ("ts_ms", "seq")) -> DataFrame:
    """Add the inclusive running sum of ``value`` along ``order`` for each of ``keys``.

    ``slice_by`` must not fall along the order (hours of ``ts_ms`` if not given).  Slices are summed, the
    slices' totals are summed up (one row for each slice), and each slice is summed on its own.  Rows are
    dealt to their slices once, for the join and the sum alike; a missing key is a key like any other.
    """
    by = F.floor(F.col("ts_ms") / SLICE_MS) if slice_by is None else F.col(slice_by) if isinstance(slice_by, str) else slice_by
    # A struct is equal to another with the same gaps.
    dealt = df.withColumn("_key", F.struct(*keys, by.alias("_slice")))
    sums = dealt.groupBy("_key").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*[f"_key.{k}" for k in keys]).orderBy("_key._slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_key", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(starts, "_key").withColumn(out, F.col("_start") + F.sum(value).over(within)).select(*df.columns, out)


def in_blocks(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]] | Sequence[Callable[[WindowSpec], dict[str, Column]]],
    back: int = 0,
    forward: int = 0,
    keys: Sequence[str] = ("symbol",),
    order: str = "bar_id",
    block: int = 8192,
) -> DataFrame:
    """Add window columns whose frames reach ``back`` rows back and ``forward`` rows ahead.

    ``order`` numbers the rows of a key without gaps.  Each row is copied to the blocks of rows that
    see it; frames are evaluated in each block, and a block keeps its own rows.  With blocks much
    longer than the frames, copies are few and a key is spread over many tasks.  ``columns`` may be a
    list of steps, each of which uses columns of the one before.
    """
    at = F.col(order)
    first, last = F.floor((at - forward) / block), F.floor((at + back) / block)
    copies = df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == F.floor(at / block))
    window = Window.partitionBy(*keys, "_block").orderBy(order)
    for step in [columns] if callable(columns) else columns:
        copies = copies.withColumns(step(window))
    return copies.filter("_own").drop("_own", "_block")


def rolling(window: WindowSpec, n: int) -> WindowSpec:
    """The frame of the last ``n`` rows."""
    return window.rowsBetween(-(n - 1), 0)


def quantile(df: DataFrame, column: str, q: float, out: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, out): the interpolated quantile of a column for each of ``keys``.

    Equal values are counted first; ranks are running counts over slices of values, so no task holds
    all values of a key.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts.withColumn("_slice", F.floor(F.asinh(column) * 64)), "_n", "_upto", keys, "_slice", (column,))
    rank = F.col("_all") * F.lit(q)
    met = ranked.join(counts.groupBy(*keys).agg((F.sum("_n") - 1).alias("_all")), list(keys)).filter((F.col("_upto") > F.floor(rank)) & (F.col("_upto") - F.col("_n") <= F.ceil(rank)))
    low, high = F.min(column), F.max(column)
    return met.groupBy(*keys).agg((low + (high - low) * F.max(rank - F.floor(rank))).alias(out))


def counted(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, _n, _upto): each different value, how often it is there, and how many values there are up
    to it.  Values are counted as partial aggregates, dealt to slices by range, and summed over slices; a window
    without keys runs over the slices' totals only."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    sliced = counts.repartitionByRange(*keys, column).withColumn("_slice", F.spark_partition_id())
    return running_sum(stored(sliced, "counts"), "_n", "_upto", keys, "_slice", (column,)).drop("_slice")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the rank of ``column`` among all rows, the mean of the places of equal values; rows without a
    value are left out."""
    ranks = counted(df, column).select(column, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, column)


def quantiles(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row with the interpolated quantiles of a column, name -> share."""
    ranked = stored(counted(df, column), "ranked")
    last = ranked.select(F.max("_upto") - 1).scalar()
    nth = lambda k: F.min(F.when(F.col("_upto") > k, F.col(column)))
    rank = lambda q: F.col("_last") * F.lit(q)
    marks = {name: nth(F.floor(rank(q))) + (nth(F.ceil(rank(q))) - nth(F.floor(rank(q)))) * F.max(rank(q) - F.floor(rank(q))) for name, q in wanted.items()}
    return ranked.withColumn("_last", last).agg(*[c.alias(name) for name, c in marks.items()])


def next_true(df: DataFrame, flag: str, columns: Sequence[str], out: str, keys: Sequence[str] = ("symbol",), order: str = "bar_id", block: int = 8192) -> DataFrame:
    """Add ``out``, a struct of ``columns`` of the next later row of the key where ``flag`` is true, however far;
    null if there is none.

    Each block of rows gives its first flagged row; the first of the blocks behind is carried back to it (one row
    for each block); within a block a frame is enough.
    """
    found = F.when(F.col(flag), F.struct(F.col(order).alias("_at"), *columns))
    dealt = df.withColumn("_key", F.struct(*keys, F.floor(F.col(order) / block).alias("_slice")))
    firsts = dealt.groupBy("_key").agg(F.min(found).alias("_first"))
    behind = Window.partitionBy(*[f"_key.{k}" for k in keys]).orderBy("_key._slice").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select("_key", F.first("_first", ignorenulls=True).over(behind).alias("_carried"))
    within = Window.partitionBy("_key").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    met = dealt.join(carried, "_key").withColumn("_next", F.coalesce(F.first(found, ignorenulls=True).over(within), F.col("_carried")))
    return met.select(*df.columns, F.col("_next").alias(out))


def fill_forward(df: DataFrame, column: str, out: str, default: object = None, keys: Sequence[str] = ("symbol",), order: str = "bar_id", block: int = 8192) -> DataFrame:
    """Add ``out``: the value of the row, or the last one before it, however far; ``default`` before the first.

    A block of rows gives its last value, which is carried over the blocks behind it; NaN is no value.
    """
    known = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    dealt = df.withColumns({"_key": F.struct(*keys, F.floor(F.col(order) / block).alias("_slice")), "_known": known})
    ends = dealt.groupBy("_key").agg(F.max(F.when(F.col("_known").isNotNull(), F.struct(order, "_known"))).alias("_end"))
    before = Window.partitionBy(*[f"_key.{k}" for k in keys]).orderBy("_key._slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", F.last("_end", ignorenulls=True).over(before)["_known"].alias("_carried"))
    within = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(carried, "_key").withColumn("_filled", F.coalesce(F.last("_known", ignorenulls=True).over(within), "_carried", F.lit(default)))
    return met.select(*df.columns, F.col("_filled").alias(out))


def at_least(value: Column, frame: WindowSpec, least: int, result: Column) -> Column:
    """``result`` where the frame has at least ``least`` values, else null."""
    return F.when(F.count(value).over(frame) >= least, result)


def check_order(df: DataFrame, keys: Sequence[str] = ("symbol",), slice_by: str = "dt") -> DataFrame:
    """(keys, violations): rows whose time is before that of the row with the next lower ``seq``.

    Slices are checked on their own and then their ends against the next slice's start.
    """
    inside = Window.partitionBy(*keys, slice_by).orderBy("seq")
    marked = df.withColumn("_late", F.col("ts_ms") < F.lag("ts_ms").over(inside))
    parts = marked.groupBy(*keys, slice_by).agg(F.sum(F.col("_late").cast("int")).alias("late"), F.min_by("ts_ms", "seq").alias("first"), F.max_by("ts_ms", "seq").alias("last"), F.min("seq").alias("at"))
    seam = F.col("first") < F.lag("last").over(Window.partitionBy(*keys).orderBy("at"))
    return parts.withColumn("seam", F.coalesce(seam.cast("int"), F.lit(0))).groupBy(*keys).agg((F.coalesce(F.sum("late"), F.lit(0)) + F.sum("seam")).cast("long").alias("violations"))
