"""Small relational steps with a check: joins that must not multiply rows, alignment, unions as sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join; an error when it is read if a key stands more than once on the right."""
    keys, values = list(on), [c for c in right.columns if c not in on]
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    checked = one.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key stands more than once"))).otherwise(F.lit(None)).cast("string"))
    return left.join(checked, keys, "left").filter(F.col("_n").isNull()).drop("_n")


def align(index: DataFrame, values: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys of ``index``, each with its values or nulls; keys that ``index`` lacks are left out."""
    return unique_join(index.select(*on), values, on)


def with_metrics(rows: DataFrame, metrics: DataFrame, on: str = "fold_idx", most: int = 100_000) -> DataFrame:
    """Rows with the metrics of their fold; up to ``most`` folds are sent to all tasks."""
    return rows.join(F.broadcast(metrics) if metrics.limit(most + 1).count() <= most else metrics, on, "left")


def union_set(*frames: DataFrame) -> DataFrame:
    """The different rows of all frames."""
    both = frames[0]
    for more in frames[1:]:
        both = both.unionByName(more)
    return both.distinct()


def tail_is_null(df: DataFrame, column: str, n: int, order: str = "bar_id") -> DataFrame:
    """(symbol, clean): whether the last ``n`` rows of an instrument have no value, as a label that looks
    ``n`` rows ahead must not."""
    last = df.groupBy("symbol").agg(F.max(order).alias("_last"))
    late = df.join(last, "symbol").filter(F.col(order) > F.col("_last") - n)
    return late.groupBy("symbol").agg(F.min(F.col(column).isNull()).alias("clean"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of each key the last by ``order``: a maximum, so rows of a key are reduced before they move."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default: object, order: Sequence[str]) -> DataFrame:
    """``df`` with ``value`` of the last row of ``table`` (by ``order``) that has its keys; ``default`` where there is
    none, or its value is missing."""
    last = keep_last(table.select(*dict.fromkeys([*keys, value, *order])), keys, order).select(*keys, F.col(value).alias("_value"))
    return df.join(last, list(keys), "left").withColumn(value, F.coalesce("_value", F.lit(default))).drop("_value")
