"""The engine's relations as temporary views, for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from flowspark.operators import bars, book
from flowspark.plans import functions
from flowspark.sources import adapters


def register(spark: SparkSession, sf_dir: str, volume: int = 500) -> list[str]:
    """Define ``ticks``, ``bars``, ``book``, ``ladder`` and ``tick_slices`` over the tables of ``sf_dir``, and the table
    function ``volume_bars`` over ``tick_slices``; nothing is computed yet."""
    ticks, ladders = adapters.ticks(spark, sf_dir), adapters.book(spark, sf_dir)
    views = {"ticks": ticks, "bars": bars.volume_bars(ticks, volume), "book": ladders, "ladder": book.ladder_features(ladders), "tick_slices": functions.by_slices(ticks, volume)}
    functions.register(spark)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
