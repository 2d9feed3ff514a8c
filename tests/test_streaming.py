"""Stateful streams against the batch operators, over several triggers."""

from pathlib import Path

import pytest
from flowspark.operators import book as batch_book
from flowspark.operators import features, signals
from flowspark.plans import catalog
from flowspark.streaming import book, labels, windows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def triggers(spark, label):
    home = max(Path(spark.conf.get("spark.checkpoint.dir")).glob(f"flowspark-stream-{label}-*"), key=lambda p: p.stat().st_mtime)
    return len([p for p in (home / "state" / "commits").iterdir() if p.name.isdigit()])


def same(a, b):
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_book_over_triggers(spark):
    """Two instruments; stretches go on over the ends of triggers."""
    one = catalog.book_messages(spark, SF)
    messages = one.unionByName(one.withColumn("symbol", F.lit("B")).filter("seq % 3 != 1"))
    flat = lambda df: df.select("symbol", "ts_ms", F.to_json("bids").alias("b"), F.to_json("asks").alias("a"))
    streamed = windows.run_available(book.reconstruct(windows.replay(messages, "ts_ms", "m", 7), 180_000, 10), "book7")
    assert triggers(spark, "book7") >= 7
    same(flat(streamed), flat(batch_book.reconstruct(messages, 180_000, 10)))


def test_labels_and_thresholds_over_triggers(spark):
    bars = features.returns(catalog.bars_of(spark, SF))
    bars = bars.unionByName(bars.withColumns({"symbol": F.lit("B"), "taker_imb1vb": F.when(F.col("bar_id") % 5 > 0, F.abs("taker_imb1vb"))}))
    shown = bars.select("symbol", "bar_id", F.col("close").alias("pred"), "close", F.col("taker_imb1vb").alias("imbalance"))
    got = windows.run_available(labels.reveal(windows.replay(shown, "bar_id", "l", 9), 12), "labels9")
    assert triggers(spark, "labels9") >= 9
    want = signals.label_variable_horizon(bars).filter("y_variable is not null").select("symbol", "bar_id", (F.col("bar_id") + F.col("hold_bars")).alias("known_at"), "hold_bars", F.round("y_variable", 9).alias("y"))
    same(got.select("symbol", "bar_id", "known_at", "hold_bars", F.round("y_variable", 9).alias("y")), want)

    scores = bars.select("symbol", "bar_id", F.when(F.col("bar_id") % 4 > 0, F.col("range1vb_bp")).alias("score"))
    got = windows.run_available(labels.rolling_threshold(windows.replay(scores, "bar_id", "t", 9), 20, 0.75, 3), "threshold9")
    want = features.rolled(scores, {"threshold": ("quantile", "score", 20, 3, 0.75)})
    rounded = lambda df: df.select("symbol", "bar_id", F.round(F.nanvl("threshold", F.lit(None)), 6).alias("t"))
    same(rounded(got), rounded(want))


def test_late_rows_are_an_error(spark):
    scores = spark.range(10).select(F.lit("A").alias("symbol"), (9 - F.col("id")).alias("bar_id"), F.col("id").cast("double").alias("score"))
    with pytest.raises(Exception, match="out of order"):
        windows.run_available(labels.rolling_threshold(windows.replay(scores.withColumn("at", 9 - F.col("bar_id")), "at", "late", 3), 5, 0.5), "late")
