"""Bars that fill over several triggers against those of the whole table."""

import pytest
from flowspark.operators import bars as batch_bars
from flowspark.plans import catalog
from flowspark.sources import adapters
from flowspark.streaming import bars, windows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def ticks(spark):
    one = adapters.ticks(spark, SF).select("symbol", *bars.COLUMNS)
    late = one.withColumns({"symbol": F.lit("B"), "lots": F.when(F.col("seq") % 9 == 0, 0).when(F.col("seq") % 7 == 0, 1700).otherwise(F.col("lots")).cast("long")}).filter("seq > 400")
    return one.unionByName(late)


def test_bars_over_triggers(spark):
    """Two instruments, one of which begins late; ticks over several bars, and ticks without lots."""
    got = bars.available_bars(windows.replay(ticks(spark), "ts_ms", "b", 7), 500, "bars7")
    names = got.columns
    want = batch_bars.volume_bars(ticks(spark), 500).select(*names)
    flat = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert flat(got) == flat(want) and len({r["symbol"] for r in got.select("symbol").distinct().collect()}) == 2


def test_ticks_that_arrive_late_are_an_error(spark):
    turned = ticks(spark).withColumn("at", -F.col("ts_ms"))
    with pytest.raises(Exception, match="out of order"):
        bars.available_bars(windows.replay(turned, "at", "late-bars", 3), 500)


def test_a_trigger_is_no_group_of_a_python_task(spark, monkeypatch):
    seen = []
    write = bars.stored
    monkeypatch.setattr(bars, "stored", lambda df, label: (seen.append(df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1])
    assert catalog.QUERIES["stream_bars"](spark, SF).count() > 50
    assert seen and not any(x in p for p in seen for x in ("Pandas", "Arrow", "SinglePartition"))
