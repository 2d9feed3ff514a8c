"""Sizes of folds against the rows of the folds themselves."""

import random

import pytest
from flowspark.operators import evaluation as E
from flowspark.plans import catalog
from pyspark.sql import functions as F


@pytest.mark.parametrize(("expanding", "purge", "ahead", "block"), [(True, 0, 60, 8192), (True, 5, 0, 16), (False, 12, 0, 7), (False, 200, 30, 64)])
def test_spans_are_those_of_the_members(spark, expanding, purge, ahead, block):
    """Two instruments, with gaps in the numbers and bars that stand twice."""
    rng = random.Random(block)
    bars = spark.createDataFrame([(s, i) for s, n in (("A", 900), ("B", 500)) for i in range(n) if not 300 <= i < 420 for _ in range(rng.choice([0, 1, 1, 2]))], "symbol string, bar_id long").repartition(5)
    folds = E.bar_folds(bars, 100, 40, 20)
    rows = E.members(bars, folds, purge, expanding, ahead, cell=64)
    want = rows.groupBy("symbol", "fold_idx", "part").agg(F.count(F.lit(1)).alias("n"), F.min("bar_id").alias("first_bar"), F.max("bar_id").alias("last_bar"))
    got = E.member_spans(bars, folds, purge, expanding, ahead, block)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 20


def test_expanding_folds_are_not_sent_to_all_tasks(spark):
    bars = catalog.bars_of(spark, "/root/testdata/sf0.001").select("symbol", "bar_id")
    plan = E.members(bars, E.bar_folds(bars, 40, 10, 0), expanding=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
