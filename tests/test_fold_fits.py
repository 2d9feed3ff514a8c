"""All folds are fitted at once: as many jobs for many folds as for few, and the trees of Spark ML."""

import random

import numpy as np
import pytest
from flowspark.operators import boosting as B
from flowspark.operators import evaluation as E
from flowspark.operators import grown
from flowspark.operators import models as M
from flowspark.plans import workflow
from flowspark.sources import adapters
from pyspark.sql import functions as F

INPUTS = ["x", "z"]
FEW = {"alpha train": 20, "alpha oos": 5, "alpha pass": 1, "entry candidates": 20, "entry train": 8, "entry oos": 1}


def members(spark, bars, train=80, oos=20):
    rng = random.Random(bars)
    data = []
    for i in range(bars):
        x, z = rng.uniform(-1, 1), rng.uniform(-1, 1)
        data.append(("EV", i, x, z, 3.0 * x + rng.gauss(0, 0.3), x + 2.0 * (x > 0) + 0.5 * z + rng.gauss(0, 0.3)))
    rows = spark.createDataFrame(data, "symbol string, bar_id long, x double, z double, first double, second double")
    return E.members(rows, E.bar_folds(rows, train, oos, 0), purge=3)


def gated(rows, **more):
    return M.gate_others(rows.filter("part = 'oos'").withColumn("pred", F.col("x")), INPUTS, "second", least=20, trees=3, **more)


def exits(rows, **more):
    """Each oos row as a sample of its bar's event."""
    samples = rows.filter("part = 'oos'").withColumn("event_id", F.col("bar_id"))
    return M.exit_walk_forward(samples, INPUTS, "second", least=30, trees=6, rate=0.5, **more)


#: Query: what of it is worked out for all folds.
RUNS = {
    "gbt_walkforward": lambda rows, **more: M.walk_forward(rows, INPUTS, "second", trees=3, **more),
    "dropout_walkforward": lambda rows, **more: M.walk_forward(rows, INPUTS, "second", fit=B.fit_dropout, trees=3, drop=0.3, skip=0.2, **more),
    "lofo_gate": gated,
    "two_stage": lambda rows, **more: M.two_stage(rows, INPUTS, "first", "second", top=0.3, gate=False, needed=FEW, trees=2, **more)[0],
    "two_stage_status": lambda rows, **more: M.two_stage(rows, INPUTS, "first", "second", top=0.3, needed=FEW, trees=2, **more)[1],
    "exit_walk_forward": exits,
    "retrained_gate": lambda rows, **more: M.retrain(rows, INPUTS, "second", rounds=1, enough=10, trees=2),
}


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("name", sorted(RUNS))
def test_jobs_do_not_grow_with_folds(spark, name):
    few, many = (jobs(spark, f"{name}-{bars}", lambda bars=bars: RUNS[name](members(spark, bars)).collect()) for bars in (140, 260))
    assert 0 < many < few + 18  # 3 and 9 folds; adaptive plans differ by a few jobs


def test_jobs_of_a_whole_run(spark):
    s = [workflow.Settings(rank_rows=20, train=40, oos=n, gap=0, horizon=3, trees=2, least=10) for n in (30, 10)]
    few, many = (jobs(spark, f"run-{x.oos}", lambda x=x: workflow.run(adapters.ticks(spark, "/root/testdata/sf0.001"), x).folds.collect()) for x in s)
    assert 0 < many < few + 18


@pytest.mark.parametrize("name", sorted(set(RUNS) - {"retrained_gate", "two_stage_status"}))
def test_same_as_by_spark_ml(spark, name):
    """``most`` 0: each fold by itself, as where a task cannot hold it.  Nodes are large, so that no two splits gain the same."""
    rows = members(spark, 600, 360, 120).cache()
    key = ["fold_idx", "bar_id"]
    at_once, apart = (RUNS[name](rows, **more).toPandas().sort_values(key) for more in ({"depth": 2}, {"depth": 2, "most": 0}))
    assert len(at_once) == len(apart) > 0 and (at_once[key].to_numpy() == apart[key].to_numpy()).all()
    assert sorted(at_once.columns) == sorted(apart.columns)
    out = "gate_score" if name == "lofo_gate" else "pred"
    assert np.allclose(at_once[out], apart[out], rtol=1e-9, atol=1e-9)


def test_cuts_are_between_values_or_at_even_shares():
    assert grown.cuts(np.array([1.0, 1.0, 2.0, 4.0, 4.0])).tolist() == [1.5, 3.0]
    assert grown.cuts(np.repeat(5.0, 9)).tolist() == []
    many = np.arange(320.0)
    assert grown.cuts(many).tolist() == [10 * k - 0.5 for k in range(1, 32)]


def test_the_order_of_rows_makes_no_difference():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (4, 300)).astype(float)  # coarse, so that many splits gain the same
    y = x[0] - x[2] + rng.normal(size=300)
    turned = rng.permutation(300)
    a, b = grown.fit_rows(x, y, trees=8), grown.fit_rows(x[:, turned], y[turned], trees=8)
    assert np.allclose(a.predict(x), b.predict(x), atol=1e-12)
    assert all((s.feature == t.feature).all() and (s.cut == t.cut).all() for s, t in zip(a.trees, b.trees, strict=True))


def test_bars_of_the_own_fold_teach_no_gate(spark):
    """Two folds predict the same bars, a third one others: each of the two learns from the third only."""
    rows = spark.createDataFrame([(s, i, k, "oos", x, x, y) for k, s, y in ((0, "A", 5.0), (1, "A", 7.0), (2, "B", 1.0)) for i, x in enumerate(np.linspace(0.1, 1, 30).tolist())], "symbol string, bar_id long, fold_idx int, part string, x double, pred double, second double")
    got = M.gate_others(rows, ["x"], "second", least=20, trees=2).groupBy("fold_idx").agg(F.min("gate_score").alias("a"), F.max("gate_score").alias("b")).orderBy("fold_idx")
    assert [(r["a"], r["b"]) for r in got.collect()] == [(1.0, 1.0), (1.0, 1.0), (6.0, 6.0)]
    none = M.gate_others(rows.withColumn("second", F.lit(None).cast("double")), ["x"], "second", least=20, trees=2)
    assert none.count() == 90 and none.filter("gate_score is not null or not gate_pass").isEmpty()
