"""Whole runs: parameters that are no good, feature lists, and a run on the smallest tables."""

import pytest
from flowspark.operators import bars, book, features, grid
from flowspark.plans import workflow
from flowspark.sources import adapters
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("name", "bad", "good"),
    [
        ("volume", 0, 1), ("scale", 4, 5), ("rank_rows", 19, 20), ("lags", -1, 0), ("horizon", 0, 1), ("purge", -2, -1), ("trees", 0, 1), ("rate", 0.0, 1.0), ("drop", 1.1, 1.0), ("top", 0.0, 0.5),
        ("spread_rows", 9, 10), ("spread_on", 1.5, 1.0), ("spread_drop", 0.0, 0.1), ("flow_bars", 1, 2), ("confirm", 0, 1), ("peak_bars", 1, 2), ("target", "x", "event"), ("volume", 1.5, 2), ("dropout", 1, True), ("train", True, 50),
    ],
)
def test_settings(name, bad, good):
    with pytest.raises(ValueError, match=name):
        workflow.Settings(**{name: bad})
    assert getattr(workflow.Settings(**{name: good}), name) == good


def test_settings_that_contradict():
    with pytest.raises(ValueError, match="spread_drop must be below"):
        workflow.Settings(spread_on=0.3, spread_drop=0.5)
    with pytest.raises(ValueError, match="purge must be below"):
        workflow.Settings(train=20, purge=20)
    assert workflow.Settings().purged == 10 and workflow.Settings(purge=0).purged == 0


@pytest.mark.parametrize("more", [{}, {"dropout": True, "target": "efficiency", "lags": 1}])
def test_run(spark, more):
    s = workflow.Settings(rank_rows=20, train=40, oos=15, gap=5, horizon=3, trees=2, least=10, **more)
    done = workflow.run(adapters.ticks(spark, SF), s)
    folds = {r["fold_idx"]: r for r in done.folds.collect()}
    assert folds and all(r["status"] == "used" and r["oos"] == 15 for r in folds.values())
    preds = done.predictions
    assert preds.count() == 15 * len(folds) and preds.filter("pred is null").isEmpty()
    assert done.pooled.first()["n"] == preds.filter("y is not null").count() == sum(r["n"] for r in folds.values())
    best = done.importance.collect()
    assert {r["feature"] for r in best} <= set(features.feature_names(s.lags)) and {r["fold_idx"] for r in best} == set(folds)
    for k in folds:
        shares = [r["share"] for r in sorted((r for r in best if r["fold_idx"] == k), key=lambda r: r["rank"])]
        assert shares == sorted(shares, reverse=True) and len(shares) == 20 and sum(shares) <= 1 + 1e-9


def test_grid_features_have_all_names(spark):
    t = adapters.ticks(spark, SF)
    b = bars.grid_bars(t, bars.grid_times(t, 3_600_000, 43_200_000), 200, 3)
    df = grid.grid_features(b, book.ladder_features(adapters.book(spark, SF)), 2, 36_000_000, rank_rows=20)
    names = features.grid_feature_names(2)
    assert len(names) == len(set(names)) == 22 + 10 + 10 + 4 + 2 * 18 + 2 * 9 and df.columns == ["symbol", "grid_ms", "bar_id", *names]
    # What comes with a bar is that of the bar; lags are the bars before it, not the rows.
    plain = grid.rows(grid.bar_columns(b), ["taker_imb", "pde"], ["taker_imb"], 2).select("grid_ms", F.col("taker_imb").alias("t"), F.col("pde").alias("p"), F.col("taker_imb_lag2").alias("l"))
    met = df.join(plain, "grid_ms")
    assert met.count() == df.count() > 50 and met.filter("not (t <=> taker_imb and p <=> pde and l <=> taker_imb_lag2)").isEmpty()
    moved = {r["bar_id"]: r for r in df.select("bar_id", "vpin_delta", "vpin_delta_lag1").collect()}
    assert all(moved[i]["vpin_delta_lag1"] == moved[i - 1]["vpin_delta"] for i in moved if i)
    assert len(features.grid_feature_names(0, book=False)) == 32
