"""Fold models on a planted relation, and what they may not see."""

import random

import pytest
from flowspark.operators import boosting as B
from flowspark.operators import evaluation as E
from flowspark.operators import models as M
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(240):
        x, z = rng.uniform(-1, 1), rng.uniform(-1, 1)
        data.append(("EV", i, x, None if i % 9 == 0 else z, 3.0 * x, x + 2.0 * (x > 0)))
    bars = spark.createDataFrame(data, "symbol string, bar_id long, x double, z double, first double, second double")
    return E.members(bars, E.bar_folds(bars, 120, 40, 5), purge=3)


def test_walk_forward_learns_and_sees_no_later_label(rows):
    got = M.walk_forward(rows, ["x", "z"], "second", trees=5).toPandas()
    assert sorted(got["fold_idx"].unique()) == [0, 1] and len(got) == 80
    assert got["pred"].corr(got["second"]) > 0.9
    changed = rows.withColumn("second", F.when(F.col("part") == "oos", -100.0).otherwise(F.col("second")))
    again = M.walk_forward(changed, ["x", "z"], "second", trees=5).toPandas()
    key = ["fold_idx", "bar_id"]
    assert (got.sort_values(key)["pred"].to_numpy() == again.sort_values(key)["pred"].to_numpy()).all()


def test_gate_passes_the_upper_share(rows):
    preds = rows.filter("part = 'oos'").withColumn("pred", F.lit(1.0))
    got = M.gate_others(preds, ["x", "z"], "second", percent=50.0, least=20, trees=5).toPandas()
    assert len(got) == 80 and got["gate_score"].notna().all()
    assert got[got.gate_pass]["second"].mean() > got[~got.gate_pass]["second"].mean() + 1


FEW = {"alpha train": 50, "alpha oos": 20, "alpha pass": 5, "entry candidates": 50, "entry train": 20, "entry oos": 5}


def test_two_stage_uses_the_predicted_value(rows):
    preds, status = M.two_stage(rows, ["x", "z"], "first", "second", top=0.5, gate=False, needed=FEW, trees=5)
    got = preds.toPandas()
    assert len(got) == 80 and (got["alpha_feature"] == got["alpha_pred"]).all() and got["alpha_threshold"].isna().all()
    assert got["alpha_pred"].corr(got["first"]) > 0.9 and got["pred"].notna().all()
    assert [r["status"] for r in status.orderBy("fold_idx").collect()] == ["used", "used"]


def test_two_stage_gates_oos_rows(rows):
    preds, status = M.two_stage(rows, ["x", "z"], "first", "second", top=0.25, needed=FEW, trees=5)
    got, found = preds.toPandas(), {r["fold_idx"]: r for r in status.collect()}
    assert (got["alpha_pred"] >= got["alpha_threshold"]).all()
    assert 0 < len(got) < 40 and got["first"].mean() > 1.0  # the upper quarter of values in -3 to 3
    assert {k: r["alpha_pass"] for k, r in found.items()} == got.groupby("fold_idx").size().to_dict()
    assert all(r["alpha_oos"] == 40 and r["alpha_train"] == r["entry_candidates"] == 117 for r in found.values())


def test_two_stage_says_what_is_missing(rows):
    for step, n in (("alpha train", 118), ("alpha oos", 41), ("alpha pass", 41), ("entry candidates", 118), ("entry train", 118), ("entry oos", 41)):
        preds, status = M.two_stage(rows, ["x", "z"], "first", "second", top=0.25, needed=FEW | {step: n}, trees=2)
        assert preds.isEmpty() and {r["status"] for r in status.collect()} == {f"too few: {step}"}
        assert {"alpha_pred", "alpha_threshold", "alpha_feature", "pred"} <= set(preds.columns)


def planted(spark, parts):
    """A step with a slope; one row in twelve is off by a thousand."""
    rng = random.Random(8)
    data = []
    for i in range(900):
        x, z = rng.uniform(-1, 1), rng.choice([None, float("nan"), rng.uniform(-1, 1)])
        clean = 2.0 * (x > 0) + x
        data.append((i, x, z, clean + rng.choice([-1, 1]) * (1000.0 if i % 12 == 0 else 0.0), clean))
    data.append((900, 0.5, 0.5, None, 2.5))
    return spark.createDataFrame(data, "i long, x double, z double, y double, clean double").repartition(parts, "i")


def test_dropout_boosting_on_outliers(spark):
    df = planted(spark, 5)
    model = B.fit_dropout(df, ["x", "z"], "y", trees=25, rate=0.3, drop=0.2, skip=0.3)
    got = model.transform(df).toPandas()
    assert list(got.columns) == ["i", "x", "z", "y", "clean", "pred"] and got["pred"].notna().all()
    error = ((got["pred"] - got["clean"]) ** 2).mean() ** 0.5
    squares = M.fit_trees(df.filter("y is not null").fillna(0.0, ["z"]).withColumn("z", F.nanvl("z", F.lit(0.0))), ["x", "z"], "y", "pred", trees=25, rate=0.3)
    loose = squares.transform(df.fillna(0.0, ["z"]).withColumn("z", F.nanvl("z", F.lit(0.0)))).toPandas()
    assert error < 0.6 and error < 0.1 * ((loose["pred"] - loose["clean"]) ** 2).mean() ** 0.5
    assert len({round(w, 9) for w in model.weights}) > 1  # trees were dropped and rescaled


def test_dropout_boosting_is_alike_for_any_partitions(spark):
    models = [B.fit_dropout(planted(spark, n), ["x", "z"], "y", trees=6, drop=0.5, skip=0.0) for n in (1, 7)]
    assert models[0] == models[1]
    # A tree that is dropped k at a time keeps k / (k + 1) of its weight, and the new one takes the rest.
    assert B.fit_dropout(planted(spark, 2), ["x"], "y", trees=2, drop=1.0, skip=0.0, rate=0.4).weights == [0.2, 0.2]


def test_no_fold_gives_no_rows(rows):
    got = M.walk_forward(rows.limit(0), ["x", "z"], "second")
    assert "pred" in got.columns and got.count() == 0
