"""Operators on small relations: two instruments, ranks by hand, joins that must not multiply."""

import pytest
from flowspark.operators import evaluation as E
from flowspark.operators import exits as P
from flowspark.operators import features as X
from flowspark.operators import grid as G
from flowspark.operators import ordering as O
from flowspark.operators import tables as N
from flowspark.plans import catalog
from flowspark.sources import adapters
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def values(df, column, order="bar_id"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_rolled_by_hand(spark):
    df = spark.createDataFrame([("X", i, v) for i, v in enumerate([1.0, 2.0, None, 2.0, 5.0, 2.0, None, 1.0])], "symbol string, bar_id long, v double")
    for block in (8192, 3):
        got = X.rolled(df, {"pct": ("rank", "v", 4, 2), "mid": ("median", "v", 3, 1)}, block=block)
        assert [x if x is None else round(x, 6) for x in values(got, "pct")] == [None, 1.0, None, 0.833333, 1.0, 0.5, None, 0.333333]
        assert values(got, "mid") == [1.0, 1.5, 1.5, 2.0, 3.5, 2.0, 3.5, 1.5]
    z = spark.createDataFrame([("X", i, v) for i, v in enumerate([1.0, 2.0, 4.0, 8.0, 100.0])], "symbol string, bar_id long, v double")
    assert [x if x is None else round(x, 6) for x in values(X.robust_z(z, {"z": "v"}, 3, 1), "z")] == [None, 1.348982, 2.697963, 1.348982, 15.513287]


def test_quantile_counts_values(spark):
    df = spark.createDataFrame([("X", float(v)) for v in (5, 1, 1, 2, 100, -3)] + [("Y", 7.0), ("Z", None)], "symbol string, v double")
    got = {r.symbol: r.q for r in O.quantile(df, "v", 0.8, "q").collect()}
    assert got == {"X": 5.0, "Y": 7.0} and {r.symbol: r.q for r in O.quantile(df, "v", 0.5, "q").collect()}["X"] == 1.5


def test_running_sum_with_missing_keys(spark):
    df = spark.createDataFrame([("X", None, 1, 0, 2), ("X", None, 2, 0, 3), (None, None, 1, 0, 5)], "symbol string, dt string, ts_ms long, seq long, v long")
    assert sorted(r.s for r in O.running_sum(df, "v", "s").collect()) == [2, 5, 5]


def test_two_instruments_are_kept_apart(spark):
    ticks = adapters.ticks(spark, SF).withColumn("symbol", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"))
    from flowspark.operators import bars as B

    def made(t):
        b = X.bar_features(B.volume_bars(t, 200), 1, 40)
        return E.members(b, E.bar_folds(b, 60, 20, 5), 3)

    both = made(ticks)
    for name in "AB":
        one = made(ticks.filter(F.col("symbol") == name))
        assert one.count() > 0 and sorted(map(str, both.filter(F.col("symbol") == name).collect())) == sorted(map(str, one.collect()))
    assert set(X.feature_names(1)) <= set(both.columns) and len(X.feature_names(2)) == 29 + 2 * 18


def test_growing_threshold_by_hand(spark):
    rows = [(0, i, "train", v) for i, v in enumerate([0.1, 0.2, 0.3, 0.4, 0.5])] + [(0, 10 + i, "oos", v) for i, v in enumerate([0.45, 0.6, 0.3, 0.55])]
    got = E.growing_threshold(spark.createDataFrame(rows, "fold_idx int, bar_id long, part string, s double"), "s", 0.2, ["fold_idx"])
    assert [round(x, 6) for x in values(got, "threshold")] == [0.42, 0.45, 0.49, 0.48] and values(got, "passed") == [True, True, False, True]


def test_path_lags_meet_the_nearest_sample(spark):
    samples = catalog.P.resample(catalog.paths(spark, SF), 6)
    got = {(r.event_id, r.sample): r for r in P.path_features(samples, 3600.0, 3, 3).collect()}
    rows = samples.collect()
    for r in rows:
        own = sorted((s for s in rows if s.event_id == r.event_id), key=lambda s: s.sample)
        for k in (1, 2, 3):
            aim = r.elapsed - k * 3600.0
            near = min(own, key=lambda s: (abs(s.elapsed - aim), s.sample)) if aim >= 0 else None
            assert got[r.event_id, r.sample][f"pnl_lag{k}"] == (near.pnl if near else 0.0)


def test_checked_joins(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, v string")
    assert {r.k: r.v for r in N.unique_join(left, right, ["k"]).collect()} == {1: "a", 2: "b", 3: None}
    assert {r.k: r.v for r in N.align(left, right, ["k"]).collect()} == {1: "a", 2: "b", 3: None}
    with pytest.raises(Exception, match="more than once"):
        N.unique_join(left, right.union(right), ["k"]).collect()
    assert N.union_set(left, left, left.limit(1)).count() == 3
    with pytest.raises(Exception, match="gaps"):
        E.null_rows(right.withColumn("v", F.lit(None)), ["v"], 0.2).collect()
    assert E.null_rows(right.limit(0), ["v"]).first().null_rows == 1.0


def test_schema_and_head(spark):
    df = spark.createDataFrame([("X", i, float(i)) for i in range(5)], "symbol string, bar_id long, v double")
    assert G.complete(df, ["v", "w"]).columns == ["symbol", "bar_id", "v", "w"] and G.head(df, 3).count() == 3
