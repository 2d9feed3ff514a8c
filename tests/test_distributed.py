"""Operators that must not put a group into one task, against plain loops."""

import random
from bisect import insort

import numpy as np
import pytest
from flowspark.operators import evaluation, ordering
from pyspark.sql import functions as F


@pytest.mark.parametrize(("block", "most"), [(1024, 1024), (7, 50), (5, 3), (1, 1000)])
def test_growing_threshold_by_a_plain_pool(spark, block, most):
    rng = random.Random(block)
    rows = []
    for fold in range(3):
        for i in range(150):
            part = "train" if i < (0 if fold == 2 else 60) else "oos"
            rows.append((fold, part, i, rng.choice([None, float("nan"), 0.0, 0.0, 1.0, rng.random(), rng.gauss(i / 50, 1)])))
    want = {}
    for fold in range(3):
        mine = [r for r in rows if r[0] == fold]
        pool = sorted(r[3] for r in mine if r[1] == "train" and r[3] is not None and r[3] == r[3])
        for _, part, i, x in mine:
            if part == "oos":
                want[fold, i] = round(float(np.quantile(pool, 0.8)), 9) if pool else None
                if x is not None and x == x:
                    insort(pool, x)
    df = spark.createDataFrame(rows, "fold_idx int, part string, bar_id long, score double")
    got = evaluation.growing_threshold(df, "score", 0.2, ["fold_idx"], block=block, most=most).collect()
    assert {(r["fold_idx"], r["bar_id"]): None if r["threshold"] is None or r["threshold"] != r["threshold"] else round(r["threshold"], 9) for r in got} == want
    assert all(r["passed"] == (r["score"] is not None and r["threshold"] is not None and r["score"] >= r["threshold"]) for r in got)


def test_ranks_and_quantiles_from_counts(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([np.round(rng.normal(size=500) * 1e-4, 5), np.zeros(200), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(a)] + [(None, -1)], "a double, i long").repartition(6)
    got = {r["i"]: r["r"] for r in ordering.average_ranks(df, "a", "r").collect()}
    order = np.sort(a)
    assert got == {i: (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2 for i, x in enumerate(a)}
    finite = df.filter("abs(a) < 1")
    row = ordering.quantiles(finite, "a", {"q0": 0.0, "q1": 0.37, "q2": 1.0}).first()
    for name, q in (("q0", 0.0), ("q1", 0.37), ("q2", 1.0)):
        assert row[name] == pytest.approx(np.quantile(a[np.abs(a) < 1], q), abs=1e-12)
    assert ordering.quantiles(finite.limit(0), "a", {"q": 0.5}).first()["q"] is None


def test_pooled_metrics_plan_has_no_single_task_over_rows(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice([0.0, rng.gauss(0, 1)]), rng.gauss(0, 1)) for _ in range(400)] + [(None, 1.0)], "p double, y double")
    got = evaluation.pooled_metrics(df, "p", "y").first()
    pdf = df.toPandas().dropna()
    assert got["n"] == 400 and got["spearman"] == pytest.approx(pdf["p"].rank().corr(pdf["y"].rank()), abs=1e-9)
    few = evaluation.pooled_metrics(df.limit(2), "p", "y").first()
    assert few["n"] == 2 and few["spearman"] is None


@pytest.mark.parametrize("block", [1000, 7, 1])
def test_next_true_however_far(spark, block):
    rng = random.Random(block)
    rows = [(s, i, rng.random() < 0.02, i * 2.0) for s in "AB" for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, bar_id long, off boolean, close double")
    got = {(r["symbol"], r["bar_id"]): r["n"] and (r["n"]["bar_id"], r["n"]["close"]) for r in ordering.next_true(df, "off", ["bar_id", "close"], "n", block=block).collect()}
    assert got == {(s, i): next(((j, c) for t, j, off, c in rows if t == s and j > i and off), None) for s, i, _, _ in rows}
