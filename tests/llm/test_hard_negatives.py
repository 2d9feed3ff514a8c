"""Hard negatives against all pairs, on crowded, clustered and odd vectors."""

import random
from functools import partial

import numpy as np
import pytest
from flowspark.llm import hard_negatives
from flowspark.llm.hard_negatives import mine
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, v string, h string"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def expected(rows, every, k=5, low=80):
    whole = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            whole[i] = ([int(np.floor(float(np.float32(c)) * 256)) for c in x], label)
    out = []
    for a, (q, label) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, x)), i, other) for i, (x, other) in whole.items() if i != a)
        for p, pid in [(-s, i) for s, i, other in scored if other == label][:k]:
            met = [(-s, i) for s, i, other in scored if other != label and low * p <= -100 * s <= 100 * p][:k]
            out += [(a, pid, n + 1, i, p, s) for n, (s, i) in enumerate(met)]
    return sorted(out)


def got(df, every, **more):
    return sorted(tuple(r[c] for c in NAMES) for r in mine(df, F.col("vec_id") % every == 0, **more).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], label, 1, "c", "c") for i, x, label in rows], SCHEMA)


@pytest.mark.parametrize(("part", "anchors"), [(8192, 4096), (37, 5)])
def test_by_all_pairs(spark, part, anchors):
    rng = np.random.default_rng(part)
    centres = rng.normal(size=(6, 8))
    rows = [(i, centres[i % 6] + rng.normal(size=8) * 0.15, int(rng.integers(3))) for i in range(400)]
    rows += [(i, np.round(centres[0], 1), i % 3) for i in range(400, 600)]  # a third of all rows are copies
    rows += [(600, None, 1), (601, [1.0], None), (602, [float("nan")] * 8, 1), (603, [float("inf")] * 8, 1), (604, [None] * 8, 1), (None, [1.0] * 8, 1), (605, [], 1), (606, [1.0, 2.0], 0), (620, [0.0] * 8, 2)]
    rng.shuffle(rows)
    assert got(frame(spark, rows), 5, part=part, anchors=anchors) == expected(rows, 5)


def test_bounds_keep_far_candidates_away(spark):
    """On clustered vectors of one length most candidates go to few groups; results are those of all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, x / np.linalg.norm(x), i // 12 % 2) for i, x in ((i, centres[i % 12] + rng.normal(size=16) * 0.05) for i in range(1200))]
    df = frame(spark, rows)
    run = hard_negatives.Mining(hard_negatives.as_integers(df, F.col("vec_id") % 2 == 0, F.col("label")), 5, 5, 80, 100, 8192, 4096)
    me = [F.col("anchor_id").alias("vec_id"), F.col("anchor_h").alias("h"), F.col("anchor_label").alias("label")]
    own = run.join(run.anchors, 5, None).groupBy(*me).agg(F.min("score").alias("score"))
    bounds = run.bounds(run.anchors, own)
    candidates = run.placed.filter("not anchor").select("vec_id", "h", "label", "v", "cell")
    spread = partial(hard_negatives._spread, pivots=run.pivots, top=run.top, dim=run.dim, bounds=bounds, parts=1, pieces=run.pieces)
    moved = candidates.mapInArrow(spread, "cell int, piece int, part int, vec_id long, h long, label long, v binary").count()
    assert moved < candidates.count() * len(run.pieces) / 3
    assert got(df, 2) == expected(rows, 2)


def test_ties_and_repeats(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(40)] + [(100, [1.0, 0.0], 0)] * 3
    assert got(frame(spark, rows), 10) == expected(rows, 10)
    assert got(frame(spark, rows).filter("false"), 10) == []


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-3e5, 3e5) for _ in range(4)], i % 2) for i in range(60)]
    assert got(frame(spark, rows), 6) == expected(rows, 6)
