"""Boosted regression trees with dropout of trees and a robust loss.

Each round drops some of the earlier trees, takes the residuals of the others, clips them at ``delta`` (the slope
of Huber's loss) and fits one tree of Spark ML to them.  The new tree and the dropped ones are then rescaled, so
that together they weigh as the dropped ones did: with k of them dropped, the new one counts 1 / (k + 1) and each
dropped one k / (k + 1) of what it did.

Features are cut into bins at quantiles first, and residuals are whole numbers of ``delta / STEPS``: sums are exact,
so the same rows give the same trees however they are dealt.  A tree is kept as numbers and applied as one SQL
expression; nothing of the rows passes through the driver or Python.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.session import stored

from .grown import fit_dropped
from .ordering import counted, quantiles

#: Bins of a feature, and steps of a residual between 0 and where it is clipped: squares of steps sum up
#: exactly over 2**33 rows.
BINS, STEPS = 32, 1024


def column_of(node, bins: list[str]) -> Column:
    """A tree (nested (feature, threshold, left, right), or a leaf's number) as an expression."""
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, threshold, left, right = node
    return F.when(F.col(bins[feature]) <= threshold, column_of(left, bins)).otherwise(column_of(right, bins))


def nodes_of(model: DecisionTreeRegressionModel):
    def walk(node):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._java_obj.rootNode())


def bin_edges(rows: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """The different values at 1 / BINS, 2 / BINS, ... of each feature's order, of all features at once: ``BINS`` - 1
    numbers a feature."""
    long = rows.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features]).unpivot([], list(features), "_f", "_v")
    ranked = counted(long, "_v", ("_f",))
    sizes = ranked.groupBy("_f").agg(F.max("_upto").alias("_all"))
    # A value is an edge if the place of a quantile lies among its copies.
    place = lambda n: F.ceil(n * BINS / F.col("_all"))
    hit = ranked.join(sizes, "_f").filter((place(F.col("_upto")) > place(F.col("_upto") - F.col("_n"))) & (F.abs("_v") < math.inf))
    found: dict[str, list[float]] = {c: [] for c in features}
    for r in hit.select("_f", "_v").collect():
        found[r["_f"]].append(r["_v"])
    return {c: sorted(v)[:-1] if len(v) > BINS - 1 else sorted(v) for c, v in found.items()}


@dataclass
class Boosted:
    """A fitted model: where features are cut, and trees with their weights."""

    features: list[str]
    edges: dict[str, list[float]]
    base: float
    unit: float
    out: str
    trees: list = field(default_factory=list)
    gains: list[list[float]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    @property
    def bins(self) -> list[str]:
        return [f"_bin_{i}" for i in range(len(self.features))]

    def binned(self, df: DataFrame) -> DataFrame:
        """Add the bins: how many edges a value is above; a missing or NaN value is below all."""
        above = lambda c: sum((F.coalesce(F.col(c) > e, F.lit(False)).cast("int") for e in self.edges[c]), F.lit(0))
        return df.withColumns({b: F.when(F.isnan(F.col(c).cast("double")), 0).otherwise(above(c)).cast("double") for b, c in zip(self.bins, self.features, strict=True)})

    def value(self, without: frozenset[int] = frozenset()) -> Column:
        terms = [F.lit(w * self.unit) * column_of(t, self.bins) for i, (t, w) in enumerate(zip(self.trees, self.weights, strict=True)) if i not in without]
        return sum(terms, F.lit(self.base))

    def importance(self) -> list[float]:
        """Each feature's share of the gain, mean over trees."""
        total = [sum(g[i] for g in self.gains) for i in range(len(self.features))]
        return [x / (sum(total) or 1.0) for x in total]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction in ``out``."""
        return self.binned(df).withColumn(self.out, self.value()).drop(*self.bins)


def fit_dropout(train: DataFrame, features: list[str], y: str, out: str = "pred", trees: int = 20, depth: int = 3, rate: float = 0.1, drop: float = 0.1, skip: float = 0.5, most_dropped: int = 50, delta: float | None = None, robust: float = 0.9, seed: int = 7, least: int = 20) -> Boosted:
    """Learn ``y``; rows without it are left out.

    Residuals are clipped at ``delta``, or at the ``robust`` quantile of the distances from the median.  A round drops
    each tree with probability ``drop``, at most ``most_dropped``, and none with probability ``skip``.  A leaf has
    ``least`` rows at least.
    """
    rows = train.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).withColumn(y, F.col(y).cast("double"))
    rows = stored(rows.select(*features, y), "boosting-rows")
    edges = bin_edges(rows, features)
    base = quantiles(rows, y, {"m": 0.5}).first()["m"] or 0.0
    if delta is None:
        delta = quantiles(rows.select(F.abs(F.col(y) - base).alias("d")), "d", {"q": robust}).first()["q"] or 0.0
    model = Boosted(list(features), edges, base, max(delta, 1e-12) / STEPS, out)
    table = stored(VectorAssembler(inputCols=model.bins, outputCol="_x").transform(model.binned(rows)).select("_x", *model.bins, F.col(y).alias("_y")), "boosting-bins")
    tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_g", maxDepth=depth, maxBins=BINS + 1, minInstancesPerNode=least, seed=seed)
    for k in range(trees):
        rng = random.Random(seed * 1_000_003 + k)
        chosen = [i for i in range(len(model.trees)) if rng.random() < drop] if rng.random() >= skip else []
        dropped = frozenset(rng.sample(chosen, min(len(chosen), most_dropped)))
        steps = F.round((F.col("_y") - model.value(dropped)) / F.lit(model.unit))
        fitted = tree.fit(table.withColumn("_g", F.greatest(F.lit(-float(STEPS)), F.least(F.lit(float(STEPS)), steps))))
        n = len(dropped)
        for i in dropped:
            model.weights[i] *= n / (n + 1)
        model.trees.append(nodes_of(fitted))
        model.gains.append(fitted.featureImportances.toArray().tolist())
        model.weights.append(rate / (n + 1))
    return model


#: The same fit on arrays, for folds that a task can hold.
fit_dropout.rows = fit_dropped
