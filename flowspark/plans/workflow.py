"""A walk-forward run from ticks to a summary, with its parameters checked before anything is computed."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators import bars as B
from flowspark.operators import boosting as T
from flowspark.operators import evaluation as E
from flowspark.operators import features as X
from flowspark.operators import models as M
from flowspark.operators import signals as S
from flowspark.session import stored

TARGETS = ("vwap", "efficiency", "variable", "event", "trend")


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; a value outside its range is an error that names it.

    ``purge`` -1 stands for the horizon.  ``decay`` 0 weighs all train rows alike.
    """

    volume: int = 500
    scale: int = 18
    rank_rows: int = 200
    lags: int = 0
    target: str = "vwap"
    horizon: int = 10
    train: int = 400
    oos: int = 100
    gap: int = 20
    purge: int = -1
    trees: int = 20
    depth: int = 3
    rate: float = 0.1
    dropout: bool = False
    drop: float = 0.1
    least: int = 50
    top: float = 0.1
    spread_rows: int = 100
    spread_on: float = 0.8
    spread_drop: float = 0.3
    flow_bars: int = 4
    consistency: float = 0.5
    confirm: int = 2
    peak_bars: int = 20

    #: name: (least, whether it may be that, most, whether it may be that)
    RANGES = {
        "volume": (1, True, math.inf, False), "scale": (5, True, math.inf, False), "rank_rows": (20, True, math.inf, False), "lags": (0, True, math.inf, False),
        "horizon": (1, True, math.inf, False), "train": (1, True, math.inf, False), "oos": (1, True, math.inf, False), "gap": (0, True, math.inf, False),
        "purge": (-1, True, math.inf, False), "trees": (1, True, math.inf, False), "depth": (1, True, 30, True), "rate": (0, False, 1, True), "drop": (0, True, 1, True),
        "least": (1, True, math.inf, False), "top": (0, False, 1, True), "spread_rows": (10, True, math.inf, False), "spread_on": (0, False, 1, True),
        "spread_drop": (0, False, 1, False), "flow_bars": (2, True, math.inf, False), "consistency": (0, False, 1, True), "confirm": (1, True, math.inf, False), "peak_bars": (2, True, math.inf, False),
    }

    def __post_init__(self) -> None:
        for f in fields(self):
            value, kind = getattr(self, f.name), {"int": int, "float": (int, float), "bool": bool, "str": str}[f.type]
            if not isinstance(value, kind) or isinstance(value, bool) and f.type != "bool":
                raise ValueError(f"{f.name} must be of type {f.type}, not {value!r}")
            if f.name in self.RANGES:
                low, with_low, high, with_high = self.RANGES[f.name]
                if not ((value > low or with_low and value == low) and (value < high or with_high and value == high)):
                    raise ValueError(f"{f.name} must lie in {'[' if with_low else '('}{low}, {high}{']' if with_high else ')'}, not be {value!r}")
        if self.target not in TARGETS:
            raise ValueError(f"target must be one of {', '.join(TARGETS)}, not {self.target!r}")
        if self.spread_drop >= self.spread_on:
            raise ValueError("spread_drop must be below spread_on")
        if self.purge >= self.train:
            raise ValueError("purge must be below train")

    @property
    def purged(self) -> int:
        return self.horizon if self.purge == -1 else self.purge


@dataclass
class Run:
    """What a run gives: ``predictions`` of oos rows, ``folds`` (metrics and status), one row ``pooled`` over all, and
    ``importance`` (fold_idx, rank, feature, share) of the 20 features with the largest gain."""

    predictions: DataFrame
    folds: DataFrame
    pooled: DataFrame
    importance: DataFrame


def labelled(bars: DataFrame, s: Settings) -> DataFrame:
    """Bars with the label ``y`` of the run's target."""
    if s.target == "vwap":
        return S.label_vwap(bars, s.horizon).withColumnRenamed("y_vwap", "y")
    if s.target == "efficiency":
        return S.label_efficiency(bars, s.horizon).withColumnRenamed("y_efficiency", "y")
    if s.target == "variable":
        return S.label_variable_horizon(bars, s.horizon).withColumnRenamed("y_variable", "y")
    if s.target == "trend":
        return S.label_scaled_trend(bars, s.horizon).withColumnRenamed("y_scaled", "y")
    shocks = S.shock_trigger(bars, s.spread_rows, s.spread_on, s.spread_drop, s.flow_bars, s.consistency, s.confirm, s.peak_bars)
    return S.label_event(shocks).withColumnRenamed("y_event", "y")


def prepared(ticks: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    """Bars of the run in its folds, with features and ``y``; and the features' names."""
    bars = X.bar_features(B.volume_bars(ticks, s.volume), s.lags, s.rank_rows, s.scale)
    names = X.feature_names(s.lags)
    rows = labelled(bars, s).select("symbol", "bar_id", "ts_ms", *names, "y")
    finite = [F.when(F.abs(c) < math.inf, F.col(c)).alias(c) for c in names]  # neither NaN nor infinite
    rows = stored(rows.select("symbol", "bar_id", "ts_ms", *finite, "y"), "run-rows")
    return E.members(rows, E.bar_folds(rows, s.train, s.oos, s.gap), purge=s.purged), names


def run(ticks: DataFrame, settings: Settings | None = None) -> Run:
    """Features, labels, folds, a model for each fold, and the summary of its predictions."""
    s = settings or Settings()
    rows, names = prepared(ticks, s)
    gains: dict[int, list[tuple[str, float]]] = {}
    more = {"fit": T.fit_dropout, "drop": s.drop} if s.dropout else {}
    preds = M.walk_forward(rows, names, "y", least=s.least, gains=gains, trees=s.trees, depth=s.depth, rate=s.rate, **more)
    preds = stored(preds.select("symbol", "fold_idx", "bar_id", "ts_ms", "y", "pred"), "run-predictions")
    parts = [E.spearman(preds, "pred", "y", ["fold_idx"]), E.fit_metrics(preds, "pred", "y", ["fold_idx"]).drop("n"), E.top_confidence(preds, "pred", "y", s.top, ["fold_idx"]).select("fold_idx", "k", F.col("sign_acc").alias("top_sign_acc"), F.col("pnl_mean").alias("top_pnl_mean"))]
    folds = M.fold_status(rows, "y", s.least)
    for part in parts:
        folds = folds.join(part, "fold_idx", "left")
    flat = [(k, i + 1, name, share) for k, best in sorted(gains.items()) for i, (name, share) in enumerate(best)]
    importance = rows.sparkSession.createDataFrame(flat, "fold_idx int, rank int, feature string, share double")  # 20 rows a fold
    return Run(preds, folds, E.pooled_metrics(preds, "pred", "y"), importance)
