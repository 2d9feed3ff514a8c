"""Trees of folds that are small enough for a task: the fits of ``models.fit_trees`` and ``boosting.fit_dropout`` on arrays.

Cuts, gains and weights are those of Spark ML's trees over all rows: of splits that gain the same, up to rounding, the
first feature's lowest one is taken, so that the order of rows makes no difference.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np

#: Bins of a feature, as Spark ML's default, and the share by which two gains count as equal.
BINS, SAME = 32, 1e-9


def cuts(ordered: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Where sorted values are cut: between all different ones, or at even shares of the rows."""
    n, most = len(ordered), min(bins, len(ordered)) - 1
    ends = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) if n else np.array([], int)
    values, upto = ordered[ends], ends + 1.0
    mids = (values[:-1] + values[1:]) / 2.0
    if len(mids) <= most:
        return mids
    stride, at, found = n / (most + 1), 0, []
    around, target = upto[:-1] + upto[1:], n / (most + 1)
    while at < len(around):
        at = max(at, int(np.searchsorted(around, 2 * target, "right")))
        if at < len(around):
            found.append(at)
            at, target = at + 1, target + stride
    return mids[found]


@dataclass
class Tree:
    """Nodes by number; ``left`` is 0 for a leaf, and the right child follows the left one."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gains: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """``x``: a row of values for each feature."""
        at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        while self.left[at].any():
            go = self.left[at] > 0
            at = np.where(go, self.left[at] + (x[self.feature[at], rows] > self.cut[at]), at)
        return self.value[at]


def grow(bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray, depth: int, least: int = 1) -> tuple[Tree, np.ndarray]:
    """A tree of least squares over binned features, and the leaf of each row."""
    wide = max([len(e) for e in edges] + [0]) + 1
    mean = float(y.mean())
    y = y - mean
    none = 1e-14 * float(y @ y)
    feature, cut, left, value, gains = [0], [0.0], [0], [mean], np.zeros(len(edges))
    at, open_ = np.zeros(len(y), np.int64), [0]
    for _ in range(depth):
        slot = np.full(len(feature), len(open_))
        slot[open_] = np.arange(len(open_))
        place, m = slot[at] * wide, len(open_)
        best = np.full((m, len(edges), wide), -1.0)
        sums, sizes = [], []
        for f in range(len(edges)):
            key = place + bins[f]
            n = np.bincount(key, minlength=(m + 1) * wide)[: m * wide].reshape(m, wide).cumsum(1)
            s = np.bincount(key, y, (m + 1) * wide)[: m * wide].reshape(m, wide).cumsum(1)
            sums.append(s), sizes.append(n)
            all_n, all_s = n[:, -1:], s[:, -1:]
            right = all_n - n
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s * s / n + (all_s - s) ** 2 / right - all_s * all_s / all_n
            best[:, f] = np.where((n >= least) & (right >= least) & (n > 0) & (right > 0), gain, -1.0)
        then, split = [], np.zeros(len(feature), bool)
        for i, node in enumerate(open_):
            top = best[i].max()
            if not top > none:
                continue
            f, b = divmod(int(np.argmax(best[i].ravel() >= top * (1 - SAME))), wide)
            if b >= len(edges[f]):
                continue
            n, s = sizes[f][i], sums[f][i]
            feature[node], cut[node], left[node], split[node] = f, float(edges[f][b]), len(feature), True
            gains[f] += best[i, f, b]
            for size, total in ((n[b], s[b]), (n[-1] - n[b], s[-1] - s[b])):
                then.append(len(feature))
                feature.append(0), cut.append(0.0), left.append(0), value.append(mean + float(total / size))
        if not then:
            break
        rows = np.flatnonzero(split[at])
        nodes = at[rows]
        fs, lefts = np.array(feature)[nodes], np.array(left)[nodes]
        limits = np.array([np.searchsorted(edges[feature[k]], cut[k]) if left[k] else 0 for k in range(len(split))])
        at[rows] = lefts + (bins[fs, rows] > limits[nodes])
        open_ = then
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value), gains), at


@dataclass
class Fitted:
    """Trees with their weights, over a base."""

    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    edges: list[np.ndarray] | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = x if self.edges is None else above(x, self.edges)
        total = np.full(x.shape[1], self.base)
        for t, w in zip(self.trees, self.weights, strict=True):
            total += w * t.predict(x)
        return total

    def shares(self) -> np.ndarray:
        """Each feature's share of the gain."""
        # With dropout every tree counts alike, as in ``boosting.Boosted``.
        each = [t.gains / (t.gains.sum() or 1.0) if self.edges is not None else t.gains for t in self.trees]
        total = np.sum(each, axis=0)
        return total / (total.sum() or 1.0)


def ordered_bins(x: np.ndarray, order: np.ndarray, keep: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bins and cuts of the rows of ``keep``, from the order of all rows by each feature."""
    place = np.cumsum(keep) - 1
    got, edges = np.empty((len(x), int(keep.sum())), np.int64), []
    for f in range(len(x)):
        rows = order[f][keep[order[f]]]
        values = x[f, rows]
        edges.append(cuts(values, bins))
        ends = np.searchsorted(values, edges[-1], "right")
        got[f, place[rows]] = np.repeat(np.arange(len(ends) + 1), np.diff(np.concatenate([[0], ends, [len(values)]])))
    return got, edges


def orders(x: np.ndarray) -> np.ndarray:
    return np.argsort(x, axis=1, kind="stable")


def boost(bins: np.ndarray, edges: list[np.ndarray], y: np.ndarray, late: tuple[np.ndarray, np.ndarray] | None = None, trees: int = 20, depth: int = 3, rate: float = 0.1) -> Fitted:
    """Gradient boosting on squares; the first tree counts whole.  ``late``: values and labels that tell when to stop, with
    the rules of Spark ML's ``GBTRegressor``."""
    model, pred, best, kept = Fitted(), np.zeros(len(y)), math.inf, 0
    held = np.zeros(len(late[1])) if late else None
    for k in range(trees):
        tree, at = grow(bins, edges, 2.0 * (y - pred) if k else y, depth)
        weight = rate if k else 1.0
        model.trees.append(tree)
        model.weights.append(weight)
        pred = pred + weight * tree.value[at]
        if late:
            held = held + weight * tree.predict(late[0])
            error = float(((late[1] - held) ** 2).mean()) if len(held) else math.nan
            if k and best - error < 0.01 * max(error, 0.01):
                break
            if not k or error < best:
                best, kept = error, k + 1
    if late:
        model.trees, model.weights = model.trees[:kept], model.weights[:kept]
    return model


def fit_rows(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 7) -> Fitted:
    """As ``models.fit_trees``, which draws nothing by its seed either: all rows and features count."""
    bins, edges = ordered_bins(x, orders(x), np.ones(len(y), bool))
    return boost(bins, edges, y, None, trees, depth, rate)


def above(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """How many edges a value is above; none for a missing one."""
    return np.stack([np.where(np.isnan(v), 0, np.searchsorted(e, v, "left")) for v, e in zip(x, edges, strict=True)]).astype(float)


def quantile(ordered: np.ndarray, share: float) -> float:
    rank = (len(ordered) - 1) * share
    low, high = float(ordered[math.floor(rank)]), float(ordered[math.ceil(rank)])
    return low + (high - low) * (rank - math.floor(rank))


def even_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """As ``boosting.bin_edges``, for one feature."""
    found, upto = np.unique(values[~np.isnan(values)], return_counts=True)
    upto = upto.cumsum()
    if not len(found):
        return found
    place = np.ceil(np.concatenate([[0], upto]) * bins / upto[-1])
    hit = found[(place[1:] > place[:-1]) & (np.abs(found) < math.inf)]
    return hit[:-1] if len(hit) > bins - 1 else hit


def fit_dropped(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.1, drop: float = 0.1, skip: float = 0.5, most_dropped: int = 50, delta: float | None = None, robust: float = 0.9, seed: int = 7, least: int = 20, bins: int = 32, steps: int = 1024) -> Fitted:
    """As ``boosting.fit_dropout``."""
    there = ~np.isnan(y)
    x, y = x[:, there], y[there]
    base = quantile(np.sort(y), 0.5)
    if delta is None:
        delta = quantile(np.sort(np.abs(y - base)), robust)
    unit = max(delta, 1e-12) / steps
    model = Fitted(base, edges=[even_edges(v, bins) for v in x])
    binned = above(x, model.edges)
    codes, edges = ordered_bins(binned, orders(binned), np.ones(len(y), bool), bins + 1)
    weights, fitted = [], []
    for k in range(trees):
        rng = random.Random(seed * 1_000_003 + k)
        chosen = [i for i in range(k) if rng.random() < drop] if rng.random() >= skip else []
        dropped = set(rng.sample(chosen, min(len(chosen), most_dropped)))
        value = np.full(len(y), base)
        for i in range(k):
            if i not in dropped:
                value = value + weights[i] * unit * fitted[i]
        far = (y - value) / unit
        far = np.sign(far) * np.floor(np.abs(far) + 0.5)
        tree, at = grow(codes, edges, np.clip(far, -steps, steps), depth, least)
        n = len(dropped)
        for i in dropped:
            weights[i] *= n / (n + 1)
        model.trees.append(tree)
        fitted.append(tree.value[at])
        weights.append(rate / (n + 1))
    model.weights = [w * unit for w in weights]
    return model
