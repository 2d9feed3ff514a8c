"""Hard-negative mining: a Voronoi-partition distributed kNN join.

Vectors become integers, and each gets one more coordinate that fills its norm up to the largest one.
Anchors get 0 there.  A larger inner product is then a smaller distance.  All vectors are assigned to
the nearest of a few pivots; anchors of one cell are a group.  A join within the cells gives each anchor
a first bound on the distance that it has to look at.  With the group's largest bound and radius, a
candidate goes to another group only if it may be near enough to serve an anchor there.  Groups are then
joined exactly, in integers.

Candidates of a group are dealt to parts of about ``PART`` rows and its anchors to parts of about
``ANCHORS``, so no task holds a whole cell, however crowded.  Only pivots and the bounds of the cells
(``MOST_PIVOTS`` at most) pass through the driver.

Rows without a vec_id, a label or a vector, or with a null or non-finite component, take no part.
Rows equal in all three are one row; others are told apart also if they share a vec_id (ties after the
id: by a hash of the vector, then the label).  Shorter vectors count as filled with zeros.  Scores must
fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of candidates and of anchors that a local join holds (about), and pivots at most.
PART, ANCHORS, MOST_PIVOTS = 8192, 4096, 512
#: Anchors that are scored against a part at once.
SLICE = 64
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)

PLACED = "vec_id long, h long, label long, anchor boolean, v binary, cell int"
HITS = "anchor_id long, anchor_h long, vec_id long, h long, label long, score long"


def as_integers(vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, h, label, anchor, x): the rows that take part, with whole components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), is_anchor.alias("anchor"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)))
    rows = rows.withColumn("x", F.transform("x", lambda c: F.floor(c * scale).cast("long"))).withColumn("h", F.xxhash64("x"))
    return rows.dropDuplicates(["vec_id", "h", "label", "x"]).withColumn("anchor", F.coalesce("anchor", F.lit(False)))


def only_first(rows: DataFrame, most: int) -> DataFrame:
    """Of rows with the same vector and label, only the ``most`` first by id can be among the first
    ``most`` of any anchor; anchors stay as well.  The count is limited before the shuffle too."""
    alike = Window.partitionBy("label", "h", "x").orderBy("vec_id")
    first = rows.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= most).drop("_n")
    return first.withColumn("candidate", F.lit(True)).unionByName(rows.filter("anchor").withColumn("candidate", F.lit(False)))


def _matrix(cells: pa.Array | pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() if isinstance(x, pa.Scalar) else x for x in cells), np.int64).reshape(-1, dim)


def _far(points: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of augmented points from augmented pivots, (points, pivots)."""
    p = np.column_stack([points.astype(float), last])
    return np.sqrt(np.maximum((p * p).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * p @ pivots.T, 0))


def _last(points: np.ndarray, anchors: bool, top: float) -> np.ndarray:
    return np.zeros(len(points)) if anchors else np.sqrt(np.maximum(top - (points.astype(float) ** 2).sum(1), 0))


def _place(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, top: float, dim: int) -> Iterator[pa.RecordBatch]:
    """Pack vectors and assign them: candidates by their filled-up point, anchors by that with 0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("x").to_pylist()
        points = np.zeros((len(lists), dim), np.int64)
        for i, x in enumerate(lists):
            points[i, : len(x)] = x
        is_anchor = ~np.array(batch.column("candidate").to_pylist(), bool)
        last = np.where(is_anchor, 0.0, _last(points, False, top))
        cell = _far(points, last, pivots).argmin(1).astype(np.int32)
        columns = [batch.column(c) for c in ("vec_id", "h", "label")] + [pa.array(is_anchor), pa.array([p.tobytes() for p in points], pa.binary()), pa.array(cell)]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "h", "label", "anchor", "v", "cell"])


def _spread(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, top: float, dim: int, bounds: dict[int, tuple[float, float, float]] | None, parts: int, pieces: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Copies of the candidates for the groups of anchors they might serve.

    Without ``bounds``, to the group of their own cell; with them (radius, outer and inner distance of
    each group) to the others.  A candidate's distance from any anchor of group i is at least its
    distance from the pivot i less the group's radius, and at least its distance from the plane
    halfway between the pivots; it is at most the distance from the pivot with the radius.
    """
    groups = np.array(sorted(pieces), int)
    between = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(2))
    for batch in batches:
        if not batch.num_rows or not len(groups):
            continue
        cell = batch.column("cell").to_numpy()
        if bounds is None:
            at, to = np.nonzero(cell[:, None] == groups[None, :])
        else:
            points = _matrix(batch.column("v"), dim)
            far = _far(points, _last(points, False, top), pivots)
            own = far[np.arange(len(cell)), cell]
            radius, outer, inner = (np.array([bounds[g][k] for g in groups.tolist()]) for k in range(3))
            apart = between[cell][:, groups]
            plane = np.where(apart > 0, (far[:, groups] ** 2 - own[:, None] ** 2) / np.maximum(2 * apart, 1e-9), 0)
            least = np.maximum(far[:, groups] - radius, plane)
            slack = 1e-6 * (1 + far[:, groups])  # of rounding
            at, to = np.nonzero((least <= outer + slack) & (far[:, groups] + radius >= inner - slack) & (cell[:, None] != groups[None, :]))
        times = np.array([pieces[g] for g in groups[to].tolist()], int)  # once for each part of the group's anchors
        piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at, to = np.repeat(at, times), np.repeat(to, times)
        taken = batch.select(["vec_id", "h", "label", "v"]).take(pa.array(at))
        part = (taken.column("h").to_numpy() ^ (taken.column("vec_id").to_numpy() * 0x9E3779B1)) % parts if parts > 1 else np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(groups[to].astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(part.astype(np.int32)), *taken.columns], names=["cell", "piece", "part", "vec_id", "h", "label", "v"])


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exact: as doubles where all sums fit, else in integers."""
    most = math.sqrt(max((q.astype(float) ** 2).sum(1).max(), 1) * max((c.astype(float) ** 2).sum(1).max(), 1))
    return (q.astype(float) @ c.T.astype(float)).astype(np.int64) if most < EXACT else q @ c.T


def _firsts(ok: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the first k of each row of ``score`` where ``ok``; columns are in tie order."""
    rows, columns = [], []
    for i in range(len(score)):
        at = np.flatnonzero(ok[i])
        if len(at) > k:
            s = score[i, at]
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
        at = at[np.lexsort((order[at], -score[i, at]))][:k]
        rows.append(np.full(len(at), i))
        columns.append(at)
    return np.concatenate(rows), np.concatenate(columns)


def _join(anchors: pd.DataFrame, found: pd.DataFrame, dim: int, k: int, low: int, high: int) -> pd.DataFrame:
    """The local join of a part of a group's anchors with a part of its candidates.

    Without ``wanted`` scores, the first k of the anchor's label; else for each of them the first k of
    other labels within ``low`` to ``high`` hundredths of it.
    """
    out: list[pd.DataFrame] = []
    if len(anchors) and len(found):
        q_all, c = _matrix(anchors["v"], dim), _matrix(found["v"], dim)
        ids, hs, labels = (found[x].to_numpy() for x in ("vec_id", "h", "label"))
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((labels, hs, ids))] = np.arange(len(ids))
        for at in range(0, len(anchors), SLICE):
            some = anchors.iloc[at : at + SLICE]
            score = _scores(q_all[at : at + SLICE], c)
            same = some["label"].to_numpy()[:, None] == labels[None, :]
            if "wanted" not in anchors:
                ok = same & ~((some["vec_id"].to_numpy()[:, None] == ids[None, :]) & (some["h"].to_numpy()[:, None] == hs[None, :]))
                met = [_firsts(ok, score, order, k)]
            else:
                met = []
                for j in range(max(map(len, some["wanted"]))):
                    w = np.array([x[j] if j < len(x) else -1 for x in some["wanted"]], np.int64)
                    # 100 * score, compared without leaving 64 bits: bounds are rounded to whole scores
                    least, most = np.array([-(-low * int(x) // 100) for x in w]), np.array([high * int(x) // 100 for x in w])
                    met.append(_firsts(~same & (w >= 0)[:, None] & (score >= least[:, None]) & (score <= most[:, None]), score, order, k))
            for i, j in met:
                out.append(pd.DataFrame({"anchor_id": some["vec_id"].to_numpy()[i], "anchor_h": some["h"].to_numpy()[i], "vec_id": ids[j], "h": hs[j], "label": labels[j], "score": score[i, j], "anchor_label": some["label"].to_numpy()[i]}))
    if not out:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_id", "anchor_h", "anchor_label", "vec_id", "h", "label", "score")})
    return pd.concat(out)[["anchor_id", "anchor_h", "anchor_label", "vec_id", "h", "label", "score"]].drop_duplicates()


class Mining:
    """The steps of one run over ``rows`` of :func:`as_integers`."""

    def __init__(self, rows: DataFrame, positives: int, negatives: int, low: int, high: int, part: int, anchors: int):
        self.positives, self.negatives, self.low, self.high, self.part = positives, negatives, low, high, part
        size = rows.agg(F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)), F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1))).first()
        self.dim, self.top, self.parts = max(size[0] or 0, 1), size[1] or 0.0, max(1, -(-size[2] // part))
        pivots = rows.orderBy(F.hash("h", "vec_id"), "vec_id", "h").limit(min(MOST_PIVOTS, max(4, math.isqrt(size[3]) // 2))).select("x").collect()
        points = np.zeros((max(len(pivots), 1), self.dim), np.int64)
        for i, r in enumerate(pivots):
            points[i, : len(r["x"])] = r["x"]
        self.pivots = np.column_stack([points.astype(float), _last(points, False, self.top)])
        packed = only_first(rows, max(positives + 1, negatives)).select("vec_id", "h", "label", "candidate", "x")
        self.placed = stored(packed.mapInArrow(partial(_place, pivots=self.pivots, top=self.top, dim=self.dim), PLACED), "placed-vectors")
        self.anchors = self.placed.filter("anchor").select("vec_id", "h", "label", "v", "cell")
        # Parts of a crowded group of anchors: cells are as many as the pivots at most.
        self.pieces = {r["cell"]: max(1, -(-r["n"] // anchors)) for r in self.anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    def join(self, anchors: DataFrame, k: int, bounds: dict | None) -> DataFrame:
        """Anchors (vec_id, h, label, v, cell and perhaps wanted) with the candidates sent to their groups."""
        moved = self.placed.filter(~F.col("anchor")).select("vec_id", "h", "label", "v", "cell").mapInArrow(
            partial(_spread, pivots=self.pivots, top=self.top, dim=self.dim, bounds=bounds, parts=self.parts, pieces=self.pieces if bounds is None else {g: self.pieces[g] for g in bounds}), "cell int, piece int, part int, vec_id long, h long, label long, v binary"
        )
        many = F.create_map(*[F.lit(x) for pair in self.pieces.items() for x in pair]) if self.pieces else F.create_map(F.lit(-1), F.lit(1))
        dealt = anchors.withColumn("piece", F.pmod(F.hash("vec_id", "h"), many[F.col("cell")])).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        local = partial(_join, dim=self.dim, k=k, low=self.low, high=self.high)
        hits = dealt.groupBy("cell", "piece", "part").cogroup(moved.groupBy("cell", "piece", "part")).applyInPandas(lambda a, b: local(a, b), "anchor_id long, anchor_h long, anchor_label long, vec_id long, h long, label long, score long")
        return hits

    def bounds(self, anchors: DataFrame, least: DataFrame, most: DataFrame | None = None) -> dict[int, tuple[float, float, float]]:
        """For each cell: radius of its anchors, and the largest and smallest distance they look at.

        ``least``: (vec_id, h, label, score) with the lowest score that can still matter, without a row
        if any may; ``most``: the same for the highest.  Distances follow from scores.
        """
        dim, pivots, top = self.dim, self.pivots, self.top

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    points = _matrix(b.column("v"), dim)
                    far = _far(points, np.zeros(len(points)), pivots)[np.arange(len(points)), b.column("cell").to_numpy()]
                    square = (points.astype(float) ** 2).sum(1) + top
                    low, high = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high"))
                    outer = np.where(np.isnan(low), np.inf, np.sqrt(np.maximum(square - 2 * np.nan_to_num(low), 0)))
                    inner = np.where(np.isnan(high), 0, np.sqrt(np.maximum(square - 2 * np.nan_to_num(high), 0)))
                    yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(far), pa.array(outer), pa.array(inner)], names=["cell", "radius", "outer", "inner"])

        keys = ["vec_id", "h", "label"]
        met = anchors.join(least.withColumnRenamed("score", "low"), keys, "left")
        met = met.join(most.withColumnRenamed("score", "high"), keys, "left") if most is not None else met.withColumn("high", F.lit(None).cast("long"))
        reached = met.select("v", "cell", F.col("low").cast("double"), F.col("high").cast("double")).mapInArrow(reach, "cell int, radius double, outer double, inner double")
        return {r["cell"]: (r["radius"], r["outer"], r["inner"]) for r in reached.groupBy("cell").agg(F.max("radius").alias("radius"), F.max("outer").alias("outer"), F.min("inner").alias("inner")).collect()}

    def both(self, anchors: DataFrame, k: int, label: str, floor) -> DataFrame:
        """Hits of the own cells and, beyond the bounds that those give, of the others."""
        own = stored(self.join(anchors, k, None), f"own-{label}")
        least, most = floor(own)
        return stored(own.unionByName(self.join(anchors, k, self.bounds(anchors, least, most))).distinct(), f"hits-{label}")

    def run(self) -> DataFrame:
        me = [F.col("anchor_id").alias("vec_id"), F.col("anchor_h").alias("h"), F.col("anchor_label").alias("label")]
        ranked = Window.partitionBy("anchor_id", "anchor_h", "anchor_label").orderBy(F.desc("score"), "vec_id", "h")
        kth = lambda hits: (hits.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") == self.positives).select(*me, "score"), None)
        near = self.both(self.anchors, self.positives, "positives", kth).withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= self.positives).drop("_n")
        # Below 0 a range from low to high holds nothing.
        near = stored(near.filter("score >= 0"), "positives")
        wanted = near.groupBy(*me).agg(F.sort_array(F.collect_set("score")).alias("wanted"))
        asked = stored(self.anchors.join(wanted, ["vec_id", "h", "label"]), "asked")

        def floor(own: DataFrame) -> tuple[DataFrame, DataFrame]:
            """The lowest score that matters: the last of a full answer, or else the end of the range."""
            full = self.answers(near, own).groupBy("anchor_id", "anchor_h", "anchor_label", "positive_score").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
            ends = near.select("anchor_id", "anchor_h", "anchor_label", F.col("score").alias("positive_score")).distinct()
            ends = ends.join(full, ["anchor_id", "anchor_h", "anchor_label", "positive_score"], "left")
            low = F.when(F.col("n") >= self.negatives, F.col("last")).otherwise(F.floor(F.col("positive_score") * self.low / 100) - 1)
            per = ends.groupBy(*me).agg(F.min(low).cast("long").alias("low"), F.max(F.floor(F.col("positive_score") * self.high / 100) + 1).cast("long").alias("high"))
            return per.select("vec_id", "h", "label", F.col("low").alias("score")), per.select("vec_id", "h", "label", F.col("high").alias("score"))

        hits = self.both(asked, self.negatives, "negatives", floor)
        # A positive score stands for all positives that have it.
        found = self.answers(near, hits)
        pairs = near.select("anchor_id", "anchor_h", "anchor_label", F.col("vec_id").alias("positive_id"), F.col("h").alias("positive_h"), F.col("score").alias("positive_score"))
        out = pairs.join(found, ["anchor_id", "anchor_h", "anchor_label", "positive_score"])
        return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    def answers(self, near: DataFrame, hits: DataFrame) -> DataFrame:
        """For each different score of an anchor's positives, the first of ``hits`` in its range."""
        who = ["anchor_id", "anchor_h", "anchor_label"]
        marks = near.select(*who, F.col("score").alias("positive_score")).distinct()
        p, s = F.col("positive_score").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)")
        met = hits.join(marks, who).filter((p * self.low <= s * 100) & (s * 100 <= p * self.high))
        first = Window.partitionBy(*who, "positive_score").orderBy(F.desc("score"), "vec_id", "h", "label")
        return met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= self.negatives)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, part: int = PART, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor, its ``positives`` nearest other rows of its label, and for each of these the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.
    Higher scores come first, ties by smaller vec_id.  An anchor without positives, or a positive
    without such a row, has no row; neither has an empty table.
    """
    rows = stored(as_integers(vectors, is_anchor, F.col("label") if label is None else label), "whole-vectors")
    return Mining(rows, positives, negatives, low, high, part, anchors).run()


ORACLE_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
