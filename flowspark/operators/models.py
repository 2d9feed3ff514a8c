"""Walk-forward boosted trees on folds, a gate over their predictions, and the two-stage model.

Rows are those of ``evaluation.members``: a bar stands once in each fold that has it, with ``part``
train or oos.  All folds of up to ``MOST`` numbers are fitted at once, each as one group of a task, by
:mod:`.grown`.  The driver walks the list of larger ones: every fit and every prediction of these is a
Spark job over the fold's rows, which are stored by fold so that a fit reads its own only.

Where a fold learns from the rows of the others, as in the gate, each task gets a share of the folds and a
copy of all rows to learn from, if those are up to ``MOST`` numbers; beyond that the driver walks the folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from flowspark.session import scratch, stored

from .evaluation import growing_threshold, impute_medians, spearman, thresholds
from .grown import boost, fit_rows, ordered_bins, orders, quantile
from .ordering import quantiles

#: Rows that a part needs for a fold to be fitted.
LEAST = 50
#: Numbers (rows times features and label) that a task may hold to learn from.
MOST = 2**23


def by_fold(rows: DataFrame) -> DataFrame:
    """The rows, written in one folder a fold."""
    spark = rows.sparkSession
    path = scratch(spark, "folds")
    rows.repartition("fold_idx").write.partitionBy("fold_idx").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def together(parts: Iterable[DataFrame], empty: DataFrame) -> DataFrame:
    """The rows of all parts, each written as it comes and read once at the end: the plan stays as small
    as for one fold, and no fold is worked out twice.  ``empty`` where there is no part."""
    path, schema = scratch(empty.sparkSession, "parts"), None
    for part in parts:
        part = part if schema is None else part.select(*schema.names)
        part.write.mode("append").parquet(path)
        schema = schema or part.schema
    return empty if schema is None else empty.sparkSession.read.schema(schema).parquet(path)


def fold_status(rows: DataFrame, y: str, least: int = LEAST) -> DataFrame:
    """(fold_idx, train, oos, status): rows with a label to learn from and rows to predict in each fold,
    and whether it is used or has too few of them."""
    sizes = rows.groupBy("fold_idx").agg(F.count_if((F.col("part") == "train") & F.col(y).isNotNull()).alias("train"), F.count_if(F.col("part") == "oos").alias("oos"))
    return sizes.withColumn("status", F.when(F.col("train") < least, "too few to learn from").when(F.col("oos") == 0, "none to predict").otherwise("used"))


def fold_list(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("fold_idx").distinct().collect())


def fit_trees(train: DataFrame, features: list[str], y: str, out: str, trees: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 7, tail: float = 0.0) -> PipelineModel:
    """Boosted trees on rows without nulls.  With ``tail``, the last share of the bars tells when to stop."""
    inputs = VectorAssembler(inputCols=features, outputCol="_x")
    rows = inputs.transform(train)
    model = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol=out, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    if tail > 0:
        edge = quantiles(rows, "bar_id", {"edge": 1 - tail}).first()["edge"]
        rows, model = rows.withColumn("_late", F.col("bar_id") > edge), model.setValidationIndicatorCol("_late")
    return PipelineModel([inputs, model.fit(rows)])


#: The same fit on arrays, for folds that a task can hold.
fit_trees.rows = fit_rows


def importance(model: PipelineModel, features: list[str], most: int = 20) -> list[tuple[str, float]]:
    """The ``most`` features with the largest share of the gain."""
    shares = model.importance() if hasattr(model, "importance") else model.stages[-1].featureImportances.toArray()
    return largest(features, shares, most)


def largest(features: list[str], shares: Iterable[float], most: int = 20) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, shares), strict=True), key=lambda x: (-x[1], x[0]))[:most]


def values(table: pa.Table, columns: list[str]) -> np.ndarray:
    """A row of numbers for each column; NaN where there is none."""
    return np.stack([table[c].cast(pa.float64()).to_numpy() for c in columns]).astype(float)


def with_numbers(table: pa.Table, schema: StructType, **columns: object) -> pa.Table:
    """The table with further columns, in the order of ``schema``."""
    for name, column in columns.items():
        table = table.append_column(name, column if isinstance(column, pa.Array) else pa.array(column, pa.float64()))
    return table.select(schema.names)


def each_fold(rows: DataFrame, features: list[str], y: str, out: str, least: int = LEAST, fit: Callable = fit_trees, predicted: str = "part = 'oos'", gains: dict[int, list[tuple[str, float]]] | None = None, most: int = MOST, **trees) -> DataFrame:
    """The ``predicted`` rows of each fold with ``out``, learnt from its train rows; a fold with too few rows to learn
    from, or none to predict, gives none.  ``gains`` gets the most important features of each fold's model."""
    table = stored(rows.withColumns({"_learn": F.coalesce((F.col("part") == "train") & F.col(y).isNotNull(), F.lit(False)), "_apply": F.coalesce(F.expr(predicted), F.lit(False))}), "folds")
    sizes = table.groupBy("fold_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("_learn").alias("_train"), F.count_if("_apply").alias("_out"))
    on_rows = None if trees.get("tail") else getattr(fit, "rows", None)
    limit = most // (len(features) + 1) if on_rows else 0
    large = sorted(r["fold_idx"] for r in sizes.filter((F.col("n") > limit) & (F.col("_train") >= least) & (F.col("_out") > 0)).select("fold_idx").collect())
    whole = StructType([*rows.schema.fields, StructField(out, DoubleType()), StructField("_gain_shares", ArrayType(DoubleType()))])

    def run(fold: pa.Table) -> pa.Table:
        learn, to = fold.filter(fold["_learn"]), fold.filter(fold["_apply"])
        if learn.num_rows < least or not to.num_rows:
            return with_numbers(to.slice(0, 0), whole, **{out: [], "_gain_shares": pa.array([], pa.list_(pa.float64()))})
        model = on_rows(values(learn, features), values(learn, [y])[0], **trees)
        shares = pa.array([model.shares().tolist(), *[None] * (to.num_rows - 1)], pa.list_(pa.float64()))  # once a fold
        return with_numbers(to, whole, **{out: model.predict(values(to, features)), "_gain_shares": shares})

    small = table if not large else table.join(F.broadcast(sizes.filter(F.col("n") <= limit).select("fold_idx")), "fold_idx", "left_semi").select(*table.columns)

    def parts() -> Iterator[DataFrame]:
        if on_rows is not None:
            yield small.groupBy("fold_idx").applyInArrow(run, whole)
        apart = by_fold(table.filter(F.col("fold_idx").isin(large))) if large else None
        for k in large:
            fold = apart.filter(F.col("fold_idx") == k)
            model = fit(fold.filter("_learn").drop("_learn", "_apply"), features, y, out, **trees)
            if gains is not None:
                gains[k] = importance(model, features)
            yield model.transform(fold.filter("_apply")).withColumn("_gain_shares", F.lit(None).cast("array<double>")).select(*whole.names)

    done = together(parts(), rows.sparkSession.createDataFrame([], whole))
    if gains is not None:
        for r in done.filter("_gain_shares is not null").select("fold_idx", "_gain_shares").collect():  # one row a fold
            gains[r["fold_idx"]] = largest(features, r["_gain_shares"])
    return done.drop("_gain_shares")


def walk_forward(rows: DataFrame, features: list[str], y: str, out: str = "pred", least: int = LEAST, fit: Callable = fit_trees, gains: dict[int, list[tuple[str, float]]] | None = None, most: int = MOST, **trees) -> DataFrame:
    """The oos rows with ``out``: trees learn from the fold's train rows; gaps take the train medians,
    and 0 where a fold has none.  ``fit``: :func:`fit_trees`, or ``boosting.fit_dropout``.  ``gains`` gets
    the most important features of each fold's model."""
    filled = impute_medians(rows, features, ["fold_idx"]).fillna(0.0, features)
    return each_fold(filled, features, y, out, least, fit, gains=gains, most=most, **trees)


def over_others(table: DataFrame, learn: DataFrame, features: list[str], y: str, out: str, run: Callable[[pa.Table, pa.Table], np.ndarray], folds: int) -> DataFrame:
    """``table`` with ``out`` by ``run(own, learn)``: a task has the rows of some folds, ``own``, and all rows to learn from."""
    tasks = min(max(folds, 1), 4 * table.sparkSession.sparkContext.defaultParallelism)
    whole = StructType([*table.schema.fields, StructField(out, DoubleType())])
    dealt = table.withColumn("_task", F.pmod(F.col("fold_idx"), F.lit(tasks)))
    copies = learn.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def both(own: pa.Table, others: pa.Table) -> pa.Table:
        return with_numbers(own, whole, **{out: run(own, others)})

    return stored(dealt.repartition(tasks, "_task").groupBy("_task").cogroup(copies.repartition(tasks, "_task").groupBy("_task")).applyInArrow(both, whole), "over-others")


def gate_others(preds: DataFrame, features: list[str], y: str, pred: str = "pred", percent: float = 70.0, least: int = LEAST, most: int = MOST, **trees) -> DataFrame:
    """Add ``gate_score``, learnt for each fold from the predictions of all other folds against
    ``sign(pred) * y``, and ``gate_pass``: at or above the pooled percentile; no score passes.

    Bars of a fold that another fold predicts too are not learnt from.
    """
    rows = preds.withColumn("_gain", F.signum(pred) * F.col(y)).fillna(0.0, features)
    none = F.lit(None).cast("double")

    def run(own: pa.Table, others: pa.Table) -> np.ndarray:
        bars = list(zip(own["symbol"].to_pylist(), own["bar_id"].to_pylist(), strict=True))
        # Where the bars of this task's folds are in the rows to learn from.
        at: dict[tuple, list[int]] = {bar: [] for bar in bars}
        for i, bar in enumerate(zip(others["symbol"].to_pylist(), others["bar_id"].to_pylist(), strict=True)):
            if bar in at:
                at[bar].append(i)
        x, label, fold = values(others, features), values(others, ["_gain"])[0], others["fold_idx"].to_numpy()
        order, own_x, own_fold = orders(x), values(own, features), own["fold_idx"].to_numpy()
        score = np.full(own.num_rows, np.nan)
        for k in np.unique(own_fold):
            mine = np.flatnonzero(own_fold == k)
            keep = fold != k
            for i in mine:
                keep[at[bars[i]]] = False
            if keep.sum() >= least:
                model = boost(*ordered_bins(x, order, keep), label[keep], **{n: v for n, v in trees.items() if n != "seed"})
                score[mine] = model.predict(own_x[:, mine])
        return score

    def gates() -> Iterator[DataFrame]:
        table = by_fold(rows)
        for k in fold_list(table):
            own = table.filter(F.col("fold_idx") == k)
            others = table.filter((F.col("fold_idx") != k) & F.col("_gain").isNotNull()).join(own.select("symbol", "bar_id"), ["symbol", "bar_id"], "left_anti")
            if others.limit(least).count() < least:
                yield own.withColumn("gate_score", none)
            else:
                yield fit_trees(others, features, "_gain", "gate_score", **trees).transform(own).drop("_x")

    rows = stored(rows, "gate-rows")
    size = rows.agg(F.count_if(F.col("_gain").isNotNull()).alias("n"), F.count_distinct("fold_idx").alias("folds")).first()
    if size["n"] * (len(features) + 1) <= most and not trees.get("tail"):
        learn = rows.filter("_gain is not null").select("symbol", "bar_id", "fold_idx", *features, "_gain")
        scored = over_others(rows, learn, features, "_gain", "gate_score", run, size["folds"])
        scored = scored.withColumn("gate_score", F.nanvl("gate_score", none))
    else:
        scored = together(gates(), rows.limit(0).withColumn("gate_score", none))
    edge = quantiles(scored, "gate_score", {"edge": percent / 100}).first()["edge"]
    return scored.withColumn("gate_pass", F.coalesce(F.col("gate_score") >= F.lit(edge), F.lit(True))).drop("_gain")


#: The rows that the stages of a fold need, by what there are too few of.
STAGES = {"alpha train": 100, "alpha oos": 50, "alpha pass": 20, "entry candidates": 100, "entry train": 50, "entry oos": 10}


def two_stage(rows: DataFrame, features: list[str], first: str, second: str, top: float = 0.2, gate: bool = True, needed: dict[str, int] = STAGES, fit: Callable = fit_trees, most: int = MOST, **trees) -> tuple[DataFrame, DataFrame]:
    """Predict ``first`` (``alpha_pred``) and, with it as a feature, ``second`` (``pred``): (predictions, status).

    The first model predicts train and oos rows that have ``first``.  With ``gate``, an oos row passes if its
    prediction reaches what the share ``top`` of the train predictions and of the oos predictions before it reach
    (``alpha_threshold``).  The second model learns from the train rows whose actual ``first`` is in its top share,
    with the actual value as the feature, and predicts the oos rows that pass and have ``second``, with the
    predicted one.  ``status`` has a row for each fold: how many rows it had at each step, and "used" or what there
    were too few of (``needed``); such a fold has no predictions.
    """
    needed = STAGES | needed
    filled = stored(impute_medians(rows, features, ["fold_idx"]).fillna(0.0, features), "two-stage")
    known, train = F.col(first).isNotNull(), F.col("part") == "train"
    steps = [s for s in STAGES if gate or s != "alpha pass"]
    # (fold_idx, a number for each step): rows of a fold at the steps, 0 where it has none.
    counts = filled.groupBy("fold_idx").agg(F.count_if(known & train).alias("alpha train"), F.count_if(known & (F.col("part") == "oos")).alias("alpha oos"), F.count_if(known & train & F.col(second).isNotNull()).alias("entry candidates"))

    def enough(counts: DataFrame, *wanted: str) -> DataFrame:
        return counts.filter(F.expr(" and ".join(f"`{s}` >= {needed[s]}" for s in wanted))).select("fold_idx")

    def more(counts: DataFrame, step: str, found: DataFrame) -> DataFrame:
        return stored(counts.join(found.groupBy("fold_idx").agg(F.count(F.lit(1)).alias(step)), "fold_idx", "left").fillna(0, [step]), "fold-counts")

    usable = filled.filter(known).join(enough(counts, "alpha train", "alpha oos"), "fold_idx", "left_semi").select(*filled.columns)
    scored = each_fold(usable, features, first, "alpha_pred", 1, fit, "true", most=most, **trees)
    if gate:
        passing = stored(growing_threshold(scored, "alpha_pred", top, ["fold_idx"]).withColumnRenamed("threshold", "alpha_threshold").filter("passed").drop("passed"), "passed")
        counts = more(counts, "alpha pass", passing)
    else:
        passing = scored.filter("part = 'oos'").withColumn("alpha_threshold", F.lit(None).cast("double"))
    base = usable.filter(train & F.col(second).isNotNull())
    edges = thresholds(base, first, top, ["fold_idx"]).withColumnRenamed("threshold", "_edge")
    chosen = base.join(edges, "fold_idx").filter(F.col(first) >= F.col("_edge")).select(*filled.columns, F.col(first).alias("alpha_feature"))
    target = passing.filter(F.col(second).isNotNull()).withColumn("alpha_feature", F.col("alpha_pred"))
    counts = more(more(counts, "entry train", chosen), "entry oos", target)
    entry = target.unionByName(chosen, allowMissingColumns=True).join(enough(counts, *steps), "fold_idx", "left_semi").select(*target.columns)
    preds = each_fold(entry, [*features, "alpha_feature"], second, "pred", 1, fit, most=most, **trees)
    # The first step with too few rows ends a fold; later steps have no number.
    short = F.coalesce(*[F.when(F.col(s) < needed[s], F.lit(i)) for i, s in enumerate(steps)], F.lit(len(steps)))
    state = F.when(F.col("_at") == len(steps), "used").otherwise(F.concat(F.lit("too few: "), F.get(F.array(*map(F.lit, steps)), F.col("_at"))))
    seen = [F.when(F.col("_at") >= steps.index(s), F.col(s)).otherwise(F.lit(None)).cast("long").alias(s.replace(" ", "_")) if s in steps else F.lit(None).cast("long").alias(s.replace(" ", "_")) for s in STAGES]
    return preds, counts.withColumn("_at", short).select("fold_idx", *seen, state.alias("status"))


def retrain(rows: DataFrame, features: list[str], y: str, rounds: int = 3, enough: int = 100, settled: float = 0.005, percent: float = 70.0, **trees) -> DataFrame:
    """Walk-forward and gate in turns: each round learns from the train rows that the gate of the round
    before let pass (all of them where they are under ``enough``), until the rank correlation of the rows
    that pass changes by less than ``settled``.  The last round's predictions, with ``round``."""
    train_rows, last, preds = rows, None, None
    for k in range(rounds):
        preds = gate_others(walk_forward(train_rows, features, y, **trees), features, y, percent=percent, **trees).withColumn("round", F.lit(k))
        # One number a round.
        found = spearman(preds.filter("gate_pass").withColumn("_all", F.lit(0)), "pred", y, ["_all"]).first()
        now = found["spearman"] if found else None
        if now is None or last is not None and abs(now - last) < settled:
            break
        last = now
        passed = preds.filter("gate_pass").select("symbol", "bar_id").distinct()
        chosen = rows.filter("part = 'train'").join(passed, ["symbol", "bar_id"], "left_semi")
        few = chosen.groupBy("fold_idx").count().filter(F.col("count") < enough).select("fold_idx")
        every = rows.filter("part = 'train'").join(few.union(rows.select("fold_idx").distinct().join(chosen.select("fold_idx").distinct(), "fold_idx", "left_anti")), "fold_idx", "left_semi")
        train_rows = rows.filter("part = 'oos'").unionByName(chosen.join(few, "fold_idx", "left_anti")).unionByName(every)
    return preds


def exit_walk_forward(samples: DataFrame, features: list[str], y: str, out: str = "pred", gap: int = 0, tail: float = 0.2, least: int = LEAST, most: int = MOST, **trees) -> DataFrame:
    """Samples of events with ``out``: a fold is predicted from the events of folds before it (``gap`` more
    folds are left out between), of which the last share ``tail`` tells when to stop.  The first folds,
    with nothing before them, are left out.  Needs ``fold_idx`` and ``event_id``."""
    rows = samples.fillna(0.0, features)

    def run(own: pa.Table, before: pa.Table) -> np.ndarray:
        x, label, fold, event = values(before, features), values(before, [y])[0], before["fold_idx"].to_numpy(), before["event_id"].to_numpy()
        order, own_x, own_fold, pred = orders(x), values(own, features), own["fold_idx"].to_numpy(), np.full(own.num_rows, np.nan)
        for k in np.unique(own_fold):
            known = fold < k - gap
            if known.sum() < least:
                continue
            last, late = known, None
            if tail > 0:
                ends = known & (event > quantile(np.sort(event[known]), 1 - tail))
                last, late = known & ~ends, (x[:, ends], label[ends])
            model = boost(*ordered_bins(x, order, last), label[last], late, **{n: v for n, v in trees.items() if n != "seed"})
            mine = own_fold == k
            pred[mine] = model.predict(own_x[:, mine])
        return pred

    def folds() -> Iterator[DataFrame]:
        table = by_fold(rows)
        for k in fold_list(table):
            before = table.filter((F.col("fold_idx") < k - gap) & F.col(y).isNotNull()).withColumn("bar_id", F.col("event_id"))
            if before.limit(least).count() == least:
                yield fit_trees(before, features, y, out, tail=tail, **trees).transform(table.filter(F.col("fold_idx") == k)).drop("_x")

    rows = stored(rows, "exit-rows")
    size = rows.agg(F.count_if(F.col(y).isNotNull()).alias("n"), F.count_distinct("fold_idx").alias("folds")).first()
    if size["n"] * (len(features) + 1) <= most:
        learn = rows.filter(F.col(y).isNotNull()).select("fold_idx", "event_id", *features, y)
        return over_others(rows, learn, features, y, out, run, size["folds"]).filter(F.col(out).isNotNull() & ~F.isnan(out))
    return together(folds(), rows.limit(0).withColumn(out, F.lit(None).cast("double")))
