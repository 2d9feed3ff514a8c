"""Walk-forward folds and rank-based metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from flowspark.session import stored

from .ordering import average_ranks, counted, fill_forward, next_true, quantiles, running_sum

TINY = 1e-12


def bar_folds(bars: DataFrame, train: int, oos: int, gap: int, step: int = 0) -> DataFrame:
    """(symbol, fold_idx, tr_start, tr_end, gap_end, os_end) over the bars of each instrument, as long as a
    fold fits; one row each."""
    stride = step or oos
    n = bars.groupBy("symbol").agg((F.max("bar_id") + 1).alias("n"))
    room = F.col("n") - (train + gap + oos)
    start = F.explode(F.sequence(F.lit(0).cast("long"), room, F.lit(stride).cast("long")))
    rows = n.filter(room >= 0).select("symbol", start.alias("tr_start"))
    at = F.col("tr_start")
    return rows.select("symbol", (at / stride).cast("int").alias("fold_idx"), at, (at + train).alias("tr_end"), (at + train + gap).alias("gap_end"), (at + train + gap + oos).alias("os_end"))


def spans(folds: DataFrame, purge: int, expanding: bool, ahead: int) -> DataFrame:
    """The folds with ``tr_last``, the bar that their train rows end before."""
    f = folds.withColumn("tr_start", F.lit(0).cast("long")) if expanding else folds
    return f.withColumn("tr_last", F.least(F.greatest(F.col("tr_end") - purge, F.col("tr_start") + 1), F.col("gap_end") - ahead))


def members(bars: DataFrame, folds: DataFrame, purge: int = 0, expanding: bool = False, ahead: int = 0, cell: int = 4096) -> DataFrame:
    """Each bar in each fold of its instrument that has it, with ``part`` train or oos.

    Train ends ``purge`` bars early, but keeps one bar at least, and no train bar lies within ``ahead``
    bars of the first oos bar.  ``expanding``: train begins with the first bar.  Bars and folds meet by
    cells of bar numbers; the cells of expanding folds grow with their square, so they are sorted, not sent to
    all tasks.  What only needs their size takes :func:`member_spans`.
    """
    f = spans(folds, purge, expanding, ahead)
    f = f.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("tr_start") / cell), F.floor((F.col("os_end") - 1) / cell))))
    met = bars.withColumn("_cell", F.floor(F.col("bar_id") / cell)).join(f.hint("merge") if expanding else f, ["symbol", "_cell"]).drop("_cell")
    train = (F.col("bar_id") >= F.col("tr_start")) & (F.col("bar_id") < F.col("tr_last"))
    oos = (F.col("bar_id") >= F.col("gap_end")) & (F.col("bar_id") < F.col("os_end"))
    return met.withColumn("part", F.when(train, "train").when(oos, "oos")).filter("part is not null").select(*bars.columns, "fold_idx", "part")


def member_spans(bars: DataFrame, folds: DataFrame, purge: int = 0, expanding: bool = False, ahead: int = 0, block: int = 8192) -> DataFrame:
    """(symbol, fold_idx, part, n, first_bar, last_bar) of :func:`members`, without a row for each bar of each fold.

    Where a part begins and ends stands in one order with the bars: the number of bars before it, the last one
    before it and the next one come from running sums and values carried over blocks.
    """
    f = spans(folds, purge, expanding, ahead)
    parts = f.select("symbol", "fold_idx", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(a).alias("_from"), F.col(b).alias("_to")) for p, a, b in (("train", "tr_start", "tr_last"), ("oos", "gap_end", "os_end"))]))).filter("_from < _to")
    marks = parts.select("symbol", F.explode(F.array("_from", "_to")).alias("_mark")).distinct()
    none = F.lit(None).cast("long")
    line = bars.select("symbol", (2 * F.col("bar_id") + 1).alias("_place"), F.col("bar_id").cast("long").alias("bar_id"), none.alias("_mark"), F.lit(1).cast("long").alias("_one"))
    line = line.unionByName(marks.select("symbol", (2 * F.col("_mark")).alias("_place"), none.alias("bar_id"), "_mark", F.lit(0).cast("long").alias("_one")))
    known = running_sum(line, "_one", "_upto", ("symbol",), F.floor(F.col("_place") / (2 * block)), ("_place",))
    known = fill_forward(known, "bar_id", "_before", order="_place", block=2 * block)
    known = next_true(known.withColumn("_bar", F.col("_one") == 1), "_bar", ["bar_id"], "_next", order="_place", block=2 * block)
    known = stored(known.filter("_one = 0").select("symbol", "_mark", "_upto", "_before", F.col("_next.bar_id").alias("_after")), "fold-marks")
    start = known.select("symbol", F.col("_mark").alias("_from"), F.col("_upto").alias("_low"), F.col("_after").alias("first_bar"))
    end = known.select("symbol", F.col("_mark").alias("_to"), F.col("_upto").alias("_high"), F.col("_before").alias("last_bar"))
    met = parts.join(start, ["symbol", "_from"]).join(end, ["symbol", "_to"])
    return met.select("symbol", "fold_idx", "part", (F.col("_high") - F.col("_low")).alias("n"), "first_bar", "last_bar").filter("n > 0")


def day_members(rows: DataFrame, folds: DataFrame, day: str = "dt", expanding: bool = False) -> DataFrame:
    """Each row in each fold of :func:`day_folds` that has its day, with ``part`` train or oos.

    Folds are spread to their days first: one row for each fold and day.
    """
    first = F.lit("0001-01-01").cast("date") if expanding else F.col("tr_start")
    days = rows.select(F.col(day).alias("_d")).distinct()
    train = (F.col("_d") >= first) & (F.col("_d") < F.col("tr_end"))
    oos = (F.col("_d") >= F.col("gap_end")) & (F.col("_d") < F.col("os_end"))
    # Days and folds are few: a row for each day with ticks and each fold.
    spread = days.join(folds, (F.col("_d") < F.col("os_end")) & ((F.col("_d") >= first) | oos)).withColumn("part", F.when(train, "train").when(oos, "oos")).filter("part is not null")
    return rows.join(spread.select("_d", "fold_idx", "part"), F.col(day) == F.col("_d")).drop("_d")


def average_rank(value: Column, group: list[str]) -> Column:
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2.0


def spearman(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """(group, n, spearman) over rows where both values stand; null under three rows or for a constant."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.select(*group, average_rank(F.col(a), group).alias("ra"), average_rank(F.col(b), group).alias("rb"))
    agg = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ra", "rb").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    return agg.select(*group, "n", F.when(F.col("n") >= 3, F.col("c") / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0))).alias("spearman"))


def fit_metrics(df: DataFrame, pred: str, y: str, group: list[str]) -> DataFrame:
    """Sign accuracy, root mean square error and mean signed outcome."""
    both = df.filter(F.col(pred).isNotNull() & F.col(y).isNotNull())
    p, t = F.col(pred), F.col(y)
    return both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.abs(t) > TINY, (F.signum(p) == F.signum(t)).cast("double"))).alias("sign_acc"),
        F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"),
        F.avg(F.signum(p) * t).alias("pnl_mean"),
    )


def top_confidence(df: DataFrame, pred: str, y: str, share: float, group: list[str], tie: str = "bar_id") -> DataFrame:
    """Of the ``share`` of rows with the largest predictions: accuracy, mean, deviation and their ratio."""
    both = df.filter(F.col(pred).isNotNull() & F.col(y).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.abs(pred).desc(), tie))
    k = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy(*group)) * share), F.lit(1))
    pnl = F.signum(pred) * F.col(y)
    agg = both.withColumns({"_in": rank <= k, "_pnl": pnl}).filter("_in").groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.avg((F.col("_pnl") > 0).cast("double")).alias("sign_acc"), F.avg("_pnl").alias("pnl_mean"), F.stddev_pop("_pnl").alias("pnl_std"))
    return agg.withColumn("pnl_ratio", F.col("pnl_mean") / F.nullif("pnl_std", F.lit(0.0)))


def thresholds(df: DataFrame, score: str, rate: float, group: list[str]) -> DataFrame:
    """The score that a share ``rate`` of a group's rows reach."""
    return df.groupBy(*group).agg(F.percentile(F.col(score), F.lit(1 - rate)).alias("threshold"))


def event_filter(df: DataFrame, score: str, rate: float, group: list[str], none: float = 3.0) -> DataFrame:
    """Rows whose score reaches the threshold that a share ``rate`` of the group's train rows reach; adds
    ``threshold`` (``none`` for a group without scores)."""
    limits = thresholds(df.filter("part = 'train'"), score, rate, group)
    return df.join(limits, group, "left").withColumn("threshold", F.coalesce("threshold", F.lit(none))).filter(F.col(score) >= F.col("threshold"))


class Ranked:
    """A multiset over known values: add one, find the n-th smallest; each takes the logarithm of their number."""

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        n = len(values)
        self.values, self.tree = values, np.concatenate([[0], np.cumsum(counts)])
        low = np.arange(n + 1)
        self.tree = (self.tree - self.tree[low & (low - 1)]).tolist()
        self.top = 1 << n.bit_length()

    def add(self, place: int) -> None:
        place += 1
        while place < len(self.tree):
            self.tree[place] += 1
            place += place & -place

    def nth(self, n: int) -> float:
        at, step = 0, self.top
        while step:
            if at + step < len(self.tree) and self.tree[at + step] <= n:
                at += step
                n -= self.tree[at]
            step >>= 1
        return float(self.values[min(at, len(self.values) - 1)])


def _grown(own: pd.DataFrame, before: pd.DataFrame, score: str, share: float, order: str, columns: list[str]) -> pd.DataFrame:
    """Thresholds of a block's rows from the values near the quantile that were there before it."""
    own = own.sort_values(order)
    x, place = own[score].to_numpy(float), own["_vs"].to_numpy(float)
    low, high = own["_lo"].iloc[0], own["_hi"].iloc[0]
    inside = (place >= low) & (place <= high)
    values, at = np.unique(np.concatenate([before[score].to_numpy(float), x[inside]]), return_inverse=True)
    known = np.zeros(len(values), np.int64)
    np.add.at(known, at[: len(before)], before["_c"].to_numpy(np.int64))
    pool, spot = Ranked(values, known), dict(zip(np.flatnonzero(inside).tolist(), at[len(before) :].tolist(), strict=True))
    size, under, limits = int(own["_size"].iloc[0]), int(own["_base"].iloc[0]), []
    for i in range(len(x)):
        if size:
            rank = share * (size - 1)
            first = int(rank)
            a, b = (pool.nth(min(k, size - 1) - under) for k in (first, first + 1))
            limits.append(a + (b - a) * (rank - first))
        else:
            limits.append(float("nan"))
        if x[i] == x[i]:
            size += 1
            under += place[i] < low
            if inside[i]:
                pool.add(spot[i])
    limit = np.array(limits, float)
    return own.assign(threshold=limit, passed=x >= limit)[[*columns, "threshold", "passed"]]


def growing_threshold(df: DataFrame, score: str, rate: float, group: list[str], order: str = "bar_id", block: int = 1024, most: int = 1024) -> DataFrame:
    """The oos rows of each group with ``threshold`` and ``passed``: the score that a share ``rate`` of the
    group's train rows and of its oos rows before the row reach; no row sees a later one.

    Scores are cut into slices by rank and oos rows into blocks by time, at most ``most`` of each in a group (or
    of ``block`` rows).  Counts of slices summed over blocks tell which slices a block's quantiles can lie
    in: as many ranks around as the block has rows.  A block is one task's group, with the values of those
    slices that were there before it; of all other values only the number counts.
    """
    share = 1 - rate
    rows = stored(df.withColumn(score, F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))), "scored")
    sizes = rows.groupBy(*group).agg(F.count(score).alias("_all"), F.count_if(F.col("part") == "oos").alias("_oos"))
    cut = lambda n: F.greatest(F.lit(block), F.ceil(F.col(n) / most))
    slices = counted(rows, score, group).join(sizes, group).select(*group, score, F.floor((F.col("_upto") - F.col("_n")) / cut("_all")).alias("_vs"))
    numbered = running_sum(rows.filter("part = 'oos'").withColumn("_one", F.lit(1).cast("long")), "_one", "_pos", group, F.floor(F.col(order) / 8192), (order,))
    oos = numbered.join(sizes, group).withColumn("_b", F.floor((F.col("_pos") - 1) / cut("_oos"))).drop("_one", "_pos", "_all", "_oos")
    oos = stored(oos.join(slices, [*group, score], "left"), "oos-rows")
    train = rows.filter("part = 'train'").select(*group, score).join(slices, [*group, score]).withColumn("_b", F.lit(-1).cast("long"))
    counts = train.select(*group, "_vs", "_b", score).unionByName(oos.filter(F.col(score).isNotNull()).select(*group, "_vs", "_b", score))
    counts = stored(counts.groupBy(*group, "_vs", "_b", score).agg(F.count(F.lit(1)).alias("_c")), "score-counts")
    # A cell for each slice and block of a group, train being block -1.
    blocks = oos.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_rows")).unionByName(sizes.select(*group, F.lit(-1).cast("long").alias("_b"), F.lit(0).cast("long").alias("_rows")))
    grid = blocks.join(slices.select(*group, "_vs").distinct(), group).join(counts.groupBy(*group, "_vs", "_b").agg(F.sum("_c").alias("_c")), [*group, "_vs", "_b"], "left")
    earlier = lambda part, by: Window.partitionBy(*group, part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    grid = grid.withColumn("_start", F.coalesce(F.sum("_c").over(earlier("_vs", "_b")), zero))
    grid = grid.withColumns({"_base": F.coalesce(F.sum("_start").over(earlier("_b", "_vs")), zero), "_size": F.sum("_start").over(Window.partitionBy(*group, "_b"))}).filter("_b >= 0")
    first = F.floor(F.lit(share) * (F.col("_size") - 1)) - F.col("_rows")
    last = F.ceil(F.lit(share) * (F.col("_size") + F.col("_rows") - 1))
    need = stored(grid.filter((F.col("_base") <= last) & (F.col("_base") + F.col("_start") > first)).select(*group, "_b", "_vs", "_base", "_size"), "needed")
    span = need.groupBy(*group, "_b").agg(F.min("_vs").alias("_lo"), F.max("_vs").alias("_hi"), F.min("_base").alias("_base"), F.max("_size").alias("_size"))
    before = counts.withColumnRenamed("_b", "_from").join(need.select(*group, "_b", "_vs"), [*group, "_vs"]).filter("_from < _b").select(*group, "_b", score, "_c")
    columns = df.columns
    schema = StructType([*rows.schema.fields, StructField("threshold", DoubleType()), StructField("passed", BooleanType())])
    own = oos.join(span, [*group, "_b"], "left").fillna(0, ["_lo", "_hi", "_base", "_size"])
    run = lambda a, b: _grown(a, b, score, share, order, columns)
    return own.groupBy(*group, "_b").cogroup(before.groupBy(*group, "_b")).applyInPandas(run, schema)


def pooled_metrics(df: DataFrame, pred: str, y: str) -> DataFrame:
    """One row over all folds: rank correlation, sign accuracy, mean and ratio of the signed outcome.

    Ranks come from running counts of the different values, so no task ranks all rows."""
    both = stored(df.filter(F.col(pred).isNotNull() & F.col(y).isNotNull()).select(F.col(pred).alias("p"), F.col(y).alias("t")), "pairs")
    ranked = average_ranks(average_ranks(both, "p", "ra"), "t", "rb").withColumn("_pnl", F.signum("p") * F.col("t"))
    n, same = F.count(F.lit(1)), F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))
    return ranked.agg(
        n.alias("n"),
        F.avg(F.when(F.abs("t") > TINY, (F.signum("p") == F.signum("t")).cast("double"))).alias("sign_acc"),
        F.avg("_pnl").alias("pnl_mean"),
        (F.avg("_pnl") / (F.stddev_pop("_pnl") + TINY)).alias("pnl_ratio"),
        F.when(n >= 3, F.covar_pop("ra", "rb") / same).alias("spearman"),
    )


def gate_metrics(df: DataFrame, pred: str, y: str, score: str = "gate_score", passed: str = "gate_pass", group: Sequence[str] = ("fold_idx",)) -> DataFrame:
    """(group, n, pass_rate, base_spearman, gate_spearman, gated_spearman, base_sign_acc, gated_sign_acc,
    base_pnl, gated_pnl): the predictions as they are against those that pass a gate; ``gate_spearman`` is
    that of the gate's score with the signed outcome.  A missing verdict passes."""
    keys = list(group)
    df = df.withColumns({"_pass": F.coalesce(F.col(passed), F.lit(True)), "_signed": F.signum(pred) * F.col(y), "_both": F.col(pred) * F.col(y)})
    on = F.col("_pass")
    right = F.when(F.abs(y) > TINY, (F.signum(pred) == F.signum(y)).cast("double"))
    rates = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(on.cast("double")).alias("pass_rate"),
        F.avg(right).alias("base_sign_acc"),
        F.avg(F.when(on, right)).alias("gated_sign_acc"),
        F.avg("_both").alias("base_pnl"),
        F.avg(F.when(on, F.col("_both"))).alias("gated_pnl"),
    )
    parts = {"base": spearman(df, pred, y, keys), "gate": spearman(df, score, "_signed", keys), "gated": spearman(df.filter(on), pred, y, keys)}
    for name, part in parts.items():
        rates = rates.join(part.select(*keys, F.col("spearman").alias(f"{name}_spearman")), keys, "left")
    return rates


def fold_summary(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, mean, median, std_pop, std_sample) of the columns of a table with one row for each fold."""
    long = metrics.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "_v")
    return long.groupBy("metric").agg(F.avg("_v").alias("mean"), F.percentile("_v", F.lit(0.5)).alias("median"), F.stddev_pop("_v").alias("std_pop"), F.stddev_samp("_v").alias("std_sample"))


def hold_stats(df: DataFrame, hold: str, group: Sequence[str]) -> DataFrame:
    """(group, mean_hold, short, long): mean of the bars held, how often one to three, how often more."""
    h = F.col(hold)
    return df.filter(h.isNotNull()).groupBy(*group).agg(F.avg(h).alias("mean_hold"), F.sum(h.between(1, 3).cast("int")).alias("short"), F.sum((h >= 4).cast("int")).alias("long"))


def train_scale(df: DataFrame, columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    """The columns less the mean of the group's train rows, in units of their deviation (1 if under 1e-8)."""
    stats = df.filter("part = 'train'").groupBy(*group).agg(*[f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    unit = lambda c: F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.join(stats, list(group), "left").withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / unit(c) for c in columns}).drop(*[f"{p}_{c}" for c in columns for p in ("_m", "_s")])


def describe(df: DataFrame, column: str) -> DataFrame:
    """(n, mean, std, min, p01, p05, p50, p95, p99, max) of a column; quantiles from running counts."""
    c = F.col(column)
    marks = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    values = stored(df.select(c), "described")
    found = quantiles(values, column, marks).select(F.struct(*marks)).scalar()
    row = values.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).withColumn("_q", found)
    return row.select("n", "mean", "std", "min", *[F.col(f"_q.{m}").alias(m) for m in marks], "max")


def match_rate(df: DataFrame, column: str) -> DataFrame:
    """(match_rate): the share of rows with a value."""
    return df.agg(F.avg(F.col(column).isNotNull().cast("double")).alias("match_rate"))


def null_rows(df: DataFrame, columns: Sequence[str], most: float | None = None) -> DataFrame:
    """(null_rows): the share of rows with a gap in any of the columns, 1 without rows; an error when it
    is read if it is over ``most``."""
    gap = F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0))
    share = df.agg(F.coalesce(F.avg(gap), F.lit(1.0)).alias("null_rows"))
    if most is None:
        return share
    return share.select(F.when(F.col("null_rows") > most, F.raise_error(F.lit("too many rows have gaps")).cast("double")).otherwise(F.col("null_rows")).alias("null_rows"))


def impute_medians(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Fill missing values of a group by the median of its rows with ``part`` train."""
    medians = df.filter("part = 'train'").groupBy(*group).agg(*[F.percentile(F.col(c), F.lit(0.5)).alias(f"_m_{c}") for c in columns])
    return df.join(medians, group, "left").withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def fill_empty(df: DataFrame, columns: Sequence[str], group: Sequence[str], value: float = 0.0) -> DataFrame:
    """Columns without any value in a group's train rows are ``value`` in all its rows, train and oos; NaN is no
    value.  A group without train rows has only such columns."""
    keys = list(group)
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    seen = df.groupBy(*keys).agg(*[F.count_if((F.col("part") == "train") & there(c)).alias(f"_n_{c}") for c in columns])
    return df.join(seen, keys).withColumns({c: F.when(F.col(f"_n_{c}") == 0, F.lit(value)).otherwise(F.col(c)) for c in columns}).drop(*[f"_n_{c}" for c in columns])


def reversion(df: DataFrame, side: str, y: str, group: Sequence[str]) -> DataFrame:
    """(group, n, reversion, share): mean of the outcome against the sign of ``side``, and how often it is above 0."""
    gain = -F.signum(side) * F.col(y)
    both = df.filter(F.col(side).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(gain).alias("reversion"), F.avg((gain > 0).cast("double")).alias("share"))


def signed_gain(df: DataFrame, pred: str, y: str, out: str = "gain") -> DataFrame:
    """Add what a prediction is worth: the outcome times the prediction's sign, the target of a gate."""
    return df.withColumn(out, F.signum(pred) * F.col(y))


def top_share(df: DataFrame, column: str, share: float, group: Sequence[str]) -> DataFrame:
    """The train rows of each group whose value is in the top ``share`` of them, with the ``threshold``."""
    rows = df.filter((F.col("part") == "train") & F.col(column).isNotNull())
    return rows.join(thresholds(rows, column, share, list(group)), list(group)).filter(F.col(column) >= F.col("threshold"))


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing): the share of nulls of each column."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "missing")


def day_folds(rows: DataFrame, train: int, oos: int, gap: int, step: int, day: str = "dt") -> DataFrame:
    """(fold_idx, tr_start, tr_end, gap_end, os_end) from every ``step``-th day that has rows; spans are
    in calendar days, and a fold must end by the last day.  One row a day is numbered in one task."""
    days = rows.select(F.col(day).alias("d")).distinct().filter("d is not null")
    order = Window.orderBy("d")
    seen = days.select("d", (F.row_number().over(order) - 1).alias("i"), F.max("d").over(Window.partitionBy()).alias("last"))
    fits = (F.col("i") % step == 0) & (F.date_add("d", train + gap + oos) <= F.col("last"))
    return seen.filter(fits).select((F.col("i") / step).cast("int").alias("fold_idx"), F.col("d").alias("tr_start"), F.date_add("d", train).alias("tr_end"), F.date_add("d", train + gap).alias("gap_end"), F.date_add("d", train + gap + oos).alias("os_end"))


def decay_weights(df: DataFrame, decay: float, group: list[str], order: str = "bar_id") -> DataFrame:
    """Add ``weight``: ``decay`` to the power of the rows that follow in the group, scaled to a mean of 1."""
    whole = Window.partitionBy(*group)
    place = F.row_number().over(whole.orderBy(F.col(order).desc())) - 1
    raw = df.withColumn("weight", F.pow(F.lit(decay), place))
    return raw.withColumn("weight", F.col("weight") * F.count(F.lit(1)).over(whole) / F.sum("weight").over(whole))


def search_threshold(df: DataFrame, score: str, rate: float, low: float = 0.3, high: float = 0.9, steps: int = 60) -> DataFrame:
    """(threshold, share): of evenly spaced thresholds the one whose share of scores at or above it is
    nearest to ``rate``, the lowest of several; 0.5 and null without scores.

    A score counts for all thresholds up to it, so rows are counted once by the highest one they reach.
    """
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    levels = F.array(*[F.lit(t) for t in grid])
    reached = df.filter(F.col(score).isNotNull()).select(F.size(F.filter(levels, lambda t: t <= F.col(score))).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    counts = reached.agg(F.sum("_n").alias("n"), F.collect_list(F.struct("_k", "_n")).alias("c"))  # steps + 1 entries at most
    rated = counts.select("n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"), "c").withColumn("share", F.aggregate(F.filter("c", lambda x: x["_k"] > F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["_n"]) / F.col("n"))
    best = rated.agg(F.min_by(F.struct(F.get(levels, F.col("i")).alias("t"), "share"), F.struct(F.abs(F.col("share") - rate), F.col("i"))).alias("b"), F.max("n").alias("n"))
    return best.select(F.when(F.col("n") > 0, F.col("b.t")).otherwise(0.5).alias("threshold"), F.col("b.share").alias("share"))
