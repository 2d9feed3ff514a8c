"""Triggers, scores and forward-looking labels of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .features import ewma, rolled
from .ordering import EPS, in_blocks, next_true, quantile, rolling

# UTC hours that count as good.
GOOD_HOURS = (3, 4, 5, 9, 10, 11, 12, 21, 22, 23)


def shock_trigger(bars: DataFrame, n: int = 100, on: float = 0.8, drop: float = 0.3, k: int = 4, consistency: float = 0.5, confirm: int = 2, peak: int = 20) -> DataFrame:
    """``trigger_on``, ``trigger_off`` and ``entry_dir`` from spread shocks and one-sided flow.

    On: a bar of the last ``k`` had a spread of rank ``on`` or more, and signs of the imbalance of the
    ``k`` bars before agree.  Off: the rank has been ``drop`` below its recent peak for ``confirm`` bars.
    """
    least = max(3, n // 4)

    def first(w: WindowSpec) -> dict[str, Column]:
        before = w.rowsBetween(-k, -1)
        sign = F.signum("taker_imb1vb")
        return {
            "_flow": F.when(F.count(sign).over(before) >= max(2, k // 2), F.sum(sign).over(before)),
        }

    def second(w: WindowSpec) -> dict[str, Column]:
        shock = F.coalesce(F.col("spread_pct") >= on, F.lit(False)).cast("int")
        recent = F.when(F.count(F.lit(1)).over(rolling(w, k)) >= max(2, k // 2), F.max(shock).over(rolling(w, k)))
        top = F.max("spread_pct").over(rolling(w, peak))
        return {"_recent": recent, "_low": F.coalesce(F.col("spread_pct") < top * (1 - drop), F.lit(False)).cast("int")}

    def third(w: WindowSpec) -> dict[str, Column]:
        agree = F.abs("_flow") / k >= consistency
        off = F.when(F.count(F.lit(1)).over(rolling(w, confirm)) >= confirm, F.min("_low").over(rolling(w, confirm)))
        on_now = F.coalesce((F.col("_recent") == 1) & agree, F.lit(False))
        return {"trigger_on": on_now, "trigger_off": F.coalesce(off == 1, F.lit(False)), "entry_dir": F.when(on_now, F.signum("_flow")).otherwise(0.0)}

    ranked = rolled(bars, {"spread_pct": ("rank", "roll_spread", n, least)})
    return in_blocks(ranked, [first, second, third], back=max(k, peak) + confirm).drop("_flow", "_recent", "_low")


def domain_score(bars: DataFrame, n: int = 2000) -> DataFrame:
    """Sum of six terms between 0 and 1; a missing term counts 0.  Needs ``streak``, ``book_imb``,
    ``cur_vol_vb_bp``, ``taker_imb1vb`` and ``ret1vb_bp``.

    The terms: rank of the streak, rank of how far the book leans against the imbalance, rank of quiet,
    rank of the imbalance over that of the return, a good hour, three large returns of one sign.
    """
    least = max(50, n // 10)
    imb, ret = F.col("taker_imb1vb"), F.col("ret1vb_bp")
    df = bars.withColumns(
        {
            "_streak": F.col("streak").cast("double"),
            "_against": F.when(imb > 0, -F.col("book_imb")).when(imb < 0, F.col("book_imb")).otherwise(0.0),
            "_imb": F.abs(imb),
            "_ret": F.abs(ret),
        }
    )
    ranks = {"score_streak": "_streak", "score_book": "_against", "_vol": "cur_vol_vb_bp", "_pi": "_imb", "_pr": "_ret"}
    df = rolled(df, {name: ("rank", column, n, least) for name, column in ranks.items()})

    def three(w: WindowSpec) -> dict[str, Column]:
        r1, r2 = F.coalesce(F.lag(ret, 1).over(w), F.lit(0.0)), F.coalesce(F.lag(ret, 2).over(w), F.lit(0.0))
        row = (F.least(F.abs(ret), F.abs(r1), F.abs(r2)) > 3) & (F.signum(ret) == F.signum(r1)) & (F.signum(r1) == F.signum(r2))
        return {"score_three": F.coalesce(row, F.lit(False)).cast("double")}

    terms = {
        "score_quiet": 1 - F.col("_vol"),
        "score_absorbed": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_pi") - F.col("_pr"))),
        "score_hour": F.hour(F.timestamp_millis("ts_ms")).isin(*GOOD_HOURS).cast("double"),
    }
    absorbed = F.when(F.col("_pi").isNotNull() & F.col("_pr").isNotNull(), terms["score_absorbed"])
    df = in_blocks(df, three, back=2).withColumns(terms | {"score_absorbed": absorbed})
    names = ("score_streak", "score_book", "score_quiet", "score_absorbed", "score_hour", "score_three")
    total = sum((F.coalesce(F.col(t), F.lit(0.0)) for t in names), F.lit(0.0))
    return df.withColumn("domain_score", total).drop("_streak", "_against", "_imb", "_ret", "_vol", "_pi", "_pr")


def label_efficiency(bars: DataFrame, horizon: int = 10) -> DataFrame:
    """Distance over path of the close in the next bars; null for the last ``horizon`` bars."""

    def step(w: WindowSpec) -> dict[str, Column]:
        path = F.sum("_d").over(w.rowsBetween(1, horizon))
        ahead = F.lead("close", horizon).over(w)
        return {"y_efficiency": F.when(ahead.isNotNull(), F.when(path <= EPS, 0.0).otherwise(F.least(F.abs(ahead - F.col("close")) / path, F.lit(1.0))))}

    return in_blocks(bars, [lambda w: {"_d": F.abs(F.col("close") - F.lag("close").over(w))}, step], back=1, forward=horizon).drop("_d")


def label_variable_horizon(bars: DataFrame, most: int = 12) -> DataFrame:
    """Log return in basis points up to the first bar with the opposite imbalance, or ``most`` bars."""
    sign = F.signum("taker_imb1vb")

    def step(w: WindowSpec) -> dict[str, Column]:
        ahead = F.collect_list(F.struct(F.col("bar_id").alias("at"), sign.alias("s"), F.col("close").alias("c"))).over(w.rowsBetween(1, most))
        turn = F.get(F.filter(ahead, lambda x: x["s"] == -sign), F.lit(0))
        last = F.when(F.size(ahead) == most, F.get(ahead, F.lit(most - 1)))
        exit_ = F.when((sign != 0) & (F.col("close") > 0), F.coalesce(turn, last))
        good = exit_["c"] > 0
        return {"hold_bars": F.when(good, exit_["at"] - F.col("bar_id")), "y_variable": F.when(good, F.log(exit_["c"] / F.col("close")) * 1e4)}

    return in_blocks(bars, step, forward=most)


def smoothed_move(bars: DataFrame, span: int, out: str) -> DataFrame:
    """Add the exponentially smoothed size of log returns, weights falling as by ``span`` rows."""
    moves = in_blocks(bars, lambda w: {"_r": F.abs(F.log(F.col("close") / F.lag("close").over(w)))}, back=1)
    return ewma(moves, "_r", out, 2.0 / (span + 1)).drop("_r")


def label_vwap(bars: DataFrame, horizon: int = 10, span: int = 50) -> DataFrame:
    """Average price of the next bars against the bar's own, in units of the smoothed size of returns."""

    def step(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(1, horizon)
        volume = F.sum("volume").over(frame)
        ahead = F.sum(F.col("vwap") * F.col("volume")).over(frame) / F.nullif(volume, F.lit(0.0))
        whole = F.lead("bar_id", horizon).over(w).isNotNull()
        scale = F.col("vwap") * F.greatest("_vol", F.lit(EPS))
        return {"y_vwap": F.when(whole & (volume > EPS) & F.col("_vol").isNotNull() & (scale > EPS), (ahead - F.col("vwap")) / scale)}

    return in_blocks(smoothed_move(bars, span, "_vol"), step, forward=horizon).drop("_vol")


def label_event(bars: DataFrame, most: int | None = 60, span: int = 50) -> DataFrame:
    """Exit of each trigger: the first off-bar of the next ``most``, or of all that follow.  ``event_bp`` is its
    log return in basis points, ``y_event`` the same in units of the smoothed size of returns and the root of the
    bars that it takes, against the median time of a bar."""

    def judged(found: Column) -> dict[str, Column]:
        use = F.when(F.col("trigger_on") & (F.col("close") > 0) & (found["close"] > 0), found)
        move, took = F.log(use["close"] / F.col("close")), use["bar_id"] - F.col("bar_id")
        return {"exit_bar": use["bar_id"], "event_bp": move * 1e4, "y_event": move / (F.col("_vol") * F.sqrt(took / (F.col("_typical") + EPS)) + EPS)}

    def step(w: WindowSpec) -> dict[str, Column]:
        return judged(F.first(F.when(F.col("trigger_off"), F.struct("bar_id", "close")), ignorenulls=True).over(w.rowsBetween(1, most)))

    rows = smoothed_move(bars, span, "_vol").join(quantile(bars, "dt_sec", 0.5, "_typical"), "symbol")
    if most is None:
        return next_true(rows, "trigger_off", ["bar_id", "close"], "_exit").withColumns(judged(F.col("_exit"))).drop("_vol", "_typical", "_exit")
    return in_blocks(rows, step, forward=most).drop("_vol", "_typical")


def composite_score(bars: DataFrame, n: int = 200, k: int = 4) -> DataFrame:
    """Mean of four rolling ranks: spread (carried forward inside the frame), speed, one-sidedness of the
    last ``k`` bars, and change of VPIN.  Null while any of them is.  Needs ``vpin_delta``."""
    least = max(10, n // 10)

    def first(w: WindowSpec) -> dict[str, Column]:
        sign = F.signum("taker_imb1vb")
        recent = rolling(w, k)
        return {
            "_spread": F.last("roll_spread", ignorenulls=True).over(rolling(w, n)),
            "_sided": F.when(F.count(sign).over(recent) >= max(2, k // 2), F.abs(F.sum(sign).over(recent)) / k),
        }

    sided = in_blocks(bars, first, back=max(n, k)).withColumns({"_dt": F.greatest("dt_sec", F.lit(0.0)), "_turn": F.abs("vpin_delta")})
    ranks = {"spread_score": "_spread", "_slow": "_dt", "imb_score": "_sided", "vpin_score": "_turn"}
    scored = rolled(sided, {name: ("rank", column, n, least) for name, column in ranks.items()}).withColumn("activity_score", 1 - F.col("_slow")).drop("_spread", "_sided", "_dt", "_turn", "_slow")
    return scored.withColumn("composite_score", (F.col("spread_score") + F.col("activity_score") + F.col("imb_score") + F.col("vpin_score")) / 4)


def label_scaled_trend(bars: DataFrame, horizon: int = 18, span: int = 50) -> DataFrame:
    """Log return over the next ``horizon`` bars in units of the smoothed absolute return and the root of
    the time it takes, against the median time of a bar; null for the last bars."""
    smooth = smoothed_move(bars, span, "_vol")
    typical = quantile(bars, "dt_sec", 0.5, "_typical")

    def step(w: WindowSpec) -> dict[str, Column]:
        time = F.sum(F.coalesce("dt_sec", F.lit(0.0))).over(w.rowsBetween(1, horizon))
        move = F.log(F.lead("close", horizon).over(w) / F.col("close"))
        return {"y_scaled": move / (F.col("_vol") * F.sqrt(time / (F.col("_typical") + EPS)) + EPS)}

    return in_blocks(smooth.join(typical, "symbol"), step, forward=horizon).drop("_vol", "_typical")
