"""DuckDB SQL with the rows of each query of the catalog, built from shared parts."""

from __future__ import annotations

TICKS = """ticks AS (
  SELECT 'EV' AS symbol, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, 1000 + value AS price, user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS lots, event_type IN ('view', 'error') AS is_buyer_maker
  FROM events)"""


def bar_parts(source: str = "ticks", volume: int = 500) -> str:
    return f"""
summed AS (SELECT *, CAST(sum(lots) OVER (ORDER BY ts_ms, seq) AS BIGINT) AS upto FROM {source}),
pieces AS (
  SELECT seq, ts_ms, price, is_buyer_maker, bar_id, least(upto, (bar_id + 1) * {volume}) - greatest(upto - lots, bar_id * {volume}) AS fill
  FROM (SELECT *, unnest(range((upto - lots) // {volume}, (upto + {volume} - 1) // {volume})) AS bar_id FROM summed)),
walked AS (
  SELECT *, CASE WHEN is_buyer_maker THEN -1.0::DOUBLE ELSE 1.0 END AS s, price * fill AS notional, count(*) OVER (PARTITION BY bar_id) AS cnt,
         price - lag(price) OVER w AS dp, ts_ms - lag(ts_ms) OVER w AS gap
  FROM pieces WINDOW w AS (PARTITION BY bar_id ORDER BY seq)),
marked AS (
  SELECT *, lag(dp) OVER (PARTITION BY bar_id ORDER BY seq) AS dp0,
         row_number() OVER (PARTITION BY bar_id ORDER BY notional DESC, seq DESC) <= greatest(1, cnt // 20) AS top,
         greatest(0, least(17, CAST(trunc((log10(greatest(notional, 1e-12)) + 2.0::DOUBLE) / 9.0::DOUBLE * 18) AS INT))) AS bin
  FROM walked),
binned AS (SELECT *, -ln(count(*) OVER (PARTITION BY bar_id, bin)::DOUBLE / cnt + 1e-12) / cnt AS ent FROM marked),
sums AS (
  SELECT bar_id, min(ts_ms) AS ts_first, max(ts_ms) AS ts_ms, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
         sum(notional) AS notional, sum(fill) AS filled, count(*) AS trade_count,
         sum(CASE WHEN is_buyer_maker THEN 0 ELSE fill END)::DOUBLE AS taker_buy_vol, sum(CASE WHEN is_buyer_maker THEN fill ELSE 0 END)::DOUBLE AS taker_sell_vol,
         sum(ent) AS ent, sum(CASE WHEN top THEN s * fill END) AS large, avg((bin BETWEEN 7 AND 11)::INT::DOUBLE) AS mid_size_share, sum(s * notional) AS signed,
         coalesce(sum((dp * dp0 < 0)::INT), 0) AS flips, coalesce(sum(abs(dp)), 0.0::DOUBLE) AS path, sum(s * fill) AS net, count(dp0) AS pairs, covar_samp(dp0, dp) AS cov,
         sum(s * fill / ln(2.0::DOUBLE + greatest(coalesce(gap, 0), 0))) AS flow, coalesce(sum((gap > 0)::INT), 0) AS gaps,
         avg(CASE WHEN gap > 0 THEN gap END) AS gap_mean, stddev_samp(CASE WHEN gap > 0 THEN gap::DOUBLE END) AS gap_std
  FROM binned GROUP BY bar_id HAVING sum(fill) = {volume}),
bars AS (
  SELECT bar_id::BIGINT AS bar_id, ts_first, ts_ms, open, high, low, close, notional / {volume} AS vwap, {volume}::DOUBLE AS volume, trade_count, taker_buy_vol, taker_sell_vol,
         (ts_ms - ts_first) / 1000.0::DOUBLE AS dt_sec, (high - low) / (close + 1e-12) * 1e4 AS range1vb_bp,
         CASE WHEN trade_count >= 5 THEN ent / ln(18.0::DOUBLE) END AS entropy_norm, large / ({volume} + 1e-12) AS large_imb_share, mid_size_share,
         signed / ({volume} * close + 1e-12) AS par, flips::DOUBLE / trade_count AS rev_count_ratio, greatest(0.0::DOUBLE, least(1.0::DOUBLE, abs(close - open) / (path + 1e-12))) AS pde,
         greatest(-2.0::DOUBLE, least(2.0::DOUBLE, flow / {volume})) AS twi,
         CASE WHEN pairs >= 2 THEN 2 * sqrt(greatest(-cov, 0.0::DOUBLE)) WHEN pairs = 1 THEN 0.0 END AS roll_spread, path / (abs(net) + 1e-12) AS kyle_lambda,
         CASE WHEN gaps >= 2 AND gap_mean > 0 THEN gap_std / gap_mean WHEN gaps >= 1 THEN 0.0 END AS burst_cv
  FROM sums)"""


BARS = TICKS + "," + bar_parts()
RETURNS = (
    BARS
    + """,
rets AS (
  SELECT *, (close - lag(close) OVER w) / (lag(close) OVER w + 1e-12) * 1e4 AS ret1vb_bp, (close - lag(close, 18) OVER w) / (lag(close, 18) OVER w + 1e-12) * 1e4 AS retHvb_bp,
         CASE WHEN abs(high - low) < 1e-12 THEN 0.0 ELSE (close - low) / (high - low) - 0.5::DOUBLE END AS close_pos1vb,
         (taker_buy_vol - taker_sell_vol) / (taker_buy_vol + taker_sell_vol + 2e-12) AS taker_imb1vb, (close - vwap) / greatest(high - low, 1e-12) AS close_vs_vwap,
         ln(close / lag(close) OVER w) * 1e4 AS logret
  FROM bars WINDOW w AS (ORDER BY bar_id)),
vol AS (
  SELECT *, CASE WHEN count(logret) OVER w >= 4 AND count(range1vb_bp) OVER w >= 4 THEN greatest(sqrt(avg(logret * logret) OVER w), avg(range1vb_bp) OVER w) END AS cur_vol_vb_bp
  FROM rets WINDOW w AS (ORDER BY bar_id ROWS 17 PRECEDING))"""
)


def rank_of(x: str, n: int, least: int, table: str, keep: str = "*") -> str:
    return f"""(SELECT {keep}, CASE WHEN {x} IS NOT NULL AND len(own) >= {least}
  THEN (len(list_filter(own, lambda v: v < {x})) + (len(list_filter(own, lambda v: v = {x})) + 1) / 2.0::DOUBLE) / len(own) END AS pct
  FROM (SELECT *, list({x}) FILTER ({x} IS NOT NULL) OVER (ORDER BY bar_id ROWS {n - 1} PRECEDING) AS own FROM {table}))"""


TRIGGER = (
    RETURNS
    + f""",
ranked AS {rank_of("roll_spread", 100, 25, "rets")},
flows AS (
  SELECT *, CASE WHEN count(taker_imb1vb) OVER w >= 2 THEN sum(sign(taker_imb1vb)) OVER w END AS flow FROM ranked
  WINDOW w AS (ORDER BY bar_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
shocks AS (
  SELECT *, CASE WHEN count(*) OVER w4 >= 2 THEN max(coalesce(pct >= 0.8::DOUBLE, false)::INT) OVER w4 END AS recent,
         coalesce(pct < max(pct) OVER (ORDER BY bar_id ROWS 19 PRECEDING) * (1 - 0.3::DOUBLE), false)::INT AS fallen
  FROM flows WINDOW w4 AS (ORDER BY bar_id ROWS 3 PRECEDING)),
triggers AS (
  SELECT *, coalesce(recent = 1 AND abs(flow) / 4 >= 0.5::DOUBLE, false) AS trigger_on,
         coalesce(CASE WHEN count(*) OVER w >= 2 THEN min(fallen) OVER w END = 1, false) AS trigger_off
  FROM shocks WINDOW w AS (ORDER BY bar_id ROWS 1 PRECEDING))"""
)

VARIABLE = (
    RETURNS
    + """,
ahead AS (
  SELECT *, list({'at': bar_id, 's': sign(taker_imb1vb), 'c': close}) OVER (ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS nxt FROM rets),
exits AS (
  SELECT *, CASE WHEN sign(taker_imb1vb) <> 0 THEN coalesce(list_filter(nxt, lambda x: x.s = -sign(taker_imb1vb))[1], CASE WHEN len(nxt) = 12 THEN nxt[12] END) END AS ex FROM ahead),
labelled AS (SELECT *, ex.at - bar_id AS hold_bars, ln(ex.c / close) * 1e4 AS y_variable FROM exits),
folds AS (
  SELECT k AS fold_idx, k * 100 AS tr_start, k * 100 + 400 AS tr_end, k * 100 + 420 AS gap_end, k * 100 + 520 AS os_end
  FROM (SELECT unnest(range(0, CASE WHEN n >= 520 THEN (n - 520) // 100 + 1 ELSE 0 END)) AS k FROM (SELECT max(bar_id) + 1 AS n FROM bars))),
met AS (
  SELECT f.fold_idx, b.bar_id, b.taker_imb1vb AS pred, b.y_variable AS y, CASE WHEN b.bar_id >= tr_start AND b.bar_id < tr_end - 12 THEN 'train' WHEN b.bar_id >= gap_end AND b.bar_id < os_end THEN 'oos' END AS part
  FROM labelled b JOIN folds f ON b.bar_id >= tr_start AND b.bar_id < os_end),
mem AS (SELECT * FROM met WHERE part IS NOT NULL),
pairs AS (SELECT * FROM mem WHERE pred IS NOT NULL AND y IS NOT NULL)"""
)

SMOOTH = """
mv AS (SELECT bar_id, abs(ln(close / lag(close) OVER (ORDER BY bar_id))) AS r FROM bars),
sm AS (SELECT bar_id, r AS v FROM mv WHERE bar_id = 1 UNION ALL SELECT mv.bar_id, (1 - 2.0::DOUBLE / 51) * sm.v + 2.0::DOUBLE / 51 * mv.r FROM sm JOIN mv ON mv.bar_id = sm.bar_id + 1)"""

PATHS = (
    TRIGGER
    + """,
evs AS (SELECT *, list({'at': bar_id, 'c': close, 't': ts_ms}) FILTER (trigger_off) OVER (ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS offs FROM triggers),
entries AS (
  SELECT e.bar_id AS event_id, sign(flow)::DOUBLE AS entry_dir, e.close AS p_entry, e.ts_ms AS ts_entry, offs[1].t AS ts_exit, coalesce(v.cur_vol_vb_bp, 0) AS entry_vol
  FROM evs e JOIN vol v USING (bar_id) WHERE trigger_on AND offs[1].at IS NOT NULL AND sign(flow) <> 0),
walk AS (
  SELECT e.*, t.ts_ms - ts_entry AS elapsed_ms, seq, price, ln(price / p_entry) * entry_dir AS pnl, CASE WHEN is_buyer_maker THEN 0 ELSE lots END AS b, CASE WHEN is_buyer_maker THEN lots ELSE 0 END AS s
  FROM entries e JOIN ticks t ON t.ts_ms BETWEEN ts_entry AND ts_exit),
paths AS (
  SELECT *, pnl - peak AS from_peak, (cum_buy - cum_sell)::DOUBLE / greatest(cum_buy + cum_sell, 1e-12) * entry_dir AS cum_imb
  FROM (SELECT *, max(pnl) OVER w AS peak, sum(b) OVER w::BIGINT AS cum_buy, sum(s) OVER w::BIGINT AS cum_sell, count(*) OVER (PARTITION BY event_id) AS n, max(elapsed_ms) OVER (PARTITION BY event_id) AS long
        FROM walk WINDOW w AS (PARTITION BY event_id ORDER BY elapsed_ms, seq))
  WHERE n >= 2 AND long > 0),
picked AS (
  SELECT event_id, sample, arg_min(p, {'gap': abs(elapsed_ms - long * sample / 5.0::DOUBLE), 'at': elapsed_ms}) AS p
  FROM (SELECT *, paths AS p FROM paths), (SELECT unnest(range(6)) AS sample) GROUP BY event_id, sample),
flat AS (
  SELECT event_id, sample, p.elapsed_ms / 1000.0::DOUBLE AS elapsed, p.pnl AS pnl, p.peak AS peak, p.from_peak AS from_peak, p.cum_imb AS cum_imb, p.cum_buy AS cum_buy, p.cum_sell AS cum_sell,
         p.price AS price, p.entry_dir AS entry_dir, p.entry_vol AS entry_vol FROM picked),
steps AS (SELECT *, elapsed <= lag(elapsed) OVER (PARTITION BY event_id ORDER BY sample) AS same FROM flat),
samples AS (SELECT * FROM steps WHERE event_id NOT IN (SELECT event_id FROM steps WHERE same)),
backs AS (
  SELECT a.event_id, a.sample, k, arg_min(b, {'gap': abs(b.elapsed - (a.elapsed - k * 3600.0::DOUBLE)), 'at': b.sample}) AS o
  FROM samples a JOIN samples b USING (event_id), (SELECT unnest([1, 2]) AS k) WHERE a.elapsed >= k * 3600.0::DOUBLE GROUP BY ALL)"""
)

SCORES = (
    RETURNS
    + f""",
vp AS (SELECT *, CASE WHEN count(*) OVER w >= 4 THEN sum(abs(taker_buy_vol - taker_sell_vol)) OVER w / (sum(volume) OVER w + 1e-12) END AS vpin_n FROM rets WINDOW w AS (ORDER BY bar_id ROWS 17 PRECEDING)),
raw AS (
  SELECT bar_id, greatest(dt_sec, 0) AS dt, abs(vpin_n - lag(vpin_n) OVER (ORDER BY bar_id)) AS dv, last_value(roll_spread IGNORE NULLS) OVER (ORDER BY bar_id ROWS 199 PRECEDING) AS spread,
         CASE WHEN count(taker_imb1vb) OVER w >= 2 THEN abs(sum(sign(taker_imb1vb)) OVER w) / 4.0::DOUBLE END AS sided
  FROM vp WINDOW w AS (ORDER BY bar_id ROWS 3 PRECEDING)),
s1 AS (SELECT * EXCLUDE (own, pct), pct AS spread_score FROM {rank_of("spread", 200, 20, "raw")}),
s2 AS (SELECT * EXCLUDE (own, pct), 1 - pct AS activity_score FROM {rank_of("dt", 200, 20, "s1")}),
s3 AS (SELECT * EXCLUDE (own, pct), pct AS imb_score FROM {rank_of("sided", 200, 20, "s2")}),
s4 AS (SELECT * EXCLUDE (own, pct), pct AS vpin_score FROM {rank_of("dv", 200, 20, "s3")}),
scores AS (SELECT *, (spread_score + activity_score + imb_score + vpin_score) / 4 AS composite_score FROM s4)"""
)

LADDER = """lad AS (
  SELECT 1704067200000 + vec_id * 60000 AS ts_ms, list_transform(embedding[1:25], lambda x: abs(x::DOUBLE)) AS b, list_transform(embedding[26:50], lambda x: abs(x::DOUBLE)) AS a FROM embeddings),
deep AS (SELECT *, list_sum(b[1:5]) AS b5, list_sum(a[1:5]) AS a5, list_sum(b[1:10]) AS b10, list_sum(a[1:10]) AS a10 FROM lad),
feats AS (
  SELECT ts_ms, (b[1] - a[1]) / (b[1] + a[1] + 2e-12) AS ob_imb_l1, (b5 - a5) / (b5 + a5 + 2e-12) AS ob_imb_l5, (b10 - a10) / (b10 + a10 + 2e-12) AS ob_imb_l10, b5 / (a5 + 2e-12) AS ob_depth_ratio_5,
         b10 / (a10 + 2e-12) AS ob_depth_ratio_10, 1000.0::DOUBLE AS mid, 1.0::DOUBLE AS ob_spread, 1.0::DOUBLE / (1000.0::DOUBLE + 2e-12) AS ob_spread_rel,
         (999.5::DOUBLE * a[1] + 1000.5::DOUBLE * b[1]) / (b[1] + a[1] + 2e-12) - 1000.0::DOUBLE AS ob_microprice_adj, b5 + a5 AS ob_total_depth_5
  FROM deep)"""


CLOCK = """WITH e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS t, (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events) AS seen FROM events)"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


GRID = TICKS + """,
edges AS (SELECT min(ts_ms) AS a, max(ts_ms) AS b FROM ticks),
grid AS (SELECT unnest(range(((a // 3600000) * 3600000 + 43200000 + 3599999) // 3600000 * 3600000, (b // 3600000) * 3600000 + 1, 3600000)) AS grid_ms FROM edges)"""

GRID_BARS = GRID + """,
summed AS (SELECT *, CAST(sum(lots) OVER (ORDER BY ts_ms, seq) AS BIGINT) AS upto FROM ticks),
totals AS (SELECT grid_ms, s.upto AS total FROM grid g ASOF JOIN (SELECT ts_ms, max(upto) AS upto FROM summed GROUP BY ts_ms) s ON g.grid_ms >= s.ts_ms),
met AS (SELECT t.grid_ms, t.total, s.* FROM totals t JOIN summed s ON s.upto > t.total - 1500 AND s.upto <= t.total WHERE t.total >= 1500),
based AS (SELECT *, min(upto - lots) OVER (PARTITION BY grid_ms) AS start FROM met),
cutoff AS (SELECT *, upto - start AS c, (total - start) // 500 - 3 AS first FROM based),
pcs AS (SELECT grid_ms, bar - first AS bar_idx, seq, ts_ms, price, is_buyer_maker, least(c, (bar + 1) * 500) - greatest(c - lots, bar * 500) AS fill
        FROM (SELECT *, unnest(range((c - lots) // 500, (c + 499) // 500)) AS bar FROM cutoff)),
gb AS (
  SELECT grid_ms, bar_idx, max(ts_ms) AS ts_ms, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(price * fill) / 500 AS vwap, count(*) AS trade_count, sum(CASE WHEN is_buyer_maker THEN -fill ELSE fill END)::DOUBLE AS net
  FROM pcs WHERE bar_idx BETWEEN 0 AND 2 GROUP BY grid_ms, bar_idx HAVING sum(fill) = 500),
gbars AS (
  SELECT *, net / (500 + 1e-12) AS taker_imb, CASE WHEN abs(high - low) >= 1e-12 THEN (close - low) / (high - low) - 0.5::DOUBLE END AS close_pos, (close - lag(close) OVER w) / (lag(close) OVER w + 1e-12) * 1e4 AS ret1_bp,
         CASE WHEN lag(close) OVER w IS NOT NULL THEN (close - vwap) / greatest(high - low, 1e-12) END AS close_vs_vwap, (high - low) / (close + 1e-12) * 1e4 AS range_bp
  FROM gb WINDOW w AS (PARTITION BY grid_ms ORDER BY bar_idx))"""

RANKED = ("ret1vb_bp", "retHvb_bp", "range1vb_bp", "cur_vol_vb_bp", "roll_spread", "vpin_delta", "kyle_finite")

DOMAIN = (
    RETURNS
    + f""", {LADDER},
brk AS (SELECT *, CASE WHEN sign(taker_imb1vb) <> 0 AND sign(taker_imb1vb) = lag(sign(taker_imb1vb)) OVER (ORDER BY bar_id) THEN 0 ELSE 1 END AS brk FROM vol),
isl AS (SELECT *, sum(brk) OVER (ORDER BY bar_id) AS island FROM brk),
stk AS (SELECT *, (row_number() OVER (PARTITION BY island ORDER BY bar_id) - 1)::DOUBLE AS streak, lag(ret1vb_bp, 1) OVER (ORDER BY bar_id) AS r1, lag(ret1vb_bp, 2) OVER (ORDER BY bar_id) AS r2 FROM isl),
bk AS (SELECT s.*, f.ob_imb_l1 AS ob FROM stk s ASOF LEFT JOIN feats f ON s.ts_ms >= f.ts_ms),
inp AS (
  SELECT bar_id, ts_ms, streak, CASE WHEN taker_imb1vb > 0 THEN -ob WHEN taker_imb1vb < 0 THEN ob ELSE 0.0 END AS against, cur_vol_vb_bp AS vol, abs(taker_imb1vb) AS ai, abs(ret1vb_bp) AS ar,
         (least(abs(ret1vb_bp), abs(coalesce(r1, 0)), abs(coalesce(r2, 0))) > 3 AND sign(ret1vb_bp) = sign(coalesce(r1, 0)) AND sign(coalesce(r1, 0)) = sign(coalesce(r2, 0))) AS three FROM bk),
k1 AS (SELECT * EXCLUDE (own, pct), pct AS score_streak FROM {rank_of("streak", 200, 50, "inp")}),
k2 AS (SELECT * EXCLUDE (own, pct), pct AS score_book FROM {rank_of("against", 200, 50, "k1")}),
k3 AS (SELECT * EXCLUDE (own, pct), 1 - pct AS score_quiet FROM {rank_of("vol", 200, 50, "k2")}),
k4 AS (SELECT * EXCLUDE (own, pct), pct AS pi FROM {rank_of("ai", 200, 50, "k3")}),
k5 AS (SELECT * EXCLUDE (own, pct), pct AS pr FROM {rank_of("ar", 200, 50, "k4")}),
k6 AS (SELECT *, CASE WHEN pi IS NOT NULL AND pr IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, pi - pr)) END AS score_absorbed, (ts_ms // 3600000 % 24 IN (3, 4, 5, 9, 10, 11, 12, 21, 22, 23))::INT::DOUBLE AS score_hour, coalesce(three, false)::INT::DOUBLE AS score_three FROM k5),
domain AS (SELECT *, coalesce(score_streak, 0) + coalesce(score_book, 0) + coalesce(score_quiet, 0) + coalesce(score_absorbed, 0) + score_hour + score_three AS domain_score FROM k6)"""
)

ORACLE_SQL: dict[str, str] = {
    "stream_tumbling": f"""{CLOCK}, w AS (SELECT *, t // 21600000 * 21600000 AS start_ms FROM e)
      SELECT start_ms, start_ms + 21600000 AS end_ms, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w WHERE start_ms + 21600000 <= seen GROUP BY start_ms, event_type""",
    "stream_sliding": f"""{CLOCK}, w AS (SELECT *, (t // 7200000 - unnest([0, 1, 2])) * 7200000 AS start_ms FROM e)
      SELECT start_ms, start_ms + 21600000 AS end_ms, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w WHERE start_ms + 21600000 <= seen GROUP BY start_ms, event_type""",
    "stream_sessions": f"""{CLOCK}, b AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 14400000000, true)::INT AS brk FROM e),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us) AS island FROM b)
      SELECT user_id, min(us) // 1000 AS start_ms, (max(us) + 14400000000) // 1000 AS end_ms, count(*) AS n, round(sum(value), 6) AS total FROM i GROUP BY user_id, island HAVING end_ms <= max(seen)""",
    "stream_bars": f"""WITH {BARS} SELECT 'EV' AS symbol, bar_id, ts_first, ts_ms, {r6("open", "high", "low", "close", "vwap")}, trade_count, {r6("taker_buy_vol", "taker_sell_vol")} FROM bars""",
    "label_scaled_trend": f"""WITH RECURSIVE {BARS}, r AS (SELECT *, abs(ln(close / lag(close) OVER (ORDER BY bar_id))) AS r FROM bars),
      e AS (SELECT bar_id, r AS v FROM r WHERE bar_id = 1 UNION ALL SELECT r.bar_id, (1 - 2.0::DOUBLE / 51) * e.v + 2.0::DOUBLE / 51 * r.r FROM e JOIN r ON r.bar_id = e.bar_id + 1),
      f AS (SELECT *, ln(lead(close, 18) OVER (ORDER BY bar_id) / close) AS move, sum(dt_sec) OVER (ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 18 FOLLOWING) AS tm, (SELECT quantile_cont(dt_sec, 0.5) FROM bars) AS typ FROM bars)
      SELECT f.bar_id, round(move / (v * sqrt(tm / (typ + 1e-12)) + 1e-12), 6) AS y_scaled FROM f LEFT JOIN e USING (bar_id)""",
    "composite_score": f"WITH {SCORES} SELECT bar_id, {r6('spread_score', 'activity_score', 'imb_score', 'vpin_score', 'composite_score')} FROM scores",
    "threshold_search": f"""WITH {SCORES}, t AS (SELECT i, 0.3::DOUBLE + (0.9::DOUBLE - 0.3::DOUBLE) * i / 59 AS thr, avg((composite_score >= thr)::INT::DOUBLE) AS share
      FROM scores, (SELECT unnest(range(60)) AS i) WHERE composite_score IS NOT NULL GROUP BY i, thr)
      SELECT round(arg_min(thr, {{'d': abs(share - 0.07::DOUBLE), 'i': i}}), 6) AS threshold, round(arg_min(share, {{'d': abs(share - 0.07::DOUBLE), 'i': i}}), 6) AS share FROM t""",
    "folds_days": """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), n AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, max(d) OVER () AS last FROM d)
      SELECT i // 5 AS fold_idx, CAST(d AS VARCHAR) AS tr_start, CAST(d + 10 AS VARCHAR) AS tr_end, CAST(d + 11 AS VARCHAR) AS gap_end, CAST(d + 16 AS VARCHAR) AS os_end FROM n WHERE i % 5 = 0 AND d + 16 <= last""",
    "sample_weights": f"""WITH {VARIABLE}, w AS (SELECT fold_idx, bar_id, pow(0.99::DOUBLE, row_number() OVER (PARTITION BY fold_idx ORDER BY bar_id DESC) - 1) AS w FROM mem WHERE part = 'train')
      SELECT fold_idx, bar_id, round(w * count(*) OVER (PARTITION BY fold_idx) / sum(w) OVER (PARTITION BY fold_idx), 6) AS weight FROM w""",
    "event_paths": f"WITH {PATHS} SELECT event_id, seq, elapsed_ms, {r6('pnl', 'peak', 'from_peak')}, cum_buy, cum_sell, {r6('cum_imb')} FROM paths",
    "exit_samples": f"WITH {PATHS} SELECT event_id, sample, {r6('elapsed', 'pnl', 'peak', 'cum_imb', 'price')} FROM samples",
    "exit_features": f"""WITH {PATHS}, j AS (
        SELECT s.*, a.o AS o1, b.o AS o2, s.cum_buy - a.o.cum_buy AS nb, s.cum_sell - a.o.cum_sell AS ns, coalesce((s.pnl - a.o.pnl) / 3600, 0) AS vel,
               coalesce(sign(s.price - lag(s.price) OVER w) = s.entry_dir, false)::INT::DOUBLE AS moved, ln(s.price) - ln(lag(s.price) OVER w) AS step,
               CASE WHEN coalesce(s.peak > lag(s.peak) OVER w, true) THEN s.elapsed END AS top
        FROM samples s LEFT JOIN backs a ON a.event_id = s.event_id AND a.sample = s.sample AND a.k = 1 LEFT JOIN backs b ON b.event_id = s.event_id AND b.sample = s.sample AND b.k = 2
        WINDOW w AS (PARTITION BY s.event_id ORDER BY s.sample)),
      g AS (SELECT event_id, max(CASE WHEN sample = 0 THEN cum_imb END) AS i0, max(CASE WHEN sample = 2 THEN cum_imb END) AS i2, max(CASE WHEN sample = 4 THEN cum_imb END) AS i4, max(CASE WHEN sample = 5 THEN cum_imb END) AS i5,
               max(CASE WHEN sample = 0 THEN elapsed END) AS e0, max(CASE WHEN sample = 2 THEN elapsed END) AS e2, max(CASE WHEN sample = 4 THEN elapsed END) AS e4, max(CASE WHEN sample = 5 THEN elapsed END) AS e5,
               stddev_pop(step) AS sd FROM j GROUP BY event_id)
      SELECT event_id, sample, round(coalesce(o1.pnl, 0), 6) AS pnl_lag1, round(coalesce(o2.cum_imb, 0), 6) AS cum_imb_lag2, round(vel, 6) AS pnl_velocity, round(coalesce(vel - (o1.pnl - o2.pnl) / 3600, 0), 6) AS pnl_acceleration,
        round(coalesce((cum_imb - o1.cum_imb) / 3600, 0), 6) AS imb_velocity, round(CASE WHEN nb + ns > 0 THEN nb / (nb + ns + 1e-12) ELSE 0 END, 6) AS buy_rate_recent,
        round(CASE WHEN nb + ns > 0 THEN (nb - ns) / (nb + ns + 1e-12) ELSE 0 END, 6) AS imb_rate_recent, round(avg(moved) OVER (PARTITION BY event_id ORDER BY sample ROWS 2 PRECEDING), 6) AS with_share,
        round(CASE WHEN peak > 1e-10 THEN pnl / peak ELSE 0 END, 6) AS realized_ratio, round(elapsed - max(top) OVER (PARTITION BY event_id ORDER BY sample), 6) AS since_peak,
        round(least(abs((i5 - i4) / greatest(e5 - e4, 1e-6)) / (abs((i2 - i0) / greatest(e2 - e0, 1e-6)) + 1e-9), 10), 6) AS imb_decay,
        round(CASE WHEN entry_vol > 0 THEN sd * 1e4 / greatest(entry_vol, 1e-4) ELSE 1 END, 6) AS vol_surprise,
        round(max(pnl) OVER (PARTITION BY event_id ORDER BY sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pnl, 6) AS remaining
      FROM j JOIN g USING (event_id)""",
    "exit_rating": f"""WITH {PATHS}, c AS (
        SELECT event_id, coalesce(arg_min(pnl, sample) FILTER (from_peak + 0.001::DOUBLE <= 0), arg_max(pnl, sample)) AS m, arg_max(pnl, sample) AS r,
               coalesce(arg_min(elapsed, sample) FILTER (from_peak + 0.001::DOUBLE <= 0), arg_max(elapsed, sample)) / greatest(max(elapsed), 1e-9) AS t FROM samples GROUP BY event_id)
      SELECT count(*) AS n_events, round(avg(m), 6) AS model_mean, round(avg(r), 6) AS rule_mean, round(avg(m) / nullif(stddev_pop(m), 0), 6) AS model_ratio, round(avg(r) / nullif(stddev_pop(r), 0), 6) AS rule_ratio,
             round(avg((m - r) * 1e4), 6) AS gain_bp, round(avg(((m - r) * 1e4 > 0)::INT::DOUBLE), 6) AS gained, round(avg(t), 6) AS time_share FROM c""",
    "tick_view": f"WITH {TICKS} SELECT symbol, ts_ms, seq, round(price, 6) AS price, lots, is_buyer_maker FROM ticks",
    "tick_order_check": f"WITH {TICKS} SELECT symbol, count(*) FILTER (ts_ms < before) AS violations FROM (SELECT *, lag(ts_ms) OVER (ORDER BY seq) AS before FROM ticks) GROUP BY symbol",
    "cumulative_lots": f"WITH {TICKS} SELECT symbol, seq, CAST(sum(lots) OVER (ORDER BY ts_ms, seq) AS BIGINT) AS upto FROM ticks",
    "volume_bars": f"""WITH {BARS} SELECT 'EV' AS symbol, bar_id, ts_first, ts_ms, {r6("open", "high", "low", "close", "vwap", "volume")}, trade_count,
      {r6("taker_buy_vol", "taker_sell_vol", "dt_sec", "range1vb_bp", "entropy_norm", "large_imb_share", "mid_size_share", "par", "rev_count_ratio", "pde", "twi", "roll_spread")},
      CASE WHEN kyle_lambda < 1e9 THEN round(kyle_lambda, 6) END AS kyle_lambda, round(burst_cv, 6) AS burst_cv FROM bars""",
    "bar_returns": f"WITH {RETURNS} SELECT bar_id, {r6('ret1vb_bp', 'retHvb_bp', 'close_pos1vb', 'taker_imb1vb', 'close_vs_vwap')} FROM rets",
    "vpin": f"""WITH {BARS}, v AS (SELECT bar_id, CASE WHEN count(*) OVER w >= 4 THEN sum(abs(taker_buy_vol - taker_sell_vol)) OVER w / (sum(volume) OVER w + 1e-12) END AS vpin_n
      FROM bars WINDOW w AS (ORDER BY bar_id ROWS 17 PRECEDING)) SELECT bar_id, round(vpin_n, 6) AS vpin_n, round(vpin_n - lag(vpin_n) OVER (ORDER BY bar_id), 6) AS vpin_delta FROM v""",
    "trade_activity": f"""WITH {BARS} SELECT bar_id, round(CASE WHEN count(*) OVER w >= 4 THEN ln(greatest(trade_count, 1e-12)) - ln(avg(trade_count::DOUBLE) OVER w) END, 6) AS tca
      FROM bars WINDOW w AS (ORDER BY bar_id ROWS 17 PRECEDING)""",
    "current_volatility": f"WITH {RETURNS} SELECT bar_id, {r6('cur_vol_vb_bp')} FROM vol",
    "rolling_percent_rank": f"WITH {BARS} SELECT bar_id, round(pct, 6) AS pct FROM {rank_of('roll_spread', 200, 20, 'bars')}",
    "robust_z": f"""WITH {BARS}, x AS (SELECT bar_id, ln(1 + greatest(dt_sec, 0)) AS x FROM bars),
      m AS (SELECT *, CASE WHEN count(x) OVER w >= 18 THEN quantile_cont(x, 0.5) OVER w END AS mid FROM x WINDOW w AS (ORDER BY bar_id ROWS 71 PRECEDING)),
      d AS (SELECT *, abs(x - mid) AS dev FROM m),
      s AS (SELECT *, CASE WHEN count(dev) OVER w >= 18 THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM d WINDOW w AS (ORDER BY bar_id ROWS 71 PRECEDING))
      SELECT bar_id, round((x - mid) / nullif(1.4826::DOUBLE * mad, 0), 6) AS dt_sec_z FROM s""",
    "ewma": f"""WITH RECURSIVE {BARS}, e AS (SELECT bar_id, dt_sec AS ewma FROM bars WHERE bar_id = 0 UNION ALL
      SELECT b.bar_id, 0.8::DOUBLE * e.ewma + 0.2::DOUBLE * b.dt_sec FROM e JOIN bars b ON b.bar_id = e.bar_id + 1) SELECT bar_id, round(ewma, 6) AS ewma FROM e""",
    "rolling_quantile": f"""WITH {BARS} SELECT bar_id, round(quantile_cont(range1vb_bp, 0.9) OVER w, 6) AS range_q90, CASE WHEN count(roll_spread) OVER w >= 20 THEN round(quantile_cont(roll_spread, 0.75) OVER w, 6) END AS spread_q75
      FROM bars WINDOW w AS (ORDER BY bar_id ROWS 49 PRECEDING)""",
    "lag_matrix": f"WITH {BARS} SELECT bar_id, " + ", ".join(f"round(lag({c}, {k}) OVER w, 6) AS {c}_lag{k}" for c in ("close", "dt_sec") for k in (1, 2, 3)) + " FROM bars WINDOW w AS (ORDER BY bar_id)",
    "streak": f"""WITH {RETURNS}, b AS (SELECT bar_id, CASE WHEN sign(taker_imb1vb) <> 0 AND sign(taker_imb1vb) = lag(sign(taker_imb1vb)) OVER (ORDER BY bar_id) THEN 0 ELSE 1 END AS brk FROM rets),
      i AS (SELECT *, sum(brk) OVER (ORDER BY bar_id) AS island FROM b) SELECT bar_id, row_number() OVER (PARTITION BY island ORDER BY bar_id) - 1 AS streak FROM i""",
    "shock_trigger": f"""WITH {TRIGGER} SELECT bar_id, round(pct, 6) AS spread_pct, trigger_on, trigger_off, CASE WHEN trigger_on THEN sign(flow)::DOUBLE ELSE 0.0::DOUBLE END AS entry_dir FROM triggers""",
    "label_event": f"""WITH RECURSIVE {TRIGGER}, {SMOOTH},
      ev AS (SELECT *, list({{'at': bar_id, 'c': close}}) FILTER (trigger_off) OVER (ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS offs, (SELECT quantile_cont(dt_sec, 0.5) FROM bars) AS typ FROM triggers),
      m AS (SELECT *, CASE WHEN trigger_on THEN offs[1].at END AS exit_bar, CASE WHEN trigger_on THEN ln(offs[1].c / close) END AS move FROM ev)
      SELECT m.bar_id, exit_bar, round(move * 1e4, 6) AS event_bp, round(move / (v * sqrt((exit_bar - m.bar_id) / (typ + 1e-12)) + 1e-12), 6) AS y_event FROM m LEFT JOIN sm USING (bar_id)""",
    "label_efficiency": f"""WITH {BARS}, d AS (SELECT *, abs(close - lag(close) OVER (ORDER BY bar_id)) AS d, lead(close, 10) OVER (ORDER BY bar_id) AS nxt FROM bars),
      p AS (SELECT *, sum(d) OVER (ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path FROM d)
      SELECT bar_id, round(CASE WHEN nxt IS NULL THEN NULL WHEN path <= 1e-12 THEN 0.0 ELSE least(abs(nxt - close) / path, 1.0::DOUBLE) END, 6) AS y_efficiency FROM p""",
    "label_variable_horizon": f"WITH {VARIABLE} SELECT bar_id, hold_bars, round(y_variable, 6) AS y_variable FROM labelled",
    "label_vwap": f"""WITH RECURSIVE {BARS}, {SMOOTH}, a AS (SELECT *, sum(vwap * volume) OVER w / sum(volume) OVER w AS ahead, lead(bar_id, 10) OVER (ORDER BY bar_id) AS whole FROM bars
      WINDOW w AS (ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
      SELECT a.bar_id, CASE WHEN whole IS NOT NULL AND v IS NOT NULL THEN round((ahead - vwap) / (vwap * greatest(v, 1e-12)), 6) END AS y_vwap FROM a LEFT JOIN sm USING (bar_id)""",
    "asof_book": f"""WITH {BARS}, {LADDER}, j AS (SELECT b.bar_id, b.ts_ms, f.ts_ms AS t, f.ob_imb_l5 AS x FROM bars b ASOF LEFT JOIN feats f ON b.ts_ms >= f.ts_ms)
      SELECT bar_id, ts_ms, CASE WHEN ts_ms - t <= 30000 THEN t END AS book_ts, CASE WHEN ts_ms - t <= 30000 THEN round(x, 6) END AS ob_imb_l5 FROM j""",
    "nearest_book": f"""WITH {BARS}, {LADDER}, j AS (SELECT b.bar_id, b.ts_ms, f.ts_ms AS t, f.ob_imb_l5 AS x FROM bars b ASOF LEFT JOIN feats f ON b.ts_ms >= f.ts_ms),
      k AS (SELECT j.*, f.ts_ms AS t2, f.ob_imb_l5 AS x2 FROM j ASOF LEFT JOIN feats f ON j.ts_ms <= f.ts_ms),
      p AS (SELECT *, t IS NOT NULL AND (t2 IS NULL OR ts_ms - t <= t2 - ts_ms) AS early FROM k)
      SELECT bar_id, ts_ms, CASE WHEN early THEN t ELSE t2 END AS book_ts, round(CASE WHEN early THEN x ELSE x2 END, 6) AS ob_imb_l5 FROM p""",
    "ladder_features": f"WITH {LADDER} SELECT ts_ms, {r6('ob_imb_l1', 'ob_imb_l5', 'ob_imb_l10', 'ob_depth_ratio_5', 'ob_depth_ratio_10', 'mid', 'ob_spread', 'ob_spread_rel', 'ob_microprice_adj', 'ob_total_depth_5')} FROM feats",
    "cross_instrument": f"""WITH {TICKS}, own AS (SELECT * FROM ticks WHERE user_id % 2 = 0), {bar_parts("own")},
      f AS (SELECT *, (taker_buy_vol - taker_sell_vol) / (taker_buy_vol + taker_sell_vol + 2e-12) AS own_imb, (close - lag(close) OVER (ORDER BY bar_id)) / (lag(close) OVER (ORDER BY bar_id) + 1e-12) * 1e4 AS own_ret FROM bars),
      m AS (SELECT b.bar_id, b.own_imb, b.own_ret, o.* FROM f b JOIN ticks o ON o.user_id % 2 = 1 AND o.ts_ms >= b.ts_first AND o.ts_ms <= b.ts_ms),
      p AS (SELECT *, abs(price - lag(price) OVER (PARTITION BY bar_id ORDER BY seq)) AS step FROM m)
      SELECT bar_id, count(*) AS n, round(sum(CASE WHEN is_buyer_maker THEN -lots ELSE lots END)::DOUBLE / sum(lots)::DOUBLE, 6) AS imb,
             round((arg_max(price, seq) - arg_min(price, seq)) / arg_min(price, seq) * 1e4, 6) AS ret_bp, sum(lots)::BIGINT AS total,
             round(coalesce(sum(step), 0) / abs(nullif(sum(CASE WHEN is_buyer_maker THEN -lots ELSE lots END), 0)), 6) AS path_over_net,
             round(sum(CASE WHEN is_buyer_maker THEN -lots ELSE lots END)::DOUBLE / sum(lots)::DOUBLE - any_value(own_imb), 6) AS imb_divergence,
             round((arg_max(price, seq) - arg_min(price, seq)) / arg_min(price, seq) * 1e4 - any_value(own_ret), 6) AS ret_divergence FROM p GROUP BY bar_id""",
    "grid_times": f"WITH {GRID} SELECT grid_ms FROM grid",
    "grid_bars": f"""WITH {GRID}, summed AS (SELECT *, CAST(sum(lots) OVER (ORDER BY ts_ms, seq) AS BIGINT) AS upto FROM ticks),
      totals AS (SELECT grid_ms, s.upto AS total FROM grid g ASOF JOIN (SELECT ts_ms, max(upto) AS upto FROM summed GROUP BY ts_ms) s ON g.grid_ms >= s.ts_ms),
      met AS (SELECT t.grid_ms, t.total, s.* FROM totals t JOIN summed s ON s.upto > t.total - 1500 AND s.upto <= t.total WHERE t.total >= 1500),
      based AS (SELECT *, min(upto - lots) OVER (PARTITION BY grid_ms) AS start FROM met),
      cut AS (SELECT *, upto - start AS c, (total - start) // 500 - 3 AS first FROM based),
      pcs AS (SELECT grid_ms, bar - first AS bar_idx, seq, ts_ms, price, is_buyer_maker, least(c, (bar + 1) * 500) - greatest(c - lots, bar * 500) AS fill
              FROM (SELECT *, unnest(range((c - lots) // 500, (c + 499) // 500)) AS bar FROM cut))
      SELECT grid_ms, bar_idx, min(ts_ms) AS ts_first, max(ts_ms) AS ts_ms, round(arg_min(price, seq), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, seq), 6) AS close,
             round(sum(price * fill) / 500, 6) AS vwap, count(*) AS trade_count, sum(CASE WHEN is_buyer_maker THEN 0 ELSE fill END)::DOUBLE AS taker_buy_vol
      FROM pcs WHERE bar_idx BETWEEN 0 AND 2 GROUP BY grid_ms, bar_idx HAVING sum(fill) = 500""",
    "folds_bars": f"WITH {VARIABLE} SELECT 'EV' AS symbol, * FROM folds",
    "fold_members": f"WITH {VARIABLE} SELECT fold_idx, part, count(*) AS n, min(bar_id) AS first_bar, max(bar_id) AS last_bar FROM mem GROUP BY ALL",
    "spearman_by_fold": f"""WITH {VARIABLE}, r AS (SELECT fold_idx, part, rank() OVER (PARTITION BY fold_idx, part ORDER BY pred) + (count(*) OVER (PARTITION BY fold_idx, part, pred) - 1) / 2.0::DOUBLE AS ra,
      rank() OVER (PARTITION BY fold_idx, part ORDER BY y) + (count(*) OVER (PARTITION BY fold_idx, part, y) - 1) / 2.0::DOUBLE AS rb FROM pairs)
      SELECT fold_idx, part, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) END, 6) AS spearman FROM r GROUP BY ALL""",
    "fit_metrics": f"""WITH {VARIABLE} SELECT fold_idx, part, count(*) AS n, round(avg(CASE WHEN abs(y) > 1e-12 THEN (sign(pred) = sign(y))::INT::DOUBLE END), 6) AS sign_acc,
      round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(sign(pred) * y), 6) AS pnl_mean FROM pairs GROUP BY fold_idx, part""",
    "top_confidence": f"""WITH {VARIABLE}, k AS (SELECT *, row_number() OVER (PARTITION BY fold_idx, part ORDER BY abs(pred) DESC, bar_id) AS rn, count(*) OVER (PARTITION BY fold_idx, part) AS n, sign(pred) * y AS pnl FROM pairs)
      SELECT fold_idx, part, count(*) AS k, round(avg((pnl > 0)::INT::DOUBLE), 6) AS sign_acc, round(avg(pnl), 6) AS pnl_mean, round(stddev_pop(pnl), 6) AS pnl_std,
             round(avg(pnl) / nullif(stddev_pop(pnl), 0), 6) AS pnl_ratio FROM k WHERE rn <= greatest(floor(n * 0.1::DOUBLE), 1) GROUP BY fold_idx, part""",
    "fold_thresholds": f"WITH {VARIABLE} SELECT fold_idx, round(quantile_cont(abs(pred), 0.8), 6) AS threshold FROM mem WHERE part = 'train' GROUP BY fold_idx",
    "median_impute": f"""WITH {VARIABLE}, m AS (SELECT fold_idx, quantile_cont(y, 0.5) AS med FROM mem WHERE part = 'train' GROUP BY fold_idx)
      SELECT fold_idx, part, round(avg(coalesce(y, med)), 6) AS y_mean FROM mem LEFT JOIN m USING (fold_idx) GROUP BY ALL""",
    "missing_profile": f"""WITH {RETURNS}, v AS (SELECT *, CASE WHEN count(*) OVER (ORDER BY bar_id ROWS 17 PRECEDING) >= 4 THEN 1 END AS vpin_n FROM vol)
      SELECT 'entropy_norm' AS "column", round(avg((entropy_norm IS NULL)::INT::DOUBLE), 6) AS missing FROM v """
    + " ".join(f"UNION ALL SELECT '{c}', round(avg(({c} IS NULL)::INT::DOUBLE), 6) FROM v" for c in ("roll_spread", "burst_cv", "vpin_n", "cur_vol_vb_bp", "ret1vb_bp")),
    "hold_buckets": f"""WITH {VARIABLE} SELECT CASE WHEN hold_bars <= 3 THEN '1-3' ELSE '4+' END AS bucket, count(*) AS n, round(avg(-sign(taker_imb1vb) * y_variable), 6) AS reversion, round(avg(hold_bars), 6) AS mean_hold
      FROM labelled WHERE y_variable IS NOT NULL GROUP BY 1""",
    "rolling_spearman": f"""WITH {VARIABLE}, x AS (SELECT bar_id, taker_imb1vb AS pred, y_variable AS y FROM labelled),
      w AS (SELECT a.bar_id, b.pred, b.y FROM x a JOIN x b ON b.bar_id > a.bar_id - 200 AND b.bar_id <= a.bar_id WHERE b.pred IS NOT NULL AND b.y IS NOT NULL),
      r AS (SELECT bar_id, rank() OVER (PARTITION BY bar_id ORDER BY pred) + (count(*) OVER (PARTITION BY bar_id, pred) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY bar_id ORDER BY y) + (count(*) OVER (PARTITION BY bar_id, y) - 1) / 2.0::DOUBLE AS rb FROM w),
      c AS (SELECT bar_id, CASE WHEN count(*) >= 20 THEN covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) END AS rho FROM r GROUP BY bar_id)
      SELECT x.bar_id, round(rho, 6) AS rho FROM x LEFT JOIN c USING (bar_id)""",
    "pace": f"WITH {BARS}, "
    + ", ".join(
        f"""x{i} AS (SELECT bar_id, ln(1 + greatest({c}, 0)) AS x FROM bars), m{i} AS (SELECT *, CASE WHEN count(x) OVER w >= 18 THEN quantile_cont(x, 0.5) OVER w END AS mid FROM x{i} WINDOW w AS (ORDER BY bar_id ROWS 71 PRECEDING)),
      d{i} AS (SELECT *, abs(x - mid) AS dev FROM m{i}), s{i} AS (SELECT *, CASE WHEN count(dev) OVER w >= 18 THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM d{i} WINDOW w AS (ORDER BY bar_id ROWS 71 PRECEDING)),
      z{i} AS (SELECT bar_id, round((x - mid) / nullif(1.4826::DOUBLE * mad, 0), 6) AS {c}_z FROM s{i})"""
        for i, c in enumerate(("dt_sec", "trade_count"))
    )
    + " SELECT * FROM z0 JOIN z1 USING (bar_id)",
    "volatility_ratio": f"""WITH RECURSIVE {RETURNS}, e AS (SELECT bar_id, abs(ret1vb_bp) AS s, abs(ret1vb_bp) AS l FROM rets WHERE bar_id = 1 UNION ALL
      SELECT r.bar_id, (1 - 2.0::DOUBLE / 10) * s + 2.0::DOUBLE / 10 * abs(ret1vb_bp), (1 - 2.0::DOUBLE / 19) * l + 2.0::DOUBLE / 19 * abs(ret1vb_bp) FROM e JOIN rets r ON r.bar_id = e.bar_id + 1)
      SELECT bar_id, round(s / (l + 2e-12), 6) AS vol_ratio FROM rets LEFT JOIN e USING (bar_id)""",
    "feature_ranks": f"""WITH {RETURNS}, vp AS (SELECT *, CASE WHEN count(*) OVER w >= 4 THEN sum(abs(taker_buy_vol - taker_sell_vol)) OVER w / (sum(volume) OVER w + 1e-12) END AS vpin_n FROM vol WINDOW w AS (ORDER BY bar_id ROWS 17 PRECEDING)),
      t0 AS (SELECT bar_id, ret1vb_bp, retHvb_bp, range1vb_bp, cur_vol_vb_bp, roll_spread, vpin_n - lag(vpin_n) OVER (ORDER BY bar_id) AS vpin_delta, CASE WHEN kyle_lambda < 1e9 THEN round(kyle_lambda, 6) END AS kyle_finite FROM vp), """
    + ", ".join(f"t{i + 1} AS (SELECT * EXCLUDE (own, pct), round(pct, 6) AS {c}_pctrank FROM {rank_of(c, 200, 20, f't{i}')})" for i, c in enumerate(RANKED))
    + " SELECT bar_id, " + ", ".join(f"{c}_pctrank" for c in RANKED) + " FROM t7",
    "fold_members_expanding": f"""WITH {VARIABLE}, m AS (SELECT fold_idx, bar_id, CASE WHEN bar_id < least(tr_end, gap_end - 60) THEN 'train' WHEN bar_id >= gap_end AND bar_id < os_end THEN 'oos' END AS part FROM bars, folds)
      SELECT 'EV' AS symbol, fold_idx, part, count(*) AS n, min(bar_id) AS first_bar, max(bar_id) AS last_bar FROM m WHERE part IS NOT NULL GROUP BY ALL""",
    "day_members": f"""WITH {TICKS}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), n AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, max(d) OVER () AS last FROM d),
      f AS (SELECT i // 5 AS fold_idx, d AS a, d + 10 AS b, d + 11 AS c, d + 16 AS e FROM n WHERE i % 5 = 0 AND d + 16 <= last), t AS (SELECT ts_ms, CAST(epoch_ms(ts_ms) AS DATE) AS dt FROM ticks)
      SELECT fold_idx, CASE WHEN dt < b THEN 'train' ELSE 'oos' END AS part, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM t JOIN f ON (dt >= a AND dt < b) OR (dt >= c AND dt < e) GROUP BY ALL""",
    "growing_threshold": f"""WITH {VARIABLE} SELECT o.fold_idx, o.bar_id, round(quantile_cont(abs(s.pred), 0.8), 6) AS threshold
      FROM mem o JOIN mem s ON s.fold_idx = o.fold_idx AND (s.part = 'train' OR s.bar_id < o.bar_id) WHERE o.part = 'oos' GROUP BY ALL""",
    "pooled_metrics": f"""WITH {VARIABLE}, q AS (SELECT *, sign(pred) * y AS pnl FROM pairs WHERE part = 'oos'),
      r AS (SELECT *, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS rb FROM q)
      SELECT count(*) AS n, round(avg(CASE WHEN abs(y) > 1e-12 THEN (sign(pred) = sign(y))::INT::DOUBLE END), 6) AS sign_acc, round(avg(pnl), 6) AS pnl_mean, round(avg(pnl) / (stddev_pop(pnl) + 1e-12), 6) AS pnl_ratio,
             round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS spearman FROM r""",
    "gate_metrics": f"""WITH {VARIABLE}, q AS (SELECT *, abs(pred) AS gs, coalesce(CASE WHEN pred <> 0 THEN abs(pred) >= 0.1::DOUBLE END, true) AS ok, sign(pred) * y AS sg FROM mem WHERE part = 'oos'),
      right_ AS (SELECT *, CASE WHEN abs(y) > 1e-12 THEN (sign(pred) = sign(y))::INT::DOUBLE END AS hit FROM q),
      a AS (SELECT fold_idx, count(*) AS n, round(avg(ok::INT::DOUBLE), 6) AS pass_rate, round(avg(hit), 6) AS base_sign_acc, round(avg(CASE WHEN ok THEN hit END), 6) AS gated_sign_acc, round(avg(pred * y), 6) AS base_pnl, round(avg(CASE WHEN ok THEN pred * y END), 6) AS gated_pnl FROM right_ GROUP BY fold_idx), """
    + ", ".join(
        f"""r_{name} AS (SELECT fold_idx, rank() OVER (PARTITION BY fold_idx ORDER BY {x}) + (count(*) OVER (PARTITION BY fold_idx, {x}) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY fold_idx ORDER BY {y}) + (count(*) OVER (PARTITION BY fold_idx, {y}) - 1) / 2.0::DOUBLE AS rb
      FROM q WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {also}), s_{name} AS (SELECT fold_idx, round(CASE WHEN count(*) >= 3 THEN covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) END, 6) AS {name}_spearman FROM r_{name} GROUP BY fold_idx)"""
        for name, x, y, also in (("base", "pred", "y", "true"), ("gate", "gs", "sg", "true"), ("gated", "pred", "y", "ok"))
    )
    + " SELECT * FROM a LEFT JOIN s_base USING (fold_idx) LEFT JOIN s_gate USING (fold_idx) LEFT JOIN s_gated USING (fold_idx)",
    "fold_summary": f"""WITH {VARIABLE}, r AS (SELECT fold_idx, rank() OVER (PARTITION BY fold_idx ORDER BY pred) + (count(*) OVER (PARTITION BY fold_idx, pred) - 1) / 2.0::DOUBLE AS ra,
      rank() OVER (PARTITION BY fold_idx ORDER BY y) + (count(*) OVER (PARTITION BY fold_idx, y) - 1) / 2.0::DOUBLE AS rb FROM pairs WHERE part = 'oos'),
      f AS (SELECT fold_idx, count(*)::DOUBLE AS n, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS spearman FROM r GROUP BY ALL),
      l AS (SELECT 'spearman' AS metric, spearman AS v FROM f UNION ALL SELECT 'n', n FROM f)
      SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std_pop, round(stddev_samp(v), 6) AS std_sample FROM l GROUP BY metric""",
    "hold_stats": f"""WITH {VARIABLE}, h AS (SELECT m.fold_idx, m.part, l.hold_bars AS h FROM mem m JOIN labelled l USING (bar_id) WHERE l.hold_bars IS NOT NULL)
      SELECT fold_idx, part, round(avg(h), 6) AS mean_hold, count(*) FILTER (h BETWEEN 1 AND 3) AS short, count(*) FILTER (h >= 4) AS long FROM h GROUP BY ALL""",
    "train_scale": f"""WITH {VARIABLE}, q AS (SELECT * FROM mem WHERE y IS NOT NULL), s AS (SELECT fold_idx, avg(pred) AS mp, stddev_pop(pred) AS sp, avg(y) AS my, stddev_pop(y) AS sy FROM q WHERE part = 'train' GROUP BY fold_idx)
      SELECT fold_idx, bar_id, round((pred - mp) / CASE WHEN sp < 1e-8 THEN 1 ELSE sp END, 6) AS pred, round((y - my) / CASE WHEN sy < 1e-8 THEN 1 ELSE sy END, 6) AS y FROM q JOIN s USING (fold_idx)""",
    "describe_label": f"""WITH {VARIABLE} SELECT count(y_variable) AS n, round(avg(y_variable), 6) AS mean, round(stddev_samp(y_variable), 6) AS std, round(min(y_variable), 6) AS min, """
    + ", ".join(f"round(quantile_cont(y_variable, {q}), 6) AS p{n}" for n, q in (("01", 0.01), ("05", 0.05), ("50", 0.5), ("95", 0.95), ("99", 0.99)))
    + ", round(max(y_variable), 6) AS max FROM labelled",
    "match_rate": f"""WITH {BARS}, {LADDER}, j AS (SELECT b.ts_ms, f.ts_ms AS t, f.ob_imb_l1 AS x FROM bars b ASOF LEFT JOIN feats f ON b.ts_ms >= f.ts_ms) SELECT round(avg((x IS NOT NULL AND ts_ms - t <= 30000)::INT::DOUBLE), 6) AS match_rate FROM j""",
    "null_rows": f"WITH {RETURNS} SELECT round(avg((entropy_norm IS NULL OR roll_spread IS NULL OR cur_vol_vb_bp IS NULL)::INT::DOUBLE), 6) AS null_rows FROM vol",
    "domain_score": f"WITH {DOMAIN} SELECT bar_id, {r6('score_streak', 'score_book', 'score_quiet', 'score_absorbed', 'score_hour', 'score_three', 'domain_score')} FROM domain",
    "domain_events": f"""WITH {DOMAIN}, folds AS (
        SELECT k AS fold_idx, k * 100 AS tr_start, k * 100 + 400 AS tr_end, k * 100 + 420 AS gap_end, k * 100 + 520 AS os_end
        FROM (SELECT unnest(range(0, CASE WHEN n >= 520 THEN (n - 520) // 100 + 1 ELSE 0 END)) AS k FROM (SELECT max(bar_id) + 1 AS n FROM bars))),
      m AS (SELECT fold_idx, bar_id, round(domain_score, 6) AS domain_score, CASE WHEN bar_id >= tr_start AND bar_id < tr_end - 12 THEN 'train' WHEN bar_id >= gap_end AND bar_id < os_end THEN 'oos' END AS part FROM domain, folds),
      t AS (SELECT fold_idx, quantile_cont(domain_score, 0.9) AS threshold FROM m WHERE part = 'train' GROUP BY fold_idx)
      SELECT fold_idx, part, bar_id, domain_score, round(threshold, 6) AS threshold FROM m JOIN t USING (fold_idx) WHERE part IS NOT NULL AND domain_score >= threshold""",
    "grid_rows": f"""WITH {GRID_BARS} SELECT grid_ms, row_number() OVER (ORDER BY grid_ms) - 1 AS bar_id, """
    + ", ".join(f"round(max(CASE WHEN bar_idx = 2 THEN {c} END), 6) AS {c}" for c in ("close", "taker_imb", "close_pos", "ret1_bp", "close_vs_vwap", "range_bp"))
    + ", max(CASE WHEN bar_idx = 2 THEN trade_count END) AS trade_count, "
    + ", ".join(f"round(max(CASE WHEN bar_idx = {2 - k} THEN {c} END), 6) AS {c}_lag{k}" for c in ("taker_imb", "ret1_bp", "range_bp") for k in (1, 2))
    + " FROM gbars GROUP BY grid_ms",
    "grid_fill_lags": f"""WITH {GRID_BARS}, g AS (SELECT grid_ms, max(CASE WHEN bar_idx = 2 THEN taker_imb END) AS t, max(CASE WHEN bar_idx = 2 THEN ret1_bp END) AS r, max(CASE WHEN bar_idx = 1 THEN ret1_bp END) AS r1, max(CASE WHEN bar_idx = 0 THEN ret1_bp END) AS r2 FROM gbars GROUP BY grid_ms)
      SELECT grid_ms, round(coalesce(r1, lag(r, 1) OVER w), 6) AS ret1_bp_lag1, round(coalesce(r2, lag(r, 2) OVER w), 6) AS ret1_bp_lag2, round(lag(t, 1) OVER w, 6) AS taker_imb_lag1, round(lag(t, 2) OVER w, 6) AS taker_imb_lag2 FROM g WINDOW w AS (ORDER BY grid_ms)""",
    "grid_book": f"""WITH {GRID_BARS}, {LADDER}, j AS (SELECT b.grid_ms, b.bar_idx, b.ts_ms, f.ts_ms AS t, f.ob_imb_l1 AS x, f.ob_total_depth_5 AS y FROM gbars b ASOF LEFT JOIN feats f ON b.ts_ms >= f.ts_ms)
      SELECT grid_ms, bar_idx, CASE WHEN ts_ms - t <= 60000 THEN t END AS book_ts, CASE WHEN ts_ms - t <= 60000 THEN round(x, 6) END AS ob_imb_l1_close, CASE WHEN ts_ms - t <= 60000 THEN round(y, 6) END AS ob_total_depth_5_close FROM j""",
    "book_over_bars": f"""WITH {BARS}, {LADDER}, m AS (SELECT b.bar_id, f.ts_ms AS t, f.ob_imb_l1 AS x, f.ob_total_depth_5 AS y FROM bars b JOIN feats f ON f.ts_ms >= b.ts_first AND f.ts_ms <= b.ts_ms),
      a AS (SELECT bar_id, arg_max(x, t) AS xc, avg(x) AS xm, arg_max(x, t) - arg_min(x, t) AS xd, arg_max(y, t) AS yc, avg(y) AS ym, arg_max(y, t) - arg_min(y, t) AS yd FROM m GROUP BY bar_id)
      SELECT bar_id, round(xc, 6) AS ob_imb_l1_close, round(xm, 6) AS ob_imb_l1_mean, round(xd, 6) AS ob_imb_l1_delta, round(yc, 6) AS ob_total_depth_5_close, round(ym, 6) AS ob_total_depth_5_mean, round(yd, 6) AS ob_total_depth_5_delta FROM bars LEFT JOIN a USING (bar_id)""",
    "horizon_return": f"""WITH {GRID}, l AS (SELECT ts_ms, arg_max(price, seq) AS price FROM ticks GROUP BY ts_ms), a AS (SELECT g.grid_ms, g.grid_ms + 7200000 AS till, l.price AS p0 FROM grid g ASOF LEFT JOIN l ON g.grid_ms >= l.ts_ms),
      b AS (SELECT a.*, l.price AS p1, l.ts_ms AS t FROM a ASOF LEFT JOIN l ON a.till >= l.ts_ms) SELECT grid_ms, CASE WHEN till - t < 120000 THEN round(ln(p1 / p0) * 1e4, 6) END AS y_horizon FROM b""",
    "two_instruments": f"WITH {TICKS} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS symbol, b.bar_id, round(close, 6) AS close, round(ret1, 6) AS ret1vb_bp, round(pct, 6) AS pct, fold_idx, CASE WHEN b.bar_id < tr_end THEN 'train' ELSE 'oos' END AS part FROM (
          WITH own AS (SELECT * FROM ticks WHERE user_id % 2 = {odd}), {bar_parts("own")}, f AS (SELECT *, (close - lag(close) OVER w) / (lag(close) OVER w + 1e-12) * 1e4 AS ret1 FROM bars WINDOW w AS (ORDER BY bar_id)),
          p AS {rank_of("roll_spread", 50, 10, "f")}, folds AS (SELECT k AS fold_idx, k * 50 AS tr_start, k * 50 + 195 AS tr_end, k * 50 + 210 AS gap_end, k * 50 + 260 AS os_end FROM (SELECT unnest(range(0, (max(bar_id) + 1 - 260) // 50 + 1)) AS k FROM bars))
          SELECT p.*, folds.* FROM p JOIN folds ON (bar_id >= tr_start AND bar_id < tr_end) OR (bar_id >= gap_end AND bar_id < os_end)) b"""
        for name, odd in (("A", 0), ("B", 1))
    ),
    "files_to_bars": f"WITH {BARS} SELECT 'EV' AS symbol, bar_id, {r6('open', 'high', 'low', 'close', 'vwap')}, trade_count, round(taker_buy_vol, 6) AS taker_buy_vol FROM bars",
    "tick_cache": f"WITH {TICKS} SELECT symbol, ts_ms, seq, round(price, 6) AS price, lots FROM ticks WHERE ts_ms >= 1704400000000 AND ts_ms < 1705000000000",
    "date_list": """WITH days AS (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS dt FROM events)
      SELECT CAST(dt AS VARCHAR) AS dt, (SELECT count(*) FROM events WHERE ts::DATE = dt) AS n FROM days""",
    "book_replay": """WITH e AS (SELECT 1704067200000 + vec_id * 60000 AS ts_ms, embedding AS v FROM embeddings), k AS (SELECT *, ts_ms // 60000 AS seq, ts_ms // 86400000 AS dt FROM e),
      s AS (SELECT *, sum((seq % 50 = 7)::INT) OVER (PARTITION BY dt ORDER BY ts_ms) AS st FROM k),
      lv AS (SELECT s.*, i, abs(v[i + 1]::DOUBLE) AS bz, abs(v[i + 26]::DOUBLE) AS az FROM s, (SELECT unnest(range(25)) AS i) WHERE st > 0 AND (seq % 50 = 7 OR (i + seq) % 5 = 0)),
      ch AS (SELECT dt, st, ts_ms, i, CASE WHEN seq % 50 <> 7 AND bz < 0.05::DOUBLE THEN 0 ELSE bz END AS bz, CASE WHEN seq % 50 <> 7 AND az < 0.05::DOUBLE THEN 0 ELSE az END AS az FROM lv),
      tk AS (SELECT dt, st, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY ts_ms) - 1 AS n FROM s WHERE st > 0) WHERE n % 3 = 0),
      now AS (SELECT t.ts_ms, c.i, arg_max(c.bz, c.ts_ms) AS bz, arg_max(c.az, c.ts_ms) AS az FROM tk t JOIN ch c ON c.dt = t.dt AND c.st = t.st AND c.ts_ms <= t.ts_ms GROUP BY ALL),
      b AS (SELECT ts_ms, count(*) AS n_bids, max(1000 - i - 0.5::DOUBLE) AS best_bid, sum(bz) AS bid_size FROM (SELECT *, row_number() OVER (PARTITION BY ts_ms ORDER BY i) AS r FROM now WHERE bz > 0) WHERE r <= 10 GROUP BY ts_ms),
      a AS (SELECT ts_ms, min(1000 + i + 0.5::DOUBLE) AS best_ask, sum(az) AS ask_size FROM (SELECT *, row_number() OVER (PARTITION BY ts_ms ORDER BY i) AS r FROM now WHERE az > 0) WHERE r <= 10 GROUP BY ts_ms)
      SELECT ts_ms, n_bids, best_bid, round(bid_size, 6) AS bid_size, best_ask, round(ask_size, 6) AS ask_size FROM b JOIN a USING (ts_ms)""",
    "two_stage_status": f"""WITH RECURSIVE {BARS}, {SMOOTH}, d AS (SELECT *, abs(close - lag(close) OVER (ORDER BY bar_id)) AS d, lead(close, 10) OVER (ORDER BY bar_id) AS nxt FROM bars),
      lab AS (SELECT bar_id, CASE WHEN nxt IS NULL THEN NULL WHEN path <= 1e-12 THEN 0.0 ELSE least(abs(nxt - close) / path, 1.0::DOUBLE) END AS a, nxt IS NOT NULL AND v IS NOT NULL AS b
        FROM (SELECT *, sum(d) OVER (ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path FROM d) LEFT JOIN sm USING (bar_id)),
      folds AS (SELECT k AS fold_idx, k * 100 AS lo FROM (SELECT unnest(range(0, CASE WHEN n >= 520 THEN (n - 520) // 100 + 1 ELSE 0 END)) AS k FROM (SELECT max(bar_id) + 1 AS n FROM bars))),
      mem AS (SELECT f.fold_idx, l.*, l.bar_id < lo + 390 AS train FROM lab l JOIN folds f ON (l.bar_id >= lo AND l.bar_id < lo + 390 OR l.bar_id >= lo + 420 AND l.bar_id < lo + 520) WHERE a IS NOT NULL),
      edges AS (SELECT fold_idx, quantile_cont(a, 0.8) AS edge FROM mem WHERE train AND b GROUP BY fold_idx)
      SELECT fold_idx, count(*) FILTER (train) AS alpha_train, count(*) FILTER (NOT train) AS alpha_oos, count(*) FILTER (train AND b) AS entry_candidates, count(*) FILTER (train AND b AND a >= edge) AS entry_train, 'used' AS status FROM mem JOIN edges USING (fold_idx) GROUP BY fold_idx""",
    "last_of_hour": f"""WITH {TICKS}, h AS (SELECT *, ts_ms // 3600000 AS hour FROM ticks) SELECT hour, is_buyer_maker, ts_ms, seq, round(price, 6) AS price, lots
      FROM h QUALIFY row_number() OVER (PARTITION BY hour, is_buyer_maker ORDER BY ts_ms DESC, seq DESC) = 1""",
    "gate_lookup": f"WITH {BARS} SELECT bar_id, CASE WHEN bar_id % 3 = 0 THEN true ELSE (taker_buy_vol::BIGINT + bar_id % 3) % 2 = 0 END AS gate_pass FROM bars",
    "filled_forward": f"""WITH {BARS}, x AS (SELECT bar_id, CASE WHEN bar_id % 97 = 50 THEN roll_spread END AS x FROM bars)
      SELECT bar_id, round(coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY bar_id), 0), 6) AS filled FROM x""",
    "fill_empty": f"WITH {VARIABLE} SELECT fold_idx, part, bar_id, CASE WHEN fold_idx % 2 = 1 THEN 0 ELSE round(pred, 6) END AS x FROM mem",
    "reversion": f"""WITH {VARIABLE} SELECT fold_idx, part, count(*) AS n, round(avg(-sign(pred) * y), 6) AS reversion, round(avg((-sign(pred) * y > 0)::INT::DOUBLE), 6) AS share FROM pairs GROUP BY fold_idx, part""",
    "top_of_train": f"""WITH {VARIABLE}, g AS (SELECT fold_idx, bar_id, sign(pred) * y AS gain FROM pairs WHERE part = 'train'), t AS (SELECT fold_idx, quantile_cont(gain, 0.8) AS threshold FROM g GROUP BY fold_idx)
      SELECT fold_idx, bar_id, round(gain, 6) AS gain, round(threshold, 6) AS threshold FROM g JOIN t USING (fold_idx) WHERE gain >= threshold""",
    "exit_units": f"WITH {PATHS} SELECT event_id, sample, round(pnl / greatest(entry_vol * 1e-4, 1e-4), 6) AS pnl, round(peak / greatest(entry_vol * 1e-4, 1e-4), 6) AS peak, round(cum_imb * entry_dir, 6) AS entry_pred_aligned FROM samples",
    "archive_bars": f"WITH {TICKS}, part AS (SELECT * FROM ticks WHERE ts_ms >= epoch_ms(TIMESTAMP '2024-01-05') AND ts_ms < epoch_ms(TIMESTAMP '2024-01-21')), {bar_parts('part')} SELECT 'EV' AS symbol, bar_id, ts_ms, {r6('open', 'high', 'low', 'close', 'vwap')}, trade_count, round(taker_buy_vol, 6) AS taker_buy_vol FROM bars",
    "archive_digests": """SELECT name, CASE WHEN n % 5 <> 0 AND n % 3 = 0 THEN 'md5' ELSE 'sha256' END AS algorithm, CASE WHEN n % 5 = 0 THEN 'bad' ELSE 'good' END AS status
      FROM (SELECT DISTINCT 'EV-aggTrades-' || strftime(ts, '%Y-%m-%d') || '.zip' AS name, dayofyear(ts) AS n FROM events)""",
    "union_files": f"""WITH {TICKS}, b AS (SELECT t.*, 0 AS f FROM ticks t JOIN events e ON e.event_id = t.seq WHERE event_type <> 'view' UNION ALL SELECT *, 1 AS f FROM ticks WHERE seq % 3 = 0)
      SELECT symbol, ts_ms, row_number() OVER (ORDER BY ts_ms, f, seq) - 1 AS seq, round(price, 6) AS price, lots FROM b""",
    "sql_bars": f"WITH {BARS} SELECT 'EV' AS symbol, bar_id, ts_first, ts_ms, {r6('open', 'high', 'low', 'close', 'vwap')}, trade_count, {r6('taker_buy_vol', 'taker_sell_vol')} FROM bars",
    "label_event_far": f"""WITH RECURSIVE {TRIGGER}, {SMOOTH}, ev AS (SELECT t.bar_id, t.close, o.bar_id AS exit_bar, o.close AS oc, (SELECT quantile_cont(dt_sec, 0.5) FROM bars) AS typ FROM triggers t JOIN bars o ON t.trigger_on AND o.bar_id = (t.bar_id // 150 + 1) * 150)
      SELECT ev.bar_id, exit_bar, round(ln(oc / close) * 1e4, 6) AS event_bp, round(ln(oc / close) / (v * sqrt((exit_bar - ev.bar_id) / (typ + 1e-12)) + 1e-12), 6) AS y_event FROM ev LEFT JOIN sm USING (bar_id)""",
    "stream_labels": f"WITH {VARIABLE} SELECT bar_id, bar_id + hold_bars AS known_at, hold_bars, round(pred, 6) AS pred, round(y_variable, 6) AS y_variable FROM (SELECT *, taker_imb1vb AS pred FROM labelled) WHERE y_variable IS NOT NULL",
    "stream_threshold": f"""WITH {BARS}, t AS (SELECT bar_id, range1vb_bp, quantile_cont(range1vb_bp, 0.9) OVER (ORDER BY bar_id ROWS 49 PRECEDING) AS t FROM bars)
      SELECT bar_id, round(t, 6) AS threshold, range1vb_bp >= t AS passed FROM t""",
    "path_predictions": f"""WITH {PATHS}, pr AS (SELECT e.event_id, (b.ts_ms - e.ts_entry) / 1000.0::DOUBLE AS el, b.taker_imb1vb AS p, row_number() OVER (PARTITION BY e.event_id ORDER BY b.ts_ms) AS up, row_number() OVER (PARTITION BY e.event_id ORDER BY b.ts_ms DESC) AS down
        FROM entries e JOIN rets b ON b.ts_ms >= e.ts_entry AND b.ts_ms <= e.ts_exit AND b.bar_id > e.event_id),
      one AS (SELECT event_id, max(CASE WHEN up = 1 THEN p END) AS p0, count(*) AS n_preds, CASE WHEN count(*) >= 2 THEN regr_slope(CASE WHEN down <= 3 THEN p END, CASE WHEN down <= 3 THEN -down::DOUBLE END) END AS pred_slope FROM pr GROUP BY event_id),
      j AS (SELECT s.event_id, s.sample, q.p AS now FROM samples s ASOF LEFT JOIN pr q ON s.event_id = q.event_id AND s.elapsed >= q.el)
      SELECT event_id, sample, round(coalesce(now, p0, 0.5), 6) AS pred_now, round(CASE WHEN p0 IS NULL THEN 0 ELSE coalesce(now, p0) - p0 END, 6) AS pred_delta, round(coalesce(pred_slope, 0), 6) AS pred_slope, coalesce(n_preds, 0) AS n_preds FROM j LEFT JOIN one USING (event_id)""",
    "peak_rate": f"""WITH {PATHS}, r AS (SELECT max(pnl) OVER (PARTITION BY event_id ORDER BY sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pnl AS remaining FROM samples) SELECT round(avg((remaining <= 1e-10)::INT::DOUBLE), 6) AS peak_rate FROM r""",
    "grid_book_rows": f"""WITH {GRID_BARS}, {LADDER}, j AS (SELECT b.grid_ms, b.bar_idx, CASE WHEN b.ts_ms - f.ts_ms <= 36000000 THEN f.ob_imb_l1 END AS x, CASE WHEN b.ts_ms - f.ts_ms <= 36000000 THEN f.ob_total_depth_5 END AS y FROM gbars b ASOF LEFT JOIN feats f ON b.ts_ms >= f.ts_ms),
      g AS (SELECT grid_ms, row_number() OVER (ORDER BY grid_ms) - 1 AS bar_id, max(CASE WHEN bar_idx = 2 THEN x END) AS x, max(CASE WHEN bar_idx = 2 THEN y END) AS y, max(CASE WHEN bar_idx = 1 THEN x END) AS x1, max(CASE WHEN bar_idx = 1 THEN y END) AS y1 FROM j GROUP BY grid_ms),
      p1 AS (SELECT * EXCLUDE (own, pct), pct AS px FROM {rank_of("x", 100, 10, "g")}), p2 AS (SELECT *, pct AS py FROM {rank_of("y", 100, 10, "p1")})
      SELECT grid_ms, round(x, 6) AS ob_imb_l1_close, round(y, 6) AS ob_total_depth_5_close, round(x1, 6) AS ob_imb_l1_close_lag1, round(y1, 6) AS ob_total_depth_5_close_lag1, round(px, 6) AS ob_imb_l1_close_pctrank, round(py, 6) AS ob_total_depth_5_close_pctrank FROM p2""",
    "fold_status": f"""WITH {VARIABLE}, s AS (SELECT fold_idx, count(*) FILTER (part = 'train' AND y IS NOT NULL) AS train, count(*) FILTER (part = 'oos') AS oos FROM mem GROUP BY fold_idx)
      SELECT *, CASE WHEN train < 380 THEN 'too few to learn from' WHEN oos = 0 THEN 'none to predict' ELSE 'used' END AS status FROM s""",
    "label_tail": "SELECT 'EV' AS symbol, true AS clean",
    "joined_metrics": f"""WITH {VARIABLE}, q AS (SELECT * FROM mem WHERE part = 'oos'), r AS (SELECT fold_idx, rank() OVER (PARTITION BY fold_idx ORDER BY pred) + (count(*) OVER (PARTITION BY fold_idx, pred) - 1) / 2.0::DOUBLE AS ra,
      rank() OVER (PARTITION BY fold_idx ORDER BY y) + (count(*) OVER (PARTITION BY fold_idx, y) - 1) / 2.0::DOUBLE AS rb FROM q WHERE pred IS NOT NULL AND y IS NOT NULL),
      m AS (SELECT fold_idx, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS spearman FROM r GROUP BY fold_idx)
      SELECT q.fold_idx, q.bar_id, round(b.close, 6) AS close, round(spearman, 6) AS spearman FROM q JOIN bars b USING (bar_id) LEFT JOIN m ON m.fold_idx = q.fold_idx""",
}
ORACLE_SQL["stream_book"] = ORACLE_SQL["book_replay"]
