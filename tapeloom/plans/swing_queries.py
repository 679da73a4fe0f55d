"""The swing reading of each symbol's newest bar."""

from pyspark.sql import functions as F

from ..functions.nulls import micro
from ..operators import swing as op
from .bar_queries import adjusted_day_bars
from .indicator_queries import CLOSES, TR, W, ema_sql, pivots_sql, wilder_sql
from .registry import query

FRAME_SQL = f"""RECURSIVE {CLOSES}, {ema_sql('e20', 'x', 20)}, {ema_sql('e50', 'x', 50)}, {ema_sql('e200', 'x', 200)}, {ema_sql('e12', 'x', 12)}, {ema_sql('e26', 'x', 26)},
mx AS MATERIALIZED (SELECT e26.symbol, e26.i - 25 AS i, e12.e - e26.e AS x FROM e12 JOIN e26 ON e12.symbol = e26.symbol AND e12.i = e26.i), {ema_sql('sg', 'mx', 9)}, {TR}, {wilder_sql('atr_', 'tr', 14)},
g AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(c - pc, 0) AS x FROM num WHERE i > 1), lo AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(pc - c, 0) AS x FROM num WHERE i > 1), {wilder_sql('ag', 'g', 14)}, {wilder_sql('al', 'lo', 14)}, {pivots_sql(5, 5)},
joined AS MATERIALIZED (SELECT num.symbol, num.dt, bars.o, num.h, num.l, num.c, bars.v, num.i - 1 AS i, count(*) OVER (PARTITION BY num.symbol) AS n, num.pc, piv.ph AS swing_high, piv.pl AS swing_low, e20.e AS ema20, e50.e AS ema50, e200.e AS ema200, mx.x AS macd, sg.e AS signal, atr_.e AS atr14,
  CASE WHEN ag.e + al.e > 0 THEN 100 * ag.e / (ag.e + al.e) END AS rsi, CASE WHEN count(*) OVER v20 = 20 THEN avg(bars.v) OVER v20 END AS vsma
  FROM num JOIN bars USING (symbol, dt) JOIN piv USING (symbol, dt) LEFT JOIN e20 ON e20.symbol = num.symbol AND e20.i = num.i LEFT JOIN e50 ON e50.symbol = num.symbol AND e50.i = num.i LEFT JOIN e200 ON e200.symbol = num.symbol AND e200.i = num.i
  LEFT JOIN mx ON mx.symbol = num.symbol AND mx.i = num.i - 25 LEFT JOIN sg ON sg.symbol = num.symbol AND sg.i = num.i - 25 LEFT JOIN atr_ ON atr_.symbol = num.symbol AND atr_.i = num.i - 1 LEFT JOIN ag ON ag.symbol = num.symbol AND ag.i = num.i - 1 LEFT JOIN al ON al.symbol = num.symbol AND al.i = num.i - 1
  WINDOW v20 AS (PARTITION BY num.symbol ORDER BY num.dt ROWS 19 PRECEDING)),
f AS MATERIALIZED (SELECT *, n - 1 - i AS age, lag(ema20) OVER w AS p20, lag(ema50) OVER w AS p50, lag(ema200) OVER w AS p200, lag(macd) OVER w AS pm, lag(signal) OVER w AS ps FROM joined WINDOW w AS ({W})),
now AS (SELECT * FROM f WHERE age = 0), hi AS MATERIALIZED (SELECT symbol, age, swing_high AS v, row_number() OVER (PARTITION BY symbol ORDER BY age) AS k FROM f WHERE swing_high IS NOT NULL), lw AS MATERIALIZED (SELECT symbol, age, swing_low AS v, row_number() OVER (PARTITION BY symbol ORDER BY age) AS k FROM f WHERE swing_low IS NOT NULL)"""


def newest(spark, sf_dir):
    return op.frame(adjusted_day_bars(spark, sf_dir))


def shown(df):
    """Floating-point columns to 6 places."""
    return df.select(*(micro(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def back_sql(c, k):
    return f"micro(100 * (max({c}) FILTER (age = 0) / nullif(max({c}) FILTER (age = {k}), 0) - 1))"


@query("swing_momentum", f"""WITH {FRAME_SQL}, s AS (SELECT symbol, {', '.join(f"{back_sql('c', k)} AS ret{k}" for k in (5, 20, 60))}, {', '.join(f"{back_sql(f'ema{k}', 5)} AS slope{k}" for k in (20, 50, 200))},
  coalesce(sum(v) FILTER (age < 20 AND c > o), 0) AS up_v, coalesce(sum(v) FILTER (age < 20 AND c < o), 0) AS down_v, coalesce(sum(c - pc) FILTER (age < 20 AND c > pc), 0) AS gain, coalesce(sum(pc - c) FILTER (age < 20 AND c < pc), 0) AS loss,
  100 * (max(c) FILTER (age = 0) / max(c) FILTER (age = 5) - 1) / 5 - 100 * (max(c) FILTER (age = 0) / max(c) FILTER (age = 20) - 1) / 20 AS acc FROM f GROUP BY symbol)
SELECT symbol, ret5, ret20, ret60, slope20, slope50, slope200, CASE WHEN ema200 IS NOT NULL THEN micro(100 * (greatest(ema20, ema50, ema200) - least(ema20, ema50, ema200)) / c) END AS separation,
  CASE WHEN up_v > 1.25 * down_v THEN 'Accumulation' WHEN down_v > 1.25 * up_v THEN 'Distribution' ELSE 'Neutral' END AS accum, CASE WHEN loss > 0 THEN micro(gain / loss) WHEN gain = 0 THEN 1 END AS advances_declines, micro(acc) AS acceleration FROM s JOIN now USING (symbol)""")
def swing_momentum(spark, sf_dir):
    return shown(op.momentum(newest(spark, sf_dir)))


@query("swing_crosses", f"""WITH {FRAME_SQL}, e AS (SELECT symbol, age, '20/50' AS pair, ema20 AS a, ema50 AS b, p20 AS pa, p50 AS pb FROM f UNION ALL SELECT symbol, age, '50/200', ema50, ema200, p50, p200 FROM f UNION ALL SELECT symbol, age, 'macd', macd, signal, pm, ps FROM f WHERE age < 14),
d AS (SELECT symbol, pair, age, CASE WHEN pa <= pb AND a > b THEN 'bullish' WHEN pa >= pb AND a < b THEN 'bearish' END AS direction FROM e WHERE age < 25)
SELECT symbol, pair, direction, age FROM d WHERE direction IS NOT NULL QUALIFY pair <> 'macd' OR age = min(age) OVER (PARTITION BY symbol, pair)""")
def swing_crosses(spark, sf_dir):
    return op.crosses(newest(spark, sf_dir))


@query("swing_levels", f"""WITH {FRAME_SQL}, s AS (SELECT now.symbol, c AS entry, atr14 AS atr, (SELECT min_by(v, age) FROM lw WHERE lw.symbol = now.symbol AND age < 250 AND v < c) AS near_support, (SELECT min(v) FROM lw WHERE lw.symbol = now.symbol AND age < 250) AS major_support,
  (SELECT min(v) FROM hi WHERE hi.symbol = now.symbol AND age < 250 AND v > c) AS near_res, (SELECT max(v) FROM hi WHERE hi.symbol = now.symbol AND age < 250 AND v > c) AS major_res, (SELECT min(v) FROM hi WHERE hi.symbol = now.symbol AND age < 250 AND v > c + 0.5 * atr14) AS target_res FROM now),
p AS (SELECT *, coalesce(entry - near_support >= 3.5 * atr, false) AS stop_far FROM s), q AS (SELECT *, CASE WHEN near_support IS NOT NULL AND NOT stop_far THEN near_support ELSE entry - 2 * atr END AS stop FROM p),
r AS (SELECT *, entry - stop AS risk FROM q WHERE entry > stop), t AS (SELECT *, least(coalesce(target_res, entry + 10 * atr), entry + 5 * risk, entry + 10 * atr) AS t1 FROM r),
u AS (SELECT *, CASE WHEN major_res > t1 + risk AND major_res <= least(entry + 20 * atr, entry + 10 * risk) THEN major_res ELSE t1 + risk END AS t2 FROM t)
SELECT symbol, {', '.join(f'micro({c}) AS {c}' for c in ('entry', 'stop', 'risk', 't1', 't2'))}, micro(greatest(t2 + 2 * risk, entry + 5 * risk)) AS t3, {', '.join(f'micro({c}) AS {c}' for c in ('near_res', 'major_res', 'near_support', 'major_support'))}, stop_far FROM u""")
def swing_levels(spark, sf_dir):
    return shown(op.levels(newest(spark, sf_dir)))


@query("swing_support", f"""WITH {FRAME_SQL}, m AS (SELECT symbol, list_max([x for x in [(SELECT min_by(v, age) FROM lw WHERE lw.symbol = now.symbol AND age < 250 AND v < c), ema20, ema50] if x < c]) AS support FROM now),
s AS (SELECT symbol, micro(100.0 * count(*) FILTER (age < 60 AND l <= ema20 AND c >= ema20) / nullif(count(*) FILTER (age < 60 AND l <= ema20), 0)) AS respects20, micro(100.0 * count(*) FILTER (age < 60 AND l <= ema50 AND c >= ema50) / nullif(count(*) FILTER (age < 60 AND l <= ema50), 0)) AS respects50,
  max(support) AS support, count(*) FILTER (age < 5 AND l <= support AND h > l AND (c - l) / (h - l) >= 0.5) > 0 AS back, max(n) AS n, sum(v) FILTER (age < 20) / 20 AS recent, sum(v) FILTER (age BETWEEN 20 AND 59) / 40 AS older FROM f JOIN m USING (symbol) GROUP BY symbol)
SELECT symbol, respects20, respects50, CASE WHEN support IS NOT NULL THEN back END AS buyers_return, CASE WHEN s.n < 60 OR coalesce(vsma, 0) = 0 THEN 'unknown' WHEN recent > 1.2 * older THEN 'expansion' WHEN recent < 0.8 * older THEN 'contraction' ELSE 'steady' END AS volume_regime,
  s.n >= 60 AND coalesce(vsma, 0) > 0 AND v > 3 * vsma AS abnormal FROM s JOIN now USING (symbol)""")
def swing_support(spark, sf_dir):
    return shown(op.support_tests(newest(spark, sf_dir)))


@query("swing_structure", f"""WITH {FRAME_SQL}, k AS (SELECT now.symbol, h1.v > h2.v AS hh, h1.v < h2.v AS lh, l1.v > l2.v AS hl, l1.v < l2.v AS ll, {', '.join(f'f{j}.rsi AS rsi{j}, f{j}.macd AS macd{j}' for j in range(1, 5))} FROM now
  LEFT JOIN hi h1 ON h1.symbol = now.symbol AND h1.k = 1 LEFT JOIN hi h2 ON h2.symbol = now.symbol AND h2.k = 2 LEFT JOIN lw l1 ON l1.symbol = now.symbol AND l1.k = 1 LEFT JOIN lw l2 ON l2.symbol = now.symbol AND l2.k = 2
  {' '.join(f'LEFT JOIN f f{j} ON f{j}.symbol = now.symbol AND f{j}.age = {a}.age' for j, a in ((1, 'h1'), (2, 'h2'), (3, 'l1'), (4, 'l2')))}),
r AS (SELECT symbol, max(h) FILTER (age < 20) - min(l) FILTER (age < 20) AS travel, max(c) FILTER (age = 60) AS c60 FROM f GROUP BY symbol),
z AS (SELECT k.*, coalesce(now.n >= 20 AND atr14 <> 0 AND travel / atr14 <= 2.5, false) AS ranging, coalesce(c > ema20 AND ema20 > ema50 AND ema50 > ema200, false) AS up, coalesce((c - ema20) / atr14 > 4, false) OR coalesce(100 * (c / c60 - 1) > 60, false) AS late, coalesce(ema50 < ema200, false) AS below FROM k JOIN now USING (symbol) JOIN r USING (symbol)),
y AS (SELECT * REPLACE (coalesce(hh, false) AS hh, coalesce(hl, false) AS hl, coalesce(lh, false) AS lh, coalesce(ll, false) AS ll) FROM z)
SELECT symbol, CASE WHEN hh AND hl THEN 'HH/HL' WHEN lh AND ll THEN 'LH/LL' WHEN hh OR hl THEN 'mixed-up' WHEN lh OR ll THEN 'mixed-down' ELSE 'unclear' END AS label, coalesce(hh AND rsi1 < rsi2, false) AS rsi_bear, coalesce(ll AND rsi3 > rsi4, false) AS rsi_bull, coalesce(hh AND macd1 < macd2, false) AS macd_bear, coalesce(ll AND macd3 > macd4, false) AS macd_bull, ranging,
  CASE WHEN NOT up AND below THEN if(ranging, 'Consolidation', 'Downtrend') WHEN NOT up THEN if(ranging OR hh OR hl, 'Consolidation', 'Reversal Attempt') WHEN late THEN 'Late Uptrend' WHEN ranging THEN 'Consolidation' WHEN hh AND hl THEN 'Established Uptrend' ELSE 'Early Uptrend' END AS stage FROM y""")
def swing_structure(spark, sf_dir):
    return op.structure(newest(spark, sf_dir))


@query("swing_breakout", f"""WITH {FRAME_SQL}, m AS (SELECT now.symbol, n, c, o, h, l, v, vsma, atr14 AS atr, (SELECT max(v) FROM hi WHERE hi.symbol = now.symbol AND k <= 4) AS res, (SELECT v FROM hi WHERE hi.symbol = now.symbol AND k = 1) AS last_high, (SELECT v FROM lw WHERE lw.symbol = now.symbol AND k = 1) AS last_low FROM now
  WHERE EXISTS (SELECT 1 FROM f WHERE f.symbol = now.symbol)), p AS (SELECT *, greatest(0.5 * atr, 0.005 * res) AS tol FROM m),
b AS (SELECT f.symbol, f.i, f.age, f.c, f.h, f.l, f.v, f.vsma, f.pc, res, tol, last_high, last_low, p.atr, p.n AS bars, f.c BETWEEN res - greatest(4 * p.atr, 0.08 * res) AND 1.02 * res AS inside, max(f.c) OVER (PARTITION BY f.symbol ORDER BY f.dt ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS ahead FROM f JOIN p USING (symbol)),
fl AS MATERIALIZED (SELECT symbol, i FROM b WHERE age < 120 AND h > res AND c < res AND coalesce(ahead, 0) < res), ep AS (SELECT symbol, min(i) AS i, 1 AS k FROM fl GROUP BY symbol UNION ALL SELECT ep.symbol, (SELECT min(fl.i) FROM fl WHERE fl.symbol = ep.symbol AND fl.i >= ep.i + 8), k + 1 FROM ep WHERE EXISTS (SELECT 1 FROM fl WHERE fl.symbol = ep.symbol AND fl.i >= ep.i + 8)),
s AS (SELECT symbol, coalesce(min(age) FILTER (c <= 0.98 * res), max(bars) - 1) AS walk, min(age) FILTER (c > res AND pc <= res AND age < 30 AND i >= 1) AS bo, count(*) FILTER (age BETWEEN 1 AND 5 AND c > res) > 0 AS was, count(*) FILTER (age < 90 AND abs(h - res) <= tol) AS res_tests, count(*) FILTER (age < 3 AND c > res) AS follow_through,
  count(*) FILTER (age < 10 AND l < last_low AND c > last_low) > 0 AS sweep, count(*) FILTER (age BETWEEN 3 AND 19 AND c < last_high) > 0 AS broke FROM b GROUP BY symbol),
q AS (SELECT b.symbol, min(row(l, i)) FILTER (age < bo) AS low_at, count(*) FILTER (age < bo AND c < res - tol) = 0 AS held, min(age) FILTER (age >= walk AND NOT inside) AS left_ FROM b JOIN s USING (symbol) GROUP BY b.symbol),
d AS (SELECT q.*, b.l AS deep, b.v AS deep_v, b.vsma AS deep_m FROM q LEFT JOIN b ON b.symbol = q.symbol AND b.i = q.low_at[2]),
fin AS (SELECT p.*, s.* EXCLUDE (symbol), d.* EXCLUDE (symbol), bo >= 1 AND deep <= res + tol AS reached FROM p JOIN s USING (symbol) JOIN d USING (symbol))
SELECT symbol, CASE WHEN res IS NULL OR (c <= res AND NOT was AND h <= res) THEN 'No Breakout' WHEN c <= res AND NOT was THEN 'Attempting Breakout' WHEN c > res AND NOT was THEN if(coalesce(v / vsma, 0) >= 1.5, 'Confirmed Breakout', 'Attempting Breakout') WHEN c > res THEN if(100 * (c / res - 1) > 12, 'Extended Breakout', 'Confirmed Breakout') WHEN c > 0.98 * res THEN 'Breakout Retest' ELSE 'Failed Breakout' END AS state,
  micro(res) AS res, res_tests, CASE WHEN res IS NULL THEN 0 ELSE least(coalesce(left_ - walk, 9999), 250, n - 1 - walk) END AS consol_days, CASE WHEN res IS NOT NULL THEN micro(abs(c - o) / nullif(atr, 0)) END AS candle, CASE WHEN res IS NOT NULL THEN micro(100 * (c - l) / nullif(h - l, 0)) END AS close_pos, follow_through,
  CASE WHEN reached THEN micro((res - deep) / atr) END AS retest_depth, CASE WHEN reached THEN held END AS retest_held, CASE WHEN reached THEN micro(deep_v / nullif(deep_m, 0)) END AS retest_vol, CASE WHEN reached THEN bo END AS retest_bars, coalesce((SELECT max(k) FROM ep WHERE ep.symbol = fin.symbol), 0) AS failures, sweep, coalesce(broke AND c > last_high, false) AS reclaim FROM fin""")
def swing_breakout(spark, sf_dir):
    return shown(op.breakout(newest(spark, sf_dir)))


@query("swing_pullback", f"""WITH {FRAME_SQL}, dn AS (SELECT symbol, o - c AS b, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k, count(*) OVER (PARTITION BY symbol) AS m FROM f WHERE age < 10 AND c < o), wk AS (SELECT symbol, avg(b) FILTER (k > m // 2) < avg(b) FILTER (k <= m // 2) AS weakening FROM dn WHERE m >= 4 GROUP BY symbol),
s AS (SELECT symbol, max(c) FILTER (age < 20) AS peak, coalesce(sum(v) FILTER (age < 20 AND c > o), 0) AS up_v, coalesce(sum(v) FILTER (age < 20 AND c < o), 0) AS down_v FROM f GROUP BY symbol),
fin AS (SELECT now.symbol, c, pc, ema20, ema50, 100 * (peak - c) / peak AS depth, coalesce(v / vsma, 1) AS vx, coalesce(c < (SELECT v FROM lw WHERE lw.symbol = now.symbol AND k = 2), false) AS broke, coalesce(c > o OR c > pc, false) AS confirmed, weakening, down_v > 1.25 * up_v AS spread FROM now JOIN s USING (symbol) LEFT JOIN wk USING (symbol))
SELECT symbol, CASE WHEN ema20 IS NULL OR ema50 IS NULL THEN 'WAIT' WHEN depth < 1.5 THEN 'NO PULLBACK' WHEN c < ema50 AND broke THEN 'TREND BREAKDOWN' WHEN broke OR (vx > 1.5 AND c < pc) OR spread THEN 'DANGEROUS' WHEN c >= ema20 AND vx < 1 AND confirmed AND coalesce(weakening, true) THEN 'BUY ZONE'
  WHEN c >= ema50 AND vx < 1.2 AND confirmed AND coalesce(weakening, true) THEN 'HEALTHY PULLBACK' ELSE 'WAIT' END AS state, micro(depth) AS depth, confirmed, weakening FROM fin""")
def swing_pullback(spark, sf_dir):
    return shown(op.pullback(newest(spark, sf_dir)))


@query("swing_trading", f"""WITH {FRAME_SQL}, cal AS (SELECT DISTINCT dt FROM f ORDER BY dt DESC LIMIT 60)
SELECT symbol, micro(100.0 * count(*) FILTER (dt IN (SELECT dt FROM cal)) / (SELECT count(*) FROM cal)) AS frequency, count(*) FILTER (age < 60 AND abs(o / pc - 1) > 0.05) AS gaps FROM f GROUP BY symbol""")
def swing_trading(spark, sf_dir):
    return shown(op.trading(newest(spark, sf_dir)))
