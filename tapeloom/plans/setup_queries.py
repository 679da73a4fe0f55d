"""Trade setups, replayed triggers and price zones by the full rules."""

from ..operators import setups as op
from .bar_queries import adjusted_day_bars
from .indicator_queries import NUMBERED, TR, W, pivots_sql, wilder_sql
from .registry import query
from .swing_queries import FRAME_SQL, shown

READY_SQL = f"""{FRAME_SQL}, pm2 AS MATERIALIZED (SELECT symbol, i - 1 AS i, CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS x FROM num WHERE i > 1),
mm2 AS MATERIALIZED (SELECT symbol, i - 1 AS i, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS x FROM num WHERE i > 1), {wilder_sql('wp', 'pm2', 14)}, {wilder_sql('wm', 'mm2', 14)},
di AS MATERIALIZED (SELECT wt.symbol, wt.i, CASE WHEN wt.e > 0 THEN 100 * wp.e / wt.e ELSE 0 END AS p, CASE WHEN wt.e > 0 THEN 100 * wm.e / wt.e ELSE 0 END AS n FROM atr_ wt JOIN wp ON wp.symbol = wt.symbol AND wp.i = wt.i JOIN wm ON wm.symbol = wt.symbol AND wm.i = wt.i),
dxx AS MATERIALIZED (SELECT symbol, i - 13 AS i, CASE WHEN p + n > 0 THEN 100 * abs(p - n) / (p + n) ELSE 0 END AS x FROM di), {wilder_sql('ax', 'dxx', 14)},
r0 AS MATERIALIZED (SELECT f.*, macd - signal AS hist, lag(macd - signal) OVER w AS pma, lag(ema50, 5) OVER w AS e50_5, max(h) OVER (PARTITION BY f.symbol ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top20, CASE WHEN count(*) OVER s2 = 200 THEN avg(c) OVER s2 END AS s200, lead(o) OVER w AS entry, ax.e AS adx, di.p AS pdi, di.n AS mdi
  FROM f LEFT JOIN di ON di.symbol = f.symbol AND di.i = f.i LEFT JOIN ax ON ax.symbol = f.symbol AND ax.i = f.i - 13 WINDOW w AS (PARTITION BY f.symbol ORDER BY dt), s2 AS (PARTITION BY f.symbol ORDER BY dt ROWS 199 PRECEDING)),
rd AS MATERIALIZED (SELECT *, coalesce(c > s200 AND round(ema20, 6) > round(ema50, 6) AND round(ema50, 6) > round(s200, 6) AND rsi > 50 AND round(macd, 6) > round(signal, 6), false) AS bull FROM r0)"""


@query("trade_setup", f"""WITH {READY_SQL}, tu AS (SELECT symbol, list_sort(list(c * v))[count(*) // 2 + 1] AS turnover FROM rd WHERE age < 20 GROUP BY symbol), of AS (SELECT symbol, coalesce(min(age) FILTER (age >= 1 AND NOT bull), count(*)) AS off FROM rd GROUP BY symbol),
s AS (SELECT rd.*, turnover, off, (CASE WHEN c > s200 THEN 10 ELSE 0 END + CASE WHEN round(ema50, 6) > round(s200, 6) THEN 10 ELSE 0 END + CASE WHEN round(ema20, 6) > round(ema50, 6) THEN 10 ELSE 0 END + CASE WHEN rsi > 50 THEN 10 ELSE 0 END + CASE WHEN round(macd, 6) > round(signal, 6) THEN 10 ELSE 0 END
  + CASE WHEN round(hist, 6) > round(pma, 6) THEN 5 ELSE 0 END + CASE WHEN adx > 25 THEN 10 ELSE 0 END + CASE WHEN round(pdi, 6) > round(mdi, 6) THEN 10 ELSE 0 END + CASE WHEN v / vsma > 1.5 THEN 10 ELSE 0 END + CASE WHEN v / vsma > 2 THEN 5 ELSE 0 END + CASE WHEN c > top20 THEN 10 ELSE 0 END) AS score FROM rd JOIN tu USING (symbol) JOIN of USING (symbol) WHERE age = 0),
gg AS (SELECT *, CASE WHEN c < s200 AND round(ema50, 6) < round(s200, 6) THEN 'STRONG SELL' WHEN c < ema50 AND round(ema50, 6) < round(e50_5, 6) THEN 'SELL' WHEN turnover < 500000 THEN 'ILLIQUID' WHEN c < s200 OR adx < 20 THEN 'AVOID' WHEN score >= 90 THEN 'STRONG BUY' WHEN score >= 80 THEN 'BUY' WHEN score >= 60 THEN 'WATCH' WHEN rsi < 50 AND round(macd, 6) < round(signal, 6) THEN 'SELL' ELSE 'AVOID' END AS sig FROM s),
l AS (SELECT *, sig IN ('STRONG BUY', 'BUY', 'WATCH') AS long, (SELECT min_by(v, age) FROM lw WHERE lw.symbol = gg.symbol AND v < gg.c) AS pv FROM gg),
t AS (SELECT *, CASE WHEN NOT long THEN c + 1.5 * atr14 WHEN pv IS NOT NULL THEN pv ELSE c - 1.5 * atr14 END AS stop, CASE WHEN bull OR long THEN off - 1 END AS days FROM l),
u AS (SELECT t.*, b.c AS then_c, coalesce(b.atr14, t.atr14) AS then_atr, (SELECT min_by(v, age) FROM lw WHERE lw.symbol = t.symbol AND lw.age >= t.days + 5 AND v < b.c) AS tp FROM t LEFT JOIN rd b ON b.symbol = t.symbol AND b.age = t.days),
v AS (SELECT *, CASE WHEN long AND days > 0 THEN coalesce(tp, then_c - 1.5 * then_atr) END AS y FROM u),
o AS (SELECT v.symbol, max(rd.age) FILTER (rd.h >= then_c + (then_c - y)) AS a1, max(rd.age) FILTER (rd.h >= then_c + 2 * (then_c - y)) AS a2, max(rd.age) FILTER (rd.l <= y) AS as_ FROM v JOIN rd ON rd.symbol = v.symbol AND rd.age < v.days WHERE y IS NOT NULL GROUP BY v.symbol)
SELECT v.symbol, dt, micro(c) AS close, score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'Watch' ELSE 'Avoid' END AS grade, sig AS signal, micro(stop) AS stop, micro(c + (c - stop)) AS target1, micro(c + 2 * (c - stop)) AS target2, micro(abs(c - stop) / c * 100) AS risk_pct, days,
  long AND (days <= 2 OR coalesce((c - then_c) / atr14 <= 2.5, false)) AS still_buy, CASE WHEN y IS NOT NULL THEN CASE WHEN as_ IS NOT NULL AND as_ >= coalesce(a1, -1) THEN 'stopped' WHEN a2 IS NOT NULL AND a2 >= coalesce(as_, -1) THEN 't2' WHEN a1 IS NOT NULL THEN 't1' ELSE 'open' END END AS outcome FROM v LEFT JOIN o ON o.symbol = v.symbol""")
def trade_setup(spark, sf_dir):
    return shown(op.trade_setup(adjusted_day_bars(spark, sf_dir)))


@query("trigger_replay", f"""WITH {READY_SQL}, tr2 AS (SELECT * FROM (SELECT *, lag(bull) OVER ({W}) AS was_bull FROM rd) WHERE bull AND NOT was_bull AND entry > 0 AND atr14 > 0),
k AS (SELECT *, coalesce((SELECT min_by(v, age) FROM lw WHERE lw.symbol = tr2.symbol AND lw.age >= tr2.age + 5 AND v < tr2.entry), entry - 1.5 * atr14) AS stop FROM tr2), q AS (SELECT symbol, dt, i, entry, stop, entry + (entry - stop) AS t1, entry + 2 * (entry - stop) AS t2 FROM k WHERE stop < entry),
p AS (SELECT q.symbol, q.dt, any_value(q.entry) AS entry, any_value(stop) AS stop, any_value(t1) AS t1, any_value(t2) AS t2, coalesce(min(b.i - q.i - 1) FILTER (b.l <= stop), 61) AS s, coalesce(min(b.i - q.i - 1) FILTER (b.h >= t1), 61) AS a, coalesce(min(b.i - q.i - 1) FILTER (b.h >= t2), 61) AS b, max_by(b.c, b.i) AS last, count(*) - 1 AS n FROM q JOIN rd b ON b.symbol = q.symbol AND b.i > q.i AND b.i <= q.i + 60 GROUP BY q.symbol, q.dt),
v AS (SELECT *, least(s, a, b) AS hit, CASE WHEN least(s, a, b) = 61 THEN 'time' WHEN s = least(s, a, b) THEN 'stop' WHEN b = least(s, a, b) THEN 't2' ELSE 't1' END AS verdict FROM p), e AS (SELECT *, CASE verdict WHEN 'stop' THEN stop WHEN 't2' THEN t2 WHEN 't1' THEN t1 ELSE last END AS exit FROM v)
SELECT symbol, dt, micro(entry) AS entry, micro(exit) AS exit, micro(exit / entry - 1 - 0.008) AS ret, CASE WHEN verdict = 'time' THEN n ELSE hit END AS bars, verdict FROM e""")
def trigger_replay(spark, sf_dir):
    return shown(op.trigger_replay(adjusted_day_bars(spark, sf_dir)))


def _fractal(k, a):
    return pivots_sql(k, k).replace("lists AS", f"{a}_lists AS").replace("piv AS", f"{a} AS").replace("FROM lists", f"FROM {a}_lists")


ZONE_SQL = f"""RECURSIVE {NUMBERED}, {TR}, {wilder_sql('atr_', 'tr', 14)}, {_fractal(3, 'fp')}, {_fractal(6, 'sp')},
bz AS MATERIALIZED (SELECT fp.symbol, num.i - 1 AS i, fp.o, fp.h, fp.l, fp.c, atr_.e AS atr, coalesce(fp.ph, sp.ph) AS ph, coalesce(fp.pl, sp.pl) AS pl FROM fp JOIN sp USING (symbol, dt) JOIN num USING (symbol, dt) LEFT JOIN atr_ ON atr_.symbol = num.symbol AND atr_.i = num.i - 1),
z0 AS (SELECT symbol, i, 'supply' AS kind, least(greatest(o, c), h - 0.75 * atr) AS lo, h AS hi, least(greatest(o, c), h - 0.75 * atr) AS entry, h + 2 * atr AS stop FROM bz WHERE atr IS NOT NULL AND ph IS NOT NULL
  UNION ALL SELECT symbol, i, 'demand', l, greatest(least(o, c), l + 0.75 * atr), greatest(least(o, c), l + 0.75 * atr), l - 2 * atr FROM bz WHERE atr IS NOT NULL AND pl IS NOT NULL),
zm AS (SELECT z0.symbol, z0.kind, z0.i AS zi, b.i, b.h >= lo AND b.l <= hi AS hit, CASE WHEN kind = 'supply' THEN b.c > hi ELSE b.c < lo END AS broken FROM z0 JOIN bz b ON b.symbol = z0.symbol AND b.i > z0.i),
zw AS (SELECT *, max(broken) OVER w AS dead, coalesce(max(NOT hit) OVER (PARTITION BY symbol, kind, zi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone, coalesce(lag(hit) OVER w, false) AS was FROM zm WINDOW w AS (PARTITION BY symbol, kind, zi ORDER BY i)),
zs AS (SELECT symbol, kind, zi, max(broken) AS b, count(*) FILTER (NOT dead AND gone AND hit AND NOT was) AS visits FROM zw GROUP BY ALL),
zo AS MATERIALIZED (SELECT z0.*, entry - 3 * (stop - entry) AS target, coalesce(visits, 0)::INT AS visits, CASE WHEN coalesce(b, false) THEN 'turncoat' WHEN coalesce(visits, 0) = 0 THEN 'untested' WHEN visits = 1 THEN 'strong' ELSE 'weak' END AS state FROM z0 LEFT JOIN zs ON zs.symbol = z0.symbol AND zs.kind = z0.kind AND zs.zi = z0.i)"""


@query("price_zones", f"WITH {ZONE_SQL} SELECT symbol, kind, i AS bar, micro(lo) AS lo, micro(hi) AS hi, micro(entry) AS entry, micro(stop) AS stop, micro(target) AS target, visits, state FROM zo")
def price_zones(spark, sf_dir):
    return shown(op.zones(adjusted_day_bars(spark, sf_dir)))


@query("nearest_zone", f"""WITH {ZONE_SQL}, n AS (SELECT symbol, h AS nh, l AS nl, c AS nc, i AS last FROM bz QUALIFY i = max(i) OVER (PARTITION BY symbol)),
k AS (SELECT zo.*, nh, nl, nc, last, row_number() OVER (PARTITION BY symbol ORDER BY state = 'weak', round(abs(entry - nc), 6), i, kind) AS k FROM zo JOIN n USING (symbol) WHERE state <> 'turncoat' AND target > 0)
SELECT symbol, kind, state, visits, last - i AS age, micro(entry) AS entry, micro(stop) AS stop, micro(target) AS target, CASE WHEN kind = 'demand' AND nl <= entry THEN 'BUY' WHEN kind = 'supply' AND nh >= entry THEN 'SELL' ELSE 'WATCH' END AS signal, nc BETWEEN lo AND hi AS in_zone, micro(100 * (entry - nc) / nc) AS dist_pct, micro(100 * abs(entry - stop) / entry) AS risk_pct FROM k WHERE k = 1""")
def nearest_zone(spark, sf_dir):
    return shown(op.nearest_zone(adjusted_day_bars(spark, sf_dir)))
