"""Indicators by symbol and session."""

from pyspark.sql import functions as F

from ..functions.nulls import micro, places
from ..operators import indicators as op
from ..operators.series import by_symbol
from .bar_queries import ADJUSTED_SQL, adjusted_day_bars
from .registry import query

W = "PARTITION BY symbol ORDER BY dt"


def m(column, name):
    return micro(column).alias(name)


@query("sma", f"""WITH {ADJUSTED_SQL} SELECT symbol, dt, {', '.join(f'micro(CASE WHEN count(*) OVER w{n} = {n} THEN avg(c) OVER w{n} END) AS sma{n}' for n in (5, 20, 50))}
FROM bars WINDOW {', '.join(f'w{n} AS ({W} ROWS {n - 1} PRECEDING)' for n in (5, 20, 50))}""")
def sma(spark, sf_dir):
    return adjusted_day_bars(spark, sf_dir).select("symbol", "dt", *(m(op.sma(n), f"sma{n}") for n in (5, 20, 50)))


@query("bollinger", f"""WITH {ADJUSTED_SQL}, b AS (SELECT symbol, dt, CASE WHEN count(*) OVER w = 20 THEN avg(c) OVER w END AS mid, stddev_pop(c) OVER w AS sd FROM bars WINDOW w AS ({W} ROWS 19 PRECEDING))
SELECT symbol, dt, round(mid, 4) AS mid, round(mid + 2 * sd, 4) AS upper, round(mid - 2 * sd, 4) AS lower FROM b""")
def bollinger(spark, sf_dir):
    return adjusted_day_bars(spark, sf_dir).select("symbol", "dt", *(places(x, 4).alias(n) for x, n in zip(op.bollinger(20, 2.0), ("mid", "upper", "lower"), strict=True)))


@query("alma", f"""WITH {ADJUSTED_SQL}, l AS (SELECT symbol, dt, list(c) OVER (PARTITION BY symbol ORDER BY dt ROWS 20 PRECEDING) AS cs FROM bars)
SELECT symbol, dt, CASE WHEN len(cs) = 21 THEN round(list_dot_product(cs, [{', '.join(map(repr, op.alma_weights(21)))}]), 4) END AS alma21 FROM l""")
def alma(spark, sf_dir):
    return adjusted_day_bars(spark, sf_dir).select("symbol", "dt", F.round(op.alma(21), 4).alias("alma21"))


def pivots_sql(left, right):
    n = left + right + 1
    return f"""lists AS (SELECT *, list(h) OVER w AS hs, list(l) OVER w AS ls FROM bars WINDOW w AS ({W} ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)),
piv AS (SELECT * EXCLUDE (hs, ls), CASE WHEN len(hs) = {n} AND h = list_max(hs) AND len(list_filter(hs, lambda x: x = h)) = 1 THEN h END AS ph,
        CASE WHEN len(ls) = {n} AND l = list_min(ls) AND len(list_filter(ls, lambda x: x = l)) = 1 THEN l END AS pl FROM lists)"""


@query("pivots", f"WITH {ADJUSTED_SQL}, {pivots_sql(5, 5)} SELECT symbol, dt, micro(ph) AS ph, micro(pl) AS pl FROM piv")
def pivots(spark, sf_dir):
    return op.pivots(adjusted_day_bars(spark, sf_dir), 5, 5).select("symbol", "dt", m(F.col("ph"), "ph"), m(F.col("pl"), "pl"))


@query("structure_events", f"""WITH {ADJUSTED_SQL}, {pivots_sql(5, 5)},
k AS (SELECT *, lag(c) OVER w AS prev, count(ph) OVER w AS kh, count(pl) OVER w AS kl, last_value(ph IGNORE NULLS) OVER w AS lph, last_value(pl IGNORE NULLS) OVER w AS lpl FROM piv WINDOW w AS ({W})),
u0 AS (SELECT *, coalesce(c > lph AND lph >= prev, false) AS cu FROM k),
u AS (SELECT *, cu AND sum(cu::INT) OVER (PARTITION BY symbol, kh ORDER BY dt) = 1 AS up FROM u0),
d0 AS (SELECT *, coalesce(NOT up AND c < lpl AND lpl <= prev, false) AS cd FROM u),
d AS (SELECT *, cd AND sum(cd::INT) OVER (PARTITION BY symbol, kl ORDER BY dt) = 1 AS down FROM d0),
e AS (SELECT symbol, dt, CASE WHEN up THEN lph ELSE lpl END AS level, CASE WHEN up THEN 'up' ELSE 'down' END AS direction FROM d WHERE up OR down)
SELECT symbol, dt, micro(level) AS level, direction, CASE WHEN coalesce(lag(direction) OVER ({W}) <> direction, false) THEN 'CHoCH' ELSE 'BOS' END AS event FROM e""")
def structure_events(spark, sf_dir):
    e = op.structure_events(adjusted_day_bars(spark, sf_dir), 5, 5)
    return e.withColumn("level", micro(F.col("level")))


def smooth_sql(name, source, n, step):
    """A recursive CTE over source (symbol, i from 1, x): seeded by the mean of n values, then `step` of r.e and s.x."""
    return f"""{name} AS (SELECT symbol, {n} AS i, avg(x) AS e FROM {source} WHERE i <= {n} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT s.symbol, s.i, {step} FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.i = r.i + 1)"""


def ema_sql(name, source, n):
    return smooth_sql(name, source, n, f"r.e + (s.x - r.e) * (2.0::DOUBLE / {n + 1})")


def wilder_sql(name, source, n):
    return smooth_sql(name, source, n, f"r.e + (s.x - r.e) * (1.0::DOUBLE / {n})")


NUMBERED = f"{ADJUSTED_SQL}, num AS MATERIALIZED (SELECT symbol, dt, h, l, c, row_number() OVER w AS i, lag(c) OVER w AS pc, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM bars WINDOW w AS ({W}))"
CLOSES = f"{NUMBERED}, x AS MATERIALIZED (SELECT symbol, i, c AS x FROM num)"


def recursive(spark, sf_dir):
    return op.recursive(adjusted_day_bars(spark, sf_dir))


@query("ema", f"""WITH RECURSIVE {CLOSES}, {ema_sql('e20', 'x', 20)}, {ema_sql('e50', 'x', 50)}
SELECT num.symbol, dt, round(e20.e, 4) AS ema20, round(e50.e, 4) AS ema50 FROM num LEFT JOIN e20 ON e20.symbol = num.symbol AND e20.i = num.i LEFT JOIN e50 ON e50.symbol = num.symbol AND e50.i = num.i""")
def ema(spark, sf_dir):
    return recursive(spark, sf_dir).select("symbol", "dt", F.round("ema20", 4).alias("ema20"), F.round("ema50", 4).alias("ema50"))


@query("macd", f"""WITH RECURSIVE {CLOSES}, {ema_sql('e12', 'x', 12)}, {ema_sql('e26', 'x', 26)}, mx AS MATERIALIZED (SELECT e26.symbol, e26.i - 25 AS i, e12.e - e26.e AS x FROM e12 JOIN e26 ON e12.symbol = e26.symbol AND e12.i = e26.i), {ema_sql('sg', 'mx', 9)}
SELECT num.symbol, dt, round(mx.x, 4) AS macd, round(sg.e, 4) AS signal, round(mx.x - sg.e, 4) AS hist FROM num LEFT JOIN mx ON mx.symbol = num.symbol AND mx.i = num.i - 25 LEFT JOIN sg ON sg.symbol = num.symbol AND sg.i = num.i - 25""")
def macd(spark, sf_dir):
    return recursive(spark, sf_dir).select("symbol", "dt", *(places(F.col(x), 4).alias(x) for x in ("macd", "signal", "hist")))


@query("rsi", f"""WITH RECURSIVE {NUMBERED}, g AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(c - pc, 0) AS x FROM num WHERE i > 1), lo AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(pc - c, 0) AS x FROM num WHERE i > 1), {wilder_sql('ag', 'g', 14)}, {wilder_sql('al', 'lo', 14)}
SELECT num.symbol, dt, CASE WHEN ag.e + al.e > 0 THEN round(100 * ag.e / (ag.e + al.e), 6) END AS rsi14 FROM num LEFT JOIN ag ON ag.symbol = num.symbol AND ag.i = num.i - 1 LEFT JOIN al ON al.symbol = num.symbol AND al.i = num.i - 1""")
def rsi(spark, sf_dir):
    return recursive(spark, sf_dir).select("symbol", "dt", F.round("rsi14", 6).alias("rsi14"))


TR = "tr AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(h - l, abs(h - pc), abs(l - pc)) AS x FROM num WHERE i > 1)"


@query("atr", f"WITH RECURSIVE {NUMBERED}, {TR}, {wilder_sql('a', 'tr', 14)} SELECT num.symbol, dt, round(a.e, 4) AS atr14 FROM num LEFT JOIN a ON a.symbol = num.symbol AND a.i = num.i - 1")
def atr(spark, sf_dir):
    return recursive(spark, sf_dir).select("symbol", "dt", F.round("atr14", 4).alias("atr14"))


@query("adx", f"""WITH RECURSIVE {NUMBERED}, {TR}, pm AS MATERIALIZED (SELECT symbol, i - 1 AS i, CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS x FROM num WHERE i > 1),
mm AS MATERIALIZED (SELECT symbol, i - 1 AS i, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS x FROM num WHERE i > 1), {wilder_sql('wt', 'tr', 14)}, {wilder_sql('wp', 'pm', 14)}, {wilder_sql('wm', 'mm', 14)},
di AS MATERIALIZED (SELECT wt.symbol, wt.i, CASE WHEN wt.e > 0 THEN 100 * wp.e / wt.e ELSE 0 END AS p, CASE WHEN wt.e > 0 THEN 100 * wm.e / wt.e ELSE 0 END AS n FROM wt JOIN wp ON wp.symbol = wt.symbol AND wp.i = wt.i JOIN wm ON wm.symbol = wt.symbol AND wm.i = wt.i),
dx AS MATERIALIZED (SELECT symbol, i - 13 AS i, CASE WHEN p + n > 0 THEN 100 * abs(p - n) / (p + n) ELSE 0 END AS x FROM di), {wilder_sql('ax', 'dx', 14)}
SELECT num.symbol, dt, round(ax.e, 6) AS adx14, round(p, 6) AS plus_di, round(n, 6) AS minus_di FROM num LEFT JOIN di ON di.symbol = num.symbol AND di.i = num.i - 1 LEFT JOIN ax ON ax.symbol = num.symbol AND ax.i = num.i - 14""")
def adx(spark, sf_dir):
    return recursive(spark, sf_dir).select("symbol", "dt", *(F.round(x, 6).alias(x) for x in ("adx14", "plus_di", "minus_di")))


@query("trade_levels", f"""WITH RECURSIVE {NUMBERED}, {TR}, {wilder_sql('a', 'tr', 14)}, z AS (SELECT num.symbol, dt, c, e, CASE WHEN c >= pc THEN 1 ELSE -1 END AS way, CASE WHEN c >= pc THEN pl ELSE ph END AS pv FROM num JOIN a ON a.symbol = num.symbol AND a.i = num.i - 1),
s AS (SELECT *, CASE WHEN (c - pv) * way > 0 THEN pv ELSE c - way * 1.5 * e END AS stop FROM z)
SELECT symbol, dt, CASE way WHEN 1 THEN 'BUY' ELSE 'SELL' END AS side, micro(stop) AS stop, micro(c + way * (c - stop) * way) AS t1, micro(c + 2 * way * (c - stop) * way) AS t2, micro((c - stop) * way / c * 100) AS risk_pct FROM s""")
def trade_levels(spark, sf_dir):
    b = recursive(spark, sf_dir).withColumns({"pc": F.lag("c").over(by_symbol()), "ph": F.lag("h").over(by_symbol()), "pl": F.lag("l").over(by_symbol())})
    b = b.filter("atr14 is not null").withColumn("side", F.when(F.col("c") >= F.col("pc"), "BUY").otherwise("SELL"))
    levels = op.trade_levels(F.col("side"), F.col("c"), F.when(F.col("side") == "BUY", F.col("pl")).otherwise(F.col("ph")), F.col("atr14"))
    return b.select("symbol", "dt", "side", levels.alias("x")).select("symbol", "dt", "side", *(micro(F.col(f"x.{k}")).alias(k) for k in ("stop", "t1", "t2", "risk_pct")))


@query("accumulation_line", f"""WITH {ADJUSTED_SQL}, a AS (SELECT *, sum(CASE WHEN h > l THEN ((c - l) - (h - c)) / (h - l) ELSE 0 END * v) OVER w AS ad, row_number() OVER w AS i, lag(c) OVER w AS pc FROM bars WINDOW w AS ({W}))
SELECT symbol, dt, round(ad, 4) AS ad, CASE WHEN count(*) OVER t = 20 THEN round(coalesce(regr_slope(ad, i) OVER t / nullif(avg(abs(ad)) OVER t, 0), 0), 6) END AS ad_slope,
  CASE WHEN count(*) OVER t = 20 THEN micro(sum(CASE WHEN c > pc THEN v ELSE 0 END) OVER t / nullif(sum(CASE WHEN c < pc THEN v ELSE 0 END) OVER t, 0)) END AS up_down FROM a WINDOW t AS ({W} ROWS 19 PRECEDING)""")
def accumulation_line(spark, sf_dir):
    return op.accumulation_line(adjusted_day_bars(spark, sf_dir)).select("symbol", "dt", F.round("ad", 4).alias("ad"), F.round("ad_slope", 6).alias("ad_slope"), m(F.col("up_down"), "up_down"))


@query("crossovers", f"""WITH {ADJUSTED_SQL}, s AS (SELECT symbol, dt, CASE WHEN count(*) OVER a = 20 THEN avg(c) OVER a END AS f, CASE WHEN count(*) OVER b = 50 THEN avg(c) OVER b END AS s FROM bars WINDOW a AS ({W} ROWS 19 PRECEDING), b AS ({W} ROWS 49 PRECEDING)),
x AS (SELECT symbol, dt, f > s AS above, lag(f > s) OVER ({W}) AS was FROM s) SELECT symbol, dt, CASE WHEN above THEN 'up' ELSE 'down' END AS "cross" FROM x WHERE above <> was""")
def crossovers(spark, sf_dir):
    return op.crossovers(adjusted_day_bars(spark, sf_dir), 20, 50)


@query("breakouts", f"""WITH {ADJUSTED_SQL}, b AS (SELECT symbol, dt, c, v, max(h) OVER p AS top, min(l) OVER p AS bottom, avg(v) OVER p AS mean_v, count(*) OVER p AS n, lead(c) OVER ({W}) AS nxt FROM bars WINDOW p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, CASE WHEN c > top THEN 'up' ELSE 'down' END AS side, v >= 1.5 * mean_v AS surge, CASE WHEN c > top THEN nxt < top ELSE nxt > bottom END AS failed FROM b WHERE n = 20 AND (c > top OR c < bottom)""")
def breakouts(spark, sf_dir):
    return op.breakouts(adjusted_day_bars(spark, sf_dir))
