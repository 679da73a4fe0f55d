"""Flow through time, regimes and the market as a whole."""

from pyspark.sql import functions as F

from ..operators import flow as fl
from ..operators import regimes as op
from ..sources.tape import FLOW_SQL, INSTRUMENTS_SQL, TAPE_SQL, bars, broker_flow, instruments, tape
from .flow_queries import WINDOWED_SQL
from .registry import query

SERIES_SQL = f"""{FLOW_SQL},
bars AS (SELECT symbol, dt, max_by(rate, row(ok, ln, pk, sk, qty, amt)) AS c, sum(qty)::BIGINT AS v, sum(amt) AS amount FROM tape GROUP BY symbol, dt),
fs AS (SELECT symbol, dt, sum(bought)::BIGINT AS volume, (max(net) + min(net)) / sum(bought) AS tilt, sum(greatest(net, 0)) / sum(bought) AS churn, count(*) FILTER (net > 0) / count(*) AS breadth FROM flow GROUP BY ALL),
ser AS MATERIALIZED (SELECT fs.*, c, amount, c / lag(c) OVER w - 1 AS ret, row_number() OVER w AS i FROM fs JOIN bars USING (symbol, dt) WINDOW w AS (PARTITION BY symbol ORDER BY dt))"""


def series(spark, sf_dir):
    t = tape(spark, sf_dir)
    return op.stock_series(broker_flow(t), bars(t))


def pit_sql(name, source, x, extra="*"):
    return f"""{name} AS (SELECT * EXCLUDE (n_, m_, s_), CASE WHEN n_ >= 20 THEN CASE WHEN s_ < 1e-12 THEN 0 ELSE ({x} - m_) / s_ END END AS z_{x} FROM (
  SELECT {extra}, count({x}) OVER w AS n_, avg({x}) OVER w AS m_, stddev_pop({x}) OVER w AS s_ FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)))"""


@query("flow_persistence", f"""WITH {SERIES_SQL}, s AS (SELECT *, CASE WHEN tilt > 0.001 THEN 1 WHEN tilt < -0.001 THEN -1 ELSE 0 END AS side FROM ser), c AS (SELECT *, CASE WHEN side IS NOT DISTINCT FROM lag(side) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY dt) AS run FROM c), l AS (SELECT symbol, run, side, count(*) AS n FROM r GROUP BY ALL), lr AS (SELECT symbol, count(*) AS runs, coalesce(max(n) FILTER (side = 1), 0) AS longest_buy, coalesce(max(n) FILTER (side = -1), 0) AS longest_sell FROM l GROUP BY symbol),
f AS (SELECT symbol, count(*) FILTER (side <> was) AS flips FROM (SELECT symbol, side, lag(side) OVER (PARTITION BY symbol ORDER BY dt) AS was FROM s WHERE side <> 0) GROUP BY symbol),
a AS (SELECT symbol, count(*) AS n, avg(tilt) AS mean, avg(abs(tilt)) AS size, stddev_pop(tilt) AS sd, count(*) FILTER (side = 1) AS up, count(*) FILTER (side = -1) AS down FROM s GROUP BY symbol)
SELECT symbol, runs, longest_buy, longest_sell, coalesce(flips, 0) AS flips, round(CASE WHEN mean > 0 THEN up ELSE down END / n, 6) AS consistency, round(1 / (1 + sd / size), 6) AS stability FROM a JOIN lr USING (symbol) LEFT JOIN f USING (symbol)""")
def flow_persistence(spark, sf_dir):
    return op.persistence(series(spark, sf_dir))


@query("accumulation_side", f"""WITH {FLOW_SQL}, s AS (SELECT symbol, broker, dt, net, sign(net) AS side, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, broker) AS n FROM flow WINDOW w AS (PARTITION BY symbol, broker ORDER BY dt)),
c AS (SELECT *, CASE WHEN side IS NOT DISTINCT FROM lag(side) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY symbol, broker ORDER BY dt)), r AS (SELECT *, sum(new) OVER (PARTITION BY symbol, broker ORDER BY dt) AS run FROM c),
k AS (SELECT symbol, broker, run, side, count(*) AS len, max(i) AS e, max(n) AS n FROM r GROUP BY ALL), st AS (SELECT symbol, broker, coalesce(max(len) FILTER (side = 1), 0) AS max_streak, coalesce(max(len) FILTER (e = n AND side = 1), 0) AS streak FROM k GROUP BY ALL)
SELECT symbol, broker, count(*) AS days, count(*) FILTER (side = 1) AS buy_days, sum(greatest(net, 0))::BIGINT AS bought_net, max(greatest(net, 0)) AS peak, coalesce(sum(net) FILTER (i * 2 > n), 0)::BIGINT AS late_net, coalesce(sum(net) FILTER (i * 2 <= n), 0)::BIGINT AS early_net, any_value(max_streak) AS max_streak, any_value(streak) AS streak
FROM r JOIN st USING (symbol, broker) GROUP BY symbol, broker""")
def accumulation_side(spark, sf_dir):
    return op.side_description(broker_flow(tape(spark, sf_dir)))


@query("acceleration_phase", f"""WITH {SERIES_SQL}, m AS (SELECT symbol, dt, i, {', '.join(f'avg(tilt) OVER w{n} AS m{n}' for n in (3, 7, 15, 30))} FROM ser WINDOW {', '.join(f'w{n} AS (PARTITION BY symbol ORDER BY dt ROWS {n - 1} PRECEDING)' for n in (3, 7, 15, 30))})
SELECT symbol, dt, {', '.join(f'round(m{n}, 6) AS m{n}' for n in (3, 7, 15, 30))}, CASE WHEN abs(m30) <= 0.001 THEN 'flat' WHEN m3 / m30 <= 0.25 THEN 'exhausted' WHEN m3 / m30 < 0.75 THEN 'weakening' WHEN m3 / m30 <= 1.25 THEN 'persistent' ELSE 'accelerating' END AS phase,
  CASE WHEN sign(m3) <> sign(m7) THEN 7 WHEN sign(m3) <> sign(m15) THEN 15 WHEN sign(m3) <> sign(m30) THEN 30 END AS first_flip, CASE WHEN abs(m3 - m30) > 0.25 * greatest(abs(m3), abs(m30)) THEN 'moving' ELSE 'stable' END AS pattern FROM m WHERE i >= 30""")
def acceleration_phase(spark, sf_dir):
    return op.accelerations(series(spark, sf_dir))


@query("flow_shape", f"""WITH {FLOW_SQL}, n AS (SELECT symbol, dt, (max(net) + min(net))::BIGINT AS x FROM flow GROUP BY ALL), c AS (SELECT symbol, dt, sum(x) OVER (PARTITION BY symbol ORDER BY dt)::BIGINT AS cum FROM n), p AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol ORDER BY dt), 0) AS peak FROM c), f AS (SELECT *, peak - cum AS fall FROM p)
SELECT symbol, max(peak) AS peak, max(fall) AS drawdown, min_by(dt, row(-fall, dt)) AS trough, max_by(cum, dt) AS final, max_by(fall, dt) AS below_peak, round(coalesce((max(fall) - max_by(fall, dt)) / nullif(max(fall), 0), 0), 6) AS recovered FROM f GROUP BY symbol""")
def flow_shape(spark, sf_dir):
    s = broker_flow(tape(spark, sf_dir)).groupBy("symbol", "dt").agg((F.max("net") + F.min("net")).alias("net_flow"))
    return op.flow_shape(s)


@query("divergences", f"""WITH {SERIES_SQL}, s AS (SELECT symbol, dt, round(regr_slope(c, i) OVER w, 9) AS price, round(regr_slope(tilt, i) OVER w, 9) AS lean, round(avg(tilt) OVER w, 9) AS level, count(*) OVER w AS k FROM ser WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS 6 PRECEDING)),
d AS (SELECT *, CASE WHEN price > 0 AND lean < 0 AND level < 0 THEN 'distribution into strength' WHEN price < 0 AND lean > 0 AND level > 0 THEN 'accumulation into weakness' WHEN price > 0 AND lean < 0 THEN 'bearish' WHEN price < 0 AND lean > 0 THEN 'bullish' END AS kind FROM s WHERE k = 7)
SELECT symbol, dt, kind, micro(price) AS price_slope, micro(lean) AS flow_slope FROM d WHERE kind IS NOT NULL""")
def divergences(spark, sf_dir):
    return op.divergences(series(spark, sf_dir))


@query("lag_scan", f"""WITH {SERIES_SQL} SELECT a.symbol, lag, count(*) AS n, round(corr(a.tilt, b.ret), 6) AS corr FROM ser a, (SELECT unnest(range(0, 11))::INT AS lag) JOIN ser b ON b.symbol = a.symbol AND b.i = a.i + lag WHERE b.ret IS NOT NULL GROUP BY ALL""")
def lag_scan(spark, sf_dir):
    return op.lag_scan(series(spark, sf_dir))


def _pit(x):
    """z of a rolling mean against up to 250 earlier ones, null with fewer than 60."""
    return f"CASE WHEN count({x}) OVER p >= 60 THEN round(CASE WHEN stddev_pop({x}) OVER p < 1e-12 THEN 0 ELSE ({x} - avg({x}) OVER p) / stddev_pop({x}) OVER p END, 6) END AS z_{x}"


MEASURES = ("tilt", "volume", "concentration", "brokers", "size")
REGIME_SQL = f"""{FLOW_SQL}, me AS (SELECT symbol, dt, (max(net) + min(net)) / sum(bought) AS tilt, (max(net) - min(net)) / sum(bought) AS concentration, sum(bought)::DOUBLE AS volume, count(*)::DOUBLE AS brokers, 2 * sum(bought) / sum(trades) AS size FROM flow GROUP BY ALL),
ro AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i, {', '.join(f'avg({x}) OVER w AS {x}' for x in MEASURES)} FROM me WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS 6 PRECEDING)),
zs AS (SELECT *, lag(tilt, 7) OVER (PARTITION BY symbol ORDER BY dt) AS was, {', '.join(map(_pit, MEASURES))} FROM ro WINDOW p AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
reg AS (SELECT symbol, dt, CASE WHEN z_tilt >= 0.5 THEN 'accumulation' WHEN z_tilt <= -0.5 THEN 'distribution' ELSE 'neutral' END AS regime,
  concat_ws(',', CASE WHEN z_volume >= 1 THEN 'high volume' WHEN z_volume <= -1 THEN 'low volume' END, CASE WHEN z_concentration >= 1 THEN 'high concentration' END, CASE WHEN z_brokers >= 1 THEN 'broad participation' END, CASE WHEN z_size >= 1 THEN 'high trade size' WHEN z_size <= -1 THEN 'low trade size' END,
    CASE WHEN was * tilt < 0 THEN 'flow reversal' WHEN abs(tilt) > 1.5 * abs(was) AND abs(was) > 1e-9 THEN 'flow acceleration' WHEN abs(tilt) < 0.5 * abs(was) THEN 'flow deterioration' END) AS tags, round(tilt, 6) AS tilt, z_tilt, coalesce(z_volume, 0) AS z_volume FROM zs WHERE i >= 7 AND z_tilt IS NOT NULL)"""


def labelled_sessions(spark, sf_dir):
    return op.regimes(op.session_measures(broker_flow(tape(spark, sf_dir))))


@query("regimes", f"WITH {REGIME_SQL} SELECT * FROM reg")
def regimes(spark, sf_dir):
    return labelled_sessions(spark, sf_dir)


@query("regime_transitions", f"""WITH {REGIME_SQL}, c AS (SELECT *, CASE WHEN regime IS NOT DISTINCT FROM lag(regime) OVER w THEN 0 ELSE 1 END AS new FROM reg WINDOW w AS (PARTITION BY symbol ORDER BY dt)), r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY dt) AS run FROM c),
l AS (SELECT symbol, run, regime AS "from", count(*) AS n FROM r GROUP BY ALL), d AS (SELECT symbol, "from", count(*) AS runs, round(avg(n), 6) AS mean_length, median(n) AS median_length FROM l GROUP BY ALL),
t AS (SELECT symbol, "from", lead("from") OVER (PARTITION BY symbol ORDER BY run) AS "to" FROM l), g AS (SELECT symbol, "from", "to", count(*) AS times FROM t WHERE "to" IS NOT NULL GROUP BY ALL)
SELECT g.*, round(times / sum(times) OVER (PARTITION BY g.symbol, g."from"), 6) AS probability, runs, mean_length, median_length FROM g JOIN d USING (symbol, "from")""")
def regime_transitions(spark, sf_dir):
    return op.transitions(labelled_sessions(spark, sf_dir), "regime")


@query("absorption_proxy", f"""WITH {SERIES_SQL}, s0 AS (SELECT *, abs(ret) AS move FROM ser), {pit_sql('s1', 's0', 'volume')}, {pit_sql('s2', 's1', 'churn')}, {pit_sql('s3', 's2', 'move')},
k AS (SELECT symbol, dt, round(100 * (greatest(0, least(1, z_volume / 2)) + greatest(0, least(1, -z_churn / 2)) + greatest(0, least(1, -z_move / 2))) / 3, 6) AS score FROM s3 WHERE z_volume IS NOT NULL AND z_churn IS NOT NULL AND z_move IS NOT NULL)
SELECT symbol, dt, score, count(*) FILTER (score >= 30) OVER (PARTITION BY symbol ORDER BY dt ROWS 4 PRECEDING) AS recent FROM k""")
def absorption_proxy(spark, sf_dir):
    return op.absorption(series(spark, sf_dir))


@query("market_flow", f"""WITH {SERIES_SQL}, {INSTRUMENTS_SQL}, s AS (SELECT ser.*, sector, CASE WHEN tilt > 0.01 THEN 1 ELSE 0 END AS up FROM ser JOIN instruments USING (symbol) WHERE dt = (SELECT max(dt) FROM ser))
SELECT sector, count(*) AS symbols, sum(volume)::BIGINT AS volume, round(sum(amount), 2) AS turnover, micro(round(sum(tilt * volume)) / sum(volume)) AS tilt, round(avg(up), 6) AS breadth, round(sum(up * volume) / sum(volume), 6) AS volume_breadth FROM s GROUP BY CUBE (sector)""")
def market_flow(spark, sf_dir):
    return op.market_flow(series(spark, sf_dir), instruments(spark, sf_dir))


@query("heatmap", f"""WITH {SERIES_SQL}, {INSTRUMENTS_SQL}, r AS (SELECT bars.*, lag(c) OVER (PARTITION BY symbol ORDER BY dt) AS prev, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM bars),
n AS (SELECT r.symbol, sector, micro(100 * (c - prev) / prev) AS pct, round(amount, 2) AS turnover FROM r JOIN instruments USING (symbol) WHERE age = 1)
SELECT sector, count(*) AS symbols, round(sum(turnover), 2) AS turnover, round(sum(pct * turnover) / sum(turnover), 4) AS pct, count(*) FILTER (pct > 0) AS up, max_by(symbol, row(pct, symbol)) AS best FROM n GROUP BY sector""")
def heatmap(spark, sf_dir):
    return op.heatmap(bars(tape(spark, sf_dir)), instruments(spark, sf_dir))


@query("timeframe_alignment", f"""WITH {WINDOWED_SQL}, t AS (SELECT symbol, w, 4 * (max(net) + min(net)) / sum(bought) AS tilt FROM win GROUP BY ALL),
p AS (SELECT symbol, {', '.join(f'max(tilt) FILTER (w = {w}) AS t{w}' for w in (3, 7, 15, 30))} FROM t GROUP BY symbol), v AS (SELECT *, {', '.join(f'CASE WHEN t{w} > 0.1 THEN 1 WHEN t{w} < -0.1 THEN -1 ELSE 0 END AS vote{w}' for w in (3, 7, 15, 30))} FROM p),
s AS (SELECT *, round(100 * abs(0.35 * vote3 + 0.30 * vote7 + 0.20 * vote15 + 0.15 * vote30)::DOUBLE, 6) AS alignment, {' + '.join(f'(vote{a} * vote{b} = -1)::INT' for a, b in ((3, 7), (3, 15), (3, 30), (7, 15), (7, 30), (15, 30)))} AS opposed FROM v)
SELECT symbol, vote3, vote7, vote15, vote30, alignment, CASE WHEN alignment >= 70 THEN 'strong' WHEN alignment >= 40 THEN 'moderate' ELSE 'weak' END AS label, round(100 * (0.5::DOUBLE * opposed / 6 + 0.5::DOUBLE * least(1, abs(t3 - t30) / 2)), 6) AS conflict FROM s""")
def timeframe_alignment(spark, sf_dir):
    w = fl.windowed(broker_flow(tape(spark, sf_dir)))
    t = w.groupBy("symbol", "w").agg((4 * (F.max("net") + F.min("net")) / F.sum("bought")).alias("tilt"))
    return op.alignment(t)
