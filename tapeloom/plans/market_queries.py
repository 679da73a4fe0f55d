"""Price against flow, execution, gates over the universe, and what followed a session."""

from pyspark.sql import functions as F

from ..functions.nulls import micro
from ..operators import market as op
from ..operators.study import labelled
from ..sources.tape import BARS_SQL, FLOW_SQL, TAPE_SQL, bars, broker_flow, tape
from .bar_queries import ADJUSTED_SQL, adjusted_day_bars
from .regime_queries import SERIES_SQL, series
from .registry import query
from .study_queries import LABELLED_SQL

W = "PARTITION BY symbol ORDER BY dt"
CHANGED_SQL = f"""{SERIES_SQL}, va AS (SELECT symbol, dt, amount / volume AS vwap FROM ser),
ch AS MATERIALIZED (SELECT ser.*, vwap, lag(volume) OVER w AS pv, lag(amount) OVER w AS pa, lag(vwap) OVER w AS pp, CASE WHEN abs(ln(vwap / lag(vwap) OVER w)) > 0.2 THEN 0 ELSE ln(vwap / lag(vwap) OVER w) END AS vret, row_number() OVER (PARTITION BY ser.symbol ORDER BY ser.dt DESC) AS age FROM ser JOIN va USING (symbol, dt) WINDOW w AS (PARTITION BY ser.symbol ORDER BY ser.dt))"""
DAYS_SQL = "days AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM (SELECT DISTINCT symbol, dt FROM tape))"


def changed(spark, sf_dir):
    return op.changes(series(spark, sf_dir), bars(tape(spark, sf_dir)))


def shown(df):
    """Floating-point columns to 6 places."""
    return df.select(*(micro(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def pearson_sql(x, y):
    return f"micro(coalesce(covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0), 0))"


@query("flow_correlations", f"""WITH {CHANGED_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS have FROM ch WHERE age <= 30), x AS (SELECT *, ln(volume / pv) AS dv, ln(amount / pa) AS da FROM w WHERE have >= 8 AND age < have),
a AS (SELECT symbol, count(*) AS n, {pearson_sql('tilt', 'vret')} AS price_flow, {pearson_sql('dv', 'vret')} AS volume_price, {pearson_sql('da', 'vret')} AS turnover_price, micro(coalesce(covar_pop(tilt, vret) / nullif(var_pop(tilt), 0), 0)) AS sensitivity FROM x GROUP BY symbol)
SELECT *, CASE WHEN price_flow > 0.3 THEN 'convergent' WHEN price_flow < -0.3 THEN 'divergent' ELSE 'unclear' END AS regime FROM a""")
def flow_correlations(spark, sf_dir):
    return shown(op.correlations(changed(spark, sf_dir)))


@query("price_elasticity", f"""WITH {CHANGED_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS have FROM ch WHERE age <= 30), x AS (SELECT symbol, dt, (vwap / pp - 1) / (volume::DOUBLE / pv - 1) AS x FROM w WHERE have >= 5 AND age < have AND abs(volume::DOUBLE / pv - 1) >= 0.05 AND abs(vwap / pp - 1) <= 0.2),
a AS (SELECT symbol, count(*) AS n, avg(x) AS mean, median(x) AS median, max_by(x, dt) AS last FROM x GROUP BY symbol)
SELECT symbol, n, micro(mean) AS mean, micro(median) AS median, micro(last) AS last, 'volume expansion + ' || CASE WHEN abs(median) < 0.05 THEN 'weak price response' WHEN median > 0 THEN 'price following' ELSE 'price fading' END AS label FROM a""")
def price_elasticity(spark, sf_dir):
    return shown(op.elasticity(changed(spark, sf_dir)))


@query("flow_efficiency", f"""WITH {CHANGED_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS have FROM ch WHERE age <= 7), a AS (SELECT symbol, 100 * sum(CASE WHEN age < have THEN vret ELSE 0 END) AS r, sum(tilt) AS f FROM w WHERE have >= 3 GROUP BY symbol)
SELECT symbol, micro(r) AS ret_pct, micro(f) AS flow_units, micro(r / f) AS efficiency, CASE WHEN (f > 0 AND r > 0) OR (f <= 0 AND r < 0) THEN 'efficient ' ELSE 'inefficient ' END || CASE WHEN f > 0 THEN 'buying' ELSE 'selling' END AS label FROM a WHERE abs(f) >= 0.05""")
def flow_efficiency(spark, sf_dir):
    return shown(op.flow_efficiency(changed(spark, sf_dir)))


def pct_sql(x):
    return f"CASE WHEN len(l_{x}) >= 60 THEN 100.0 * (len(list_filter(l_{x}, lambda y: y < {x})) + 0.5 * len(list_filter(l_{x}, lambda y: y = {x}))) / len(l_{x}) END AS p_{x}"


@query("executed_liquidity", f"""WITH {TAPE_SQL}, d AS (SELECT symbol, dt, round(sum(amt), 2) AS turnover, count(*)::DOUBLE AS trades, median(qty) AS median_trade, round(coalesce(sqrt(greatest(sum(rate * rate * qty) / sum(qty) - (sum(rate * qty) / sum(qty)) ** 2, 0)) / nullif(sum(rate * qty) / sum(qty), 0), 0), 9) AS dispersion FROM tape GROUP BY ALL),
l AS (SELECT *, {', '.join(f'list({x}) OVER w AS l_{x}' for x in ('turnover', 'trades', 'median_trade', 'dispersion'))} FROM d WINDOW w AS ({W} ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)), p AS (SELECT *, {', '.join(map(pct_sql, ('turnover', 'trades', 'median_trade', 'dispersion')))} FROM l)
SELECT symbol, dt, micro(turnover) AS turnover, trades, median_trade, micro(dispersion) AS dispersion, micro(greatest(0, least(100, (p_turnover + p_trades + p_median_trade) / 3 - 0.5 * (p_dispersion - 50)))) AS score FROM p WHERE p_turnover IS NOT NULL""")
def executed_liquidity(spark, sf_dir):
    d = op.session_liquidity(tape(spark, sf_dir)).withColumns({"turnover": F.round("turnover", 2), "dispersion": F.round("dispersion", 9)})
    return shown(op.executed_liquidity(d).filter("score is not null").select("symbol", "dt", "turnover", "trades", "median_trade", "dispersion", "score"))


@query("price_asymmetry", f"""WITH {TAPE_SQL}, {DAYS_SQL}, t AS (SELECT tape.* FROM tape JOIN days USING (symbol, dt) WHERE age = 1), legs AS (SELECT symbol, dt, buyer AS broker, 'buy' AS side, qty, rate, amt FROM t UNION ALL SELECT symbol, dt, seller, 'sell', qty, rate, amt FROM t),
c AS (SELECT *, sum(qty) OVER (PARTITION BY symbol, broker, side ORDER BY rate) AS upto, sum(qty) OVER (PARTITION BY symbol, broker, side) AS whole FROM legs), m AS (SELECT symbol, sum(amt) / sum(qty) AS vwap FROM t GROUP BY symbol),
a AS (SELECT symbol, dt, broker, {', '.join(f"coalesce(sum(qty) FILTER (side = '{s}'), 0)::BIGINT AS {s}_qty, sum(amt) FILTER (side = '{s}') AS {s}_amt, min(rate) FILTER (side = '{s}' AND 2 * upto >= whole) AS {s}_median, min(rate) FILTER (side = '{s}') AS {s}_low, max(rate) FILTER (side = '{s}') AS {s}_high" for s in ('buy', 'sell'))} FROM c GROUP BY ALL)
SELECT symbol, dt, broker, buy_qty, sell_qty, micro(buy_amt / buy_qty) AS buy_vwap, micro(sell_amt / sell_qty) AS sell_vwap, {', '.join(f'micro({s}_{x}) AS {s}_{x}' for s in ('buy', 'sell') for x in ('median', 'low', 'high'))}, micro((sell_amt / sell_qty - buy_amt / buy_qty) / vwap) AS spread,
  micro(buy_qty::DOUBLE / nullif(sell_qty, 0)) AS qty_ratio, micro(CASE WHEN sell_qty > 0 THEN coalesce(buy_amt, 0) / sell_amt END) AS turnover_ratio FROM a JOIN m USING (symbol)""")
def price_asymmetry(spark, sf_dir):
    return shown(op.price_asymmetry(tape(spark, sf_dir)))


@query("price_quality", f"""WITH {TAPE_SQL}, {DAYS_SQL}, t AS (SELECT tape.*, sum(amt) OVER (PARTITION BY symbol, dt) / sum(qty) OVER (PARTITION BY symbol, dt) AS vwap FROM tape JOIN days USING (symbol, dt) WHERE age <= 15),
p AS (SELECT *, CASE WHEN rate < vwap * 0.9975 THEN 'below' WHEN rate <= vwap * 1.0025 THEN 'near' ELSE 'above' END AS place FROM t), legs AS (SELECT symbol, buyer AS broker, 'buy_' || place AS k, qty FROM p UNION ALL SELECT symbol, seller, 'sell_' || place, qty FROM p),
a AS (SELECT symbol, broker, {', '.join(f"coalesce(sum(qty) FILTER (k = '{s}_{x}'), 0)::BIGINT AS {s}_{x}" for s in ('buy', 'sell') for x in ('below', 'near', 'above'))} FROM legs GROUP BY ALL)
SELECT *, micro((buy_below - buy_above + sell_above - sell_below)::DOUBLE / (buy_below + buy_near + buy_above + sell_below + sell_near + sell_above)) AS quality FROM a""")
def price_quality(spark, sf_dir):
    return shown(op.price_quality(tape(spark, sf_dir)))


@query("stock_rotation", f"""WITH {FLOW_SQL}, {DAYS_SQL}, b AS (SELECT broker, symbol, coalesce(sum(bought + sold) FILTER (age <= 3), 0)::BIGINT AS g0, sum(bought + sold)::BIGINT AS g1 FROM flow JOIN days USING (symbol, dt) WHERE age <= 30 GROUP BY ALL),
s AS (SELECT *, coalesce(g0::DOUBLE / nullif(sum(g0) OVER w, 0), 0) AS s0, g1::DOUBLE / sum(g1) OVER w AS s1, row_number() OVER (PARTITION BY broker ORDER BY g0 DESC, symbol) AS r0, row_number() OVER (PARTITION BY broker ORDER BY g1 DESC, symbol) AS r1 FROM b WINDOW w AS (PARTITION BY broker)),
a AS (SELECT broker, max(symbol) FILTER (r0 = 1 AND g0 > 0) AS focus_short, max(symbol) FILTER (r1 = 1 AND g1 > 0) AS focus_long, micro(max(s0)) AS share_short, micro(max(s1)) AS share_long, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (r0 <= 5 AND g0 > 0 AND r1 > 5), '') AS new_focus,
  coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (r1 <= 5 AND NOT (r0 <= 5 AND g0 > 0)), '') AS abandoned, count(*) FILTER (s0 > s1) AS increasing, count(*) FILTER (s1 > s0) AS decreasing FROM s GROUP BY broker)
SELECT *, coalesce(focus_short <> focus_long, false) AS rotated FROM a""")
def stock_rotation(spark, sf_dir):
    return shown(op.stock_rotation(broker_flow(tape(spark, sf_dir))))


PRICED_SQL = f"""{TAPE_SQL}, {DAYS_SQL}, t0 AS (SELECT tape.* FROM tape JOIN days USING (symbol, dt) WHERE age <= 120), sd AS (SELECT symbol, broker, sign(sum(x)) AS side FROM (SELECT symbol, buyer AS broker, qty AS x FROM t0 UNION ALL SELECT symbol, seller, -qty FROM t0) GROUP BY ALL),
t AS (SELECT t0.*, b.side AS bs, s.side AS ss, floor(rate * 100 + 0.5) / 100 AS price FROM t0 JOIN sd b ON b.symbol = t0.symbol AND b.broker = buyer JOIN sd s ON s.symbol = t0.symbol AND s.broker = seller),
bp AS (SELECT symbol, price, sum(qty)::BIGINT AS volume, (coalesce(sum(qty) FILTER (bs > 0), 0) - coalesce(sum(qty) FILTER (ss > 0), 0))::BIGINT AS net, coalesce(sum(qty) FILTER (bs > 0), 0)::BIGINT AS demand, coalesce(sum(qty) FILTER (ss < 0), 0)::BIGINT AS supply FROM t GROUP BY ALL)"""


@query("flow_by_price", f"WITH {PRICED_SQL} SELECT symbol, micro(price) AS price, volume, greatest(net, 0) AS absorbed, micro(net::DOUBLE / volume) AS tilt, micro(demand::DOUBLE / volume) AS demand, micro(supply::DOUBLE / volume) AS supply FROM bp")
def flow_by_price(spark, sf_dir):
    return shown(op.price_levels(op.flow_by_price(tape(spark, sf_dir))[1]))


@query("price_bands", f"""WITH {PRICED_SQL}, e AS (SELECT symbol, min(price) AS lo, max(price) AS hi, sum(volume) AS total, (max(price) - min(price)) / 8 AS width FROM bp GROUP BY symbol),
v AS (SELECT symbol, lo, hi, width, total, CASE WHEN width > 0 THEN least(floor((price - lo) / width), 7) ELSE 0 END::INT AS band, sum(volume)::BIGINT AS volume, sum(net) AS net, sum(demand) AS demand, sum(supply) AS supply FROM bp JOIN e USING (symbol) GROUP BY ALL),
lg AS (SELECT t.symbol, CASE WHEN width > 0 THEN least(floor((price - lo) / width), 7) ELSE 0 END::INT AS band, unnest([buyer, seller]) AS broker, unnest([qty, -qty]) AS x FROM t JOIN e ON e.symbol = t.symbol), nt AS (SELECT symbol, band, sum(greatest(x, 0)) AS kept, count(*) AS brokers FROM (SELECT symbol, band, broker, sum(x) AS x FROM lg GROUP BY ALL) GROUP BY ALL)
SELECT symbol, band, micro(lo + width * band) AS low, micro(CASE WHEN width > 0 THEN lo + width * band + width ELSE hi END) AS high, volume, micro(volume::DOUBLE / total) AS volume_share, micro(net::DOUBLE / volume) AS tilt, micro(demand::DOUBLE / volume) AS demand, micro(supply::DOUBLE / volume) AS supply, micro(kept::DOUBLE / volume) AS churn, brokers FROM v JOIN nt USING (symbol, band)""")
def price_bands(spark, sf_dir):
    return shown(op.price_bands(*op.flow_by_price(tape(spark, sf_dir))))


@query("broker_breadth", f"""WITH {TAPE_SQL}, {DAYS_SQL}, d AS (SELECT symbol, dt, count(DISTINCT broker) AS n FROM (SELECT symbol, dt, unnest([buyer, seller]) AS broker FROM tape JOIN days USING (symbol, dt) WHERE age <= 20) GROUP BY ALL) SELECT symbol, median(n) AS median_brokers, median(n) >= 10 AS passes FROM d GROUP BY symbol""")
def broker_breadth(spark, sf_dir):
    return op.broker_breadth(tape(spark, sf_dir))


@query("current_only", f"WITH {TAPE_SQL}, l AS (SELECT symbol, max(dt) AS last FROM tape GROUP BY symbol) SELECT symbol, last FROM l QUALIFY dense_rank() OVER (ORDER BY last DESC) <= 6")
def current_only(spark, sf_dir):
    return op.current_only(tape(spark, sf_dir).select("symbol", "dt")).select("symbol", "last")


@query("universe_sample", f"""WITH {TAPE_SQL}, s AS (SELECT symbol, count(*) AS size, count(DISTINCT dt) AS sessions FROM tape GROUP BY symbol), r AS (SELECT symbol, size, row_number() OVER (ORDER BY size DESC, symbol) - 1 AS rank, count(*) OVER () AS n FROM s WHERE sessions >= 20)
SELECT symbol, size, rank FROM r WHERE n <= 10 OR rank IN (SELECT i * (SELECT max(n) FROM r) // 10 FROM range(10) t(i))""")
def universe_sample(spark, sf_dir):
    sizes = tape(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("size"), F.count_distinct("dt").alias("sessions"))
    return op.stratified_sample(sizes, 10, 20)


@query("split_trim", f"""WITH {BARS_SQL}, {DAYS_SQL}, b AS (SELECT symbol, dt, age, amount / v AS vwap FROM bars JOIN days USING (symbol, dt) WHERE age <= 120), g AS (SELECT *, vwap / lag(vwap) OVER ({W}) - 1 AS gap FROM b)
SELECT symbol, coalesce(max(dt) FILTER (abs(gap) > 0.2), min(dt)) AS from_dt, coalesce(min(age) FILTER (abs(gap) > 0.2), count(*)) AS sessions, micro(max_by(gap, dt) FILTER (abs(gap) > 0.2)) AS gap FROM g GROUP BY symbol""")
def split_trim(spark, sf_dir):
    return shown(op.split_trim(bars(tape(spark, sf_dir))))


@query("market_calendar", f"WITH {TAPE_SQL}, {DAYS_SQL} SELECT DISTINCT dt FROM days WHERE age <= 400 AND symbol IN (SELECT DISTINCT symbol FROM tape ORDER BY symbol LIMIT 60)")
def market_calendar(spark, sf_dir):
    return op.market_calendar(bars(tape(spark, sf_dir)))


OUTCOME_SQL = f"""{ADJUSTED_SQL}, num AS MATERIALIZED (SELECT *, row_number() OVER w AS i, lead(o) OVER w AS entry FROM bars WINDOW w AS ({W})),
p AS (SELECT a.symbol, a.dt, any_value(a.entry) AS entry, max(b.c) FILTER (b.i = a.i + 20) / any_value(a.entry) - 1 AS ret, max(b.h) / any_value(a.entry) - 1 AS mfe, min(b.l) / any_value(a.entry) - 1 AS mae, min(b.i - a.i) FILTER (b.h >= a.entry * 1.1) AS tt_target, min(b.i - a.i) FILTER (b.l <= a.entry * (1 - 0.07)) AS tt_stop
  FROM num a JOIN num b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 20 GROUP BY ALL HAVING count(*) = 20),
oc AS MATERIALIZED (SELECT *, CASE WHEN tt_stop <= coalesce(tt_target, 99) THEN CASE WHEN tt_stop <= 3 THEN 'false signal' WHEN ret > 0 THEN 'signal reversal' ELSE 'failed accumulation' END WHEN tt_target IS NULL THEN 'no resolution' WHEN ret < 0 THEN 'signal reversal' WHEN mfe >= 0.15 THEN 'breakout after accumulation' WHEN tt_target > 10 THEN 'delayed signal' ELSE 'successful accumulation' END AS label FROM p)"""


@query("outcome_labels", f"WITH {OUTCOME_SQL} SELECT symbol, dt, micro(entry) AS entry, micro(ret) AS ret, micro(mfe) AS mfe, micro(mae) AS mae, tt_target, tt_stop, label FROM oc")
def outcome_labels(spark, sf_dir):
    return shown(op.outcomes(adjusted_day_bars(spark, sf_dir)))


@query("label_drawdown", f"""WITH RECURSIVE {OUTCOME_SQL}, d AS MATERIALIZED (SELECT label, dt, avg(ret) AS r FROM oc GROUP BY ALL),
chain AS (SELECT label, min(dt) AS dt FROM d GROUP BY label UNION ALL SELECT c.label, (SELECT min(d.dt) FROM d WHERE d.label = c.label AND d.dt >= c.dt + 28) FROM chain c WHERE EXISTS (SELECT 1 FROM d WHERE d.label = c.label AND d.dt >= c.dt + 28)),
e AS (SELECT label, dt, exp(sum(ln(1 + r)) OVER (PARTITION BY label ORDER BY dt)) AS eq FROM chain JOIN d USING (label, dt)), k AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY label ORDER BY dt)) AS peak FROM e)
SELECT label, count(*) AS links, micro(ln(max_by(eq, dt))) AS log_equity, micro(least(0, min(eq / peak - 1))) AS drawdown FROM k GROUP BY label""")
def label_drawdown(spark, sf_dir):
    return shown(op.block_drawdown(op.outcomes(adjusted_day_bars(spark, sf_dir)), "label", "ret").select("label", F.col("links").cast("long").alias("links"), F.ln("equity").alias("log_equity"), "drawdown"))


FAMILY_SQL = f"{LABELLED_SQL}, fam AS MATERIALIZED (SELECT *, fwd - avg(fwd) OVER (PARTITION BY dt) AS ex FROM lab)"


def family(spark, sf_dir):
    return op.excess(labelled(series(spark, sf_dir)), "fwd")


@query("cluster_bootstrap", f"""WITH {FAMILY_SQL}, s AS MATERIALIZED (SELECT symbol, sum(ex) AS t, count(*) AS k, row_number() OVER (ORDER BY symbol) - 1 AS j, count(*) OVER () AS m FROM fam WHERE tilt > 0.2 GROUP BY symbol), g AS (SELECT count(*) AS symbols, sum(t) AS grand, sum(t) / sum(k) AS excess, max(m) AS m FROM s),
p AS (SELECT draw, ('0x' || substr(md5('11/' || draw || '/' || pick), 1, 8))::BIGINT % m AS j FROM g, range(1, 20001) d(draw), range(1, 1000) q(pick) WHERE pick <= m), b AS (SELECT draw, sum(t) / sum(k) AS mean FROM p JOIN s USING (j) GROUP BY draw)
SELECT any_value(symbols) AS symbols, (SELECT count(*) FROM s, g WHERE (t > 0) = (excess > 0))::INT AS agree, micro((SELECT sum(t) FROM (SELECT t FROM s, g ORDER BY CASE WHEN excess > 0 THEN -t ELSE t END LIMIT 3)) / any_value(grand)) AS top3_share, micro(any_value(excess)) AS excess, micro(quantile_cont(mean, 0.025)) AS lo, micro(quantile_cont(mean, 0.975)) AS hi,
  micro((CASE WHEN any_value(excess) > 0 THEN count(*) FILTER (mean <= 0) ELSE count(*) FILTER (mean >= 0) END + 1) / (count(*) + 1)) AS p_value FROM b, g""")
def cluster_bootstrap(spark, sf_dir):
    return shown(op.cluster_bootstrap(family(spark, sf_dir).filter("tilt > 0.2")))


@query("phase_split", f"""WITH {FAMILY_SQL}, o AS (SELECT dt, ((row_number() OVER (ORDER BY dt) - 1) % 4)::INT AS phase FROM (SELECT DISTINCT dt FROM fam)) SELECT phase, count(*) AS n, micro(avg(ex)) AS excess FROM fam JOIN o USING (dt) WHERE tilt > 0.2 GROUP BY phase""")
def phase_split(spark, sf_dir):
    return shown(op.phase_split(family(spark, sf_dir).withColumn("hot", F.col("tilt") > 0.2), "hot"))


LEADERS_SQL = f"""{FAMILY_SQL}, dn AS MATERIALIZED (SELECT symbol, dt, row_number() OVER ({W}) AS i FROM (SELECT DISTINCT symbol, dt FROM flow)), fi AS MATERIALIZED (SELECT symbol, broker, i, net, bought FROM flow JOIN dn USING (symbol, dt)),
tw AS (SELECT dn.symbol, dn.dt, broker, sum(net) AS net, sum(bought) AS bought FROM dn JOIN fi ON fi.symbol = dn.symbol AND fi.i BETWEEN dn.i - 14 AND dn.i GROUP BY ALL),
tb AS (SELECT symbol, dt, max_by(broker, row(net, -broker)) AS broker, max(net) AS net, sum(bought) AS volume FROM tw GROUP BY ALL), ld AS MATERIALIZED (SELECT fam.symbol, dt, broker, ex FROM tb JOIN fam USING (symbol, dt) WHERE tb.net > 0 AND tb.net >= 0.05 * tb.volume)"""


def edges_sql(*key):
    by, more = ", ".join(key), "" if "symbol" in key else ", symbol"
    return f"""WITH {LEADERS_SQL}, sy AS (SELECT {by}, count(*) AS symbols, max(n) AS top FROM (SELECT {by}{more}, count(*) AS n FROM ld GROUP BY ALL) GROUP BY ALL), yr AS (SELECT {by}, avg((m > 0)::INT) AS consistency FROM (SELECT {by}, year(dt) AS y, avg(ex) AS m FROM ld GROUP BY ALL) GROUP BY ALL),
a AS (SELECT {by}, count(*) AS n, avg((ex > 0)::INT) AS positive, avg(ex) AS mean, median(ex) AS median, max(ex) AS best, min(ex) AS worst FROM ld GROUP BY ALL)
SELECT {by}, n, {', '.join(f'micro(CASE WHEN n >= 30 THEN {c} END) AS {c}' for c in ('positive', 'mean', 'median', 'best', 'worst', 'consistency'))}, CASE WHEN n >= 30 THEN symbols END AS symbols, micro(CASE WHEN n >= 30 THEN top / n END) AS top_symbol_share, n < 30 AS suppressed FROM a JOIN sy USING ({by}) JOIN yr USING ({by})"""


def followed(spark, sf_dir):
    return op.leading_buyers(broker_flow(tape(spark, sf_dir))).join(family(spark, sf_dir).select("symbol", "dt", "ex"), ["symbol", "dt"])


@query("broker_edges", edges_sql("broker"))
def broker_edges(spark, sf_dir):
    return shown(op.edges(followed(spark, sf_dir), ["broker"]))


@query("broker_stock_edges", edges_sql("broker", "symbol"))
def broker_stock_edges(spark, sf_dir):
    return shown(op.edges(followed(spark, sf_dir), ["broker", "symbol"]))
