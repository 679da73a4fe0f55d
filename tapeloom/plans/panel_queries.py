"""The study panel, and the rule families that are studied on it."""

from pyspark.sql import functions as F

from ..functions.nulls import micro
from ..operators import panel as op
from ..sources.store import stored
from ..sources.tape import FLOW_SQL, TAPE_SQL, tape
from .bar_queries import ADJUSTED_SQL, adjusted_day_bars
from .registry import query

#: Columns that are whole numbers or amounts, or are told apart by equality alone.
EXACT = {"trades", "volume", "turnover", "buyers", "sellers", "brokers", "reversal", "flow_price_lag", "signal_age", "top_buyer", "top_seller", "pair_buyer", "pair_seller", "tt_target", "tt_stop", "hold"}


def nano(x):
    return f"(floor(({x}) * 1e9 + 0.5) / 1e9)"


def window_sql(w):
    """Brokers' quantities pooled over the last w sessions, by a join of sessions with the flow of the sessions before."""
    full = lambda x: f"CASE WHEN i >= {w - 1} THEN {x} ELSE 0 END"
    return f"""pool{w} AS (SELECT a.symbol, a.i, f.broker, sum(bought)::BIGINT AS b, sum(bought - sold)::BIGINT AS net FROM num a JOIN fl f ON f.symbol = a.symbol AND f.i BETWEEN a.i - {w - 1} AND a.i GROUP BY ALL),
win{w} AS (SELECT symbol, i, {full('sum(greatest(net, 0))::DOUBLE / sum(b)')} AS netchurn_{w}, {full('(max(net) + min(net))::DOUBLE / sum(b)')} AS tilt_{w}, {full('count(*) FILTER (net > 0)::DOUBLE / count(*)')} AS breadth_{w},
  {full('(count(*) FILTER (net > 0) - count(*) FILTER (net < 0))::DOUBLE / count(*)')} AS consensus_{w}, {full('(max(net) - min(net))::DOUBLE / sum(b)')} AS conc_{w} FROM pool{w} GROUP BY symbol, i)"""


def corr_sql(x, y, w):
    spread = f"sqrt(var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) OVER {w} * var_pop({y}) OVER {w})"
    return nano(f"CASE WHEN count({y}) OVER {w} < 3 OR {spread} < 1e-12 THEN 0 ELSE greatest(-1, least(1, covar_pop(CASE WHEN {y} IS NOT NULL THEN {x} END, {y}) OVER {w} / {spread})) END")


def z_sql(x):
    return f"CASE WHEN count({x}) OVER past >= 60 AND stddev_pop({x}) OVER past > 1e-9 THEN {nano(f'({x} - avg({x}) OVER past) / stddev_pop({x}) OVER past')} ELSE 0 END"


ROWS = ", ".join(f"r{n} AS (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING)" for n in (3, 4, 5, 7, 8, 15, 30, 31, 55, 56, 57, 58, 59, 60))
#: Follows the tape and adjusted bars.
PANEL_SQL = f"""{FLOW_SQL.removeprefix(TAPE_SQL + ",").lstrip()},
every AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, dt FROM tape)),
cal AS (SELECT dt, (row_number() OVER (ORDER BY dt) - 1) % 5 = 0 AS on_grid FROM (SELECT DISTINCT dt FROM tape)),
num AS MATERIALIZED (SELECT symbol, dt, i, on_grid FROM every JOIN cal USING (dt) WHERE n >= 200),
tr AS MATERIALIZED (SELECT tape.*, i FROM tape JOIN num USING (symbol, dt)),
fl AS MATERIALIZED (SELECT flow.*, i FROM flow JOIN num USING (symbol, dt)),
cut AS (SELECT a.symbol, a.i, quantile_cont(amt, 0.9) AS cut FROM num a JOIN tr ON tr.symbol = a.symbol AND tr.i BETWEEN a.i - 30 AND a.i - 1 GROUP BY ALL),
day AS (SELECT symbol, i, count(*)::DOUBLE AS trades, sum(qty)::DOUBLE AS volume, round(sum(amt), 2) AS turnover, median(qty)::DOUBLE AS median_trade, min(rate) AS lo, max(rate) AS hi, count(DISTINCT buyer)::DOUBLE AS buyers, count(DISTINCT seller)::DOUBLE AS sellers,
  coalesce(sum(qty) FILTER (amt >= cut), 0)::DOUBLE AS big FROM tr LEFT JOIN cut USING (symbol, i) GROUP BY symbol, i),
lev AS (SELECT symbol, i, sum(q * q) / sum(q) ** 2 AS level_hhi FROM (SELECT symbol, i, rate, sum(qty)::DOUBLE AS q FROM tr GROUP BY ALL) GROUP BY symbol, i),
who AS (SELECT symbol, i, list(bought ORDER BY bought DESC) AS bs, sum(bought)::DOUBLE AS v, count(*)::DOUBLE AS brokers, greatest(max(net), 0) AS up, greatest(-min(net), 0) AS dn, sum(bought::DOUBLE ** 2) AS bb, sum(sold::DOUBLE ** 2) AS ss, sum(greatest(net, 0)) AS pos,
  count(*) FILTER (net > 0) - count(*) FILTER (net < 0) AS camps, count(*) FILTER (bought > 0) AS k FROM fl GROUP BY symbol, i),
daily AS (SELECT symbol, i, trades, volume, turnover, turnover / volume AS vwap, (hi - lo) / (turnover / volume) AS price_range, volume / trades AS avg_trade, median_trade, big / volume AS large_ratio, buyers, sellers, brokers, up / v AS top1_conc,
  list_sum(bs[1:5])::DOUBLE / v AS top5_conc, bb / (v * v) AS buy_hhi, ss / (v * v) AS sell_hhi, up / v - dn / v AS net_flow, pos / v AS flow_quality, camps / brokers AS flow_imbalance, trades / brokers AS fragmentation,
  {nano("CASE WHEN k < 2 THEN 0 ELSE -list_sum([b / v * ln(b / v) FOR b IN bs IF b > 0]) / ln(k) END")} AS broker_entropy, brokers / trades AS broker_diversity, CASE WHEN hi > lo THEN {nano("greatest(0, least(1, (turnover / volume - lo) / (hi - lo)))")} ELSE 0.5 END AS vwap_position, {nano("level_hhi")} AS level_hhi
  FROM day JOIN lev USING (symbol, i) JOIN who USING (symbol, i)),
{", ".join(map(window_sql, op.WINDOWS))},
base AS (SELECT *, CASE WHEN abs(mv) <= 0.20 THEN mv ELSE 0 END AS ret FROM (SELECT *, ln(vwap / lag(vwap) OVER (PARTITION BY symbol ORDER BY i)) AS mv FROM daily {" ".join(f"JOIN win{w} USING (symbol, i)" for w in op.WINDOWS)})),
behind AS (SELECT *, {", ".join(f"lag(tilt_3, {k}) OVER (PARTITION BY symbol ORDER BY i) AS t{k}" for k in range(6))}, CASE WHEN (tilt_3 > 0) = (lag(tilt_3) OVER (PARTITION BY symbol ORDER BY i) > 0) THEN 0 ELSE 1 END AS turned FROM base),
islands AS (SELECT *, sum(turned) OVER (PARTITION BY symbol ORDER BY i) AS run FROM behind),
aged AS (SELECT *, (row_number() OVER (PARTITION BY symbol, run ORDER BY i) - 1)::DOUBLE AS signal_age, (sign(tilt_3) + sign(tilt_7) + sign(tilt_15) + sign(tilt_30))::DOUBLE AS signs FROM islands),
wide AS (SELECT *, {nano("avg(large_ratio) OVER r8")} AS large_7, {nano("avg(large_ratio) OVER r31")} AS large_30, {", ".join(f"(count(*) FILTER (tilt_3 > 0.001) OVER r{n})::DOUBLE / count(*) OVER r{n} AS persistence_{n}" for n in (7, 15, 30))},
  tilt_3 - tilt_15 AS momentum, (tilt_3 - tilt_7) - (tilt_7 - tilt_15) AS acceleration, (tilt_3 * tilt_15 < 0)::INT::DOUBLE AS reversal, {nano("avg(brokers) OVER r4 / avg(brokers) OVER r31 - 1")} AS participation_change, {nano("vwap / avg(vwap) OVER r30 - 1")} AS vwap_distance,
  {nano("avg(vwap) OVER r3 / avg(vwap) OVER r15 - 1")} AS vwap_slope, {corr_sql("ret", "t0", "r30")} AS price_flow_corr, abs({z_sql("volume")}) AS anomaly, {z_sql("turnover")} AS turnover_z, exp(-signal_age / 7) AS signal_decay, signs / 4 AS alignment, 1 - abs(signs) / 4 AS conflict,
  {", ".join(f"{nano(f'sum(ret) OVER r{n}')} AS ret_{n}" for n in (5, 15, 30))}, sum(abs(tilt_3)) OVER r15 AS gross, [{", ".join(f"abs({corr_sql('ret', f't{k}', f'r{60 - k}')})" for k in range(6))}] AS cs
  FROM aged WINDOW past AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING), {ROWS}),
feat AS MATERIALIZED (SELECT *, CASE WHEN i + 1 < 20 THEN 0 ELSE list_position(cs, list_max(cs)) - 1 END::DOUBLE AS flow_price_lag, {nano("ret_15 / CASE WHEN gross > 0 THEN gross ELSE 1 END")} AS flow_efficiency FROM wide JOIN num USING (symbol, i)),
pct AS (SELECT g.symbol, g.i, {", ".join(f"100 * (count(*) FILTER (r.{x} < g.{x}) + 0.5::DOUBLE * count(*) FILTER (r.{x} = g.{x})) / count(*) AS p_{x}" for x in op.FEATURES)} FROM feat g JOIN feat r ON r.symbol = g.symbol AND r.i BETWEEN g.i - 250 AND g.i - 1 WHERE g.on_grid AND g.i >= 60 GROUP BY g.symbol, g.i),
lead AS (SELECT symbol, i, arg_max(broker, row(net, -broker)) AS top_buyer, max(net)::DOUBLE / sum(b) AS top_buyer_share, arg_min(broker, row(net, broker)) AS top_seller, sum(b) AS vol FROM pool15 GROUP BY symbol, i),
pairs AS (SELECT a.symbol, a.i, buyer, seller, count(*) AS k FROM num a JOIN tr ON tr.symbol = a.symbol AND tr.i BETWEEN a.i - 14 AND a.i WHERE on_grid GROUP BY ALL),
pair AS (SELECT symbol, i, arg_max(buyer, row(k, -buyer, -seller)) AS pair_buyer, arg_max(seller, row(k, -buyer, -seller)) AS pair_seller, max(k) AS k FROM pairs GROUP BY symbol, i)"""
#: The path after each decision day, over adjusted bars kept as lists.
PATH_SQL = """series AS (SELECT symbol, list(dt ORDER BY dt) AS ds, list(o ORDER BY dt) AS os, list(h ORDER BY dt) AS hs, list(l ORDER BY dt) AS ls, list(c ORDER BY dt) AS cs FROM bars GROUP BY symbol),
start AS (SELECT num.symbol, num.dt, list_position(ds, num.dt) AS p, * EXCLUDE (symbol, dt) FROM num JOIN series USING (symbol) WHERE on_grid),
path AS (SELECT symbol, dt, os[p + 1] AS entry, hs[p + 1:p + 20] AS hs, ls[p + 1:p + 20] AS ls, cs[p + 1:p + 20] AS cs FROM start WHERE p + 20 <= len(ds) AND os[p + 1] > 0),
touched AS (SELECT *, coalesce(list_min(list_filter(range(1, 21), lambda j: hs[j] >= entry * (1 + 0.10::DOUBLE))), 0) AS tt_target, coalesce(list_min(list_filter(range(1, 21), lambda j: ls[j] <= entry * (1 - 0.07::DOUBLE))), 0) AS tt_stop FROM path),
after AS (SELECT symbol, dt, entry, cs[5] / entry - 1 AS fwd_5, cs[10] / entry - 1 AS fwd_10, cs[20] / entry - 1 AS fwd_20, list_max(hs) / entry - 1 AS mfe, list_min(ls) / entry - 1 AS mae, tt_target, tt_stop,
  CASE WHEN tt_stop > 0 AND (tt_target = 0 OR tt_stop <= tt_target) THEN -0.07 WHEN tt_target > 0 THEN 0.10 ELSE cs[20] / entry - 1 END::DOUBLE AS managed,
  CASE WHEN tt_target > 0 AND tt_stop > 0 THEN least(tt_target, tt_stop) WHEN tt_target + tt_stop > 0 THEN tt_target + tt_stop ELSE 20 END AS hold FROM touched)"""
COLUMNS = [*op.FEATURES, *(f"p_{x}" for x in op.FEATURES), *op.LEADING, "entry", "fwd_5", "fwd_10", "fwd_20", "mfe", "mae", "tt_target", "tt_stop", "managed", "hold"]


def shown_sql(x):
    value = "pair.k::DOUBLE / vol" if x == "pair_share" else x
    return value if x in EXACT else f"micro({value}) AS {x}"


@query("study_panel", f"""WITH {ADJUSTED_SQL}, {PANEL_SQL}, {PATH_SQL}
SELECT symbol, dt, {', '.join(map(shown_sql, COLUMNS))} FROM feat JOIN pct USING (symbol, i) JOIN lead USING (symbol, i) JOIN pair USING (symbol, i) JOIN after USING (symbol, dt)""")
def study_panel(spark, sf_dir):
    return panel(spark, sf_dir).select("symbol", "dt", *(F.col(c) if c in EXACT else micro(F.col(c)).alias(c) for c in COLUMNS))


def panel(spark, sf_dir):
    """The panel is stored like the tape: studies read its few rows again and again."""
    return stored(spark, sf_dir, "panel", lambda: op.study_panel(tape(spark, sf_dir), adjusted_day_bars(spark, sf_dir)), ["dt", "symbol"])


#: Each family's conditions as one predicate.
FIRES = {
    "accumulation": "p_tilt_15 >= 80", "distribution": "p_tilt_15 <= 20", "net_churn (control)": "p_netchurn_30 >= 80", "concentration": "p_conc_7 >= 80", "breadth": "p_breadth_7 >= 80", "large_trade": "p_large_7 >= 80", "consensus": "p_consensus_7 >= 80",
    "vwap_slope": "p_vwap_slope >= 80", "flow_price_divergence": "p_tilt_15 >= 70 AND p_ret_15 <= 30", "mtf_alignment": "alignment >= 1",
}
RATES = {
    "mean_ret": "avg(s * fwd_20)", "win_rate": "avg((s * fwd_20 > 0)::INT)", "mean_excess": "avg(s * (fwd_20 - m))", "excess_win_rate": "avg((s * (fwd_20 - m) > 0)::INT)", "managed_mean": "avg(s * managed)", "mfe_mean": "avg(CASE WHEN s > 0 THEN mfe ELSE -mae END)",
    "mae_mean": "avg(CASE WHEN s > 0 THEN mae ELSE -mfe END)", "target_rate": "avg((CASE WHEN s > 0 THEN tt_target ELSE tt_stop END > 0)::INT)", "invalidation_rate": "avg((CASE WHEN s > 0 THEN tt_stop ELSE tt_target END > 0)::INT)", "avg_hold": "avg(hold)",
}


@query("rule_families", f"""WITH {ADJUSTED_SQL}, {PANEL_SQL}, {PATH_SQL},
obs AS MATERIALIZED (SELECT *, avg(fwd_20) OVER (PARTITION BY dt) AS m FROM feat JOIN pct USING (symbol, i) JOIN after USING (symbol, dt)),
hits AS ({" UNION ALL ".join(f"SELECT '{name}' AS family, {-1 if name == 'distribution' else 1} AS s, symbol, dt, fwd_20, m, managed, mfe, mae, tt_target, tt_stop, hold FROM obs WHERE {cond}" for name, cond in FIRES.items())})
SELECT family, CASE WHEN s > 0 THEN 'long' ELSE 'short' END AS side, count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT dt) AS days, {', '.join(f'micro(CASE WHEN count(*) >= 30 THEN {x} END) AS {c}' for c, x in RATES.items())} FROM hits GROUP BY family, s""")
def rule_families(spark, sf_dir):
    return op.rule_families(panel(spark, sf_dir)).select("family", "side", "n", "symbols", "days", *(micro(F.col(c)).alias(c) for c in RATES))
