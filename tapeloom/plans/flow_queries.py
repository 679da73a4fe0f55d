"""Broker flow: the fact table, its windows and roll-ups."""

from pyspark.sql import functions as F

from ..functions.nulls import share
from ..operators import flow as op
from ..sources.tape import FLOW_SQL, TAPE_SQL, broker_flow, tape
from .registry import query

WINDOWED_SQL = f"""{FLOW_SQL},
days AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM (SELECT DISTINCT symbol, dt FROM flow)),
win AS (SELECT symbol, w, broker, sum(bought)::BIGINT AS bought, sum(sold)::BIGINT AS sold, sum(net)::BIGINT AS net, sum(buy_amt) AS buy_amt, sum(sell_amt) AS sell_amt, sum(trades)::BIGINT AS trades
        FROM flow JOIN days USING (symbol, dt) JOIN (SELECT unnest([3, 7, 15, 30]) AS w) ON age <= w GROUP BY symbol, w, broker)"""
STOCK_COLUMNS = """sum(bought)::BIGINT AS volume, round(sum(buy_amt), 2) AS turnover, count(*) AS brokers, count(*) FILTER (net > 0) AS net_buyers, count(*) FILTER (net < 0) AS net_sellers, count(*) FILTER (net = 0) AS neutral,
  max_by(broker, row(net, -broker)) AS top_buyer, greatest(max(net), 0) AS top_buy_net, min_by(broker, row(net, broker)) AS top_seller, least(min(net), 0) AS top_sell_net, sum(greatest(net, 0))::BIGINT AS net_qty"""
STOCK_MEASURES = """volume * 2 AS gross, round(net_qty / volume, 6) AS flow_quality_stock, round(net_buyers / brokers, 6) AS breadth,
  round(CASE WHEN net_sellers = 0 THEN net_buyers ELSE net_buyers / net_sellers END, 6) AS breadth_ratio, round(100.0 * top_buy_net / volume, 6) AS top_buy_share"""


def flow(spark, sf_dir):
    return broker_flow(tape(spark, sf_dir))


@query("broker_flow_daily", f"WITH {FLOW_SQL} SELECT symbol, dt, broker, bought, sold, net, round(buy_amt, 2) AS buy_amt, round(sell_amt, 2) AS sell_amt, trades FROM flow")
def broker_flow_daily(spark, sf_dir):
    return flow(spark, sf_dir).withColumns({c: F.round(c, 2) for c in ("buy_amt", "sell_amt")})


@query("broker_window_flow", f"""WITH {WINDOWED_SQL} SELECT symbol, w, broker, net, bought + sold AS gross, round(buy_amt - sell_amt, 2) AS net_amt, trades,
  micro(round(buy_amt, 2) / nullif(bought, 0)) AS buy_vwap, micro(round(sell_amt, 2) / nullif(sold, 0)) AS sell_vwap, round(net / (bought + sold), 6) AS imbalance,
  round(abs(net) / (bought + sold), 6) AS flow_quality, CASE WHEN net > 0 THEN 'BUY' WHEN net < 0 THEN 'SELL' ELSE 'FLAT' END AS side FROM win""")
def broker_window_flow(spark, sf_dir):
    return op.windowed(flow(spark, sf_dir)).select("symbol", "w", "broker", *op.broker_measures())


@query("stock_flow_daily", f"WITH {FLOW_SQL}, s AS (SELECT symbol, dt, {STOCK_COLUMNS} FROM flow GROUP BY symbol, dt) SELECT *, {STOCK_MEASURES} FROM s")
def stock_flow_daily(spark, sf_dir):
    return op.stock_flow(flow(spark, sf_dir), ["symbol", "dt"])


@query("stock_flow_windows", f"WITH {WINDOWED_SQL}, s AS (SELECT symbol, w, {STOCK_COLUMNS} FROM win GROUP BY symbol, w) SELECT *, {STOCK_MEASURES} FROM s")
def stock_flow_windows(spark, sf_dir):
    return op.stock_flow(op.windowed(flow(spark, sf_dir)), ["symbol", "w"])


@query("broker_shares", f"""WITH {WINDOWED_SQL}, t AS (SELECT symbol, w, sum(bought) AS v, sum(buy_amt) AS a, sum(trades) AS n FROM win GROUP BY symbol, w)
SELECT symbol, w, broker, round(100.0 * bought / v, 6) AS buy_share, round(100.0 * sold / v, 6) AS sell_share, round(100.0 * abs(net) / v, 6) AS net_share,
  round(100.0 * (bought + sold) / (2 * v), 6) AS gross_share, round(100.0 * (buy_amt + sell_amt) / (2 * a), 6) AS turnover_share, round(100.0 * trades / n, 6) AS trade_share,
  round(net / v, 6) AS flow_intensity, round((buy_amt - sell_amt) / a, 6) AS turnover_intensity FROM win JOIN t USING (symbol, w)""")
def broker_shares(spark, sf_dir):
    w = op.windowed(flow(spark, sf_dir))
    total = w.groupBy("symbol", "w").agg(F.sum("bought").alias("v"), F.sum("buy_amt").alias("a"), F.sum("trades").alias("n"))
    c = F.col
    parts = {
        "buy_share": share(c("bought"), c("v")), "sell_share": share(c("sold"), c("v")), "net_share": share(F.abs("net"), c("v")), "gross_share": share(c("bought") + c("sold"), 2 * c("v")),
        "turnover_share": share(c("buy_amt") + c("sell_amt"), 2 * c("a")), "trade_share": share(c("trades"), c("n")),
        "flow_intensity": share(c("net"), c("v")) / 100, "turnover_intensity": share(c("buy_amt") - c("sell_amt"), c("a")) / 100,
    }
    return w.join(total, ["symbol", "w"]).select("symbol", "w", "broker", *(F.round(v, 6).alias(k) for k, v in parts.items()))


@query("net_churn_windows", f"""WITH {FLOW_SQL}, days AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM (SELECT DISTINCT symbol, dt FROM flow)),
win AS (SELECT symbol, w, broker, sum(bought)::BIGINT AS bought, sum(net)::BIGINT AS net FROM flow JOIN days USING (symbol, dt) JOIN (SELECT unnest([3, 10, 20]) AS w) ON age <= w GROUP BY ALL)
SELECT symbol, w, round(sum(greatest(net, 0)) / sum(bought), 6) AS net_churn, round(sum(bought::DOUBLE * bought) / (sum(bought)::DOUBLE * sum(bought)), 6) AS buy_hhi,
  max_by(broker, row(net, -broker)) AS top_buyer, max(net) AS buyer_net, min_by(broker, row(net, broker)) AS top_seller, min(net) AS seller_net FROM win GROUP BY symbol, w""")
def net_churn_windows(spark, sf_dir):
    return op.churn_windows(flow(spark, sf_dir))


@query("broker_board", f"""WITH {FLOW_SQL}, per AS (SELECT broker, symbol, sum(bought) AS b, sum(sold) AS s, round(sum(buy_amt), 2) AS ba, round(sum(sell_amt), 2) AS sa FROM flow GROUP BY ALL),
d AS (SELECT broker, count(DISTINCT dt) AS sessions FROM flow GROUP BY broker)
SELECT broker, sum(b - s)::BIGINT AS net_qty, sum(b + s)::BIGINT AS gross_qty, round(sum(ba - sa), 2) AS net_amt, round(sum(ba + sa), 2) AS gross_amt, count(*) AS symbols, count(*) FILTER (b > s) AS symbols_net_bought,
  max_by(symbol, row(abs(round(ba - sa, 2)), symbol)) AS top_symbol, any_value(sessions) AS sessions, round(sum(b - s) / sum(b + s), 6) AS conviction FROM per JOIN d USING (broker) GROUP BY broker""")
def broker_board(spark, sf_dir):
    return op.broker_board(flow(spark, sf_dir))


@query("broker_flow_topk", f"""WITH {WINDOWED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, broker) AS br, row_number() OVER (PARTITION BY symbol ORDER BY net, broker) AS sr FROM win WHERE w = 30)
SELECT symbol, broker, bought, sold, net, (CASE WHEN net > 0 THEN br ELSE sr END)::INT AS rank, CASE WHEN net > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM r WHERE (br <= 10 AND net > 0) OR (sr <= 10 AND net < 0)""")
def broker_flow_topk(spark, sf_dir):
    return op.top_flow(flow(spark, sf_dir), 30, 10)


@query("broker_ledger", f"""WITH {FLOW_SQL} SELECT symbol, dt, bought, sold, net, net - lag(net) OVER w AS vs_prev, (sum(net) OVER w)::BIGINT AS position FROM flow WHERE broker = 7 WINDOW w AS (PARTITION BY symbol ORDER BY dt)""")
def broker_ledger(spark, sf_dir):
    return op.ledger(flow(spark, sf_dir), 7)


@query("market_share_groupingsets", f"""WITH {FLOW_SQL} SELECT symbol, broker, sum(bought)::BIGINT AS bought, sum(sold)::BIGINT AS sold, grouping(symbol, broker)::INT AS level FROM flow GROUP BY GROUPING SETS ((symbol, broker), (symbol), (broker), ())""")
def market_share_groupingsets(spark, sf_dir):
    flow(spark, sf_dir).createOrReplaceTempView("tapeloom_flow")
    return spark.sql("SELECT symbol, broker, sum(bought) AS bought, sum(sold) AS sold, cast(grouping_id(symbol, broker) AS int) AS level FROM tapeloom_flow GROUP BY GROUPING SETS ((symbol, broker), (symbol), (broker), ())")


@query("month_leaders", f"""WITH {FLOW_SQL}, days AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM (SELECT DISTINCT symbol, dt FROM flow)),
w AS (SELECT symbol, broker, sum(net)::BIGINT AS net, count(*) FILTER (net > 0) AS buy_days, count(*) FILTER (net < 0) AS sell_days, count(*) AS days FROM flow JOIN days USING (symbol, dt) WHERE age <= 20 GROUP BY ALL)
SELECT symbol, max_by(broker, row(net, -broker)) AS leader, max(net) AS leader_net, round(max_by(buy_days, row(net, -broker)) / max_by(days, row(net, -broker)), 6) AS regular, min_by(broker, row(net, broker)) AS seller, min(net) AS seller_net FROM w GROUP BY symbol""")
def month_leaders(spark, sf_dir):
    per = op.recent_sessions(flow(spark, sf_dir), 20).groupBy("symbol", "broker").agg(F.sum("net").alias("net"), F.count_if(F.col("net") > 0).alias("buy_days"), F.count("*").alias("days"))
    first, last = F.struct("net", -F.col("broker")), F.struct("net", "broker")
    return per.groupBy("symbol").agg(
        F.max_by("broker", first).alias("leader"), F.max("net").alias("leader_net"), F.round(F.max_by(F.col("buy_days") / F.col("days"), first), 6).alias("regular"), F.min_by("broker", last).alias("seller"), F.min("net").alias("seller_net")
    )


@query("dense_flow_grid", f"""WITH {FLOW_SQL} SELECT symbol, dt, broker, coalesce(bought, 0) AS bought, coalesce(sold, 0) AS sold, coalesce(net, 0) AS net
FROM (SELECT DISTINCT symbol, dt FROM flow) JOIN (SELECT DISTINCT symbol, broker FROM flow) USING (symbol) LEFT JOIN flow USING (symbol, dt, broker)""")
def dense_flow_grid(spark, sf_dir):
    return op.dense_grid(flow(spark, sf_dir))


@query("self_trades", f"""WITH {TAPE_SQL} SELECT symbol, count(*) FILTER (buyer = seller) AS n_self, coalesce(sum(qty) FILTER (buyer = seller), 0)::BIGINT AS self_qty, count(DISTINCT buyer) FILTER (buyer = seller) AS self_brokers,
  round(100.0 * count(*) FILTER (buyer = seller) / count(*), 6) AS pct_trades, round(100.0 * coalesce(sum(qty) FILTER (buyer = seller), 0) / sum(qty), 6) AS pct_qty FROM tape GROUP BY symbol""")
def self_trades(spark, sf_dir):
    return op.self_trades(tape(spark, sf_dir))


@query("tape_invariants", f"""WITH {FLOW_SQL}, f AS (SELECT symbol, dt, sum(net)::BIGINT AS net, (sum(bought) - sum(sold))::BIGINT AS gap, sum(bought)::BIGINT AS volume, sum(buy_amt) / sum(bought) AS vwap FROM flow GROUP BY ALL),
b AS (SELECT symbol, dt, min(rate) AS lo, max(rate) AS hi, sum(qty) AS v FROM tape GROUP BY ALL)
SELECT symbol, count(*) AS sessions, count(*) FILTER (net <> 0 OR gap <> 0) AS unbalanced, count(*) FILTER (volume <> v) AS volume_gaps, count(*) FILTER (vwap < lo - 1e-6 OR vwap > hi + 1e-6) AS vwap_outside FROM f JOIN b USING (symbol, dt) GROUP BY symbol""")
def tape_invariants(spark, sf_dir):
    """What holds for every session: nets add up to 0, both sides to the volume, and the average price lies in its range."""
    trades = tape(spark, sf_dir)
    f = broker_flow(trades).groupBy("symbol", "dt").agg(F.sum("net").alias("net"), (F.sum("bought") - F.sum("sold")).alias("gap"), F.sum("bought").alias("volume"), (F.sum("buy_amt") / F.sum("bought")).alias("vwap"))
    b = trades.groupBy("symbol", "dt").agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"), F.sum("qty").alias("v"))
    c = F.col
    return f.join(b, ["symbol", "dt"]).groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.count_if((c("net") != 0) | (c("gap") != 0)).alias("unbalanced"), F.count_if(c("volume") != c("v")).alias("volume_gaps"), F.count_if((c("vwap") < c("lo") - 1e-6) | (c("vwap") > c("hi") + 1e-6)).alias("vwap_outside")
    )
