"""Broker and stock aggregates over the tape. Broker days add up, so every window is a sum of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import micro, ratio, ratio0, share, sign

WINDOWS = (3, 7, 15, 30)


def recent_sessions(rows: DataFrame, n: int, upto: str | None = None) -> DataFrame:
    """Rows of the last n sessions of each symbol at or before `upto` (n = 0: all), with `age` from 1 for the newest.

    Sessions are ranked in the small table of distinct days, not over the rows.
    """
    rows = rows.filter(F.col("dt") <= F.lit(upto)) if upto else rows
    days = rows.select("symbol", "dt").distinct().withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))))
    return rows.join(days.filter(F.col("age") <= n) if n else days, ["symbol", "dt"])


def windowed(flow: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Broker flow summed over each symbol's last w sessions, for all windows in one pass."""
    recent = recent_sessions(flow, max(windows))
    in_ = F.filter(F.array(*map(F.lit, windows)), lambda w: w >= F.col("age"))
    return recent.select("*", F.explode(in_).alias("w")).groupBy("symbol", "w", "broker").agg(*(F.sum(c).alias(c) for c in ("bought", "sold", "net", "buy_amt", "sell_amt", "trades")))


def broker_measures() -> list[Column]:
    """Net and gross, average prices (null for a side that never traded), imbalance, quality and side of a broker."""
    gross = F.col("bought") + F.col("sold")
    return [
        F.col("net"), gross.alias("gross"), F.round(F.col("buy_amt") - F.col("sell_amt"), 2).alias("net_amt"), F.col("trades"),
        micro(ratio(F.round("buy_amt", 2), F.col("bought"))).alias("buy_vwap"), micro(ratio(F.round("sell_amt", 2), F.col("sold"))).alias("sell_vwap"),
        F.round(ratio0(F.col("net"), gross), 6).alias("imbalance"), F.round(ratio0(F.abs("net"), gross), 6).alias("flow_quality"),
        F.when(F.col("net") > 0, "BUY").when(F.col("net") < 0, "SELL").otherwise("FLAT").alias("side"),
    ]


def stock_flow(by_broker: DataFrame, keys: list[str]) -> DataFrame:
    """Roll brokers up: volume, camps, top of each side (the smallest broker wins ties), net quantity and its quality."""
    positive = F.when(F.col("net") > 0, F.col("net")).otherwise(0)
    top_buyer, top_seller = F.max_by("broker", F.struct("net", -F.col("broker"))), F.min_by("broker", F.struct("net", "broker"))
    agg = by_broker.groupBy(*keys).agg(
        F.sum("bought").alias("volume"), F.round(F.sum("buy_amt"), 2).alias("turnover"), F.count("*").alias("brokers"),
        F.count_if(F.col("net") > 0).alias("net_buyers"), F.count_if(F.col("net") < 0).alias("net_sellers"), F.count_if(F.col("net") == 0).alias("neutral"),
        top_buyer.alias("top_buyer"), F.greatest(F.max("net"), F.lit(0)).alias("top_buy_net"), top_seller.alias("top_seller"), F.least(F.min("net"), F.lit(0)).alias("top_sell_net"), F.sum(positive).alias("net_qty"),
    )
    return agg.select(
        "*", (F.col("volume") * 2).alias("gross"), F.round(ratio0(F.col("net_qty"), F.col("volume")), 6).alias("flow_quality_stock"),
        F.round(ratio0(F.col("net_buyers"), F.col("brokers")), 6).alias("breadth"),
        F.round(F.when(F.col("net_sellers") == 0, F.col("net_buyers").cast("double")).otherwise(ratio0(F.col("net_buyers"), F.col("net_sellers"))), 6).alias("breadth_ratio"),
        F.round(share(F.col("top_buy_net"), F.col("volume")), 6).alias("top_buy_share"),
    )


def dense_grid(flow: DataFrame) -> DataFrame:
    """A row for each session and broker of a symbol, with 0 where the broker didn't trade.

    Joined by symbol from its distinct sessions and brokers, never across symbols.
    """
    days, who = flow.select("symbol", "dt").distinct(), flow.select("symbol", "broker").distinct()
    grid = days.join(who, "symbol")
    measured = flow.select("symbol", "dt", "broker", "bought", "sold", "net")
    return grid.join(measured, ["symbol", "dt", "broker"], "left").fillna(0, ["bought", "sold", "net"])


def churn_windows(flow: DataFrame, windows: tuple[int, ...] = (3, 10, 20)) -> DataFrame:
    """Net churn, buyers' concentration, and the leaders of both sides by symbol and window."""
    w = windowed(flow, windows)
    total = w.groupBy("symbol", "w").agg(F.sum("bought").alias("volume"), F.sum(F.greatest("net", F.lit(0))).alias("net_qty"), F.sum(F.col("bought").cast("double") * F.col("bought")).alias("sq"), F.max_by("broker", F.struct("net", -F.col("broker"))).alias("top_buyer"), F.max("net").alias("buyer_net"), F.min_by("broker", F.struct("net", "broker")).alias("top_seller"), F.min("net").alias("seller_net"))
    v = F.col("volume")
    return total.select("symbol", "w", F.round(ratio0(F.col("net_qty"), v), 6).alias("net_churn"), F.round(ratio0(F.col("sq"), v.cast("double") * v), 6).alias("buy_hhi"), "top_buyer", "buyer_net", "top_seller", "seller_net")


def broker_board(flow: DataFrame) -> DataFrame:
    """Each broker over the whole market: totals, conviction, reach, and the symbol with the largest net amount."""
    per = flow.groupBy("broker", "symbol").agg(F.sum("bought").alias("b"), F.sum("sold").alias("s"), F.round(F.sum("buy_amt"), 2).alias("ba"), F.round(F.sum("sell_amt"), 2).alias("sa"), F.collect_set("dt").alias("days"))
    top = F.max_by("symbol", F.struct(F.abs(F.round(F.col("ba") - F.col("sa"), 2)), "symbol"))
    out = per.groupBy("broker").agg(
        F.sum(F.col("b") - F.col("s")).alias("net_qty"), F.sum(F.col("b") + F.col("s")).alias("gross_qty"), F.round(F.sum(F.col("ba") - F.col("sa")), 2).alias("net_amt"), F.round(F.sum(F.col("ba") + F.col("sa")), 2).alias("gross_amt"),
        F.count("*").alias("symbols"), F.count_if(F.col("b") > F.col("s")).alias("symbols_net_bought"), top.alias("top_symbol"), F.size(F.array_distinct(F.flatten(F.collect_list("days")))).cast("long").alias("sessions"),
    )
    return out.withColumn("conviction", F.round(ratio0(F.col("net_qty"), F.col("gross_qty")), 6))


def top_flow(flow: DataFrame, sessions: int, k: int) -> DataFrame:
    """The k largest net buyers and sellers of each symbol over its last sessions."""
    w = windowed(flow, (sessions,))
    rank = lambda c: F.row_number().over(Window.partitionBy("symbol").orderBy(c, "broker"))
    ranked = w.select("symbol", "broker", "bought", "sold", "net", rank(F.desc("net")).alias("buy_rank"), rank(F.asc("net")).alias("sell_rank"))
    return ranked.filter(((F.col("buy_rank") <= k) & (F.col("net") > 0)) | ((F.col("sell_rank") <= k) & (F.col("net") < 0))).select(
        "symbol", "broker", "bought", "sold", "net", F.when(F.col("net") > 0, F.col("buy_rank")).otherwise(F.col("sell_rank")).alias("rank"), F.when(F.col("net") > 0, "BUY").otherwise("SELL").alias("side")
    )


def ledger(flow: DataFrame, broker: int) -> DataFrame:
    """One broker's rows, each with the difference from its row before in that symbol, and running totals."""
    w = Window.partitionBy("symbol").orderBy("dt")
    return flow.filter(F.col("broker") == broker).select("symbol", "dt", "bought", "sold", "net", (F.col("net") - F.lag("net").over(w)).alias("vs_prev"), F.sum("net").over(w).alias("position"))


def self_trades(trades: DataFrame) -> DataFrame:
    """Trades of a broker with itself, by symbol."""
    own = F.col("buyer") == F.col("seller")
    out = trades.groupBy("symbol").agg(F.count_if(own).alias("n_self"), F.count("*").alias("n"), F.sum(F.when(own, F.col("qty")).otherwise(0)).alias("self_qty"), F.sum("qty").alias("qty"), F.count_distinct(F.when(own, F.col("buyer"))).alias("self_brokers"))
    return out.select("symbol", "n_self", "self_qty", "self_brokers", F.round(share(F.col("n_self"), F.col("n")), 6).alias("pct_trades"), F.round(share(F.col("self_qty"), F.col("qty")), 6).alias("pct_qty"))


def flow_side(net: Column, volume: Column) -> Column:
    return sign(ratio0(net, volume), 0.001)
