"""Screens: composite queries with a row for each symbol, side or window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import micro, ratio, ratio0
from .flow import churn_windows, recent_sessions
from .indicators import pivots, recursive, sma
from .series import by_symbol
from .stats import two_proportions

SPIKE_BASE = 60
SPIKE_WINDOWS = {3: (2.5, 0.36, 2.0), 10: (2.0, 0.24, 3.0), 20: (2.0, 0.18, 5.0)}


def _by_window(values: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("w"))


def volume_spike(bars: DataFrame, flow: DataFrame, base: int = SPIKE_BASE) -> DataFrame:
    """Volume of the newest 3, 10 and 20 sessions against the 60 before each window, with churn, leaders and kind of move.

    A move is relative to the median of all symbols in that window.
    """
    b = bars.select("symbol", "c", "v", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))).alias("age"))
    x = b.select("*", F.explode(F.array(*map(F.lit, SPIKE_WINDOWS))).alias("w")).filter(F.col("age") <= base + F.col("w"))
    now = F.col("age") <= F.col("w")
    v, pick = F.col("v").cast("double"), lambda c, y: F.when(c, y)
    a = x.groupBy("symbol", "w").agg(
        F.avg(pick(now, F.log1p(v))).alias("m1"), F.avg(pick(~now, F.log1p(v))).alias("m0"), F.stddev_samp(pick(~now, F.log1p(v))).alias("sd"), F.avg(pick(now, v)).alias("mean_v"), F.median(pick(~now, v)).alias("median_v"),
        F.max(pick(F.col("age") == 1, F.col("c"))).alias("c1"), F.max(pick(F.col("age") == F.col("w") + 1, F.col("c"))).alias("c0"), F.count("*").alias("n"),
    ).filter((F.col("n") == base + F.col("w")) & (F.col("sd") > 0))
    s = a.select("symbol", "w", ((F.col("m1") - F.col("m0")) / F.col("sd")).alias("z"), ratio0(F.col("mean_v"), F.col("median_v")).alias("spike_ratio"), (100 * (F.col("c1") / F.col("c0") - 1)).alias("pct"))
    s = s.withColumn("rel", F.col("pct") - F.median("pct").over(Window.partitionBy("w")))
    out = s.join(churn_windows(flow, tuple(SPIKE_WINDOWS)), ["symbol", "w"])
    cut = lambda k: _by_window({w: t[k] for w, t in SPIKE_WINDOWS.items()})
    kind = F.when(F.abs("rel") <= cut(2), "churn").when(F.col("rel") > 0, "markup").otherwise("markdown")
    side = F.when((F.col("buyer_net") > 0) & (F.col("buyer_net") >= -F.col("seller_net")), "BUY").when(F.col("seller_net") < 0, "SELL")
    flags = F.array_compact(F.array(F.when(F.col("z") >= cut(0), "SPIKE"), F.when(F.col("net_churn") <= cut(1), "CHURN"), side))
    return out.select(
        "symbol", "w", F.round("z", 6).alias("z"), F.round("spike_ratio", 6).alias("spike_ratio"), F.round("pct", 4).alias("pct"), F.round("rel", 4).alias("rel"), "net_churn", "buy_hhi", "top_buyer", "buyer_net", "top_seller", "seller_net", kind.alias("kind"), F.concat_ws(",", flags).alias("flags")
    )


def operator_now(trades: DataFrame, sessions: int = 20, least_other: int = 2) -> DataFrame:
    """Who leads each side of a symbol over its last sessions, how tight the grip is, and how regular; self trades are left out.

    The score compares symbols on the same side.
    """
    t = recent_sessions(trades, sessions).filter("buyer != seller")
    leg = F.array(F.struct(F.col("buyer").alias("broker"), F.col("seller").alias("other"), F.col("qty").alias("x")), F.struct(F.col("seller").alias("broker"), F.col("buyer").alias("other"), (-F.col("qty")).alias("x")))
    legs = t.select("symbol", "dt", "age", F.inline(leg))
    w = legs.select("*", F.explode(F.filter(F.array(*map(F.lit, (3, 7, 15, 20))), lambda k: k >= F.col("age"))).alias("w"))
    net = w.groupBy("symbol", "w", "broker").agg(F.sum("x").alias("net"), F.sum(F.greatest("x", F.lit(0))).alias("b"))
    per = net.groupBy("symbol", "w").agg(F.sum("b").alias("vol"), F.struct(F.max_by("broker", F.struct("net", -F.col("broker"))).alias("who"), F.max("net").alias("n"), F.lit("BUY").alias("side")).alias("x"), F.struct(F.min_by("broker", F.struct("net", "broker")).alias("who"), F.min("net").alias("n"), F.lit("SELL").alias("side")).alias("y"))
    lead = per.select("symbol", "w", "vol", F.inline(F.array("x", "y"))).withColumn("grip", 100 * F.abs("n") / F.col("vol"))
    at = lambda k, c: F.max(F.when(F.col("w") == k, F.col(c)))
    s = lead.groupBy("symbol", "side").agg(at(20, "who").alias("who"), at(20, "grip").alias("grip"), (at(3, "grip") - at(20, "grip")).alias("tighten"), F.count_distinct("who").alias("persist"))
    daily = legs.groupBy("symbol", "broker", "dt").agg(F.sum("x").alias("net"))
    act = s.join(daily.withColumnRenamed("broker", "who"), ["symbol", "who"])
    on = F.when(F.col("side") == "BUY", F.col("net") > 0).otherwise(F.col("net") < 0)
    reg = act.groupBy("symbol", "side").agg(F.round(100 * F.count_if(on) / F.count("*")).alias("regular"))
    other = s.join(legs.withColumnRenamed("broker", "who"), ["symbol", "who"]).filter(F.when(F.col("side") == "BUY", F.col("x") > 0).otherwise(F.col("x") < 0)).groupBy("symbol", "side").agg(F.count_distinct("other").alias("counterparties"))
    r = s.join(reg, ["symbol", "side"]).join(other, ["symbol", "side"]).filter(F.col("counterparties") >= least_other)
    side = Window.partitionBy("side")
    z = lambda c: (F.col(c) - F.avg(c).over(side)) / F.coalesce(F.nullif(F.stddev_pop(c).over(side), F.lit(0.0)), F.lit(1.0))
    bonus = F.when(F.col("persist") == 1, 1.0).when(F.col("persist") == 2, 0.5).when(F.col("persist") == 3, 0.2).otherwise(0.0)
    score = (z("grip") + 0.5 * z("tighten") + bonus) * (0.4 + 0.6 * F.col("regular") / 100)
    return r.select("symbol", "side", "who", F.round("grip", 6).alias("grip"), F.round("tighten", 6).alias("tighten"), "persist", "regular", "counterparties", F.round(score, 5).alias("score"))


def operator_proof(flow: DataFrame, sessions: int = 20) -> DataFrame:
    """Is the leading buyer's share in a symbol larger than elsewhere? Own symbol left out of the comparison."""
    f = recent_sessions(flow, sessions).groupBy("symbol", "broker").agg(F.sum("bought").alias("b"), F.sum("net").alias("net"))
    f = f.withColumns({"vol": F.sum("b").over(Window.partitionBy("symbol")), "all_b": F.sum("b").over(Window.partitionBy("broker"))})
    market = f.select(F.sum("b").alias("market"))
    f = f.join(F.broadcast(market))  # one row
    lead = f.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("net"), "broker"))).filter("r = 1")
    rest, rest_vol = F.col("all_b") - F.col("b"), F.col("market") - F.col("vol")
    inside, outside = 100 * ratio(F.col("b"), F.col("vol")), 100 * ratio(rest, rest_vol)
    z = F.round(two_proportions(F.col("b"), F.col("vol"), rest, rest_vol), 6)
    times = F.when(outside > 0.01, inside / outside).otherwise(999.0)
    verdict = F.when((F.abs(z) > 3.2905) & (times >= 2), "CONCENTRATED").when((F.abs(z) > 1.96) & (times >= 1.5), "elevated").otherwise("just a big broker")
    return lead.select("symbol", F.col("broker").alias("who"), F.round(inside, 6).alias("share_in"), F.round(outside, 6).alias("share_out"), F.round(times, 6).alias("times"), z.alias("z"), verdict.alias("verdict"))


def operator_verdict(trades: DataFrame, sessions: int = 20) -> DataFrame:
    """Four tests of the leading net buyer: dominance, clip size, persistence and counterparties."""
    t = recent_sessions(trades, sessions)
    legs = t.filter("buyer != seller").select("symbol", "dt", F.inline(F.array(F.struct(F.col("buyer").alias("broker"), F.col("qty").alias("x")), F.struct(F.col("seller").alias("broker"), (-F.col("qty")).alias("x")))))
    net = legs.groupBy("symbol", "broker").agg(F.sum("x").alias("net"))
    lead = net.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("net"), "broker"))).filter("r = 1").select("symbol", F.col("broker").alias("who"), "net")
    mine = t.join(lead, "symbol").withColumn("own", F.col("buyer") == F.col("who"))
    a = mine.groupBy("symbol", "who", "net").agg(
        F.sum("qty").alias("vol"), F.coalesce(F.sum(F.when(F.col("own"), F.col("qty"))), F.lit(0)).alias("q"), F.median(F.when(F.col("own"), F.col("qty"))).alias("clip"), F.median(F.when(~F.col("own"), F.col("qty"))).alias("rest_clip"), F.count_distinct(F.when(F.col("own"), F.col("seller"))).alias("counterparties")
    )
    days = legs.groupBy("symbol", "broker", "dt").agg(F.sum("x").alias("d")).join(lead.withColumnRenamed("who", "broker"), ["symbol", "broker"]).groupBy("symbol").agg(F.round(F.count_if(F.col("d") > 0) / F.count("*"), 6).alias("persist"))
    r = a.join(days, "symbol").withColumn("share_in", F.round(100 * F.col("q") / F.col("vol"), 6))
    passes = (F.col("share_in") >= 20).cast("int") + F.coalesce((F.col("clip") >= 1.5 * F.col("rest_clip")).cast("int"), F.lit(0)) + (F.col("persist") >= 0.6).cast("int") + (F.col("counterparties") >= 10).cast("int")
    return r.select("symbol", "who", "net", "share_in", "clip", "rest_clip", "persist", "counterparties", passes.alias("passes"), F.when(passes == 4, "OPERATOR ENGAGED").when(passes == 3, "LIKELY").otherwise("NO").alias("verdict"))


def scan(bars: DataFrame) -> DataFrame:
    """The newest session of each symbol: trend by EMA 20, momentum, ATR, last pivots and a signal."""
    r = recursive(bars).select("symbol", "dt", "h", "l", "c", "ema20", "rsi14", "atr14")
    p = pivots(r, 5, 5).withColumns({"last_high": F.last("ph", True).over(by_symbol()), "last_low": F.last("pl", True).over(by_symbol()), "age": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))), "prev": F.lag("c").over(by_symbol())})
    up, over, under = F.col("c") >= F.col("ema20"), F.col("c") > F.col("last_high"), F.col("c") < F.col("last_low")
    return p.filter("age = 1 and ema20 is not null").select(
        "symbol", "dt", micro(F.col("c")).alias("c"), F.round(100 * (F.col("c") / F.col("prev") - 1), 4).alias("change_pct"), F.when(up, "up").otherwise("down").alias("trend"), F.round("rsi14", 4).alias("rsi14"), micro(F.col("atr14")).alias("atr14"),
        F.when(up & F.coalesce(over, F.lit(False)), "BUY").when(~up & F.coalesce(under, F.lit(False)), "SELL").otherwise("WATCH").alias("signal"),
    )


def setup_score(bars: DataFrame) -> DataFrame:
    """A score of up to 100 for each session from trend, momentum, strength, volume and price."""
    b = recursive(bars).withColumns({"sma50": sma(50), "top": F.max("h").over(by_symbol().rowsBetween(-20, -1)), "mv": F.avg("v").over(by_symbol().rowsBetween(-20, -1)), "prev_hist": F.lag("hist").over(by_symbol())})
    c = F.col
    parts = [
        (c("c") > c("sma50"), 10), (F.round("ema50", 6) > F.round("sma50", 6), 10), (c("ema20") > c("ema50"), 10), (c("rsi14") > 50, 10), (c("macd") > c("signal"), 10), (c("hist") > c("prev_hist"), 5), (c("adx14") > 25, 10), (c("plus_di") > c("minus_di"), 10),
        (c("v") > 1.5 * c("mv"), 10), (c("v") > 2 * c("mv"), 5), (c("c") > c("top"), 10),
    ]
    score = sum((F.when(test, n).otherwise(0) for test, n in parts), F.lit(0))
    return b.filter("sma50 is not null and adx14 is not null and signal is not null").select("symbol", "dt", score.alias("score"), F.when(score >= 90, "STRONG BUY").when(score >= 80, "BUY").when(score >= 60, "WATCH").otherwise("AVOID").alias("label"))


def position_size(capital: float, budget: float, entry: Column, stop: Column) -> Column:
    """Shares that risk at most the budget and cost at most the capital; 0 without a stop below the entry."""
    risk = entry - stop
    n = F.least(F.floor(F.lit(budget) / F.nullif(risk, F.lit(0.0))), F.floor(F.lit(capital) / F.nullif(entry, F.lit(0.0))))
    return F.when((risk > 0) & (entry > 0), F.greatest(n, F.lit(0))).otherwise(0)


def supply_demand(bars: DataFrame, size: int = 3, pad: float = 0.75) -> DataFrame:
    """Price zones at pivots and what became of each: broken, or how often price came back after leaving.

    Bars after a pivot meet its zone in one join by symbol. Leaving, coming back and breaking are windows over them.
    """
    b = recursive(bars).select("symbol", "dt", "o", "h", "l", "c", "atr14")
    b = pivots(b, size, size).withColumn("i", F.row_number().over(by_symbol()))
    z = b.filter("atr14 is not null and (ph is not null or pl is not null)")
    supply = F.struct(F.lit("supply").alias("kind"), F.least(F.greatest("o", "c"), F.col("h") - pad * F.col("atr14")).alias("lo"), F.col("h").alias("hi"))
    demand = F.struct(F.lit("demand").alias("kind"), F.col("l").alias("lo"), F.greatest(F.least("o", "c"), F.col("l") + pad * F.col("atr14")).alias("hi"))
    zones = z.select("symbol", F.col("i").alias("at"), F.inline(F.array_compact(F.array(F.when(F.col("ph").isNotNull(), supply), F.when(F.col("pl").isNotNull(), demand)))))
    m = zones.join(b.select("symbol", "i", "h", "l", "c"), "symbol").filter("i > at")
    w = Window.partitionBy("symbol", "kind", "at").orderBy("i")
    hit = (F.col("h") >= F.col("lo")) & (F.col("l") <= F.col("hi"))
    broken = F.when(F.col("kind") == "supply", F.col("c") > F.col("hi")).otherwise(F.col("c") < F.col("lo"))
    m = m.withColumns({"hit": hit, "broken": broken}).withColumns({"dead": F.max("broken").over(w), "gone_before": F.coalesce(F.max(~F.col("hit")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)), "was_hit": F.coalesce(F.lag("hit").over(w), F.lit(False))})
    # a visit starts at a hit once price has left, with no hit at the bar before
    visit = ~F.col("dead") & F.col("gone_before") & F.col("hit") & ~F.col("was_hit")
    out = m.groupBy("symbol", "kind", "at", "lo", "hi").agg(F.max("broken").alias("b"), F.count_if(visit).alias("visits"))
    state = F.when(F.col("b"), "turncoat").when(F.col("visits") == 0, "untested").when(F.col("visits") == 1, "strong").otherwise("weak")
    return out.select("symbol", "kind", F.col("at").alias("bar"), micro(F.col("lo")).alias("lo"), micro(F.col("hi")).alias("hi"), "visits", state.alias("state"))


def first_passage(bars: DataFrame, horizon: int = 20, up: float = 0.05, down: float = 0.05, cost: float = 0.8) -> DataFrame:
    """From each bar: does price first rise by `up` or fall by `down` within the horizon? Both at once count as down.

    The following bars of a bar are collected in a window of fixed length, so no join is needed.
    """
    path = F.collect_list(F.struct("h", "l")).over(by_symbol().rowsBetween(1, horizon))
    p = bars.select("symbol", "dt", "c", path.alias("p"), F.lead("c", horizon).over(by_symbol()).alias("end")).filter(F.size("p") == horizon)
    first = lambda test: F.coalesce(F.get(F.filter(F.transform("p", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(horizon))
    p = p.withColumns({"u": first(lambda x: x["h"] >= F.col("c") * (1 + up)), "d": first(lambda x: x["l"] <= F.col("c") * (1 - down))})
    out = F.when((F.col("u") == horizon) & (F.col("d") == horizon), "none").when(F.col("u") < F.col("d"), "up").otherwise("down")
    p = p.withColumn("outcome", out)
    share = lambda x: F.avg((F.col("outcome") == x).cast("int"))
    rest = F.coalesce(F.avg(F.when(F.col("outcome") == "none", 100 * (F.col("end") / F.col("c") - 1))), F.lit(0.0))
    value = share("up") * up * 100 - share("down") * down * 100 + share("none") * rest
    return p.groupBy("symbol").agg(F.count("*").alias("n"), F.round(share("up"), 6).alias("p_up"), F.round(share("down"), 6).alias("p_down"), F.round(share("none"), 6).alias("p_none"), F.count_if((F.col("u") == F.col("d")) & (F.col("u") < horizon)).alias("ambiguous"), F.round(value - cost, 6).alias("net_edge"))
