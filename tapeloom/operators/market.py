"""Price against flow, execution, gates over the universe, and what followed: operators over sessions and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import pearson, ratio, ratio0
from .flow import recent_sessions
from .panel import ranked_in_past
from .series import by_symbol, vwap_returns

#: A session's largest believable log move, a gap that is a restatement, the tolerance around the average price.
CIRCUIT, SPLIT, NEAR = 0.20, 0.20, 0.0025
#: Sessions held, target and stop of an outcome.
HOLD, TARGET, STOP = 20, 0.10, 0.07


def changes(series: DataFrame, bars: DataFrame) -> DataFrame:
    """series with the average price, its log return, and each session's volume, turnover and price against the session before."""
    s = series.join(vwap_returns(bars, CIRCUIT).select("symbol", "dt", "vwap", F.col("ret").alias("vret")), ["symbol", "dt"])
    lag = lambda c: F.lag(c).over(by_symbol())
    return s.withColumns({"pv": lag("volume"), "pa": lag("amount"), "pp": lag("vwap"), "age": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))})


def correlations(changed: DataFrame, window: int = 30, least: int = 8) -> DataFrame:
    """Of the last `window` sessions: correlations of the return with tilt and with log changes of volume and turnover, and
    what a unit of tilt moves. No row with fewer than `least` sessions; the first session has no change and counts out."""
    w = changed.filter(F.col("age") <= window).withColumn("have", F.count("*").over(Window.partitionBy("symbol"))).filter((F.col("have") >= least) & (F.col("age") < F.col("have")))
    w = w.withColumns({"dv": F.ln(F.col("volume") / F.col("pv")), "da": F.ln(F.col("amount") / F.col("pa"))})
    flow = pearson("tilt", "vret")
    return w.groupBy("symbol").agg(
        F.count("*").alias("n"), flow.alias("price_flow"), pearson("dv", "vret").alias("volume_price"), pearson("da", "vret").alias("turnover_price"), F.coalesce(F.regr_slope("vret", "tilt"), F.lit(0.0)).alias("sensitivity"),
    ).withColumn("regime", F.when(F.col("price_flow") > 0.3, "convergent").when(F.col("price_flow") < -0.3, "divergent").otherwise("unclear"))


def elasticity(changed: DataFrame, window: int = 30, least_move: float = 0.05) -> DataFrame:
    """Price moved per unit of volume expansion over the last sessions, where volume moved and the price wasn't restated."""
    w = changed.filter(F.col("age") <= window).withColumn("have", F.count("*").over(Window.partitionBy("symbol"))).filter((F.col("have") >= 5) & (F.col("age") < F.col("have")))
    w = w.withColumns({"dv": F.col("volume") / F.col("pv") - 1, "dp": F.col("vwap") / F.col("pp") - 1}).filter((F.abs("dv") >= least_move) & (F.abs("dp") <= CIRCUIT)).withColumn("x", F.col("dp") / F.col("dv"))
    a = w.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.max_by("x", "dt").alias("last"))
    return a.withColumn("label", F.concat(F.lit("volume expansion + "), F.when(F.abs("median") < 0.05, "weak price response").when(F.col("median") > 0, "price following").otherwise("price fading")))


def flow_efficiency(changed: DataFrame, window: int = 7, least_flow: float = 0.05) -> DataFrame:
    """Return per unit of tilt over the last sessions; no row without a direction."""
    w = changed.filter(F.col("age") <= window).withColumn("have", F.count("*").over(Window.partitionBy("symbol"))).filter("have >= 3")
    a = w.groupBy("symbol").agg((100 * F.sum(F.when(F.col("age") < F.col("have"), F.col("vret")).otherwise(0.0))).alias("ret_pct"), F.sum("tilt").alias("flow_units")).filter(F.abs("flow_units") >= least_flow)
    good = F.when(F.col("flow_units") > 0, F.col("ret_pct") > 0).otherwise(F.col("ret_pct") < 0)
    return a.select("symbol", "ret_pct", "flow_units", (F.col("ret_pct") / F.col("flow_units")).alias("efficiency"), F.concat(F.when(good, "efficient ").otherwise("inefficient "), F.when(F.col("flow_units") > 0, "buying").otherwise("selling")).alias("label"))


def session_liquidity(trades: DataFrame) -> DataFrame:
    """Turnover, trades, median size and spread of prices (deviation over mean, by volume) of each session."""
    rq, rrq = F.sum(F.col("rate") * F.col("qty")), F.sum(F.col("rate") * F.col("rate") * F.col("qty"))
    mean = rq / F.sum("qty")
    var = F.greatest(rrq / F.sum("qty") - mean * mean, F.lit(0.0))
    return trades.groupBy("symbol", "dt").agg(F.sum("amt").alias("turnover"), F.count("*").cast("double").alias("trades"), F.median("qty").alias("median_trade"), ratio0(F.sqrt(var), mean).alias("dispersion"))


def executed_liquidity(sessions: DataFrame, lookback: int = 250, least: int = 60) -> DataFrame:
    """Score of 0 to 100 from point-in-time percentiles: the mean of turnover, trades and median size, less half of what dispersion has over 50."""
    numbered = sessions.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("dt")) - 1)
    s = ranked_in_past(numbered, ["turnover", "trades", "median_trade", "dispersion"], lookback, least).drop("i")
    score = (F.col("p_turnover") + F.col("p_trades") + F.col("p_median_trade")) / 3 - 0.5 * (F.col("p_dispersion") - 50)
    return s.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).withColumn("score", F.when(score.isNotNull(), F.col("score")))


def price_asymmetry(trades: DataFrame) -> DataFrame:
    """Each broker's purchases against its sales in a symbol's newest session: averages, weighted medians, ranges, ratios; null where a side is absent."""
    t = recent_sessions(trades, 1)
    legs = t.select("symbol", "dt", "qty", "rate", "amt", F.explode(F.array(F.struct(F.col("buyer").alias("broker"), F.lit("buy").alias("side")), F.struct(F.col("seller").alias("broker"), F.lit("sell").alias("side")))).alias("x")).select("symbol", "dt", "x.*", "qty", "rate", "amt")
    w = Window.partitionBy("symbol", "dt", "broker", "side")
    legs = legs.withColumns({"upto": F.sum("qty").over(w.orderBy("rate").rangeBetween(Window.unboundedPreceding, 0)), "all": F.sum("qty").over(w)})
    of = lambda side, x: F.when(F.col("side") == side, x)
    sums = [e for s in ("buy", "sell") for e in (
        F.coalesce(F.sum(of(s, F.col("qty"))), F.lit(0)).alias(f"{s}_qty"), F.sum(of(s, F.col("amt"))).alias(f"{s}_amt"), F.min(of(s, F.when(2 * F.col("upto") >= F.col("all"), F.col("rate")))).alias(f"{s}_median"), F.min(of(s, F.col("rate"))).alias(f"{s}_low"), F.max(of(s, F.col("rate"))).alias(f"{s}_high"))]
    a = legs.groupBy("symbol", "dt", "broker").agg(*sums).join(t.groupBy("symbol").agg((F.sum("amt") / F.sum("qty")).alias("vwap")), "symbol")
    bv, sv = ratio(F.col("buy_amt"), F.col("buy_qty")), ratio(F.col("sell_amt"), F.col("sell_qty"))
    return a.select(
        "symbol", "dt", "broker", "buy_qty", "sell_qty", bv.alias("buy_vwap"), sv.alias("sell_vwap"), *(f"{s}_{x}" for s in ("buy", "sell") for x in ("median", "low", "high")), ((sv - bv) / F.col("vwap")).alias("spread"),
        ratio(F.col("buy_qty"), F.col("sell_qty")).alias("qty_ratio"), F.when(F.col("sell_qty") > 0, ratio(F.coalesce("buy_amt", F.lit(0.0)), F.col("sell_amt"))).alias("turnover_ratio"),
    )


def price_quality(trades: DataFrame, sessions: int = 15) -> DataFrame:
    """Each broker's quantities below, near and above the average price of their session, and -1 to 1: bought low and sold high."""
    t = recent_sessions(trades, sessions)
    t = t.join(t.groupBy("symbol", "dt").agg((F.sum("amt") / F.sum("qty")).alias("vwap")), ["symbol", "dt"])
    place = F.when(F.col("rate") < F.col("vwap") * (1 - NEAR), "below").when(F.col("rate") <= F.col("vwap") * (1 + NEAR), "near").otherwise("above")
    legs = t.withColumn("place", place).select("symbol", "qty", F.explode(F.array(F.struct(F.col("buyer").alias("broker"), F.concat(F.lit("buy_"), F.col("place")).alias("k")), F.struct(F.col("seller").alias("broker"), F.concat(F.lit("sell_"), F.col("place")).alias("k")))).alias("x"))
    kinds = [f"{s}_{p}" for s in ("buy", "sell") for p in ("below", "near", "above")]
    a = legs.groupBy("symbol", F.col("x.broker").alias("broker")).agg(*(F.coalesce(F.sum(F.when(F.col("x.k") == k, F.col("qty"))), F.lit(0)).alias(k) for k in kinds))
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return a.withColumn("quality", ratio0(F.col("buy_below") - F.col("buy_above") + F.col("sell_above") - F.col("sell_below"), total))


def stock_rotation(flow: DataFrame, short: int = 3, long: int = 30, top: int = 5) -> DataFrame:
    """What each broker's book turned to: its largest symbol in both windows, new and left names of the top five, shares that rose and fell."""
    f = recent_sessions(flow, long).withColumn("gross", F.col("bought") + F.col("sold"))
    b = f.groupBy("broker", "symbol").agg(F.coalesce(F.sum(F.when(F.col("age") <= short, F.col("gross"))), F.lit(0)).alias("g0"), F.sum("gross").alias("g1"))
    w = Window.partitionBy("broker")
    for k in ("0", "1"):
        b = b.withColumns({f"s{k}": ratio0(F.col(f"g{k}"), F.sum(f"g{k}").over(w)), f"r{k}": F.row_number().over(w.orderBy(F.desc(f"g{k}"), "symbol"))})
    in_ = lambda k: (F.col(f"r{k}") <= top) & (F.col(f"g{k}") > 0)
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_list(F.when(c, F.col("symbol")))))
    focus = lambda k: F.max(F.when((F.col(f"r{k}") == 1) & (F.col(f"g{k}") > 0), F.col("symbol")))
    a = b.groupBy("broker").agg(
        focus("0").alias("focus_short"), focus("1").alias("focus_long"), F.max("s0").alias("share_short"), F.max("s1").alias("share_long"), names(in_("0") & ~in_("1")).alias("new_focus"), names(in_("1") & ~in_("0")).alias("abandoned"),
        F.count_if(F.col("s0") > F.col("s1")).alias("increasing"), F.count_if(F.col("s1") > F.col("s0")).alias("decreasing"),
    )
    return a.withColumn("rotated", F.coalesce(F.col("focus_short") != F.col("focus_long"), F.lit(False)))


def flow_by_price(trades: DataFrame, sessions: int = 120) -> tuple[DataFrame, DataFrame]:
    """Trades of the last sessions with what side each broker is on over all of them, and volume, net absorption, demand and
    supply by executed price. A broker is on one side for the whole window, not price by price."""
    t = recent_sessions(trades, sessions)
    legs = t.select("symbol", F.inline(F.array(F.struct(F.col("buyer").alias("broker"), F.col("qty").alias("x")), F.struct(F.col("seller").alias("broker"), (-F.col("qty")).alias("x")))))
    side = legs.groupBy("symbol", "broker").agg(F.signum(F.sum("x")).alias("side"))
    of = lambda who: side.select("symbol", F.col("broker").alias(who), F.col("side").alias(f"{who}_side"))
    t = t.join(of("buyer"), ["symbol", "buyer"]).join(of("seller"), ["symbol", "seller"]).withColumn("price", F.floor(F.col("rate") * 100 + 0.5) / 100)
    q = F.col("qty")
    up = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0))
    by_price = t.groupBy("symbol", "price").agg(F.sum("qty").alias("volume"), (up(F.col("buyer_side") > 0) - up(F.col("seller_side") > 0)).alias("net"), up(F.col("buyer_side") > 0).alias("demand"), up(F.col("seller_side") < 0).alias("supply"))
    return t, by_price


def price_levels(by_price: DataFrame) -> DataFrame:
    return by_price.select("symbol", "price", "volume", F.greatest("net", F.lit(0)).alias("absorbed"), ratio0(F.col("net"), F.col("volume")).alias("tilt"), ratio0(F.col("demand"), F.col("volume")).alias("demand"), ratio0(F.col("supply"), F.col("volume")).alias("supply"))


def price_bands(trades: DataFrame, by_price: DataFrame, n: int = 8) -> DataFrame:
    """n bands of equal width over a symbol's executed prices, the top one closed; one band where there is one price. trades and
    by_price are of flow_by_price()."""
    ends = by_price.groupBy("symbol").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum("volume").alias("total")).withColumn("width", (F.col("hi") - F.col("lo")) / n)
    band = F.when(F.col("width") > 0, F.least(F.floor((F.col("price") - F.col("lo")) / F.col("width")), F.lit(n - 1))).otherwise(0).cast("int")
    v = by_price.join(ends, "symbol").withColumn("band", band).groupBy("symbol", "band", "lo", "hi", "width", "total").agg(*(F.sum(c).alias(c) for c in ("volume", "net", "demand", "supply")))
    legs = trades.join(ends, "symbol").withColumn("band", band).select("symbol", "band", F.inline(F.array(F.struct(F.col("buyer").alias("broker"), F.col("qty").alias("x")), F.struct(F.col("seller").alias("broker"), (-F.col("qty")).alias("x")))))
    nets = legs.groupBy("symbol", "band", "broker").agg(F.sum("x").alias("x")).groupBy("symbol", "band").agg(F.sum(F.greatest("x", F.lit(0))).alias("kept"), F.count("*").alias("brokers"))
    share = lambda c: F.col(c) / F.col("volume")
    low = F.col("lo") + F.col("width") * F.col("band")
    return v.join(nets, ["symbol", "band"]).select("symbol", "band", low.alias("low"), F.when(F.col("width") > 0, low + F.col("width")).otherwise(F.col("hi")).alias("high"), "volume", (F.col("volume") / F.col("total")).alias("volume_share"), share("net").alias("tilt"), share("demand").alias("demand"), share("supply").alias("supply"), share("kept").alias("churn"), "brokers")


# ---- gates over the universe ------------------------------------------------------------------------------------


def broker_breadth(trades: DataFrame, sessions: int = 20, least: int = 10) -> DataFrame:
    """Median of the brokers on either side by session, and whether that is a real tape of many."""
    d = recent_sessions(trades, sessions).select("symbol", "dt", F.explode(F.array("buyer", "seller")).alias("broker")).distinct().groupBy("symbol", "dt").count()
    return d.groupBy("symbol").agg(F.median("count").alias("median_brokers")).withColumn("passes", F.col("median_brokers") >= least)


def current_only(rows: DataFrame, newest: int = 6) -> DataFrame:
    """Symbols whose last session is among the `newest` distinct last sessions of all symbols."""
    last = rows.groupBy("symbol").agg(F.max("dt").alias("last"))
    days = last.select("last").distinct().orderBy(F.desc("last")).limit(newest)  # at most `newest` rows
    return last.join(F.broadcast(days), "last", "left_semi")


def stratified_sample(sizes: DataFrame, n: int, least: int = 1) -> DataFrame:
    """n symbols at even ranks of size among those with `least` sessions or more, all of them if there are no more than n.

    Pick i has rank i * symbols div n, so a symbol knows from its own rank whether it is one.
    """
    w = Window.orderBy(F.desc("size"), "symbol")  # one row a symbol
    r = sizes.filter(F.col("sessions") >= least).withColumns({"rank": F.row_number().over(w) - 1, "total": F.count("*").over(Window.partitionBy())})
    i = F.expr(f"(rank * {n} + total - 1) div total")  # the only pick that could have this rank
    return r.filter((F.col("total") <= n) | ((i < n) & (F.expr(f"((rank * {n} + total - 1) div total) * total div {n}") == F.col("rank")))).select("symbol", "size", "rank")


def split_trim(bars: DataFrame, sessions: int = 120) -> DataFrame:
    """From when a symbol's last sessions can be profiled: the newest session whose average price gapped by more than SPLIT, and how many are left."""
    b = recent_sessions(bars, sessions).withColumn("vwap", F.col("amount") / F.col("v"))
    b = b.withColumn("gap", F.col("vwap") / F.lag("vwap").over(by_symbol()) - 1)
    a = b.groupBy("symbol").agg(F.min("dt").alias("first"), F.max(F.when(F.abs("gap") > SPLIT, F.struct("dt", "gap", "age"))).alias("x"), F.count("*").alias("n"))
    return a.select("symbol", F.coalesce("x.dt", "first").alias("from_dt"), F.coalesce("x.age", "n").cast("long").alias("sessions"), F.col("x.gap").alias("gap"))


def market_calendar(bars: DataFrame, last: int = 400, symbols: int = 60) -> DataFrame:
    """Sessions of the market: those of the last `last` bars of the first `symbols` symbols by name."""
    first = bars.select("symbol").distinct().orderBy("symbol").limit(symbols)  # at most `symbols` rows
    return recent_sessions(bars.join(F.broadcast(first), "symbol", "left_semi").select("symbol", "dt"), last).select("dt").distinct()


# ---- what followed ------------------------------------------------------------------------------------------------


def outcomes(bars: DataFrame, hold: int = HOLD) -> DataFrame:
    """Each session's future from the next open: return over `hold` bars, best and worst excursion, bars to target and stop (null if never), and the label of a purchase."""
    w = by_symbol().rowsBetween(1, hold)
    p = bars.withColumns({"entry": F.lead("o", 1).over(by_symbol()), "path": F.collect_list(F.struct("h", "l", "c")).over(w)}).filter((F.size("path") == hold) & (F.col("entry") > 0))
    first = lambda test: F.get(F.filter(F.transform("path", lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull()), F.lit(0))
    p = p.withColumns({
        "ret": F.get("path", F.lit(hold - 1))["c"] / F.col("entry") - 1, "mfe": F.array_max(F.transform("path", lambda x: x["h"])) / F.col("entry") - 1, "mae": F.array_min(F.transform("path", lambda x: x["l"])) / F.col("entry") - 1,
        "tt_target": first(lambda x: x["h"] >= F.col("entry") * (1 + TARGET)), "tt_stop": first(lambda x: x["l"] <= F.col("entry") * (1 - STOP)),
    })
    t, s, final = F.col("tt_target"), F.col("tt_stop"), F.col("ret")
    stopped = s.isNotNull() & (t.isNull() | (s <= t))
    label = (
        F.when(stopped & (s <= 3), "false signal").when(stopped & (final > 0), "signal reversal").when(stopped, "failed accumulation").when(t.isNull(), "no resolution").when(final < 0, "signal reversal")
        .when(F.col("mfe") >= 1.5 * TARGET, "breakout after accumulation").when(t > hold // 2, "delayed signal").otherwise("successful accumulation")
    )
    return p.select("symbol", "dt", "entry", "ret", "mfe", "mae", "tt_target", "tt_stop", label.alias("label"))


def block_drawdown(rows: DataFrame, key: str, outcome: str, gap_days: int = HOLD * 7 // 5) -> DataFrame:
    """Deepest fall from a peak of a book that holds all of a date's rows equally, then skips ahead past the holding period.

    One row for each date of a key reaches the fold, so its array is as long as the calendar.
    """
    d = rows.groupBy(key, "dt").agg(F.avg(outcome).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dt", "r"))).alias("days"))
    start = F.struct(F.lit(None).cast("date").alias("last"), F.lit(1.0).alias("eq"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("dd"), F.lit(0).alias("links"))

    def step(s: Column, x: Column) -> Column:
        eq = s["eq"] * (1 + x["r"])
        peak = F.greatest(s["peak"], eq)
        return F.when(F.date_diff(x["dt"], s["last"]) < gap_days, s).otherwise(F.struct(x["dt"].alias("last"), eq.alias("eq"), peak.alias("peak"), F.least(s["dd"], eq / peak - 1).alias("dd"), (s["links"] + 1).alias("links")))

    return d.select(key, F.aggregate("days", start, step).alias("s")).select(key, F.col("s.links").alias("links"), F.col("s.eq").alias("equity"), F.col("s.dd").alias("drawdown"))


def excess(rows: DataFrame, outcome: str) -> DataFrame:
    """rows with `ex`, the outcome beyond the mean of its session."""
    return rows.withColumn("ex", F.col(outcome) - F.avg(outcome).over(Window.partitionBy("dt")))


def cluster_bootstrap(family: DataFrame, draws: int = 20_000, seed: int = 11) -> DataFrame:
    """family (symbol, ex): its mean excess with a 95 % interval and a one-sided p by drawing whole symbols with replacement.

    Picks come from md5 of (seed, draw, pick), so they don't depend on partitions. Sums by symbol are drawn, not rows.
    A family without a row has no draws: one row of nulls with agree 0 and p 1.
    """
    s = family.groupBy("symbol").agg(F.sum("ex").alias("t"), F.count("*").alias("k"))
    numbered = s.withColumns({"j": F.row_number().over(Window.orderBy("symbol")) - 1, "m": F.count("*").over(Window.partitionBy())})  # one row a symbol
    whole = s.agg(F.count("*").alias("symbols"), F.sum("t").alias("grand"), F.sum("k").alias("n"), F.sort_array(F.collect_list("t")).alias("ts")).withColumn("excess", F.col("grand") / F.col("n"))
    m = F.broadcast(whole.select(F.col("symbols").alias("m")).filter("m > 0"))  # one row
    hashed = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), "draw", "pick")), 1, 8), 16, 10).cast("long")
    picks = s.sparkSession.range(1, draws + 1).select(F.col("id").alias("draw")).join(m).select("draw", "m", F.explode(F.sequence(F.lit(1), "m")).alias("pick")).withColumn("j", hashed % F.col("m"))
    means = picks.select("draw", "j").join(numbered.select("j", "t", "k"), "j").groupBy("draw").agg((F.sum("t") / F.sum("k")).alias("mean"))
    ranked = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.count("*").alias("drawn"), F.count_if(F.col("mean") <= 0).alias("below"), F.count_if(F.col("mean") >= 0).alias("over"))
    three = F.when(F.col("excess") > 0, F.slice(F.reverse("ts"), 1, 3)).otherwise(F.slice("ts", 1, 3))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    agree = F.size(F.filter("ts", lambda x: (x > 0) == (F.col("excess") > 0)))
    crossed = F.when(F.col("excess") > 0, F.col("below")).otherwise(F.col("over"))
    share = F.when(F.col("symbols") > 0, ratio0(add(three), F.col("grand")))
    return whole.join(F.broadcast(ranked)).select(F.nullif("symbols", F.lit(0)).alias("symbols"), agree.alias("agree"), share.alias("top3_share"), "excess", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"), ((crossed + 1) / (F.col("drawn") + 1)).alias("p_value"))  # one row


def phase_split(rows: DataFrame, member: str, steps: int = 4) -> DataFrame:
    """The family's excess on each of `steps` subsets of dates that don't overlap: every steps-th date of all rows."""
    order = rows.select("dt").distinct().withColumn("phase", (F.row_number().over(Window.orderBy("dt")) - 1) % steps)  # one row a date
    return rows.filter(member).join(order, "dt").groupBy("phase").agg(F.count("*").alias("n"), F.avg("ex").alias("excess"))


def leading_buyers(flow: DataFrame, sessions: int = 15, least: float = 0.05) -> DataFrame:
    """For each session: the broker with the largest net purchase over the trailing sessions, where that is `least` of the volume.

    Each broker day is sent to the sessions whose window holds it, and summed there.
    """
    days = flow.select("symbol", "dt").distinct().withColumn("i", F.row_number().over(by_symbol()))
    f = flow.join(days, ["symbol", "dt"]).select("symbol", "broker", "net", "bought", F.explode(F.sequence(F.col("i"), F.col("i") + sessions - 1)).alias("i"))
    w = f.groupBy("symbol", "i", "broker").agg(F.sum("net").alias("net"), F.sum("bought").alias("bought"))
    top = w.groupBy("symbol", "i").agg(F.max_by("broker", F.struct("net", -F.col("broker"))).alias("broker"), F.max("net").alias("net"), F.sum("bought").alias("volume"))
    return top.filter((F.col("net") > 0) & (F.col("net") >= least * F.col("volume"))).join(days, ["symbol", "i"]).select("symbol", "dt", "broker", (F.col("net") / F.col("volume")).alias("share"))


def edges(rows: DataFrame, key: list[str], least: int = 30) -> DataFrame:
    """rows (symbol, dt, ex and the key) -> what followed each key; keys with fewer than `least` rows are named and suppressed."""
    by_symbol_ = rows.groupBy(*key, *([] if "symbol" in key else ["symbol"])).count().groupBy(*key).agg(F.count("*").alias("symbols"), F.max("count").alias("top"))
    by_year = rows.groupBy(*key, F.year("dt").alias("y")).agg(F.avg("ex").alias("m")).groupBy(*key).agg(F.avg((F.col("m") > 0).cast("int")).alias("consistency"))
    a = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg((F.col("ex") > 0).cast("int")).alias("positive"), F.avg("ex").alias("mean"), F.median("ex").alias("median"), F.max("ex").alias("best"), F.min("ex").alias("worst")).join(by_symbol_, key).join(by_year, key)
    shown = F.col("n") >= least
    return a.select(*key, "n", *(F.when(shown, F.col(c)).alias(c) for c in ("positive", "mean", "median", "best", "worst", "consistency", "symbols")), F.when(shown, F.col("top") / F.col("n")).alias("top_symbol_share"), (~shown).alias("suppressed"))
