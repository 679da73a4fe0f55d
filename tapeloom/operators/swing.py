"""Swing reading of daily bars: one row a symbol, about its newest bar and what led to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from .indicators import full, pivots, recursive, trailing
from .series import by_symbol

#: Sessions that a swing may be old to count as support or resistance, and the share of the close that is a gap.
MAJOR, GAP = 250, 0.05


def frame(bars: DataFrame) -> DataFrame:
    """Bars with indicators, 5/5 pivots, i (from 0) and age (0 for the newest bar of a symbol)."""
    b = pivots(recursive(bars), 5, 5).withColumns({"i": F.row_number().over(by_symbol()) - 1, "n": F.count("*").over(Window.partitionBy("symbol")), "vsma": full(F.avg("v").over(trailing(20)), 20, "v")})
    lag = lambda c: F.lag(c).over(by_symbol())
    return b.withColumns({"age": F.col("n") - 1 - F.col("i"), "pc": lag("c"), "p20": lag("ema20"), "p50": lag("ema50"), "p200": lag("ema200"), "pm": lag("macd"), "ps": lag("signal")})


def at(c: str, age: int = 0) -> Column:
    return F.max(F.when(F.col("age") == age, F.col(c)))


def total(x: Column | str, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col(x) if isinstance(x, str) else x)), F.lit(0.0))


def young(k: int) -> Column:
    return F.col("age") < k


def momentum(f: DataFrame) -> DataFrame:
    """Returns and EMA slopes in percent, spread of the EMAs by price, who volume favours, advances over declines, acceleration.

    A return over k bars is null with too few; advances without a decline are infinite, written as null here.
    """
    up, down = F.col("c") > F.col("o"), F.col("c") < F.col("o")
    step = F.col("c") - F.col("pc")
    back = lambda c, k: 100 * (ratio(at(c), at(c, k)) - 1)
    a = f.groupBy("symbol").agg(
        *(back("c", k).alias(f"ret{k}") for k in (5, 20, 60)), *(back(f"ema{k}", 5).alias(f"slope{k}") for k in (20, 50, 200)),
        at("c").alias("close"), at("ema20").alias("e20"), at("ema50").alias("e50"), at("ema200").alias("e200"),
        total("v", young(20) & up).alias("up_v"), total("v", young(20) & down).alias("down_v"), total(step, young(20) & (step > 0)).alias("gain"), total(-step, young(20) & (step < 0)).alias("loss"),
    )
    spread = 100 * (F.greatest("e20", "e50", "e200") - F.least("e20", "e50", "e200")) / F.col("close")
    return a.select(
        "symbol", "ret5", "ret20", "ret60", "slope20", "slope50", "slope200", F.when(F.col("e20").isNotNull() & F.col("e50").isNotNull() & F.col("e200").isNotNull(), spread).alias("separation"),
        F.when(F.col("up_v") > 1.25 * F.col("down_v"), "Accumulation").when(F.col("down_v") > 1.25 * F.col("up_v"), "Distribution").otherwise("Neutral").alias("accum"),
        F.when(F.col("loss") > 0, F.col("gain") / F.col("loss")).when(F.col("gain") == 0, 1.0).alias("advances_declines"), (F.col("ret5") / 5 - F.col("ret20") / 20).alias("acceleration"),
    )


def crosses(f: DataFrame, look: int = 25, macd_look: int = 14) -> DataFrame:
    """Crossings of EMA 20/50 and 50/200 within `look` bars, and the newest of MACD and its signal within macd_look."""
    pairs = [("20/50", "ema20", "ema50", "p20", "p50"), ("50/200", "ema50", "ema200", "p50", "p200"), ("macd", "macd", "signal", "pm", "ps")]
    turn = lambda a, b, pa, pb: F.when((F.col(pa) <= F.col(pb)) & (F.col(a) > F.col(b)), "bullish").when((F.col(pa) >= F.col(pb)) & (F.col(a) < F.col(b)), "bearish")
    each = F.inline(F.array(*(F.struct(F.lit(p).alias("pair"), turn(*c).alias("direction")) for p, *c in pairs)))
    found = f.filter(young(look)).select("symbol", "age", each).filter(F.col("direction").isNotNull() & ((F.col("pair") != "macd") | young(macd_look)))
    newest = F.row_number().over(Window.partitionBy("symbol", "pair").orderBy("age"))
    return found.withColumn("k", newest).filter("pair != 'macd' or k = 1").select("symbol", "pair", "direction", "age")


def swings(f: DataFrame) -> DataFrame:
    """symbol, highs and lows: arrays of struct(age, v), newest first. A pivot stands for six bars at least, so they are short."""
    listed = lambda c: F.array_sort(F.filter(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("age", F.col(c).alias("v")))), lambda x: x.isNotNull()))
    return f.groupBy("symbol").agg(listed("ph").alias("highs"), listed("pl").alias("lows"))


def value(swing: str, k: int, field: str = "v") -> Column:
    return F.get(F.col(swing), F.lit(k))[field]


def levels(f: DataFrame) -> DataFrame:
    """Entry, a stop at the newest swing low under the price (2 ATR away where that is 3.5 ATR or more), targets from
    resistance within bounds of 5 R and 10 ATR, near and major levels. No row where there is no risk to take."""
    now = f.groupBy("symbol").agg(at("c").alias("entry"), at("atr14").alias("atr"))
    s = swings(f).join(now, "symbol")
    recent = lambda c: F.filter(F.col(c), lambda x: x["age"] < MAJOR)
    above = lambda d: F.transform(F.filter(recent("highs"), lambda x: x["v"] > F.col("entry") + d), lambda x: x["v"])
    s = s.withColumns({
        "near_support": F.get(F.filter(recent("lows"), lambda x: x["v"] < F.col("entry")), F.lit(0))["v"], "major_support": F.array_min(F.transform(recent("lows"), lambda x: x["v"])),
        "near_res": F.array_min(above(F.lit(0.0))), "major_res": F.array_max(above(F.lit(0.0))), "target_res": F.array_min(above(0.5 * F.col("atr"))),
    })
    s = s.withColumn("stop_far", F.coalesce(F.col("entry") - F.col("near_support") >= 3.5 * F.col("atr"), F.lit(False)))
    s = s.withColumn("stop", F.when(F.col("near_support").isNotNull() & ~F.col("stop_far"), F.col("near_support")).otherwise(F.col("entry") - 2 * F.col("atr"))).withColumn("risk", F.col("entry") - F.col("stop")).filter("risk > 0")
    horizon = F.col("entry") + 10 * F.col("atr")
    s = s.withColumn("t1", F.least(F.coalesce("target_res", horizon), F.col("entry") + 5 * F.col("risk"), horizon))
    cap = F.least(F.col("entry") + 20 * F.col("atr"), F.col("entry") + 10 * F.col("risk"))
    s = s.withColumn("t2", F.when((F.col("major_res") > F.col("t1") + F.col("risk")) & (F.col("major_res") <= cap), F.col("major_res")).otherwise(F.col("t1") + F.col("risk")))
    return s.withColumn("t3", F.greatest(F.col("t2") + 2 * F.col("risk"), F.col("entry") + 5 * F.col("risk"))).select("symbol", "entry", "stop", "risk", "t1", "t2", "t3", "near_res", "major_res", "near_support", "major_support", "stop_far")


def support_tests(f: DataFrame) -> DataFrame:
    """Share of dips to an EMA within 60 bars that closed above it again, whether buyers came back within 5 bars at the support
    that a dip would meet first (swing low or EMA), and the volume regime; null where there was nothing to test."""
    def respected(e: str) -> Column:
        dip = young(60) & (F.col("l") <= F.col(e))
        return 100 * ratio(F.sum(F.when(dip & (F.col("c") >= F.col(e)), 1).otherwise(0)), F.sum(F.when(dip, 1).otherwise(0)))

    now = f.groupBy("symbol").agg(*(at(c).alias(n) for c, n in (("c", "close"), ("ema20", "e20"), ("ema50", "e50"))))
    low = F.get(F.filter("lows", lambda x: (x["age"] < MAJOR) & (x["v"] < F.col("close"))), F.lit(0))["v"]
    under = lambda x: F.when(x < F.col("close"), x)
    met = swings(f).join(now, "symbol").select("symbol", F.greatest(low, under(F.col("e20")), under(F.col("e50"))).alias("support"))
    g = f.join(met, "symbol")
    back = young(5) & (F.col("l") <= F.col("support")) & (F.col("h") > F.col("l")) & ((F.col("c") - F.col("l")) / (F.col("h") - F.col("l")) >= 0.5)
    a = g.groupBy("symbol").agg(
        respected("ema20").alias("respects20"), respected("ema50").alias("respects50"), F.max("support").alias("s"), F.coalesce(F.max(back), F.lit(False)).alias("back"), F.count("*").alias("n"),
        (total("v", young(20)) / 20).alias("recent"), (total("v", young(60) & ~young(20)) / 40).alias("older"), at("v").alias("v"), at("vsma").alias("vsma"),
    )
    known = (F.col("n") >= 60) & (F.col("vsma") > 0)
    regime = F.when(~known, "unknown").when(F.col("recent") > 1.2 * F.col("older"), "expansion").when(F.col("recent") < 0.8 * F.col("older"), "contraction").otherwise("steady")
    return a.select("symbol", "respects20", "respects50", F.when(F.col("s").isNotNull(), F.col("back")).alias("buyers_return"), regime.alias("volume_regime"), (known & (F.col("v") > 3 * F.col("vsma"))).alias("abnormal"))


def structure(f: DataFrame) -> DataFrame:
    """Label of the last two swings each way, divergence of RSI and MACD on them, whether 20 bars stay within 2.5 ATR, and the stage of the trend."""
    ages = lambda c: [value(c, k, "age") for k in (0, 1)]
    s = swings(f)
    marks = f.select("symbol", "age", "h", "l", F.col("rsi14").alias("rsi"), "macd")
    for name, c in (("h0", ages("highs")[0]), ("h1", ages("highs")[1]), ("l0", ages("lows")[0]), ("l1", ages("lows")[1])):
        s = s.withColumn(f"a_{name}", c)
    picked = s.select("symbol", "highs", "lows", F.inline_outer(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"a_{k}").alias("age")) for k in ("h0", "h1", "l0", "l1")))))
    read = picked.join(marks, ["symbol", "age"], "left").groupBy("symbol").agg(F.first("highs").alias("highs"), F.first("lows").alias("lows"), *(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in ("h0", "h1", "l0", "l1") for c in ("rsi", "macd")))
    now = f.groupBy("symbol").agg(
        *(at(c).alias(c) for c in ("c", "atr14", "ema20", "ema50", "ema200")), (100 * (ratio(at("c"), at("c", 60)) - 1)).alias("ret60"), F.max(F.when(young(20), F.col("h"))).alias("top"), F.min(F.when(young(20), F.col("l"))).alias("bottom"), F.count("*").alias("n")
    )
    w = read.join(now, "symbol")
    up = lambda s: F.coalesce(value(s, 0) > value(s, 1), F.lit(False))
    down = lambda s: F.coalesce(value(s, 0) < value(s, 1), F.lit(False))
    hh, hl, lh, ll = up("highs"), up("lows"), down("highs"), down("lows")
    fact = lambda c: F.coalesce(c, F.lit(False))
    tight = fact((F.col("n") >= 20) & (F.col("atr14") != 0) & ((F.col("top") - F.col("bottom")) / F.col("atr14") <= 2.5))
    trend = fact((F.col("c") > F.col("ema20")) & (F.col("ema20") > F.col("ema50")) & (F.col("ema50") > F.col("ema200")))
    far = fact((F.col("c") - F.col("ema20")) / F.col("atr14") > 4) | fact(F.col("ret60") > 60)
    label = F.when(hh & hl, "HH/HL").when(lh & ll, "LH/LL").when(hh | hl, "mixed-up").when(lh | ll, "mixed-down").otherwise("unclear")
    stage = (
        F.when(~trend & fact(F.col("ema50") < F.col("ema200")), F.when(tight, "Consolidation").otherwise("Downtrend")).when(~trend, F.when(tight | hh | hl, "Consolidation").otherwise("Reversal Attempt"))
        .when(far, "Late Uptrend").when(tight, "Consolidation").when(hh & hl, "Established Uptrend").otherwise("Early Uptrend")
    )
    bear = lambda x: fact(hh & (F.col(f"{x}_h0") < F.col(f"{x}_h1")))
    bull = lambda x: fact(ll & (F.col(f"{x}_l0") > F.col(f"{x}_l1")))
    return w.select("symbol", label.alias("label"), *(g(x).alias(f"{x}_{n}") for x in ("rsi", "macd") for n, g in (("bear", bear), ("bull", bull))), tight.alias("ranging"), stage.alias("stage"))


def resistance(f: DataFrame) -> DataFrame:
    """f with res, the highest of the last four swing highs, and atr of the newest bar."""
    s = swings(f).select("symbol", F.array_max(F.transform(F.slice("highs", 1, 4), lambda x: x["v"])).alias("res"), value("highs", 0).alias("last_high"), value("lows", 0).alias("last_low"), value("lows", 1).alias("low_before"))
    return f.join(s, "symbol").withColumn("atr", F.max(F.when(F.col("age") == 0, F.col("atr14"))).over(Window.partitionBy("symbol")))


def breakout(f: DataFrame) -> DataFrame:
    """The state of the breakout of `res`, how the base and the retest went, failures within 120 bars (one for each week), and
    whether the last swing low was swept within 10 bars or the last high reclaimed within 20."""
    g = resistance(f).withColumns({"tol": F.greatest(0.5 * F.col("atr"), 0.005 * F.col("res")), "base": F.col("res") - F.greatest(4 * F.col("atr"), 0.08 * F.col("res"))})
    ahead = F.max("c").over(by_symbol().rowsBetween(1, 7))
    crossed = (F.col("c") > F.col("res")) & (F.col("pc") <= F.col("res"))
    per = Window.partitionBy("symbol")
    g = g.withColumns({
        "fails": (F.col("age") < 120) & (F.col("h") > F.col("res")) & (F.col("c") < F.col("res")) & (F.coalesce(ahead, F.lit(0.0)) < F.col("res")),
        "walk": F.coalesce(F.min(F.when((F.col("c") <= 0.98 * F.col("res")), F.col("age"))).over(per), F.col("n") - 1),
        "bo": F.min(F.when(crossed & (F.col("age") < 30) & (F.col("i") >= 1), F.col("age"))).over(per),
    })
    within = (F.col("c") >= F.col("base")) & (F.col("c") <= 1.02 * F.col("res"))
    after = F.col("age") < F.col("bo")
    episodes = F.aggregate(F.array_sort(F.filter(F.collect_list(F.when(F.col("fails"), F.col("i"))), lambda x: x.isNotNull())), F.struct(F.lit(-99).cast("long").alias("last"), F.lit(0).cast("long").alias("k")), lambda s, x: F.when(x >= s["last"] + 8, F.struct(x.cast("long").alias("last"), (s["k"] + 1).alias("k"))).otherwise(s), lambda s: s["k"])
    a = g.groupBy("symbol").agg(
        *(F.max(x).alias(x) for x in ("res", "atr", "tol", "walk", "n", "bo", "last_low", "last_high")), *(at(c).alias(c) for c in "ohlc"), at("v").alias("v"), at("vsma").alias("vsma"),
        F.coalesce(F.max(F.when((F.col("age") >= 1) & (F.col("age") <= 5), F.col("c") > F.col("res"))), F.lit(False)).alias("was"),
        F.sum(F.when((F.col("age") < 90) & (F.abs(F.col("h") - F.col("res")) <= F.col("tol")), 1).otherwise(0)).alias("res_tests"),
        F.min(F.when((F.col("age") >= F.col("walk")) & ~within, F.col("age"))).alias("left"), F.sum(F.when(young(3) & (F.col("c") > F.col("res")), 1).otherwise(0)).alias("follow_through"),
        F.min(F.when(after, F.struct("l", "i", "v", "vsma"))).alias("deep"), F.coalesce(F.max(F.when(after, F.col("c") < F.col("res") - F.col("tol"))), F.lit(False)).alias("lost"), episodes.alias("failures"),
        F.coalesce(F.max(young(10) & (F.col("l") < F.col("last_low")) & (F.col("c") > F.col("last_low"))), F.lit(False)).alias("sweep"),
        F.coalesce(F.max((F.col("age") < 20) & (F.col("age") >= 3) & (F.col("c") < F.col("last_high"))), F.lit(False)).alias("broke"),
    )
    above, was = F.col("c") > F.col("res"), F.col("was")
    state = (
        F.when(F.col("res").isNull() | (~above & ~was & (F.col("h") <= F.col("res"))), "No Breakout").when(~above & ~was, "Attempting Breakout").when(above & ~was, F.when(F.coalesce(F.col("v") / F.col("vsma"), F.lit(0.0)) >= 1.5, "Confirmed Breakout").otherwise("Attempting Breakout"))
        .when(above, F.when(100 * (F.col("c") / F.col("res") - 1) > 12, "Extended Breakout").otherwise("Confirmed Breakout")).when(F.col("c") > 0.98 * F.col("res"), "Breakout Retest").otherwise("Failed Breakout")
    )
    span = F.least(F.lit(250), F.col("n") - 1 - F.col("walk"))
    reached = F.col("res").isNotNull() & (F.col("bo") >= 1) & (F.col("deep.l") <= F.col("res") + F.col("tol"))
    return a.select(
        "symbol", state.alias("state"), "res", F.when(F.col("res").isNull(), 0).otherwise(F.col("res_tests")).alias("res_tests"),
        F.when(F.col("res").isNull(), 0).otherwise(F.least(F.coalesce(F.col("left") - F.col("walk"), span), span)).alias("consol_days"), F.when(F.col("res").isNotNull(), ratio(F.abs(F.col("c") - F.col("o")), F.col("atr"))).alias("candle"),
        F.when(F.col("res").isNotNull(), 100 * ratio(F.col("c") - F.col("l"), F.col("h") - F.col("l"))).alias("close_pos"), "follow_through", F.when(reached, (F.col("res") - F.col("deep.l")) / F.col("atr")).alias("retest_depth"), F.when(reached, ~F.col("lost")).alias("retest_held"),
        F.when(reached, ratio(F.col("deep.v"), F.col("deep.vsma"))).alias("retest_vol"), F.when(reached, F.col("bo")).alias("retest_bars"), "failures", "sweep", (F.col("broke") & (F.col("c") > F.col("last_high"))).alias("reclaim"),
    )


def pullback(f: DataFrame) -> DataFrame:
    """Whether a dip under the highest close of 20 bars is to be bought: seven states, with what decides them."""
    downs = F.array_sort(F.filter(F.collect_list(F.when(young(10) & (F.col("c") < F.col("o")), F.struct("i", (F.col("o") - F.col("c")).alias("b")))), lambda x: x.isNotNull()))
    a = resistance(f).groupBy("symbol").agg(
        *(at(c).alias(c) for c in ("o", "c", "v", "vsma", "ema20", "ema50")), at("c", 1).alias("pc"), F.max(F.when(young(20), F.col("c"))).alias("peak"), F.max("low_before").alias("low_before"), downs.alias("downs"),
        total("v", young(20) & (F.col("c") > F.col("o"))).alias("up_v"), total("v", young(20) & (F.col("c") < F.col("o"))).alias("down_v"),
    )
    half = F.floor(F.size("downs") / 2).cast("int")
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, d: s + d["b"], lambda s: s / F.size(x))
    a = a.withColumns({
        "depth": 100 * (F.col("peak") - F.col("c")) / F.col("peak"), "vx": F.coalesce(F.col("v") / F.col("vsma"), F.lit(1.0)), "broke": F.coalesce(F.col("c") < F.col("low_before"), F.lit(False)),
        "confirmed": F.coalesce((F.col("c") > F.col("o")) | (F.col("c") > F.col("pc")), F.lit(False)),
        "weakening": F.when(F.size("downs") >= 4, mean(F.slice("downs", half + 1, F.size("downs") - half)) < mean(F.slice("downs", F.lit(1), half))),
        "spread": (F.col("down_v") > 1.25 * F.col("up_v")),
    })
    ok = F.col("confirmed") & F.coalesce("weakening", F.lit(True))
    state = (
        F.when(F.col("ema20").isNull() | F.col("ema50").isNull(), "WAIT").when(F.col("depth") < 1.5, "NO PULLBACK").when((F.col("c") < F.col("ema50")) & F.col("broke"), "TREND BREAKDOWN")
        .when(F.col("broke") | ((F.col("vx") > 1.5) & (F.col("c") < F.col("pc"))) | F.col("spread"), "DANGEROUS").when((F.col("c") >= F.col("ema20")) & (F.col("vx") < 1) & ok, "BUY ZONE")
        .when((F.col("c") >= F.col("ema50")) & (F.col("vx") < 1.2) & ok, "HEALTHY PULLBACK").otherwise("WAIT")
    )
    return a.select("symbol", state.alias("state"), "depth", "confirmed", "weakening")


def trading(f: DataFrame, look: int = 60) -> DataFrame:
    """Share of the market's last sessions that a symbol traded in, and its gaps of more than 5 % within its own last bars."""
    market = f.select("dt").distinct().orderBy(F.desc("dt")).limit(look)
    size = market.count()  # sessions of the calendar, at most look
    seen = f.join(F.broadcast(market.withColumn("recent", F.lit(1))), "dt", "left")  # at most look rows
    gap = young(look) & F.col("pc").isNotNull() & (F.abs(F.col("o") / F.col("pc") - 1) > GAP)
    return seen.groupBy("symbol").agg((100.0 * F.count("recent") / size).alias("frequency"), F.sum(F.when(gap, 1).otherwise(0)).alias("gaps"))
