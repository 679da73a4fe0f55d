"""Trade setups: the score and signal of the newest bar, replayed triggers, and price zones with their nearest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import pivots, recursive, sma, trade_levels
from .series import by_symbol
from .swing import at, frame, swings, young

#: Turnover that can be traded, cost of a round trip, bars that a trade is held, bars until a pivot is known.
LIQUID, COST, HOLD, CONFIRMED = 500_000, 0.008, 60, 5
#: Fixed values of zones: least height, stop and target in ATR, and sizes of the two fractals.
FUZZ, STOP_ATR, TARGET_R, FAST, SLOW = 0.75, 2.0, 3.0, 3, 6


def ready(bars: DataFrame) -> DataFrame:
    """swing.frame() with the mean of 200 closes and whether a bar is bullish: above it, means in order, RSI over 50, MACD over its signal."""
    f = frame(bars).withColumns({"s200": sma(200), "pma": F.lag("hist").over(by_symbol()), "e50_5": F.lag("ema50", 5).over(by_symbol()), "top20": F.max("h").over(by_symbol().rowsBetween(-20, -1))})
    c = F.col
    bull = (c("c") > c("s200")) & (F.round("ema20", 6) > F.round("ema50", 6)) & (F.round("ema50", 6) > F.round("s200", 6)) & (c("rsi14") > 50) & (F.round("macd", 6) > F.round("signal", 6))
    return f.withColumn("bull", F.coalesce(bull, F.lit(False)))


def pivot_before(lows: str, price: Column, age: Column) -> Column:
    """The newest swing low under a price that was known at an age."""
    return F.get(F.filter(lows, lambda x: (x["age"] >= age + CONFIRMED) & (x["v"] < price)), F.lit(0))["v"]


def trade_setup(bars: DataFrame) -> DataFrame:
    """One row a symbol: score, grade and signal of its newest bar, stop and targets, since when the trend holds, whether to buy still, and how a purchase then went.

    A trend trade is judged by levels that were known on its first bar; a bar that reaches stop and target counts as stopped.
    """
    f = ready(bars)
    yes = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    c = F.col
    names = ("c", "v", "s200", "ema20", "ema50", "rsi14", "macd", "signal", "hist", "pma", "adx14", "plus_di", "minus_di", "vsma", "atr14", "e50_5", "top20", "bull")
    turn = F.array_sort(F.filter(F.collect_list(F.when(young(20), c("c") * c("v"))), lambda x: x.isNotNull()))
    a = f.groupBy("symbol").agg(F.max("dt").alias("dt"), *(at(x).alias(x) for x in names), F.get(turn, F.floor(F.size(turn) / 2).cast("int")).alias("turnover"), F.coalesce(F.min(F.when((c("age") >= 1) & ~c("bull"), c("age"))), F.count("*")).alias("off"))
    a = a.join(swings(f).select("symbol", "lows"), "symbol")
    six = lambda x: F.round(x, 6)
    a = a.withColumn(
        "score",
        yes(c("c") > c("s200"), 10) + yes(six("ema50") > six("s200"), 10) + yes(six("ema20") > six("ema50"), 10) + yes(c("rsi14") > 50, 10) + yes(six("macd") > six("signal"), 10) + yes(six("hist") > six("pma"), 5) + yes(c("adx14") > 25, 10)
        + yes(six("plus_di") > six("minus_di"), 10) + yes(c("v") / c("vsma") > 1.5, 10) + yes(c("v") / c("vsma") > 2, 5) + yes(c("c") > c("top20"), 10),
    )
    is_ = lambda x: F.coalesce(x, F.lit(False))
    under = is_(c("c") < c("s200"))
    signal = (
        F.when(under & is_(six("ema50") < six("s200")), "STRONG SELL").when(is_((c("c") < c("ema50")) & (six("ema50") < six("e50_5"))), "SELL").when(is_(c("turnover") < LIQUID), "ILLIQUID").when(under | is_(c("adx14") < 20), "AVOID")
        .when(c("score") >= 90, "STRONG BUY").when(c("score") >= 80, "BUY").when(c("score") >= 60, "WATCH").when(is_((c("rsi14") < 50) & (six("macd") < six("signal"))), "SELL").otherwise("AVOID")
    )
    a = a.withColumn("verdict_", signal).withColumn("long", c("verdict_").isin("STRONG BUY", "BUY", "WATCH"))
    a = a.withColumn("x", trade_levels(F.when(c("long"), "BUY").otherwise("SELL"), c("c"), F.when(c("long"), F.get(F.filter("lows", lambda p: p["v"] < c("c")), F.lit(0))["v"]), c("atr14")))
    a = a.withColumn("days", F.when(c("bull") | c("long"), c("off") - 1))
    then = f.select("symbol", c("age").alias("days"), c("c").alias("then"), c("atr14").alias("then_atr"))
    a = a.join(then, ["symbol", "days"], "left").withColumn("p", pivot_before("lows", c("then"), c("days"))).withColumn("y", F.when(c("long") & (c("days") > 0), trade_levels(F.lit("BUY"), c("then"), c("p"), F.coalesce("then_atr", "atr14"))))
    went = f.join(a.select("symbol", "days", "y"), "symbol").filter(c("age") < c("days"))
    first = lambda test: F.max(F.when(test, c("age")))
    went = went.groupBy("symbol").agg(first(c("h") >= c("y.t1")).alias("a1"), first(c("h") >= c("y.t2")).alias("a2"), first(c("l") <= c("y.stop")).alias("as"))
    a = a.join(went, "symbol", "left")
    outcome = F.when(c("as").isNotNull() & (c("a1").isNull() | (c("as") >= c("a1"))), "stopped").when(c("a2").isNotNull() & (c("as").isNull() | (c("a2") >= c("as"))), "t2").when(c("a1").isNotNull(), "t1").otherwise("open")
    ext = (c("c") - c("then")) / c("atr14")
    grade = F.when(c("score") >= 90, "A+").when(c("score") >= 80, "A").when(c("score") >= 70, "B").when(c("score") >= 60, "Watch").otherwise("Avoid")
    return a.select(
        "symbol", "dt", c("c").alias("close"), "score", grade.alias("grade"), c("verdict_").alias("signal"), c("x.stop").alias("stop"), c("x.t1").alias("target1"), c("x.t2").alias("target2"), c("x.risk_pct").alias("risk_pct"), "days",
        (c("long") & ((c("days") <= 2) | is_(ext <= 2.5))).alias("still_buy"), F.when(c("y").isNotNull(), outcome).alias("outcome"),
    )


def trigger_replay(bars: DataFrame) -> DataFrame:
    """Every bar on which the bullish state begins: bought at the next open, sold at the stop, else at the second or first
    target, else at the close after HOLD bars or the last one. The stop is the newest swing low known by then, or 1.5 ATR."""
    f = ready(bars).withColumns({"was": F.lag("bull").over(by_symbol()), "entry": F.lead("o", 1).over(by_symbol()), "path": F.collect_list(F.struct("h", "l", "c")).over(by_symbol().rowsBetween(1, HOLD))})
    t = f.filter("bull and not was and entry > 0 and atr14 > 0").join(swings(f).select("symbol", "lows"), "symbol")
    t = t.withColumn("x", trade_levels(F.lit("BUY"), F.col("entry"), pivot_before("lows", F.col("entry"), F.col("age")), F.col("atr14"))).filter("x.stop < entry")
    far = F.lit(HOLD + 1)
    first = lambda test: F.coalesce(F.get(F.filter(F.transform("path", lambda p, i: F.when(test(p), i)), lambda i: i.isNotNull()), F.lit(0)), far)
    t = t.withColumns({"s": first(lambda p: p["l"] <= F.col("x.stop")), "a": first(lambda p: p["h"] >= F.col("x.t1")), "b": first(lambda p: p["h"] >= F.col("x.t2"))})
    hit = F.least("s", "a", "b")
    verdict = F.when(hit == far, "time").when(F.col("s") == hit, "stop").when(F.col("b") == hit, "t2").otherwise("t1")
    last = F.size("path") - 1
    exit_ = F.when(verdict == "stop", F.col("x.stop")).when(verdict == "t2", F.col("x.t2")).when(verdict == "t1", F.col("x.t1")).otherwise(F.get("path", last)["c"])
    return t.select("symbol", "dt", "entry", exit_.alias("exit"), (exit_ / F.col("entry") - 1 - COST).alias("ret"), F.when(verdict == "time", last).otherwise(hit).alias("bars"), verdict.alias("verdict"))


def zones(bars: DataFrame) -> DataFrame:
    """Supply at swing highs and demand at swing lows of both fractals, with entry, stop and target, and what became of each.

    A zone ends with its first close through the far edge. A visit begins once price has left, at a bar that touches the zone
    after one that didn't. What follows is found from a symbol's array of bars, one row a symbol, not by a join of zones and bars.
    """
    b = recursive(bars).select("symbol", "dt", "o", "h", "l", "c", "atr14").withColumn("i", F.row_number().over(by_symbol()) - 1)
    for k in (FAST, SLOW):
        b = pivots(b, k, k).withColumnsRenamed({"ph": f"ph{k}", "pl": f"pl{k}"})
    atr = F.col("atr14")
    near_s = F.least(F.greatest("o", "c"), F.col("h") - FUZZ * atr)
    near_d = F.greatest(F.least("o", "c"), F.col("l") + FUZZ * atr)
    supply = F.struct(F.lit("supply").alias("kind"), near_s.alias("lo"), F.col("h").alias("hi"), near_s.alias("entry"), (F.col("h") + STOP_ATR * atr).alias("stop"))
    demand = F.struct(F.lit("demand").alias("kind"), F.col("l").alias("lo"), near_d.alias("hi"), near_d.alias("entry"), (F.col("l") - STOP_ATR * atr).alias("stop"))
    high, low = F.coalesce(f"ph{FAST}", f"ph{SLOW}").isNotNull(), F.coalesce(f"pl{FAST}", f"pl{SLOW}").isNotNull()
    z = b.filter(atr.isNotNull() & (high | low)).select("symbol", "i", F.inline(F.array_compact(F.array(F.when(high, supply), F.when(low, demand)))))
    z = z.withColumn("target", F.col("entry") - TARGET_R * (F.col("stop") - F.col("entry")))
    series = b.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("i", "h", "l", "c"))).alias("all"))
    z = z.join(series, "symbol").withColumn("after", F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0))))
    start = F.struct(F.lit(False).alias("broken"), F.lit(False).alias("gone"), F.lit(False).alias("inside"), F.lit(0).alias("visits"))

    def step(s: Column, x: Column) -> Column:
        through = F.when(F.col("kind") == "supply", x["c"] > F.col("hi")).otherwise(x["c"] < F.col("lo"))
        hit = (x["h"] >= F.col("lo")) & (x["l"] <= F.col("hi"))
        walked = F.struct(F.lit(False).alias("broken"), (s["gone"] | ~hit).alias("gone"), (s["gone"] & hit).alias("inside"), (s["visits"] + F.when(s["gone"] & hit & ~s["inside"], 1).otherwise(0)).alias("visits"))
        return F.when(s["broken"], s).when(through, F.struct(F.lit(True).alias("broken"), s["gone"].alias("gone"), s["inside"].alias("inside"), s["visits"].alias("visits"))).otherwise(walked)

    z = z.withColumn("w", F.aggregate("after", start, step))
    state = F.when(F.col("w.broken"), "turncoat").when(F.col("w.visits") == 0, "untested").when(F.col("w.visits") == 1, "strong").otherwise("weak")
    return z.select("symbol", "kind", F.col("i").cast("long").alias("bar"), "lo", "hi", "entry", "stop", "target", F.col("w.visits").alias("visits"), state.alias("state"))


def nearest_zone(bars: DataFrame) -> DataFrame:
    """The live zone nearest to a symbol's newest close, worn ones last, whose target is a price; and whether the bar touches it."""
    now = bars.groupBy("symbol").agg(F.max_by(F.struct("h", "l", "c"), "dt").alias("n"), (F.count("*") - 1).alias("last"))
    z = zones(bars).filter("state != 'turncoat' and target > 0").join(now, "symbol")
    best = Window.partitionBy("symbol").orderBy(F.col("state") == "weak", F.round(F.abs(F.col("entry") - F.col("n.c")), 6), "bar", "kind")
    z = z.withColumn("k", F.row_number().over(best)).filter("k = 1")
    touched = F.when(F.col("kind") == "demand", F.col("n.l") <= F.col("entry")).otherwise(F.col("n.h") >= F.col("entry"))
    return z.select(
        "symbol", "kind", "state", "visits", (F.col("last") - F.col("bar")).alias("age"), "entry", "stop", "target", F.when(touched, F.when(F.col("kind") == "demand", "BUY").otherwise("SELL")).otherwise("WATCH").alias("signal"),
        ((F.col("n.c") >= F.col("lo")) & (F.col("n.c") <= F.col("hi"))).alias("in_zone"), (100 * (F.col("entry") - F.col("n.c")) / F.col("n.c")).alias("dist_pct"), (100 * F.abs(F.col("entry") - F.col("stop")) / F.col("entry")).alias("risk_pct"),
    )
