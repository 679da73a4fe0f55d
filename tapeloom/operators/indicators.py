"""Indicators over bars (symbol, dt, o, h, l, c, v). Null until there are enough bars."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import smoothing
from ..functions.nulls import ratio, ratio0
from .series import by_symbol


def trailing(n: int):
    return by_symbol().rowsBetween(1 - n, 0)


def full(value: Column, n: int, of: str = "c") -> Column:
    return F.when(F.count(of).over(trailing(n)) == n, value)


def sma(n: int, of: str = "c") -> Column:
    return full(F.avg(of).over(trailing(n)), n, of)


def bollinger(n: int, width: float) -> tuple[Column, Column, Column]:
    mean, sd = sma(n), full(F.stddev_pop("c").over(trailing(n)), n)
    return mean, mean + width * sd, mean - width * sd


def alma_weights(n: int, offset: float = 0.85, sigma: float = 6.0) -> list[float]:
    m, s = offset * (n - 1), n / sigma
    w = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]
    return [x / sum(w) for x in w]


def alma(n: int = 21) -> Column:
    """Gaussian-weighted mean of the last n closes, oldest first."""
    closes = F.collect_list("c").over(trailing(n))
    weights = F.array(*map(F.lit, alma_weights(n)))
    return full(F.aggregate(F.zip_with(closes, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), n)


def pivots(bars: DataFrame, left: int, right: int) -> DataFrame:
    """`ph` and `pl`: the high or low of a bar that is the only greatest or least from `left` before to `right` after it.

    It stands at its own bar but is known only `right` bars later; whoever must not look ahead lags it.
    """
    w = by_symbol().rowsBetween(-left, right)
    only = lambda x, list_, best: F.when((F.size(list_) == left + right + 1) & (x == best(list_)) & (F.size(F.filter(list_, lambda y: y == x)) == 1), x)
    lists = bars.withColumns({"hs": F.collect_list("h").over(w), "ls": F.collect_list("l").over(w)})
    return lists.withColumns({"ph": only(F.col("h"), F.col("hs"), F.array_max), "pl": only(F.col("l"), F.col("ls"), F.array_min)}).drop("hs", "ls")


def structure_events(bars: DataFrame, left: int, right: int) -> DataFrame:
    """Closes through the last pivot that is still whole: BOS in the direction of the break before, CHoCH against it.

    A pivot is used up by the first close that crosses it, so within the bars up to the next pivot the first crossing
    counts. A bar that breaks a high breaks no low.
    """
    p = pivots(bars, left, right).withColumns({"prev": F.lag("c").over(by_symbol())})
    p = p.withColumns({"kh": F.count("ph").over(by_symbol()), "kl": F.count("pl").over(by_symbol()), "lph": F.last("ph", True).over(by_symbol()), "lpl": F.last("pl", True).over(by_symbol())})
    c, prev = F.col("c"), F.col("prev")

    def first(cross: Column, group: str) -> Column:
        return F.coalesce(cross, F.lit(False)) & (F.sum(F.coalesce(cross, F.lit(False)).cast("int")).over(Window.partitionBy("symbol", group).orderBy("dt")) == 1)

    p = p.withColumn("up", first((c > F.col("lph")) & (F.col("lph") >= prev), "kh"))
    p = p.withColumn("down", first(~F.col("up") & (c < F.col("lpl")) & (F.col("lpl") <= prev), "kl"))
    e = p.filter("up or down").select("symbol", "dt", F.when(F.col("up"), F.col("lph")).otherwise(F.col("lpl")).alias("level"), F.when(F.col("up"), "up").otherwise("down").alias("direction"))
    against = F.lag("direction").over(by_symbol()) != F.col("direction")
    return e.withColumn("event", F.when(F.coalesce(against, F.lit(False)), "CHoCH").otherwise("BOS"))


RECURSIVE = "ema20 double, ema50 double, ema200 double, macd double, signal double, hist double, rsi14 double, atr14 double, adx14 double, plus_di double, minus_di double"


def recursive(bars: DataFrame) -> DataFrame:
    """Bars with all recursive indicators. A symbol's series is smoothed in one place, as each value needs the last.

    That is one row a session: a symbol has some thousands, however many trades stand behind them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt").reset_index(drop=True)
        c, h, l = (pdf[x].to_numpy(float) for x in "chl")
        macd = smoothing.ema(c, 12) - smoothing.ema(c, 26)
        signal = smoothing.ema(macd, 9)
        strength, plus, minus = smoothing.adx(h, l, c, 14)
        return pdf.assign(
            ema20=smoothing.ema(c, 20), ema50=smoothing.ema(c, 50), ema200=smoothing.ema(c, 200), macd=macd, signal=signal, hist=macd - signal, rsi14=smoothing.rsi(c, 14), atr14=smoothing.wilder(smoothing.true_range(h, l, c), 14),
            adx14=strength, plus_di=plus, minus_di=minus,
        )

    kept = bars.select("symbol", "dt", "o", "h", "l", "c", "v")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", " + RECURSIVE
    out = kept.groupBy("symbol").applyInPandas(run, schema)
    names = [x.split()[0] for x in RECURSIVE.split(", ")]
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def trade_levels(signal: Column, price: Column, pivot: Column, atr: Column) -> Column:
    """struct(stop, t1, t2, risk_pct): the stop at the pivot if it is on the right side, else 1.5 ATR away; 1R and 2R."""
    way = F.when(signal == "BUY", 1).otherwise(-1)
    right = F.coalesce((price - pivot) * way > 0, F.lit(False))
    stop = F.when(right, pivot).otherwise(price - way * 1.5 * atr)
    risk = (price - stop) * way
    ok = (risk > 0) & (price != 0) & (atr != 0)
    return F.struct(F.when(ok, stop).alias("stop"), F.when(ok, price + way * risk).alias("t1"), F.when(ok, price + 2 * way * risk).alias("t2"), F.when(ok, risk / price * 100).alias("risk_pct"))


def accumulation_line(bars: DataFrame, n: int = 20) -> DataFrame:
    """The accumulation/distribution line, its slope over n bars by its mean size, and up volume over down volume."""
    mf = ratio0((F.col("c") - F.col("l")) - (F.col("h") - F.col("c")), F.col("h") - F.col("l")) * F.col("v")
    b = bars.withColumns({"ad": F.sum(mf).over(by_symbol()), "i": F.row_number().over(by_symbol()), "up": F.col("c") > F.lag("c").over(by_symbol()), "down": F.col("c") < F.lag("c").over(by_symbol())})
    w = trailing(n)
    volume = lambda f: F.sum(F.when(F.col(f), F.col("v")).otherwise(0)).over(w)
    slope = F.regr_slope(F.col("ad"), F.col("i").cast("double")).over(w)
    return b.select("symbol", "dt", "ad", full(ratio0(slope, F.avg(F.abs("ad")).over(w)), n).alias("ad_slope"), full(ratio(volume("up"), volume("down")), n).alias("up_down"))


def crossovers(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Sessions on which the fast mean crosses the slow one."""
    m = bars.withColumns({"f": sma(fast), "s": sma(slow)}).withColumn("above", F.col("f") > F.col("s"))
    return m.withColumn("was", F.lag("above").over(by_symbol())).filter(F.col("above") != F.col("was")).select("symbol", "dt", F.when(F.col("above"), "up").otherwise("down").alias("cross"))


def breakouts(bars: DataFrame, n: int = 20, surge: float = 1.5) -> DataFrame:
    """Closes beyond the highest high or lowest low of the n bars before, and whether volume surged or the next close came back."""
    prior = by_symbol().rowsBetween(-n, -1)
    b = bars.withColumns({"top": F.max("h").over(prior), "bottom": F.min("l").over(prior), "mean_v": F.avg("v").over(prior), "n": F.count("c").over(prior), "next": F.lead("c").over(by_symbol())})
    up, down = F.col("c") > F.col("top"), F.col("c") < F.col("bottom")
    failed = F.when(up, F.col("next") < F.col("top")).otherwise(F.col("next") > F.col("bottom"))
    return b.filter((F.col("n") == n) & (up | down)).select("symbol", "dt", F.when(up, "up").otherwise("down").alias("side"), (F.col("v") >= surge * F.col("mean_v")).alias("surge"), failed.alias("failed"))
