"""Bars and other time series: resampling, gap filling, corporate-action adjustment, returns and forward paths."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.nulls import micro, ratio



def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("dt")


#: Fixed values of the ex-date rule: gap, smallest factor, days apart.
GAP, LEAST_FACTOR, MAX_DAYS = -0.105, 0.2, 60


def crude_days(a: Column, b: Column) -> Column:
    """Days from a to b, counting years as 365 and months as 30 days."""
    part = lambda f: f(b) - f(a)
    return 365 * part(F.year) + 30 * part(F.month) + part(F.dayofmonth)


def ex_dates(bars: DataFrame) -> DataFrame:
    """Bars whose open and close both gap down by 10.5 % or more, with the price factor from close to close: a bonus or a split."""
    prev, prev_dt = F.lag("c").over(by_symbol()), F.lag("dt").over(by_symbol())
    marked = bars.withColumns({"prev": prev, "prev_dt": prev_dt}).withColumn("factor", ratio(F.col("c"), F.col("prev")))
    return marked.filter((F.col("prev") > 0) & (F.col("o") / F.col("prev") - 1 <= GAP) & (F.col("c") / F.col("prev") - 1 <= GAP) & (F.col("factor") >= LEAST_FACTOR) & (crude_days(F.col("prev_dt"), F.col("dt")) <= MAX_DAYS)).select("symbol", "dt", "factor")


@F.pandas_udf(DoubleType())
def exponential(x: pd.Series) -> pd.Series:
    """e ** x as the C library and SQL have it; Spark's exp() is often the double beside it."""
    return x.map(math.exp)


def adjusted(bars: DataFrame) -> DataFrame:
    """Prices of every bar times the factors of all later ex-dates; volume stays.

    Logarithms of the factors add up over the following rows, in one window from the newest bar back. They add up as whole
    numbers (12 places), so that bars between the same ex-dates have the very same factor. The close of an ex-date and the
    one before it are equal but for the last bit, so that a comparison of the two needs the factors of SQL bit by bit.
    """
    marked = bars.join(ex_dates(bars), ["symbol", "dt"], "left")
    later = Window.partitionBy("symbol").orderBy(F.desc("dt")).rowsBetween(Window.unboundedPreceding, -1)
    power = F.coalesce(F.sum(F.round(F.ln("factor") * F.lit(1e12)).cast("long")).over(later), F.lit(0)) / F.lit(1e12)
    return marked.withColumn("power", power).withColumn("adj", exponential("power")).select("symbol", "dt", *((F.col(c) * F.col("adj")).alias(c) for c in "ohlc"), "v", "amount", "adj")


def bar_changes(bars: DataFrame) -> DataFrame:
    """Change and change in percent against the last close before that isn't null, to 2 places."""
    prev = F.last("c", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    change = F.col("c") - prev
    return bars.withColumns({"change": F.round(change, 2), "pct": F.round(100 * ratio(change, prev), 2)})


def newest_versions(*versions: DataFrame) -> DataFrame:
    """Bars of several writes, oldest first: of each (symbol, dt) the one written last. One pass over all of them, however many."""
    cols = ["symbol", "dt", "o", "h", "l", "c", "v", "amount"]
    rows = None
    for i, x in enumerate(versions):
        x = x.select(*cols, F.lit(i).alias("version"))
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy("symbol", "dt").agg(F.max_by(F.struct(*cols[2:]), "version").alias("x")).select("symbol", "dt", "x.*")


def upsert_bars(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the bars of new's (symbol, dt), add the others, and derive changes anew. Doing it twice changes nothing."""
    return bar_changes(newest_versions(stored, new))


def upsert_partition(stored: DataFrame, new: DataFrame, key: str = "dt") -> DataFrame:
    """Replace whole sessions: rows of stored in new's sessions go, whoever they are about."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def minute_bars(ticks: DataFrame, step: int = 1, by_day: bool = False) -> DataFrame:
    """One bar for each instrument and step of so many minutes, opened and closed by the order of seq.

    by_day: the bars have their `day` too and lie by instrument and day, so that what follows by day moves no row again.
    """
    minute = F.date_trunc("minute", "ts") if step == 1 else F.window("ts", f"{step} minutes").start
    t, keys = ticks.withColumn("minute", minute), ["instrument", "minute"]
    if by_day:
        t, keys = t.withColumn("day", F.to_date("minute")).repartition("instrument", "day"), ["instrument", "day", "minute"]
    return t.groupBy(*keys).agg(
        F.min_by("price", "seq").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "seq").alias("c"), F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("amount")
    )


def filled_minutes(minutes: DataFrame, step: int = 1) -> DataFrame:
    """A flat bar without trades for each step of minutes that is missing between an instrument's first and last of a day.

    Each bar makes the bars that are missing up to the next one, so only bars with trades are sent to their day and sorted.
    Bars of no instrument have no values, as they match none.
    """
    w = Window.partitionBy("instrument", "day").orderBy("minute")
    gap, named = F.expr(f"interval {step} minutes"), F.col("instrument").isNotNull()
    have = (minutes if "day" in minutes.columns else minutes.withColumn("day", F.to_date("minute"))).filter("minute is not null")
    have = have.withColumns({"close": F.when(named, F.last("c", ignorenulls=True).over(w)), "upto": F.greatest(F.coalesce(F.lead("minute").over(w) - gap, F.col("minute")), F.col("minute"))})
    each = have.withColumn("at", F.explode(F.sequence("minute", "upto", gap)))
    own = lambda x: F.when(named & (F.col("at") == F.col("minute")), F.col(x))
    return each.select("instrument", F.col("at").alias("minute"), *(F.coalesce(own(x), F.col("close")).alias(x) for x in "ohl"), F.col("close").alias("c"), F.coalesce(own("n"), F.lit(0)).alias("n"))


def resampled(ticks: DataFrame, minutes: int) -> DataFrame:
    """Bars over buckets of so many minutes from midnight."""
    bucket = F.window("ts", f"{minutes} minutes").start
    return ticks.groupBy("instrument", bucket.alias("bucket")).agg(F.min_by("price", "seq").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "seq").alias("c"), F.count("*").alias("n"))


def resampled_all(ticks: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """Bars of several step lengths `m` in minutes, by UTC, from one scan: 1-minute bars are made first and then put together."""
    last = F.max_by(F.struct("price"), "seq").price
    minutes = ticks.groupBy("instrument", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min_by("price", "seq").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), last.alias("c"), F.count("*").alias("n"), F.min("seq").alias("s0"), F.max("seq").alias("s1")
    )
    each = minutes.withColumn("m", F.explode(F.array(*map(F.lit, steps))))
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("minute") / (F.col("m") * 60)) * F.col("m") * 60)
    return each.groupBy("instrument", bucket.alias("bucket"), "m").agg(F.min_by("o", "s0").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "s1").alias("c"), F.sum("n").alias("n"))


def vwap_returns(bars: DataFrame, circuit: float = 0.20) -> DataFrame:
    """Log returns of the average price; one beyond the circuit is an artefact and counts as 0."""
    v = bars.withColumn("vwap", ratio(F.col("amount"), F.col("v")))
    r = F.ln(ratio(F.col("vwap"), F.lag("vwap").over(by_symbol())))
    return v.select("symbol", "dt", "vwap", F.when(F.abs(r) > circuit, 0.0).otherwise(r).alias("ret"))


def market_bars(bars: DataFrame) -> DataFrame:
    """The market as one series: average close by session. One row a session, so a single series is small."""
    return bars.groupBy("dt").agg(F.avg("c").alias("c"), F.sum("v").alias("v"), F.count("*").alias("symbols"))


def market_regime(index: DataFrame, n: int = 20) -> DataFrame:
    """Whether the index closes above its mean of n sessions; null until there are n."""
    w = Window.orderBy("dt").rowsBetween(1 - n, 0)
    return index.select("dt", "c", F.when(F.count("c").over(w) == n, F.avg("c").over(w)).alias("mean")).withColumn("up", F.col("c") > F.col("mean"))


def forward_path(bars: DataFrame, horizon: int) -> DataFrame:
    """For each session: the next open, and closes, highest high and lowest low of the next `horizon` bars."""
    ahead = by_symbol().rowsBetween(1, horizon)
    return bars.select(
        "symbol", "dt", F.lead("o", 1).over(by_symbol()).alias("entry"), F.lead("c", horizon).over(by_symbol()).alias("exit"), F.max("h").over(ahead).alias("best"), F.min("l").over(ahead).alias("worst"), F.count("c").over(ahead).alias("bars")
    ).filter(F.col("bars") == horizon)


def last_two(bars: DataFrame) -> DataFrame:
    """The newest bar of a symbol with the close before it, its change, and turnover (close times volume without one)."""
    w = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    r = bars.select("symbol", "dt", "c", "v", "amount", F.lead("c").over(w).alias("prev"), F.row_number().over(w).alias("age")).filter("age = 1")
    turnover = F.coalesce(F.nullif(F.col("amount"), F.lit(0.0)), F.col("c") * F.col("v"))
    return r.select("symbol", "dt", micro(F.col("c")).alias("c"), micro(100 * ratio(F.col("c") - F.col("prev"), F.col("prev"))).alias("pct"), F.round(turnover, 2).alias("turnover"))
