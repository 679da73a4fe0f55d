"""Checks of an archive against itself and against the live feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import adjusted, by_symbol, forward_path

#: A fall in percent that no session allows, and how near a book closure it is put down to that (as yyyymmdd numbers).
CIRCUIT, NEAR = -10.5, 120


def positive_bars(bars: DataFrame) -> DataFrame:
    """Bars as they were traded, those with a positive high, low and close."""
    return bars.filter("h > 0 and l > 0 and c > 0")


def unclassified(traded: DataFrame, known: DataFrame) -> DataFrame:
    """Symbols that trade and that no list knows."""
    return traded.select("symbol").distinct().join(known.select("symbol"), "symbol", "left_anti")


def day_number(d: Column) -> Column:
    return F.year(d) * 10_000 + F.month(d) * 100 + F.dayofmonth(d)


def restatement_audit(bars: DataFrame, closures: DataFrame) -> DataFrame:
    """Falls beyond the circuit, and whether a book closure of the symbol is near. Bars and closures meet in one window over
    both, where the last and the next closure are all that matter; they are never paired."""
    b = bars.select("symbol", "dt", "c", F.lag("c").over(by_symbol()).alias("prev")).withColumns({"pct": 100 * (F.col("c") / F.col("prev") - 1), "e": F.lit(None).cast("int")})
    u = b.unionByName(closures.select("symbol", "dt", day_number(F.col("dt")).alias("e")), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("dt")
    since = day_number(F.col("dt")) - F.last("e", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    until = F.first("e", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)) - day_number(F.col("dt"))
    near = F.coalesce(F.least(since, until) < NEAR, F.lit(False))
    return u.withColumn("near", near).filter((F.col("prev") > 0) & (F.col("pct") < CIRCUIT)).select("symbol", "dt", "pct", "near")


def survivorship(bars: DataFrame, first_by: str, least: int, stride: int = 5, hold: int = 20) -> DataFrame:
    """What symbols listed after a date returned over `hold` bars against those listed before, on every stride-th session of the market: adjusted bars, entry at the next open."""
    who = bars.groupBy("symbol").agg(F.min("dt").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= least).select("symbol", F.when(F.col("first") <= F.lit(first_by), "qualifying").otherwise("late").alias("listed"))
    grid = bars.select("dt").distinct().withColumn("k", F.row_number().over(Window.orderBy("dt")) - 1).filter(F.col("k") % stride == 0).select("dt")  # one row a session of the market
    f = forward_path(adjusted(bars), hold).withColumn("ret", F.col("exit") / F.col("entry") - 1).join(grid, "dt").join(who, "symbol")
    return f.groupBy("listed").agg(F.count_distinct("symbol").alias("symbols"), F.count("*").alias("n"), F.avg("ret").alias("mean"), F.median("ret").alias("median"), F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"))


def rank_in_sample(series: DataFrame, value: str, width: int = 7) -> DataFrame:
    """Where a symbol's newest mean of `width` sessions stands among all its own: 0 to 1, half of the equal ones below; 0.5 with fewer than five."""
    w = by_symbol().rowsBetween(1 - width, 0)
    m = series.select("symbol", "dt", F.round(F.avg(value).over(w), 9).alias("m"), F.count(value).over(w).alias("k")).filter(F.col("k") == width)
    m = m.withColumn("now", F.max_by("m", "dt").over(Window.partitionBy("symbol")))
    below = F.count_if(F.col("m") < F.col("now")) + 0.5 * F.count_if(F.col("m") == F.col("now"))
    return m.groupBy("symbol").agg(F.max("now").alias("value"), F.when(F.count("*") < 5, 0.5).otherwise(below / F.count("*")).alias("rank"))


def feed_name(name: Column, aliases: dict[str, str]) -> Column:
    """The feed's name of an archive's instrument; the same where no alias is known."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[name], name)


def live_overlay(stored: DataFrame, quotes: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Each instrument's newest bar with the feed's quote laid over it. A quote that is stamped with another day than the bar's
    is left out: the snapshot outlives its session. `live` says whether a quote was taken."""
    newest = stored.groupBy("instrument").agg(F.max_by(F.struct("day", "o", "h", "l", "c"), "day").alias("b")).select("instrument", "b.*").withColumn("feed", feed_name(F.col("instrument"), aliases))
    q = quotes.select(F.col("instrument").alias("feed"), F.to_date("ts").alias("stamp"), F.col("price").alias("q"))
    j = newest.join(q, "feed", "left").withColumn("live", F.coalesce(F.col("stamp") == F.col("day"), F.lit(False)))
    over = lambda c, x: F.when(F.col("live"), x).otherwise(F.col(c)).alias(c)
    return j.select("instrument", "day", "o", over("h", F.greatest("h", "q")), over("l", F.least("l", "q")), over("c", F.col("q")), "live")
