"""Event replay and factor research: triggers, outcomes, buckets, information coefficients, controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import pearson, ratio0
from .indicators import recursive, sma
from .series import by_symbol
from .stats import average_rank

COST, MAX_HOLD = 0.008, 60


def bull_state(bars: DataFrame) -> DataFrame:
    """Whether a session is in the bull state: above its long mean, means in order, RSI over 50, MACD over its signal."""
    b = recursive(bars).withColumn("long", sma(50))
    c = F.col
    state = (c("c") > c("long")) & (c("ema20") > c("ema50")) & (F.round("ema50", 6) > F.round("long", 6)) & (c("rsi14") > 50) & (c("macd") > c("signal"))
    return b.withColumn("bull", F.coalesce(state, F.lit(False)))


def edges(states: DataFrame, state: str) -> DataFrame:
    """Sessions on which a state begins."""
    return states.withColumn("was", F.lag(state).over(by_symbol())).filter(F.col(state) & ~F.col("was")).drop("was")


def replay(bars: DataFrame, signal: Column, hold: int = 20, risk: float = 0.05, reward: float = 2.0, cost: float = COST) -> DataFrame:
    """Enter at the next open after a signal; leave at the stop, else at the target, else at the close after `hold` bars.

    A bar that reaches both counts as stopped. The path of each signal is a window of fixed length behind it.
    """
    w = by_symbol().rowsBetween(1, hold)
    p = bars.withColumns({"_s": signal, "entry": F.lead("o", 1).over(by_symbol()), "path": F.collect_list(F.struct("h", "l", "c")).over(w)}).filter(F.col("_s") & (F.size("path") == hold))
    p = p.withColumns({"stop": F.col("entry") * (1 - risk), "target": F.col("entry") * (1 + reward * risk)})
    first = lambda test: F.coalesce(F.get(F.filter(F.transform("path", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(hold))
    p = p.withColumns({"s": first(lambda x: x["l"] <= F.col("stop")), "t": first(lambda x: x["h"] >= F.col("target"))})
    verdict = F.when((F.col("s") < hold) & (F.col("s") <= F.col("t")), "stop").when(F.col("t") < hold, "target").otherwise("time")
    exit_ = F.when(verdict == "stop", F.col("stop")).when(verdict == "target", F.col("target")).otherwise(F.get("path", F.lit(hold - 1))["c"])
    return p.select("symbol", "dt", "entry", exit_.alias("exit"), (exit_ / F.col("entry") - 1 - cost).alias("ret"), (F.least("s", "t", F.lit(hold - 1)) + 1).alias("bars"), verdict.alias("verdict"))


def variants(trades: DataFrame, conditions: dict[str, Column], cut: str = "2000-01-01") -> DataFrame:
    """Each variant's trades before and after a date, all in one pass: a trade is exploded into the variants it meets."""
    tags = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))
    t = trades.select("*", F.explode(tags).alias("variant")).withColumn("sample", F.when(F.col("dt") < F.lit(cut), "in").otherwise("out"))
    win = F.col("ret") > 0
    return t.groupBy("variant", "sample").agg(
        F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.median("ret"), 6).alias("median"), F.round(F.avg(win.cast("int")), 6).alias("win_rate"),
        F.round(ratio0(F.sum(F.when(win, F.col("ret")).otherwise(0.0)), -F.sum(F.when(win, 0.0).otherwise(F.col("ret")))), 4).alias("profit_factor"),
    )


def same_day_rank(rows: DataFrame, value: str, tie: str = "symbol") -> Column:
    """(i + 1/2) / n among the rows of one session."""
    w = Window.partitionBy("dt")
    return (F.row_number().over(w.orderBy(value, tie)) - 0.5) / F.count("*").over(w)


def labelled(series: DataFrame, horizon: int = 5) -> DataFrame:
    """A series with the return from the next close over so many sessions."""
    return series.withColumn("fwd", F.lead("c", horizon).over(by_symbol()) / F.col("c") - 1).filter("fwd is not null")


def buckets(rows: DataFrame, value: str, outcome: str, n: int) -> DataFrame:
    """Outcome by n equal buckets of a value over all rows, the first taking what doesn't divide.

    Buckets are cut from exact percentiles, which are aggregates; no row is ranked against all others in one task.
    """
    cuts = rows.agg(F.percentile(value, F.array(*(F.lit(i / n) for i in range(1, n)))).alias("cuts"))
    b = rows.join(F.broadcast(cuts))  # one row
    k = F.size(F.filter("cuts", lambda c: c < F.col(value))) + 1
    return b.groupBy(k.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(outcome), 6).alias("mean"), F.round(F.median(outcome), 6).alias("median"), F.round(F.avg((F.col(outcome) > 0).cast("int")), 6).alias("win_rate"))


def information(rows: DataFrame, value: str, outcome: str) -> DataFrame:
    """Rank correlation within each session."""
    r = rows.select("dt", average_rank(value, ["dt"]).alias("rx"), average_rank(outcome, ["dt"]).alias("ry"))
    return r.groupBy("dt").agg(F.count("*").alias("n"), F.round(pearson("rx", "ry"), 6).alias("ic"))


def demeaned(rows: DataFrame, member: Column, outcome: str) -> DataFrame:
    """What members of a family earn beyond their session, and beyond its other members."""
    w = Window.partitionBy("dt")
    m = member.cast("int")
    r = rows.withColumns({"_m": m, "_mean": F.avg(outcome).over(w), "_s": F.sum(outcome).over(w), "_n": F.count(outcome).over(w)})
    r = r.withColumns({"_fs": F.sum(F.col("_m") * F.col(outcome)).over(w), "_fn": F.sum("_m").over(w)})
    rest = (F.col("_s") - F.col("_fs")) / F.nullif(F.col("_n") - F.col("_fn"), F.lit(0))
    f = r.filter("_m = 1")
    return f.groupBy(F.year("dt").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg(outcome), 6).alias("mean"), F.round(F.avg(F.col(outcome) - F.col("_mean")), 6).alias("excess"), F.round(F.avg(F.col(outcome) - rest), 6).alias("excess_of_rest"))


def walk_forward(rows: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """For each year and feature: its correlation with the outcome in all earlier years and in that year."""
    long_ = rows.select(F.year("dt").alias("year"), outcome, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features)))).filter("x is not null")
    y = F.col(outcome)
    sums = long_.groupBy("feature", "year").agg(F.count("x").alias("n"), F.sum("x").alias("sx"), F.sum(y).alias("sy"), F.sum(F.col("x") * y).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(y * y).alias("syy"))
    prior = Window.partitionBy("feature").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    parts = ["n", "sx", "sy", "sxy", "sxx", "syy"]
    s = sums.withColumns({f"p_{c}": F.sum(c).over(prior) for c in parts})

    def corr(p: str) -> Column:
        n, sx, sy, sxy, sxx, syy = (F.col(p + c) for c in parts)
        return ratio0(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))

    return s.filter("p_n is not null").select("feature", "year", "n", F.round(corr("p_"), 5).alias("train_ic"), F.round(corr(""), 5).alias("test_ic"))


def permutation_control(rows: DataFrame, member: str, outcome: str, draws: int, seed: int = 7) -> DataFrame:
    """How often as many random rows of the same sessions do at least as well as the members.

    Each draw shuffles within sessions by a hash of (seed, draw, row), so it doesn't depend on how rows are partitioned.
    """
    n = F.sum(F.col(member).cast("int")).over(Window.partitionBy("dt"))
    r = rows.select("symbol", "dt", outcome, member).withColumn("k", n).filter("k > 0")
    d = r.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = F.xxhash64(F.lit(seed), "draw", "symbol", "dt")
    picked = d.withColumn("i", F.row_number().over(Window.partitionBy("draw", "dt").orderBy(order, "symbol"))).filter("i <= k")
    by_draw = picked.groupBy("draw").agg(F.avg(outcome).alias("drawn"))
    real = r.filter(member).agg(F.avg(outcome).alias("real"), F.count("*").alias("n"))
    return by_draw.join(F.broadcast(real)).groupBy("real", "n").agg(F.count("*").alias("draws"), F.count_if(F.col("drawn") >= F.col("real")).alias("as_good"), F.avg("drawn").alias("control"))  # one row
