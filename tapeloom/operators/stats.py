"""Descriptive statistics as aggregates and windows. A statistic without spread is 0, not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import pearson, ratio, ratio0


def herfindahl(x: Column) -> Column:
    """Sum of squared shares."""
    x = x.cast("double")
    return ratio0(F.sum(x * x), F.pow(F.sum(x), 2))


def corrected_skew(x: str) -> Column:
    """Bias-corrected skewness: 0 with fewer than 3 values or no spread."""
    n, g = F.count(x).cast("double"), F.skewness(x)
    return F.when(n < 3, 0.0).otherwise(F.coalesce(g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)), F.lit(0.0)))


def corrected_kurtosis(x: str) -> Column:
    """Bias-corrected excess kurtosis: 0 with fewer than 4 values or no spread."""
    n, g = F.count(x).cast("double"), F.kurtosis(x)
    return F.when(n < 4, 0.0).otherwise(F.coalesce((n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g + 6), F.lit(0.0)))


def nearest_rank(x: Column, p: float) -> Column:
    """The value at rank round(p (n - 1)), halves to even."""
    s = F.array_sort(F.collect_list(x))
    return F.get(s, F.bround((F.size(s) - 1) * F.lit(p)).cast("int"))


def upper_median(x: Column) -> Column:
    s = F.array_sort(F.collect_list(x))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def ranked_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """By key, the value at rank round(0.9 (n - 1)), halves to even, as nearest_rank_90, and at rank n div 2 as upper_median.

    Equal values are counted before they are put in order, so what is sorted is as long as there are unlike values.
    """
    w = Window.partitionBy(key)
    c = rows.groupBy(key, value).count().withColumns({"upto": F.sum("count").over(w.orderBy(value)), "n": F.sum("count").over(w)})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    return c.groupBy(key).agg(at(F.bround((F.col("n") - 1) * F.lit(0.9))).alias("nearest_rank_90"), at(F.floor(F.col("n") / 2)).alias("upper_median"))


#: Slices of a key's unlike values that are put in order apart.
SLICES = 64


def linear_percentiles(counted: DataFrame, key: str, value: str, n: str, points: dict[str, float]) -> DataFrame:
    """Interpolated percentiles by key: a column for each of points, {name: share}. counted has a row for each value of a key, and n, how often it occurs.

    A key's values are cut into SLICES at approximate percentiles and ordered within slices; a slice's ranks begin where the
    slices before it end. The cuts only share out the work, so results are exact, and no task or group holds all of a key.
    """
    c = counted.filter(F.col(value).isNotNull()).select(key, value, F.col(n).alias("_n"))
    cuts = c.groupBy(key).agg(F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)], 1000).alias("_cuts"))
    c = c.join(F.broadcast(cuts), key).withColumn("_slice", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")  # one row a key
    w = Window.partitionBy(key).orderBy("_slice")
    sums = c.groupBy(key, "_slice").agg(F.sum("_n").alias("_in")).withColumns({"_upto": F.sum("_in").over(w) - F.col("_in"), "_all": F.sum("_in").over(Window.partitionBy(key))})
    ranked = c.withColumn("_within", F.sum("_n").over(Window.partitionBy(key, "_slice").orderBy(value))).join(sums, [key, "_slice"])
    upto = F.col("_upto") + F.col("_within")
    at = lambda rank: F.min(F.when(upto > rank, F.col(value)))

    def point(q: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return ranked.groupBy(key).agg(*(point(q).alias(name) for name, q in points.items()))


def baseline(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sixteen statistics of a value by key; variance is the population's."""
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))
    return rows.groupBy(key).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("sd"), F.var_pop(v).alias("variance"), F.min(v).alias("least"), F.max(v).alias("most"),
        q(0.1).alias("p10"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.9).alias("p90"), (q(0.75) - q(0.25)).alias("iqr"), ratio0(F.stddev_pop(v), F.avg(v)).alias("cv"),
        F.coalesce(F.skewness(v), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(v), F.lit(0.0)).alias("kurtosis"), ratio0(F.count_if(v > 0), F.count(v)).alias("positive"),
    )


def point_in_time(rows: DataFrame, value: str, lookback: int, least: int, key: str = "symbol", order: str = "dt") -> DataFrame:
    """`z` and `pct` of a value against the `lookback` values strictly before it, null with fewer than `least`.

    pct counts half of the equal ones; z is 0 without spread. Whoever drops pct pays for no list of values; several percentiles
    at once, or a long lookback, are cheaper by panel.ranked_in_past.
    """
    prior = Window.partitionBy(key).orderBy(order).rowsBetween(-lookback, -1)
    v = F.col(value)
    r = rows.withColumns({"_prior": F.collect_list(v).over(prior), "_mean": F.avg(v).over(prior), "_sd": F.stddev_pop(v).over(prior)})
    r = r.withColumn("_n", F.count(v).over(prior))
    n = F.col("_n")
    below = F.size(F.filter("_prior", lambda x: x < v)) + 0.5 * F.size(F.filter("_prior", lambda x: x == v))
    enough = n >= least
    return r.withColumns({"pct": F.when(enough, 100 * below / n), "z": F.when(enough, F.when(F.col("_sd") < 1e-12, 0.0).otherwise(ratio0(v - F.col("_mean"), F.col("_sd"))))}).drop("_prior", "_mean", "_sd", "_n")


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1, ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    ranked = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson("rx", "ry").alias("rho"))


def weighted_quantile(levels: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """The first value at which the weights up to it reach q of all."""
    w = Window.partitionBy(*keys)
    cum = F.sum(weight).over(w.orderBy(value))
    return levels.withColumns({"_cum": cum, "_all": F.sum(weight).over(w)}).filter(F.col("_cum") >= q * F.col("_all")).groupBy(*keys).agg(F.min(value).alias(name))


def pareto(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.05, 0.10, 0.20)) -> DataFrame:
    """What the largest 5, 10 and 20 % of the rows hold, one row at least."""
    w = Window.partitionBy(*keys)
    r = rows.withColumns({"_i": F.row_number().over(w.orderBy(F.desc(value))), "_n": F.count("*").over(w)})
    held = lambda p: ratio0(F.sum(F.when(F.col("_i") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(p))), F.col(value)).otherwise(0)), F.sum(value))
    return r.groupBy(*keys).agg(*(held(p).alias(f"top{int(p * 100)}") for p in shares))


def concentration(by_broker: DataFrame, keys: list[str]) -> DataFrame:
    """Top 1, 3, 5 and 10 shares, HHI, entropy and its exponential, of buying, selling and gross."""
    one = lambda side, x: F.struct(F.lit(side).alias("side"), x.cast("double").alias("x"))
    long_ = by_broker.select(*keys, "broker", F.inline(F.array(one("buy", F.col("bought")), one("sell", F.col("sold")), one("gross", F.col("bought") + F.col("sold"))))).filter("x > 0")
    w = Window.partitionBy(*keys, "side")
    p = long_.withColumns({"i": F.row_number().over(w.orderBy(F.desc("x"), "broker")), "p": F.col("x") / F.sum("x").over(w)})
    entropy = -F.sum(F.col("p") * F.ln("p"))
    top = lambda k: F.sum(F.when(F.col("i") <= k, F.col("p")).otherwise(0.0))
    return p.groupBy(*keys, "side").agg(*(top(k).alias(f"top{k}") for k in (1, 3, 5, 10)), F.sum(F.col("p") * F.col("p")).alias("hhi"), entropy.alias("entropy"), F.exp(entropy).alias("effective"))


def volume_profile(trades: DataFrame, keys: list[str], levels: int = 24) -> DataFrame:
    """Volume by equal price steps of each key: level, its price range, volume, trades, and whether it is the point of control."""
    span = trades.groupBy(*keys).agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / levels
    level = F.least(F.floor(ratio0(F.col("rate") - F.col("lo"), step)), F.lit(levels - 1)).cast("int")
    by = trades.join(span, keys).withColumn("level", level).groupBy(*keys, "level").agg(F.sum("qty").alias("volume"), F.count("*").alias("trades"))
    w = Window.partitionBy(*keys)
    first = F.row_number().over(w.orderBy(F.desc("volume"), "level"))
    return by.withColumns({"poc": first == 1, "share": F.col("volume") / F.sum("volume").over(w), "heavy": F.col("volume") >= 1.5 * F.avg("volume").over(w)})


def value_area(profile: DataFrame, keys: list[str], covered: float = 0.70, levels: int = 24) -> DataFrame:
    """Levels around the point of control that hold `covered` of the volume, grown by the larger neighbour, upwards on ties.

    A fold over the fixed number of levels; empty levels count as 0.
    """
    packed = profile.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("level", "volume"))).alias("m"), F.sum("volume").alias("total"), F.max(F.when(F.col("poc"), F.col("level"))).alias("poc"))
    at = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))
    start = F.struct(F.col("poc").alias("lo"), F.col("poc").alias("hi"), at(F.col("poc")).alias("acc"))

    def grow(s: Column, _: Column) -> Column:
        up, down = F.when(s["hi"] < levels - 1, at(s["hi"] + 1)).otherwise(F.lit(-1).cast("long")), F.when(s["lo"] > 0, at(s["lo"] - 1)).otherwise(F.lit(-1).cast("long"))
        done = (s["acc"] >= covered * F.col("total")) | ((up < 0) & (down < 0))
        return F.when(done, s).when(up >= down, F.struct(s["lo"].alias("lo"), (s["hi"] + 1).alias("hi"), (s["acc"] + up).alias("acc"))).otherwise(F.struct((s["lo"] - 1).alias("lo"), s["hi"].alias("hi"), (s["acc"] + down).alias("acc")))

    va = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, grow)
    return packed.select(*keys, "poc", va.alias("va"), "total").select(*keys, "poc", F.col("va.lo").alias("va_low"), F.col("va.hi").alias("va_high"), F.round(F.col("va.acc") / F.col("total"), 6).alias("held"))


def large_trades(trades: DataFrame, p: float = 0.90) -> DataFrame:
    """Trades at or above each symbol's percentile of quantity: their share, brokers and how many sessions have one."""
    cuts = trades.groupBy("symbol").agg(F.percentile("qty", F.lit(p)).alias("cut"))
    t = trades.join(cuts, "symbol").withColumn("large", F.col("qty") >= F.col("cut"))
    big = lambda x: F.when(F.col("large"), x)
    return t.groupBy("symbol", "cut").agg(
        F.count_if("large").alias("n"), F.sum(big(F.col("qty"))).alias("qty"), ratio0(F.sum(big(F.col("qty"))), F.sum("qty")).alias("share"), F.count_distinct(big(F.col("buyer"))).alias("buyers"), F.count_distinct(big(F.col("seller"))).alias("sellers"),
        ratio0(F.count_distinct(big(F.col("dt"))), F.count_distinct("dt")).alias("persistence"), F.max("qty").alias("largest"),
    )


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """The pooled z statistic of two shares; 0 if it isn't defined."""
    p = ratio(x1 + x2, n1 + n2)
    return ratio0(ratio(x1, n1) - ratio(x2, n2), F.sqrt(p * (1 - p) * (ratio(F.lit(1.0), n1) + ratio(F.lit(1.0), n2))))
