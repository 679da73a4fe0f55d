"""Flow through time: sides, runs, phases, divergences, regimes. Series are one row for each symbol and session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import micro, pearson, ratio, ratio0, sign
from .series import by_symbol


def stock_series(flow: DataFrame, bars: DataFrame) -> DataFrame:
    """Per session: volume, churn, tilt ((largest net + smallest net) / volume), breadth, close and its return."""
    f = flow.groupBy("symbol", "dt").agg(
        F.sum("bought").alias("volume"), ((F.max("net") + F.min("net")) / F.sum("bought")).alias("tilt"), (F.sum(F.greatest("net", F.lit(0))) / F.sum("bought")).alias("churn"), (F.count_if(F.col("net") > 0) / F.count("*")).alias("breadth")
    )
    return f.join(bars.select("symbol", "dt", "c", "amount"), ["symbol", "dt"]).withColumns({"ret": F.col("c") / F.lag("c").over(by_symbol()) - 1, "i": F.row_number().over(by_symbol())})


def runs(rows: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Gaps and islands: `run` numbers stretches of equal labels within the keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")
    return rows.withColumn("run", F.sum(new).over(w))


def persistence(series: DataFrame, value: str = "tilt", band: float = 0.001) -> DataFrame:
    """Runs of one side, flips that ignore neutral sessions, the share of sessions on the side of the mean, and stability."""
    s = series.withColumn("side", sign(F.col(value), band))
    lengths = runs(s, ["symbol"], "dt", "side").groupBy("symbol", "run", "side").agg(F.count("*").alias("n"))
    longest = lambda x: F.coalesce(F.max(F.when(F.col("side") == x, F.col("n"))), F.lit(0))
    r = lengths.groupBy("symbol").agg(F.count("*").alias("runs"), longest(1).alias("longest_buy"), longest(-1).alias("longest_sell"))
    taken = s.filter("side != 0").withColumn("was", F.lag("side").over(by_symbol()))
    flips = taken.groupBy("symbol").agg(F.count_if(F.col("side") != F.col("was")).alias("flips"))
    mean = F.avg(value)
    a = s.groupBy("symbol").agg(F.count("*").alias("n"), mean.alias("mean"), F.avg(F.abs(value)).alias("size"), F.stddev_pop(value).alias("sd"), F.count_if(F.col("side") == 1).alias("up"), F.count_if(F.col("side") == -1).alias("down"))
    on = F.when(F.col("mean") > 0, F.col("up")).otherwise(F.col("down"))
    return a.join(r, "symbol").join(flips, "symbol", "left").select("symbol", "runs", "longest_buy", "longest_sell", F.coalesce("flips", F.lit(0)).alias("flips"), F.round(on / F.col("n"), 6).alias("consistency"), F.round(1 / (1 + ratio0(F.col("sd"), F.col("size"))), 6).alias("stability"))


def side_description(flow: DataFrame) -> DataFrame:
    """Each broker's accumulation in a symbol: sessions on the side, quantity, longest and current streak, later half against earlier."""
    s = flow.withColumn("side", sign(F.col("net")))
    w = Window.partitionBy("symbol", "broker").orderBy("dt")
    r = runs(s, ["symbol", "broker"], "dt", "side").withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("symbol", "broker"))})
    streak = r.groupBy("symbol", "broker", "run", "side").agg(F.count("*").alias("len"), F.max("i").alias("end"), F.max("n").alias("n"))
    st = streak.groupBy("symbol", "broker").agg(F.coalesce(F.max(F.when(F.col("side") == 1, F.col("len"))), F.lit(0)).alias("max_streak"), F.coalesce(F.max(F.when((F.col("end") == F.col("n")) & (F.col("side") == 1), F.col("len"))), F.lit(0)).alias("streak"))
    late = F.col("i") * 2 > F.col("n")
    a = r.groupBy("symbol", "broker").agg(
        F.count("*").alias("days"), F.count_if(F.col("side") == 1).alias("buy_days"), F.sum(F.greatest("net", F.lit(0))).alias("bought_net"), F.max(F.greatest("net", F.lit(0))).alias("peak"),
        F.sum(F.when(late, F.col("net")).otherwise(0)).alias("late_net"), F.sum(F.when(late, 0).otherwise(F.col("net"))).alias("early_net"),
    )
    return a.join(st, ["symbol", "broker"])


#: The band of a mean that is no direction, and where phases of the short mean over the long one end.
NEUTRAL, EXHAUSTED, WEAK, HOT = 0.001, 0.25, 0.75, 1.25


def phase(m_short: Column, m_long: Column) -> Column:
    """How the short mean stands to the long one: exhausted (also when it turned), weakening, persistent or accelerating; flat where the long one has no direction."""
    r = ratio(m_short, m_long)
    return F.when(F.abs(m_long) <= NEUTRAL, "flat").when(r <= EXHAUSTED, "exhausted").when(r < WEAK, "weakening").when(r <= HOT, "persistent").otherwise("accelerating")


def accelerations(series: DataFrame, value: str = "tilt") -> DataFrame:
    mean = lambda n: F.avg(value).over(by_symbol().rowsBetween(1 - n, 0))
    s = series.withColumns({f"m{n}": mean(n) for n in (3, 7, 15, 30)}).filter("i >= 30")
    first = F.when(F.signum("m3") != F.signum("m7"), 7).when(F.signum("m3") != F.signum("m15"), 15).when(F.signum("m3") != F.signum("m30"), 30)
    moved = F.abs(F.col("m3") - F.col("m30")) > 0.25 * F.greatest(F.abs("m3"), F.abs("m30"))
    return s.select("symbol", "dt", *(F.round(f"m{n}", 6).alias(f"m{n}") for n in (3, 7, 15, 30)), phase(F.col("m3"), F.col("m30")).alias("phase"), first.alias("first_flip"), F.when(moved, "moving").otherwise("stable").alias("pattern"))


def flow_shape(series: DataFrame, value: str = "net_flow") -> DataFrame:
    """The running sum of a flow: its peak, deepest fall from a peak, and how much of that fall came back."""
    s = series.withColumn("cum", F.sum(value).over(by_symbol()))
    s = s.withColumn("peak", F.greatest(F.max("cum").over(by_symbol()), F.lit(0)))
    s = s.withColumn("fall", F.col("peak") - F.col("cum"))
    return s.groupBy("symbol").agg(F.max("peak").alias("peak"), F.max("fall").alias("drawdown"), F.min_by("dt", F.struct(-F.col("fall"), "dt")).alias("trough"), F.max_by("cum", "dt").alias("final"), F.max_by("fall", "dt").alias("below_peak"), F.round(ratio0(F.max("fall") - F.max_by("fall", "dt"), F.max("fall")), 6).alias("recovered"))


def divergences(series: DataFrame, n: int = 7) -> DataFrame:
    """Sessions on which price and flow lean apart over n rows, by the signs of their slopes."""
    w = by_symbol().rowsBetween(1 - n, 0)
    i = F.col("i").cast("double")
    s = series.withColumns({"price": F.regr_slope(F.col("c"), i).over(w), "lean": F.regr_slope(F.col("tilt"), i).over(w), "level": F.avg("tilt").over(w), "k": F.count("c").over(w)}).filter(F.col("k") == n)
    p, f = F.round("price", 9), F.round("lean", 9)
    kind = F.when((p > 0) & (f < 0) & (F.round("level", 9) < 0), "distribution into strength").when((p < 0) & (f > 0) & (F.round("level", 9) > 0), "accumulation into weakness").when((p > 0) & (f < 0), "bearish").when((p < 0) & (f > 0), "bullish")
    return s.filter(kind.isNotNull()).select("symbol", "dt", kind.alias("kind"), micro(p).alias("price_slope"), micro(f).alias("flow_slope"))


def lag_scan(series: DataFrame, most: int = 10) -> DataFrame:
    """Correlation of a session's tilt with the return so many sessions later. One equi-join for each lag, all in one."""
    a = series.select("symbol", "i", "tilt", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag")).withColumn("at", F.col("i") + F.col("lag"))
    b = series.select("symbol", F.col("i").alias("at"), "ret")
    return a.join(b, ["symbol", "at"]).filter("ret is not null").groupBy("symbol", "lag").agg(F.count("*").alias("n"), F.round(pearson("tilt", "ret"), 6).alias("corr"))


def session_measures(flow: DataFrame) -> DataFrame:
    """What regimes are read from, by session: tilt and concentration (shares of the largest net buyer and seller), volume, brokers, mean size of a trade."""
    v = F.sum("bought")
    return flow.groupBy("symbol", "dt").agg(
        ((F.max("net") + F.min("net")) / v).alias("tilt"), ((F.max("net") - F.min("net")) / v).alias("concentration"), v.cast("double").alias("volume"), F.count("*").cast("double").alias("brokers"), (2 * v / F.sum("trades")).alias("size")
    )


def regimes(measures: DataFrame, n: int = 7, lookback: int = 250, least: int = 60, band: float = 0.5) -> DataFrame:
    """Each session's trailing n sessions as accumulation, distribution or neutral, by the z of mean tilt against earlier
    windows, with tags where another mean lies a deviation off, and for how tilt stands to the window before.

    Nothing but windows that ended before a session is in its baseline; sessions without `least` of them have no row.
    """
    from .stats import point_in_time

    w = by_symbol().rowsBetween(1 - n, 0)
    s = measures.select("symbol", "dt", F.row_number().over(by_symbol()).alias("i"), *(F.avg(c).over(w).alias(c) for c in ("tilt", "volume", "concentration", "brokers", "size")))
    for x in ("tilt", "volume", "concentration", "brokers", "size"):
        s = point_in_time(s, x, lookback, least).withColumn(f"z_{x}", F.round("z", 6)).drop("z", "pct")
    s = s.withColumn("before", F.lag("tilt", n).over(by_symbol()))
    high = lambda x, name: F.when(F.col(f"z_{x}") >= 1, name)
    low = lambda x, name: F.when(F.col(f"z_{x}") <= -1, name)
    turn = (
        F.when(F.col("before") * F.col("tilt") < 0, "flow reversal").when((F.abs("tilt") > 1.5 * F.abs("before")) & (F.abs("before") > 1e-9), "flow acceleration").when(F.abs("tilt") < 0.5 * F.abs("before"), "flow deterioration")
    )
    tags = F.array_compact(F.array(F.coalesce(high("volume", "high volume"), low("volume", "low volume")), high("concentration", "high concentration"), high("brokers", "broad participation"), F.coalesce(high("size", "high trade size"), low("size", "low trade size")), turn))
    label = F.when(F.col("z_tilt") >= band, "accumulation").when(F.col("z_tilt") <= -band, "distribution").otherwise("neutral")
    return s.filter((F.col("i") >= n) & F.col("z_tilt").isNotNull()).select("symbol", "dt", label.alias("regime"), F.concat_ws(",", tags).alias("tags"), F.round("tilt", 6).alias("tilt"), "z_tilt", F.coalesce("z_volume", F.lit(0.0)).alias("z_volume"))


def transitions(labels: DataFrame, label: str) -> DataFrame:
    """By symbol, from label to label: how often and with what probability; how long the first lasts, over all its runs, the last one too."""
    r = runs(labels, ["symbol"], "dt", label).groupBy("symbol", "run", F.col(label).alias("from")).agg(F.count("*").alias("n"))
    lasts = r.groupBy("symbol", "from").agg(F.count("*").alias("runs"), F.round(F.avg("n"), 6).alias("mean_length"), F.median("n").alias("median_length"))
    t = r.withColumn("to", F.lead("from").over(Window.partitionBy("symbol").orderBy("run"))).filter("to is not null").groupBy("symbol", "from", "to").agg(F.count("*").alias("times"))
    return t.withColumn("probability", F.round(F.col("times") / F.sum("times").over(Window.partitionBy("symbol", "from")), 6)).join(lasts, ["symbol", "from"])


def absorption(series: DataFrame, lookback: int = 60, least: int = 20) -> DataFrame:
    """Much volume and churn with little movement: mean of clamped z scores, and how often the last five sessions had it."""
    from .stats import point_in_time

    s = series.withColumn("move", F.abs("ret"))
    for x in ("volume", "churn", "move"):
        s = point_in_time(s, x, lookback, least).withColumnRenamed("z", f"z_{x}").drop("pct")
    clamp = lambda z: F.greatest(F.lit(0.0), F.least(F.lit(1.0), z / 2))
    score = 100 * (clamp(F.col("z_volume")) + clamp(-F.col("z_churn")) + clamp(-F.col("z_move"))) / 3
    s = s.filter("z_volume is not null and z_churn is not null and z_move is not null").withColumn("score", F.round(score, 6))
    return s.select("symbol", "dt", "score", F.count_if(F.col("score") >= 30).over(by_symbol().rowsBetween(-4, 0)).alias("recent"))


def market_flow(series: DataFrame, sectors: DataFrame) -> DataFrame:
    """The newest session by sector and over all: volume, turnover, tilt weighted by volume, breadth by count and by volume."""
    newest = series.join(F.broadcast(series.agg(F.max("dt").alias("d"))), F.col("dt") == F.col("d"))  # one row
    s = newest.join(sectors.select("symbol", "sector"), "symbol")
    s = s.withColumn("lean", sign(F.col("tilt"), 0.01))
    up = F.col("lean") == 1
    out = s.cube("sector").agg(
        F.count("*").alias("symbols"), F.sum("volume").alias("volume"), F.round(F.sum("amount"), 2).alias("turnover"), micro(F.round(F.sum(F.col("tilt") * F.col("volume"))) / F.sum("volume")).alias("tilt"),
        F.round(F.avg(up.cast("int")), 6).alias("breadth"), F.round(F.sum(F.when(up, F.col("volume")).otherwise(0)) / F.sum("volume"), 6).alias("volume_breadth"),
    )
    return out


def heatmap(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sectors by change of their symbols' newest bars, weighted by turnover, largest turnover first."""
    from .series import last_two

    b = last_two(bars).join(sectors.select("symbol", "sector"), "symbol")
    return b.groupBy("sector").agg(F.count("*").alias("symbols"), F.round(F.sum("turnover"), 2).alias("turnover"), F.round(F.sum(F.col("pct") * F.col("turnover")) / F.sum("turnover"), 4).alias("pct"), F.count_if(F.col("pct") > 0).alias("up"), F.max_by("symbol", F.struct("pct", "symbol")).alias("best"))


def alignment(by_window: DataFrame) -> DataFrame:
    """Votes of the windows 3, 7, 15 and 30 on a symbol's direction, their weighted agreement, and the conflict between them.

    by_window: symbol, w, tilt. A tilt within 0.10 votes for neither side.
    """
    p = by_window.groupBy("symbol").pivot("w", [3, 7, 15, 30]).agg(F.max("tilt"))
    v = {w: sign(F.col(str(w)), 0.10) for w in (3, 7, 15, 30)}
    weight = {3: 0.35, 7: 0.30, 15: 0.20, 30: 0.15}
    score = 100 * F.abs(sum((v[w] * F.lit(weight[w]) for w in v), F.lit(0.0)))
    ws = list(v)
    opposed = sum(((v[a] * v[b] == -1).cast("int") for i, a in enumerate(ws) for b in ws[i + 1 :]), F.lit(0))
    gap = F.abs(F.col("3") - F.col("30"))
    conflict = 100 * (0.5 * opposed / 6 + 0.5 * F.least(F.lit(1.0), gap / 2))
    return p.select("symbol", *(v[w].alias(f"vote{w}") for w in ws), F.round(score, 6).alias("alignment"), F.when(F.round(score, 6) >= 70, "strong").when(F.round(score, 6) >= 40, "moderate").otherwise("weak").alias("label"), F.round(conflict, 6).alias("conflict"))
