"""How fresh a stock's flow signal is, how it decayed, and how long brokers have been buying.

Marks are one row for each symbol and session of the last HISTORY ones; everything after them works on those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio0, sign
from ..sources.tape import broker_flow
from .regimes import NEUTRAL, runs

#: Sessions of a reading; means of the line and the trend; percentile of a large trade and of an event; level of half a
#: signal; where a decay's labels begin; turnover of a session that counts and streak that persists.
HISTORY = 120
LINE, TREND = 3, 15
LARGE, EVENT = 0.9, 0.9
HALF = 50.0
REACCELERATING, RECOVERING, DECAYING, PERSISTENT = 5.0, 0.25, 0.05, 0.5
MIN_TURNOVER, STREAK = 500_000.0, 3


def linear_percentile(rows: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """The interpolated percentile of a value by key. Equal values are counted first; only unlike ones are put in order."""
    w = Window.partitionBy(key)
    c = rows.groupBy(key, value).count().withColumns({"upto": F.sum("count").over(w.orderBy(value)), "n": F.sum("count").over(w)})
    place = (F.col("n") - 1) * F.lit(q)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
    return c.groupBy(key).agg((low + (high - low) * part).alias(name))


def last_sessions(trades: DataFrame, n: int = HISTORY) -> DataFrame:
    """Trades of each symbol's last n sessions, with `i`, the session's number from 1, and `n`, their count."""
    w = Window.partitionBy("symbol")
    days = trades.select("symbol", "dt").distinct().withColumn("back", F.row_number().over(w.orderBy(F.desc("dt")))).filter(F.col("back") <= n)
    days = days.withColumn("n", F.max("back").over(w))
    return trades.join(days.select("symbol", "dt", (F.col("n") + 1 - F.col("back")).alias("i"), "n"), ["symbol", "dt"])


def marks(trades: DataFrame, history: int = HISTORY) -> DataFrame:
    """By session: tilt, its means over LINE and TREND sessions, side, concentration of gross quantities, brokers, share of large trades.

    A symbol's first sessions have means over what there is. A trade is large from the LARGE percentile of the symbol's amounts on.
    """
    t = last_sessions(trades, history)
    cut = linear_percentile(t, "symbol", "amt", LARGE, "large")
    gross = (F.col("bought") + F.col("sold")).cast("double")
    per = broker_flow(t).groupBy("symbol", "dt").agg(
        F.sum("bought").alias("volume"), ((F.max("net") + F.min("net")) / F.sum("bought")).alias("tilt"), (F.sum(gross * gross) / (F.sum(gross) * F.sum(gross))).alias("hhi"), F.count("*").alias("participants")
    )
    big = t.join(cut, "symbol").groupBy("symbol", "dt", "i", "n").agg(F.coalesce(F.sum(F.when(F.col("amt") >= F.col("large"), F.col("qty"))), F.lit(0)).alias("large_qty"))
    m = per.join(big, ["symbol", "dt"]).withColumn("large_share", ratio0(F.col("large_qty"), F.col("volume")))
    w = Window.partitionBy("symbol").orderBy("i")
    m = m.withColumns({"line": F.avg("tilt").over(w.rowsBetween(1 - LINE, 0)), "trend": F.avg("tilt").over(w.rowsBetween(1 - TREND, 0))})
    return m.withColumn("side", sign(F.col("line"), NEUTRAL))


def percentile_cut(x: str) -> Column:
    """By symbol, the value at rank round(EVENT (n - 1)), halves to even; for at most HISTORY marks a symbol."""
    return F.max(F.when(F.col(f"rank_{x}") == F.bround((F.col("n") - 1) * F.lit(EVENT)) + 1, F.col(x))).over(Window.partitionBy("symbol"))


#: Events of a spike or an expansion by the column that shows it.
ABOVE = {"concentration spike": "hhi", "participation expansion": "participants", "large-trade emergence": "large_share"}


def events(marks: DataFrame) -> DataFrame:
    """By symbol and event, the last time it happened: dt, idx (0 for the first mark), age in sessions, level, active; for runs also their length.

    accumulation start and distribution start date the last run of either side of the line; flow reversal the last turn of the trend
    from beyond the neutral band to beyond it on the other side; the rest the last mark above the symbol's own EVENT percentile.
    """
    by, w = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("i")
    m = runs(marks, ["symbol"], "i", "side")
    island = Window.partitionBy("symbol", "run")
    first = F.min(F.struct("i", "dt", "line")).over(island)
    was = F.lag("trend").over(w)
    m = m.withColumns({"first": first, "turned": (was * F.col("trend") < 0) & (F.abs(was) > NEUTRAL) & (F.abs("trend") > NEUTRAL)})
    m = m.withColumns({f"rank_{x}": F.row_number().over(by.orderBy(x)) for x in ABOVE.values()})
    m = m.withColumns({f"cut_{x}": percentile_cut(x) for x in ABOVE.values()})
    none = F.lit(None)
    start = lambda name, side: F.struct(F.lit(name).alias("event"), (F.col("side") == side).alias("hit"), F.col("first.i").alias("at"), F.col("first.dt").alias("on"), F.col("first.line").alias("level"), (F.col("i") - F.col("first.i") + 1).cast("long").alias("run"))
    point = lambda name, hit, level: F.struct(F.lit(name).alias("event"), hit.alias("hit"), F.col("i").alias("at"), F.col("dt").alias("on"), level.cast("double").alias("level"), none.cast("long").alias("run"))
    found = [start("accumulation start", 1), start("distribution start", -1), point("flow reversal", F.coalesce("turned", F.lit(False)), F.col("trend"))]
    found += [point(name, F.col(x) > F.col(f"cut_{x}"), F.col(x)) for name, x in ABOVE.items()]
    hits = m.select("symbol", "i", "n", F.inline(F.array(*found))).filter("hit")
    last = hits.groupBy("symbol", "event").agg(F.max(F.struct("i", "at", "on", "level", "run", "n")).alias("e"))
    return last.select("symbol", "event", F.col("e.on").alias("dt"), (F.col("e.at") - 1).cast("long").alias("idx"), (F.col("e.n") - F.col("e.at")).cast("long").alias("age"), F.col("e.level").alias("level"), (F.col("e.i") == F.col("e.n")).alias("active"), F.col("e.run").alias("run"))


def freshness(marks: DataFrame) -> DataFrame:
    """One row for each symbol: its last session, which side began last and how long ago, the age of each event, and both sides' last runs."""
    e = events(marks)
    of = lambda name, x: F.max(F.when(F.col("event") == name, F.col(x)))
    pos, neg = "accumulation start", "distribution start"
    ages = {"accumulation": pos, "distribution": neg, "flow_reversal": "flow reversal", "concentration_spike": "concentration spike", "participation_expansion": "participation expansion", "large_trade_emergence": "large-trade emergence"}
    wide = e.groupBy("symbol").agg(
        of(pos, "idx").alias("p"), of(neg, "idx").alias("q"), *(of(name, "age").alias(f"days_since_{k}") for k, name in ages.items()), F.coalesce(of(pos, "run"), F.lit(0)).alias("accumulation_run"),
        F.coalesce(of(neg, "run"), F.lit(0)).alias("distribution_run"), F.coalesce(of(pos, "active"), F.lit(False)).alias("accumulation_active"), F.coalesce(of(neg, "active"), F.lit(False)).alias("distribution_active"),
    )
    ends = marks.groupBy("symbol").agg(F.max("dt").alias("dt"), F.max("n").alias("n"))
    buying = F.col("p").isNotNull() & (F.col("q").isNull() | (F.col("p") >= F.col("q")))
    origin = F.when(buying, F.col("p")).otherwise(F.col("q"))
    r = ends.join(wide, "symbol", "left").withColumns({"origin": origin, "signal": F.when(buying, "accumulation").when(F.col("q").isNotNull(), "distribution").otherwise("none")})
    zero, off = (lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)), (lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c))
    return r.select("symbol", "dt", "signal", (F.col("n") - 1 - F.col("origin")).cast("long").alias("signal_age"), *(f"days_since_{k}" for k in ages), zero("accumulation_run"), zero("distribution_run"), off("accumulation_active"), off("distribution_active"), "origin")


def decay(points: DataFrame) -> DataFrame:
    """points (symbol, d: day from 0, v: level from 0) -> how each symbol's signal changed after its peak, with the peak as 100.

    rate: minus the slope of ln(level) over the days from the peak on, from all points above 0; half_life only where that is above 0;
    persistence: share of those days at HALF or more; recovery: the largest rise from the lowest level before it, as a share of the peak;
    reacceleration: mean of the last three levels less that of the three before, 0 with under six.
    """
    by = Window.partitionBy("symbol")
    day = by.orderBy("d")
    p = points.filter(F.col("v").isNotNull() & ~F.isnan("v")).withColumns({"top": F.max("v").over(by), "first_d": F.min("d").over(by), "k": F.row_number().over(by.orderBy(F.desc("d")))})
    p = p.withColumns({"d": F.col("d") - F.col("first_d"), "s": F.when(F.col("top") > 0, F.lit(100.0) * F.col("v") / F.col("top")).otherwise(F.col("v"))})
    p = p.withColumn("peak", F.min(F.when(F.col("v") == F.col("top"), F.col("d"))).over(by)).withColumn("tail", (F.col("d") >= F.col("peak")) & (F.col("top") > 0))
    p = p.withColumn("rise", F.col("s") - F.min(F.when(F.col("tail"), F.col("s"))).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    up = F.col("tail") & (F.col("s") > 0)
    slope = F.regr_slope(F.when(up, F.ln("s")), F.when(up, F.col("d").cast("double")))
    last3, before3 = (F.avg(F.when(F.col("k").between(a, a + 2), F.col("s"))) for a in (1, 4))
    a = p.groupBy("symbol").agg(
        F.count("*").alias("days"), F.min_by("s", "d").alias("day1"), F.max("peak").alias("peak"), F.max("top").alias("top"), F.max_by("s", "d").alias("latest"), F.coalesce(-slope, F.lit(0.0)).alias("rate"), ratio0(F.count_if(F.col("tail") & (F.col("s") >= HALF)), F.count_if("tail")).alias("persistence"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("tail"), F.col("rise"))), F.lit(0.0)) / 100).alias("recovery"), F.when((F.count("*") >= 6) & (F.max("top") > 0), last3 - before3).otherwise(0.0).alias("reacceleration"),
    )
    label = F.when(F.col("top") <= 0, "flat").when(F.col("reacceleration") > REACCELERATING, "reaccelerating").when(F.col("recovery") > RECOVERING, "recovering").when(F.col("rate") > DECAYING, "decaying").when(F.col("persistence") >= PERSISTENT, "persistent").otherwise("flat")
    return a.select("symbol", "days", "day1", F.when(F.col("top") > 0, F.col("peak")).otherwise(0).cast("long").alias("peak_day"), "latest", "rate", F.when(F.col("rate") > 1e-9, F.lit(0.6931471805599453) / F.col("rate")).alias("half_life"), "persistence", "recovery", "reacceleration", label.alias("label"))


def signal_points(marks: DataFrame, fresh: DataFrame) -> DataFrame:
    """The absolute line of each symbol from the start of its signal on; symbols without a signal have none."""
    start = fresh.filter("origin is not null").select("symbol", "origin")
    return marks.join(start, "symbol").filter(F.col("i") - 1 >= F.col("origin")).select("symbol", (F.col("i") - 1 - F.col("origin")).alias("d"), F.abs("line").alias("v"))


def streak_features(flow: DataFrame) -> DataFrame:
    """By symbol and session with MIN_TURNOVER or more: what brokers with a streak of buying take, the longest streak, and how buying is shared.

    A broker's streak grows by each such session in which it buys more than it sells, and ends with any session in which it doesn't, a thin
    one too; a thin session in which it buys leaves the streak as it is. Streaks are those before the session. No row is folded in turn: a
    streak is the number of counted sessions since the last end.
    """
    day = Window.partitionBy("symbol", "dt")
    f = flow.withColumns({"volume": F.sum("bought").over(day), "turnover": F.round(F.sum("buy_amt").over(day), 2)})
    f = f.withColumn("counts", (F.col("volume") > 0) & (F.col("turnover") >= MIN_TURNOVER))
    w = Window.partitionBy("symbol", "broker").orderBy("dt")
    f = f.withColumn("part", F.sum((F.col("net") <= 0).cast("int")).over(w))
    grown = (F.col("counts") & (F.col("net") > 0)).cast("int")
    f = f.withColumn("streak", F.sum(grown).over(Window.partitionBy("symbol", "broker", "part").orderBy("dt")) - grown)
    v, buys = F.col("volume"), F.col("net") > 0
    bought = F.col("bought").cast("double")
    return f.filter("counts").groupBy("symbol", "dt").agg(
        (F.sum(F.when(buys & (F.col("streak") >= STREAK), F.col("net")).otherwise(0)) / F.max(v)).alias("persist_k"), F.coalesce(F.max(F.when(buys, F.col("streak"))), F.lit(0)).alias("streak_max"),
        (F.sum(bought * bought) / (F.max(v).cast("double") * F.max(v))).alias("herfindahl"), (F.max("net") / F.max(v)).alias("top_share"), (F.count_if(F.col("sold") > 0) / F.greatest(F.count_if(F.col("bought") > 0), F.lit(1))).alias("buyer_ratio"),
    )
