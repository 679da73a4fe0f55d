"""The study panel: what was known of a stock on a decision day, how it ranks in the stock's own past, and what came after.

What looks back over a bounded number of sessions goes by blocks: a session is sent to its own block and, as history, to the
next one. So a symbol's sessions are spread over many tasks, each holding two blocks, and no row carries its past along.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.nulls import ratio0, sign
from ..sources.tape import broker_flow
from .flow import dense_grid

#: Windows of broker flow; sessions before a percentile and the fewest of them; sessions between decisions; sessions of
#: prior amounts and the percentile of a large trade; largest logarithmic return; neutral band; sessions a symbol needs.
WINDOWS = (3, 7, 15, 30)
LOOKBACK, LEAST, STRIDE = 250, 60, 5
PRIOR, LARGE = 30, 90.0
CIRCUIT, BAND, SESSIONS = 0.20, 0.001, 200
#: Sessions of forward returns, the last of them the horizon of a path; target and stop of a path; sessions of the leaders;
#: lags of flow against price, and the sessions that are scanned for them.
HORIZONS, TARGET, STOP, LEADERS = (5, 10, 20), 0.10, 0.07, 15
LAGS, SCANNED, LEAST_SCANNED = 6, 60, 20

DAILY = [
    "trades", "volume", "turnover", "vwap", "price_range", "avg_trade", "median_trade", "large_ratio", "buyers", "sellers", "brokers", "top1_conc", "top5_conc", "buy_hhi", "sell_hhi", "net_flow", "flow_quality", "flow_imbalance",
    "fragmentation", "broker_entropy", "broker_diversity", "vwap_position", "level_hhi",
]
POOLED = [f"{x}_{w}" for x in ("netchurn", "tilt", "breadth", "consensus") for w in WINDOWS] + ["conc_7", "conc_30"]
DERIVED = [
    "large_7", "large_30", "persistence_7", "persistence_15", "persistence_30", "momentum", "acceleration", "reversal", "participation_change", "vwap_distance", "vwap_slope", "price_flow_corr", "flow_price_lag", "flow_efficiency", "anomaly",
    "turnover_z", "signal_age", "signal_decay", "alignment", "conflict", "ret_5", "ret_15", "ret_30",
]
FEATURES = DAILY + POOLED + DERIVED
LEADING = ["top_buyer", "top_buyer_share", "top_seller", "pair_buyer", "pair_seller", "pair_share"]


def nano(x: Column) -> Column:
    """x to 9 places: what is summed over a window is compared with its own past for equality, and sums differ in the last bits by their order."""
    return F.floor(x * 1e9 + 0.5) / 1e9


def numbered(trades: DataFrame) -> DataFrame:
    """Sessions of each symbol with at least SESSIONS of them, numbered from 0, and whether the day is a decision day of the market's calendar."""
    days = trades.select("symbol", "dt").distinct()
    w = Window.partitionBy("symbol")
    s = days.withColumns({"i": F.row_number().over(w.orderBy("dt")) - 1, "n": F.count("*").over(w)}).filter(F.col("n") >= SESSIONS)
    # one row for each day of the market: a few thousand, however many trades there are
    calendar = days.select("dt").distinct().withColumn("on_grid", (F.row_number().over(Window.orderBy("dt")) - 1) % STRIDE == 0)
    return s.join(calendar, "dt").drop("n")


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Every row twice: in its block of `size` sessions, as its own, and in the next one, as history."""
    block = F.floor(F.col("i") / size).cast("int")
    to = lambda b, own: F.struct(b.alias("block"), F.lit(own).alias("own"))
    return rows.select("*", F.inline(F.array(to(block, True), to(block + 1, False))))


def by_block(rows: DataFrame, size: int, made: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`made` of each symbol and block, with rows by session; blocks with nothing but history give nothing."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return made(group.sort_values("i", kind="stable").reset_index(drop=True))

    return in_blocks(rows, size).groupBy("symbol", "block").applyInPandas(run, schema)


def ranked_in_past(rows: DataFrame, values: list[str], lookback: int = LOOKBACK, least: int = LEAST, only: str | None = None) -> DataFrame:
    """rows (symbol, i: consecutive from 0, values, other columns) -> the same with p_<value>: the percentile of each value among the symbol's `lookback` values before it.

    Half of the equal ones count; null with fewer than `least` before it. only: a boolean column; other rows are history alone and go. Null and NaN
    values count as 0. All values are ranked in one pass over two blocks of sessions. Clashing columns p_<value> are replaced.
    """
    kept = [c for c in rows.columns if c not in {f"p_{v}" for v in values}]

    def made(g: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(g[values].to_numpy(dtype="float64", na_value=0.0))
        at = np.flatnonzero(g["own"] & g[only] if only else g["own"])
        out = np.full((len(at), len(values)), np.nan)
        for k, r in enumerate(at):
            past = x[max(0, r - lookback) : r]
            if len(past) >= least:
                out[k] = 100.0 * ((past < x[r]).sum(0) + 0.5 * (past == x[r]).sum(0)) / len(past)
        found = pd.DataFrame(out, columns=[f"p_{v}" for v in values]).astype(object).where(~np.isnan(out), None)
        return pd.concat([g.loc[at, kept].reset_index(drop=True), found], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return by_block(rows.select(*kept), lookback, made, f"{schema}, " + ", ".join(f"`p_{v}` double" for v in values))


def large_quantity(trades: DataFrame, prior: int = PRIOR, q: float = LARGE) -> DataFrame:
    """trades (symbol, i, qty, amt) -> symbol, i, large_qty: shares traded at or above the percentile of the amounts of the `prior` sessions before; 0 for the first session."""

    def made(g: pd.DataFrame) -> pd.DataFrame:
        i, amt, qty = (g[c].to_numpy() for c in ("i", "amt", "qty"))
        found = []
        for day in np.unique(i[g["own"].to_numpy()]):
            before, first, last = np.searchsorted(i, day - prior), np.searchsorted(i, day), np.searchsorted(i, day, "right")
            large = qty[first:last][amt[first:last] >= np.percentile(amt[before:first], q)].sum() if first > before else 0
            found.append((g["symbol"].iloc[0], int(day), int(large)))
        return pd.DataFrame(found, columns=["symbol", "i", "large_qty"])

    return by_block(trades.select("symbol", "i", "qty", "amt"), prior, made, "symbol string, i int, large_qty long")


def daily(trades: DataFrame, flow: DataFrame) -> DataFrame:
    """The DAILY features. trades and flow have `i`."""
    key = ["symbol", "dt", "i", "on_grid"]
    day = trades.groupBy(*key).agg(
        F.count("*").alias("trades"), F.sum("qty").alias("volume"), F.round(F.sum("amt"), 2).alias("turnover"), F.median("qty").alias("median_trade"), F.min("rate").alias("low"), F.max("rate").alias("high"),
        F.count_distinct("buyer").alias("buyers"), F.count_distinct("seller").alias("sellers"),
    )
    levels = trades.groupBy("symbol", "i", "rate").agg(F.sum("qty").cast("double").alias("q")).groupBy("symbol", "i").agg((F.sum(F.col("q") * F.col("q")) / F.pow(F.sum("q"), 2)).alias("level_hhi"))
    w = Window.partitionBy("symbol", "i")
    b, s = F.col("bought").cast("double"), F.col("sold").cast("double")
    p = b / F.col("total")
    f = flow.withColumns({"total": F.sum("bought").over(w), "k": F.row_number().over(w.orderBy(F.desc("bought"), "broker"))})
    plogp = F.when(b > 0, p * F.ln(p)).otherwise(0.0)
    f = f.groupBy("symbol", "i").agg(
        F.count("*").alias("brokers"), F.greatest(F.max("net"), F.lit(0)).alias("up"), F.greatest(-F.min("net"), F.lit(0)).alias("down"), F.sum(F.when(F.col("k") <= 5, F.col("bought")).otherwise(0)).alias("top5"), F.sum(b * b).alias("bb"), F.sum(s * s).alias("ss"),
        F.sum(F.greatest("net", F.lit(0))).alias("pos"), (F.count_if(F.col("net") > 0) - F.count_if(F.col("net") < 0)).alias("camps"), F.when(F.count_if(b > 0) >= 2, -F.sum(plogp) / F.ln(F.count_if(b > 0))).otherwise(0.0).alias("entropy"),
    )
    d = day.join(large_quantity(trades), ["symbol", "i"]).join(levels, ["symbol", "i"]).join(f, ["symbol", "i"])
    v, n, vwap = F.col("volume"), F.col("trades"), F.col("turnover") / F.col("volume")
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (vwap - F.col("low")) / (F.col("high") - F.col("low"))))
    made = {
        "vwap": vwap, "price_range": ratio0(F.col("high") - F.col("low"), vwap), "avg_trade": v / n, "large_ratio": F.col("large_qty") / v, "top1_conc": F.col("up") / v, "top5_conc": F.col("top5") / v, "buy_hhi": F.col("bb") / (v.cast("double") * v),
        "sell_hhi": F.col("ss") / (v.cast("double") * v), "net_flow": F.col("up") / v - F.col("down") / v, "flow_quality": F.col("pos") / v, "flow_imbalance": F.col("camps") / F.col("brokers"), "fragmentation": n / F.col("brokers"), "broker_entropy": nano(F.col("entropy")),
        "broker_diversity": F.col("brokers") / n, "vwap_position": F.when(F.col("high") > F.col("low"), nano(place)).otherwise(0.5), "level_hhi": nano(F.col("level_hhi")),
    }
    d = d.withColumns(made)
    return d.select(*key, *(F.col(c).cast("double").alias(c) for c in DAILY))


def pooled(flow: DataFrame) -> DataFrame:
    """The POOLED features and the leaders' nets: brokers' quantities summed over the last w sessions; 0 before there are w of them.

    A broker counts in a window if it traded in it. flow has `i`. Each broker's sessions are a partition of their own.
    """
    days = flow.select("symbol", "dt", "i").distinct()
    grid = dense_grid(flow).join(days, ["symbol", "dt"])
    w = Window.partitionBy("symbol", "broker").orderBy("i")
    sums = {f"{c}_{n}": F.sum(c).over(w.rowsBetween(1 - n, 0)) for n in WINDOWS for c in ("bought", "sold")}
    g = grid.withColumns(sums)
    aggregates = []
    for n in WINDOWS:
        net = F.when(F.col(f"bought_{n}") + F.col(f"sold_{n}") > 0, F.col(f"bought_{n}") - F.col(f"sold_{n}"))
        aggregates += [F.sum(f"bought_{n}").alias(f"v_{n}"), F.count(net).alias(f"who_{n}"), F.max(net).alias(f"most_{n}"), F.min(net).alias(f"least_{n}"), F.sum(F.greatest(net, F.lit(0))).alias(f"pos_{n}"), F.count_if(net > 0).alias(f"up_{n}"), F.count_if(net < 0).alias(f"down_{n}")]
    net = F.when(F.col(f"bought_{LEADERS}") + F.col(f"sold_{LEADERS}") > 0, F.col(f"bought_{LEADERS}") - F.col(f"sold_{LEADERS}"))
    aggregates += [F.max(F.when(net.isNotNull(), F.struct(net.alias("net"), (-F.col("broker")).alias("b")))).alias("first"), F.min(F.when(net.isNotNull(), F.struct(net.alias("net"), F.col("broker").alias("b")))).alias("final")]
    a = g.groupBy("symbol", "i").agg(*aggregates)
    out = {"top_buyer": -F.col("first.b"), "top_buyer_share": F.col("first.net") / F.col(f"v_{LEADERS}"), "top_seller": F.col("final.b")}
    for n in WINDOWS:
        c = lambda x, n=n: F.col(f"{x}_{n}")
        full = lambda x, n=n: F.when(F.col("i") >= n - 1, x).otherwise(0.0)
        out |= {f"netchurn_{n}": full(c("pos") / c("v")), f"tilt_{n}": full((c("most") + c("least")) / c("v")), f"breadth_{n}": full(c("up") / c("who")), f"consensus_{n}": full((c("up") - c("down")) / c("who")), f"conc_{n}": full((c("most") - c("least")) / c("v"))}
    return a.select("symbol", "i", F.col(f"v_{LEADERS}").alias("window_volume"), *(x.alias(name) for name, x in out.items() if name in POOLED or name in LEADING))


def corr_over(x: str, y: Column, w: WindowSpec) -> Column:
    """Correlation over a window: 0 with fewer than 3 pairs or without spread, within -1 and 1."""
    a, b = F.when(y.isNotNull(), F.col(x)), y
    spread = F.sqrt(F.var_pop(a).over(w) * F.var_pop(b).over(w))
    return nano(F.when((F.count(b).over(w) < 3) | (spread < 1e-12), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(a, b).over(w) / spread))))


def derived(s: DataFrame) -> DataFrame:
    """The DERIVED features, from DAILY and POOLED ones of all sessions of a symbol."""
    w = Window.partitionBy("symbol").orderBy("i")
    last = lambda n: w.rowsBetween(1 - n, 0)
    prior = w.rowsBetween(-LOOKBACK, -1)
    mean = lambda c, n: F.avg(c).over(last(n))
    move = F.ln(F.col("vwap") / F.lag("vwap").over(w))
    s = s.withColumn("ret", F.coalesce(F.when(F.abs(move) <= CIRCUIT, move), F.lit(0.0)))
    s = s.withColumns({f"_tilt{k}": F.lag("tilt_3", k).over(w) for k in range(LAGS)} | {"_up": F.col("tilt_3") > 0})
    s = s.withColumn("_run", F.sum(F.when(F.col("_up") == F.lag("_up").over(w), 0).otherwise(1)).over(w))
    scans = {f"_c{k}": F.abs(corr_over("ret", F.col(f"_tilt{k}"), last(SCANNED - k))) for k in range(LAGS)}
    t3, t7, t15 = (F.col(f"tilt_{n}") for n in WINDOWS[:3])
    signs = sum((sign(F.col(f"tilt_{n}")) for n in WINDOWS[1:]), sign(t3)).cast("double")
    z = lambda c: F.when((F.count(c).over(prior) >= LEAST) & (F.stddev_pop(c).over(prior) > 1e-9), nano((F.col(c) - F.avg(c).over(prior)) / F.stddev_pop(c).over(prior))).otherwise(0.0)
    age = (F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("i")) - 1).cast("double")
    s = s.withColumns(scans | {
        "large_7": nano(mean("large_ratio", 8)), "large_30": nano(mean("large_ratio", 31)), **{f"persistence_{n}": F.count_if(t3 > BAND).over(last(n)) / F.count("*").over(last(n)) for n in WINDOWS[1:]},
        "momentum": t3 - t15, "acceleration": (t3 - t7) - (t7 - t15), "reversal": (t3 * t15 < 0).cast("double"), "participation_change": nano(mean("brokers", 4) / mean("brokers", 31) - 1),
        "vwap_distance": nano(F.col("vwap") / mean("vwap", 30) - 1), "vwap_slope": nano(mean("vwap", 3) / mean("vwap", 15) - 1), "price_flow_corr": corr_over("ret", F.col("_tilt0"), last(30)),
        "anomaly": F.abs(z("volume")), "turnover_z": z("turnover"), "signal_age": age, "signal_decay": F.exp(-age / 7), "alignment": signs / 4, "conflict": 1 - F.abs(signs) / 4,
        **{f"ret_{n}": nano(F.sum("ret").over(last(n))) for n in (5, 15, 30)}, "_gross": F.sum(F.abs(t3)).over(last(15)),
    })
    best = F.greatest(*(F.col(f"_c{k}") for k in range(LAGS)))
    lag = F.when(F.col("i") + 1 < LEAST_SCANNED, 0.0)
    for k in range(LAGS):
        lag = lag.when(F.col(f"_c{k}") == best, float(k))
    s = s.withColumns({"flow_price_lag": lag, "flow_efficiency": nano(F.col("ret_15") / F.when(F.col("_gross") > 0, F.col("_gross")).otherwise(1.0))})
    return s.select("symbol", "dt", "i", "on_grid", "window_volume", *FEATURES, *LEADING[:3])


def leading_pair(trades: DataFrame, days: DataFrame) -> DataFrame:
    """By decision day, the pair of buyer and seller with most trades over the last LEADERS sessions (the smallest pair of equal ones), and their number.

    A session's counts go to the few decision days that look back on it, not to every session.
    """
    reach = days.filter("on_grid").select("symbol", F.col("i").alias("at"), F.explode(F.sequence(F.col("i") - (LEADERS - 1), F.col("i"))).alias("i"))
    c = trades.groupBy("symbol", "i", "buyer", "seller").count().join(reach, ["symbol", "i"])
    on = c.groupBy("symbol", F.col("at").alias("i"), "buyer", "seller").agg(F.sum("count").alias("n"))
    top = on.groupBy("symbol", "i").agg(F.max(F.struct("n", (-F.col("buyer")).alias("b"), (-F.col("seller")).alias("s"))).alias("t"))
    return top.select("symbol", "i", (-F.col("t.b")).alias("pair_buyer"), (-F.col("t.s")).alias("pair_seller"), F.col("t.n").alias("pair_trades"))


def forward(days: DataFrame, bars: DataFrame) -> DataFrame:
    """days (symbol, dt) -> what adjusted bars did after each: entry (the next bar's open), returns of HORIZONS, largest rise and fall, and the bar
    that first touched target and stop (0: none). Days without a whole path have no row.

    Each day meets its path by number, 20 rows each; no path is collected.
    """
    path = HORIZONS[-1]
    w = Window.partitionBy("symbol").orderBy("dt")
    b = bars.select("symbol", "dt", "o", "h", "l", "c", F.row_number().over(w).alias("at"))
    start = days.join(b.withColumn("entry", F.lead("o").over(w)).select("symbol", "dt", "at", "entry"), ["symbol", "dt"]).filter("entry > 0")
    steps = start.select("symbol", "dt", "entry", F.posexplode(F.sequence(F.col("at") + 1, F.col("at") + path)).alias("j", "at"))
    j, e = F.col("j") + 1, F.col("entry")
    met = steps.join(b.drop("dt"), ["symbol", "at"]).groupBy("symbol", "dt", "entry").agg(
        F.count("*").alias("n"), *(F.max(F.when(j == n, F.col("c") / e - 1)).alias(f"fwd_{n}") for n in HORIZONS), (F.max("h") / F.max(e) - 1).alias("mfe"), (F.min("l") / F.max(e) - 1).alias("mae"),
        F.coalesce(F.min(F.when(F.col("h") >= e * (1 + TARGET), j)), F.lit(0)).alias("tt_target"), F.coalesce(F.min(F.when(F.col("l") <= e * (1 - STOP), j)), F.lit(0)).alias("tt_stop"),
    )
    touched = (F.col("tt_stop") > 0) & ((F.col("tt_target") == 0) | (F.col("tt_stop") <= F.col("tt_target")))
    managed = F.when(touched, F.lit(-STOP)).when(F.col("tt_target") > 0, F.lit(TARGET)).otherwise(F.col(f"fwd_{path}"))
    held = F.when((F.col("tt_target") == 0) & (F.col("tt_stop") == 0), path).otherwise(F.least(*(F.when(F.col(c) > 0, F.col(c)) for c in ("tt_target", "tt_stop"))))
    return met.filter(F.col("n") == path).withColumns({"managed": managed, "hold": held}).drop("n")


def study_panel(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """One row for each symbol and decision day with LEAST sessions before and a whole path after: FEATURES, p_ of each, the leaders, and the path."""
    days = numbered(trades)
    t = trades.join(days, ["symbol", "dt"])
    f = broker_flow(trades).join(days.drop("on_grid"), ["symbol", "dt"])
    s = derived(daily(t, f).join(pooled(f), ["symbol", "i"]))
    rows = ranked_in_past(s, FEATURES, only="on_grid").filter(f"p_{FEATURES[0]} is not null").join(leading_pair(t, days), ["symbol", "i"])
    rows = rows.withColumn("pair_share", F.col("pair_trades") / F.col("window_volume"))
    out = forward(days.filter("on_grid").select("symbol", "dt"), bars)
    return rows.join(out, ["symbol", "dt"]).select("symbol", "dt", *FEATURES, *(f"p_{x}" for x in FEATURES), *LEADING, "entry", *(f"fwd_{n}" for n in HORIZONS), "mfe", "mae", "tt_target", "tt_stop", "managed", "hold")


#: The rule families that read flow, each with its side and its conditions (column, whether at least or at most, cut).
RULES = [
    ("accumulation", "long", "p_tilt_15", ">=", 80.0),
    ("distribution", "short", "p_tilt_15", "<=", 20.0),
    ("net_churn (control)", "long", "p_netchurn_30", ">=", 80.0),
    ("concentration", "long", "p_conc_7", ">=", 80.0),
    ("breadth", "long", "p_breadth_7", ">=", 80.0),
    ("large_trade", "long", "p_large_7", ">=", 80.0),
    ("consensus", "long", "p_consensus_7", ">=", 80.0),
    ("vwap_slope", "long", "p_vwap_slope", ">=", 80.0),
    ("flow_price_divergence", "long", "p_tilt_15", ">=", 70.0),
    ("flow_price_divergence", "long", "p_ret_15", "<=", 30.0),
    ("mtf_alignment", "long", "alignment", ">=", 1.0),
]
#: Fixed value: with fewer occurrences there are no rates.
OCCURRENCES = 30


def fired(panel: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """panel rows x families -> a row for each decision on which all conditions of a family hold, with `family` and `side`.

    Rules are rows: the columns that they name become rows of their own and meet the rules in one join, whatever their number. The table
    of rules is as long as `rules`, so it is broadcast. A condition on a null does not hold; conditions named twice count once.
    """
    rules = list(dict.fromkeys(rules))
    spark = panel.sparkSession
    table = spark.createDataFrame(rules, "family string, side string, feature string, op string, cut double").withColumn("needed", F.count("*").over(Window.partitionBy("family")))
    names = sorted({r[2] for r in rules})
    kept = [c for c in ("symbol", "dt", "fwd_20", "mfe", "mae", "tt_target", "tt_stop", "managed", "hold", "demeaned") if c in panel.columns]
    long_ = panel.select(*kept, F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))))
    holds = F.when(F.col("op") == ">=", F.col("value") >= F.col("cut")).otherwise(F.col("value") <= F.col("cut"))
    met = long_.join(F.broadcast(table), "feature").filter(holds)
    return met.groupBy(*kept, "family", "side").agg(F.count("*").alias("met"), F.max("needed").alias("needed")).filter("met = needed").drop("met", "needed")


def rule_families(panel: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """By family that ever fired: how often, on how many symbols and days, and what followed, seen from its side; rates only from OCCURRENCES on.

    excess is the return less the mean of all the panel's returns of that day. Target and invalidation of a short are the long's stop and target.
    """
    days = panel.groupBy("dt").agg(F.avg("fwd_20").alias("_mean"))
    hits = fired(panel.join(days, "dt").withColumn("demeaned", F.col("fwd_20") - F.col("_mean")), rules)
    long_ = F.col("side") == "long"
    sign_ = F.when(long_, 1.0).otherwise(-1.0)
    hits = hits.withColumns({"r": sign_ * F.col("fwd_20"), "x": sign_ * F.col("demeaned"), "m": sign_ * F.col("managed"), "up": F.when(long_, F.col("mfe")).otherwise(-F.col("mae")), "down": F.when(long_, F.col("mae")).otherwise(-F.col("mfe"))})
    hits = hits.withColumns({"target": F.when(long_, F.col("tt_target")).otherwise(F.col("tt_stop")) > 0, "stop": F.when(long_, F.col("tt_stop")).otherwise(F.col("tt_target")) > 0})
    rates = {"mean_ret": F.avg("r"), "win_rate": F.avg((F.col("r") > 0).cast("double")), "mean_excess": F.avg("x"), "excess_win_rate": F.avg((F.col("x") > 0).cast("double")), "managed_mean": F.avg("m"), "mfe_mean": F.avg("up"), "mae_mean": F.avg("down"), "target_rate": F.avg(F.col("target").cast("double")), "invalidation_rate": F.avg(F.col("stop").cast("double")), "avg_hold": F.avg("hold")}
    enough = F.count("*") >= OCCURRENCES
    return hits.groupBy("family", "side").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("dt").alias("days"), *(F.when(enough, x).alias(c) for c, x in rates.items()))
