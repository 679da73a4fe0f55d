"""The network of brokers: who trades, who comes and goes, and who trades with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio, ratio0
from .flow import recent_sessions


def participation(flow: DataFrame, sessions: int = 30) -> DataFrame:
    """Brokers of each symbol: by side, on both sides, and new or gone between the halves of its last sessions."""
    f = recent_sessions(flow, sessions).withColumn("late", F.col("age") <= sessions // 2)
    per = f.groupBy("symbol", "broker").agg(F.max(F.col("bought") > 0).alias("b"), F.max(F.col("sold") > 0).alias("s"), F.max("late").alias("late"), F.max(~F.col("late")).alias("early"), F.count("*").alias("days"))
    c = F.count_if
    return per.groupBy("symbol").agg(
        F.count("*").alias("brokers"), c("b").alias("buyers"), c("s").alias("sellers"), c(F.col("b") & F.col("s")).alias("both"), c(F.col("late") & ~F.col("early")).alias("expanding"), c(F.col("early") & ~F.col("late")).alias("contracting"),
        F.round(ratio0(c("late") - c("early"), c("early")), 6).alias("growth"), F.round(F.avg("days"), 6).alias("mean_days"),
    )


def churn(flow: DataFrame, window: int = 7) -> DataFrame:
    """Brokers of the last window against the one before it and all earlier history: one aggregate with three flags."""
    f = recent_sessions(flow, 0)
    per = f.groupBy("symbol", "broker").agg(F.max(F.col("age") <= window).alias("now"), F.max((F.col("age") > window) & (F.col("age") <= 2 * window)).alias("prev"), F.max(F.col("age") > 2 * window).alias("old"))
    n, p, o, c = F.col("now"), F.col("prev"), F.col("old"), F.count_if
    return per.groupBy("symbol").agg(c(n & ~p & ~o).alias("new"), c(n & ~p & o).alias("returning"), c(n & p).alias("continuing"), c(~n & p).alias("exiting"))


def rotation(flow: DataFrame, window: int = 7) -> DataFrame:
    """How the roster of one window differs from the next: Jaccard distance, shares gained and lost, moves in rank."""
    f = recent_sessions(flow, 2 * window).withColumn("now", F.col("age") <= window)
    per = f.groupBy("symbol", "now", "broker").agg(F.sum(F.col("bought") + F.col("sold")).alias("gross"))
    w = Window.partitionBy("symbol", "now")
    per = per.withColumns({"share": F.col("gross") / F.sum("gross").over(w), "rank": F.row_number().over(w.orderBy(F.desc("gross"), "broker"))})
    side = lambda now, x: F.max(F.when(F.col("now") == now, F.col(x)))
    both = per.groupBy("symbol", "broker").agg(side(True, "share").alias("s1"), side(False, "share").alias("s0"), side(True, "rank").alias("r1"), side(False, "rank").alias("r0"))
    gain = F.coalesce("s1", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0))
    return both.groupBy("symbol").agg(
        F.round(1 - ratio0(F.count_if(F.col("s1").isNotNull() & F.col("s0").isNotNull()), F.count("*")), 6).alias("jaccard_distance"), F.count_if(gain > 1e-12).alias("share_up"), F.count_if(gain < -1e-12).alias("share_down"),
        F.round(F.sum(F.greatest(gain, F.lit(0.0))), 6).alias("share_moved"), F.round(F.avg(F.abs(F.col("r1") - F.col("r0"))), 6).alias("mean_rank_move"), F.max_by("broker", F.struct(F.coalesce("s1", F.lit(0.0)), -F.col("broker"))).alias("dominant"),
    )


def rank_stability(flow: DataFrame, sessions: int = 30) -> DataFrame:
    """How often the leader by gross changes from session to session, and how much of the top five stays."""
    f = recent_sessions(flow, sessions).withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "dt").orderBy(F.desc(F.col("bought") + F.col("sold")), "broker")))
    day = f.groupBy("symbol", "dt").agg(F.max(F.when(F.col("rank") == 1, F.col("broker"))).alias("leader"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.col("broker")))).alias("top"))
    w = Window.partitionBy("symbol").orderBy("dt")
    day = day.withColumns({"was": F.lag("leader").over(w), "top_was": F.lag("top").over(w)})
    modal = day.groupBy("symbol", "leader").count().groupBy("symbol").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("modal_leader"), F.max("count").alias("led"))
    kept = F.size(F.array_intersect("top", "top_was")) / 5
    return day.groupBy("symbol").agg(F.count_if(F.col("leader") != F.col("was")).alias("flips"), F.count("*").alias("days"), F.round(F.avg(kept), 6).alias("top5_kept")).join(modal, "symbol")


def pairs(trades: DataFrame) -> DataFrame:
    """Directed pairs of brokers in each symbol: trades, sizes, days, recurrence, and their share of the volume.

    Recurrence is the pair's days over the days of whichever of the two was active on fewer.
    """
    p = trades.groupBy("symbol", "buyer", "seller").agg(F.count("*").alias("trades"), F.sum("qty").alias("qty"), F.round(F.sum("amt"), 2).alias("amt"), F.count_distinct("dt").alias("days"), F.max("qty").alias("largest"), F.min("dt").alias("first"), F.max("dt").alias("last"))
    active = trades.select("symbol", "dt", F.explode(F.array("buyer", "seller")).alias("broker")).groupBy("symbol", "broker").agg(F.count_distinct("dt").alias("active"))
    of = lambda who, name: active.select("symbol", F.col("broker").alias(who), F.col("active").alias(name))
    out = p.join(of("buyer", "a"), ["symbol", "buyer"]).join(of("seller", "b"), ["symbol", "seller"])
    total = F.sum("qty").over(Window.partitionBy("symbol"))
    return out.select("symbol", "buyer", "seller", "trades", "qty", "amt", "days", "largest", "first", "last", F.round(F.col("days") / F.least("a", "b"), 6).alias("recurrence"), F.round(F.col("qty") / total, 8).alias("share"))


def edges(trades: DataFrame, least_share: float) -> DataFrame:
    """Pairs of unlike brokers with at least so much of the symbol's volume."""
    e = trades.groupBy("symbol", F.col("buyer").alias("src"), F.col("seller").alias("dst")).agg(F.sum("qty").alias("qty"))
    return e.withColumn("total", F.sum("qty").over(Window.partitionBy("symbol"))).filter((F.col("src") != F.col("dst")) & (F.col("qty") >= least_share * F.col("total")))


def network(e: DataFrame) -> DataFrame:
    """Nodes, directed and undirected edges, density, mean degree and clustering, and the busiest broker of each symbol.

    Triangles come from joining edges on (symbol, shared end), with ends in order so that each counts once.
    """
    und = e.select("symbol", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = und.select("symbol", F.explode(F.array("a", "b")).alias("node")).groupBy("symbol", "node").agg(F.count("*").alias("k"))
    ab, bc, ac = und.alias("ab"), und.select("symbol", F.col("a").alias("b"), F.col("b").alias("c")), und.select("symbol", "a", F.col("b").alias("c"))
    tri = ab.join(bc, ["symbol", "b"]).join(ac, ["symbol", "a", "c"])
    in_ = tri.select("symbol", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("symbol", "node").agg(F.count("*").alias("t"))
    node = deg.join(in_, ["symbol", "node"], "left").withColumn("cl", F.when(F.col("k") < 2, 0.0).otherwise(2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))))
    n = node.groupBy("symbol").agg(F.count("*").alias("nodes"), F.round(F.avg("k"), 6).alias("mean_degree"), F.round(F.avg("cl"), 6).alias("clustering"), F.max_by("node", F.struct("k", -F.col("node"))).alias("busiest"))
    counts = e.groupBy("symbol").agg(F.count("*").alias("edges")).join(und.groupBy("symbol").agg(F.count("*").alias("undirected")), "symbol")
    return n.join(counts, "symbol").withColumn("density", F.round(ratio0(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 6))


def cycles3(e: DataFrame) -> DataFrame:
    """Directed rings of three brokers, named from the smallest, with the least of their three volumes."""
    step = lambda a, b, q: e.select("symbol", F.col("src").alias(a), F.col("dst").alias(b), F.col("qty").alias(q))
    r = step("a", "b", "q1").join(step("b", "c", "q2"), ["symbol", "b"]).filter((F.col("a") < F.col("b")) & (F.col("a") < F.col("c")))
    return r.join(step("c", "a", "q3"), ["symbol", "c", "a"]).select("symbol", "a", "b", "c", F.least("q1", "q2", "q3").alias("least"), (F.col("q1") + F.col("q2") + F.col("q3")).alias("qty"))


def cycles4(e: DataFrame) -> DataFrame:
    """Directed rings of four unlike brokers, named from the smallest."""
    step = lambda a, b, q: e.select("symbol", F.col("src").alias(a), F.col("dst").alias(b), F.col("qty").alias(q))
    a = F.col("a")
    r = step("a", "b", "q1").filter("a < b").join(step("b", "c", "q2"), ["symbol", "b"]).filter(a < F.col("c"))
    r = r.join(step("c", "d", "q3"), ["symbol", "c"]).filter((a < F.col("d")) & (F.col("b") != F.col("d")))
    return r.join(step("d", "a", "q4"), ["symbol", "d", "a"]).select("symbol", "a", "b", "c", "d", F.least("q1", "q2", "q3", "q4").alias("least"))


def sequence(trades: DataFrame, order: list[str]) -> DataFrame:
    """Trades in order within a symbol: how often a side repeats, its longest run, ticks up and down, and early against late size.

    Trades are sent to their sessions once and ordered there. A session leaves one row: what it begins and ends with, and the
    lengths of its first, last and longest runs, from which runs over several sessions are put together. So no symbol's whole
    tape is sorted in one task.
    """
    day, side = ["symbol", "dt"], {"b": "buyer", "s": "seller", "r": "rate"}
    ds = Window.partitionBy("symbol").orderBy("dt")
    before = F.coalesce(F.sum("m").over(ds.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = trades.groupBy(*day).agg(F.count("*").alias("m")).select(*day, before.alias("before"), F.sum("m").over(Window.partitionBy("symbol")).alias("all"))
    w = Window.partitionBy(*day).orderBy(*order)
    t = trades.join(counts, day).withColumns({"k": F.row_number().over(w).cast("long"), **{f"p{x}": F.lag(c).over(w) for x, c in side.items()}})
    t = t.withColumns({f"from_{x}": F.max(F.when(F.coalesce(F.col(side[x]) != F.col(f"p{x}"), F.lit(True)), F.col("k"))).over(w) for x in "bs"})  # where the run began
    at, half = F.struct(*order), (F.col("before") + F.col("k")) * 2 <= F.col("all")
    size = {"early": F.when(half, F.col("qty")), "late": F.when(~half, F.col("qty"))}
    d = t.groupBy(*day).agg(
        F.count("*").alias("m"), *(F.min_by(c, at).alias(f"first_{x}") for x, c in side.items()), *(F.max_by(c, at).alias(f"last_{x}") for x, c in side.items()),
        *(F.count_if(F.col(side[x]) == F.col(f"p{x}")).alias(f"same_{x}") for x in side), F.count_if(F.col("rate") > F.col("pr")).alias("up"), F.count_if(F.col("rate") < F.col("pr")).alias("down"),
        *(F.max(F.col("k") - F.col(f"from_{x}") + 1).alias(f"most_{x}") for x in "bs"), *(F.max(F.when(F.col(f"from_{x}") == 1, F.col("k"))).alias(f"head_{x}") for x in "bs"), *((F.count("*") - F.max(f"from_{x}") + 1).alias(f"tail_{x}") for x in "bs"),
        *(F.sum(q).alias(f"{x}_sum") for x, q in size.items()), *(F.count(q).alias(f"{x}_n") for x, q in size.items()),
    )
    d = d.withColumns({f"was_{x}": F.lag(f"last_{x}").over(ds) for x in side})
    d = d.withColumns({f"joins_{x}": F.coalesce(F.col(f"first_{x}") == F.col(f"was_{x}"), F.lit(False)) for x in side})
    # A session of one run that its forerunner's last run goes on into is no new part; a part's sessions add up to its last run.
    d = d.withColumns({f"part_{x}": F.sum((~(F.col(f"joins_{x}") & (F.col(f"head_{x}") == F.col("m")))).cast("int")).over(ds) for x in "bs"})
    d = d.withColumns({f"end_{x}": F.sum(f"tail_{x}").over(Window.partitionBy("symbol", f"part_{x}").orderBy("dt")) for x in "bs"})
    d = d.withColumns({f"over_{x}": F.when(F.col(f"joins_{x}"), F.lag(f"end_{x}").over(ds) + F.col(f"head_{x}")) for x in "bs"})
    return d.groupBy("symbol").agg(
        F.sum("m").alias("n"), (F.sum("same_b") + F.count_if("joins_b")).alias("buyer_repeats"), (F.sum("same_s") + F.count_if("joins_s")).alias("seller_repeats"),
        (F.sum("up") + F.count_if(F.col("first_r") > F.col("was_r"))).alias("up"), (F.sum("down") + F.count_if(F.col("first_r") < F.col("was_r"))).alias("down"), (F.sum("same_r") + F.count_if("joins_r")).alias("flat"),
        *(F.round(ratio(F.sum(f"{x}_sum"), F.sum(f"{x}_n")), 6).alias(f"{x}_qty") for x in size), *(F.greatest(F.max(f"most_{x}"), F.max(f"over_{x}")).alias(f"longest_{side[x]}_run") for x in "bs"),
    )


def affinity(flow: DataFrame) -> DataFrame:
    """What share of a broker's whole activity a symbol is, the symbol's rank for it, and its percentile among the symbol's brokers."""
    per = flow.groupBy("symbol", "broker").agg(F.sum(F.col("bought") + F.col("sold")).alias("gross"))
    a = per.withColumn("affinity", F.col("gross") / F.sum("gross").over(Window.partitionBy("broker")))
    return a.select(
        "symbol", "broker", "gross", F.round("affinity", 8).alias("affinity"), F.row_number().over(Window.partitionBy("broker").orderBy(F.desc("affinity"), "symbol")).alias("rank"),
        F.round((F.rank().over(Window.partitionBy("symbol").orderBy("affinity")) - 1) / F.count("*").over(Window.partitionBy("symbol")), 6).alias("percentile"),
    )


def repeats(trades: DataFrame, k: int = 5) -> DataFrame:
    """The k most repeated pairs, quantities, and buyers with quantities of each symbol; repeated_patterns has the other kinds."""
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    kinds = F.array(
        one("pair", F.concat_ws(">", F.col("buyer").cast("string"), F.col("seller").cast("string"))), one("quantity", F.col("qty").cast("string")), one("combination", F.concat_ws(":", F.col("buyer").cast("string"), F.col("qty").cast("string")))
    )
    c = trades.select("symbol", F.inline(kinds)).groupBy("symbol", "kind", "key").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc("n"), "key"))).filter(F.col("rank") <= k)


def anomaly(sessions: DataFrame, metrics: list[str], lookback: int = 60, least: int = 20) -> DataFrame:
    """How unusual a session is: |z| of each metric against the sessions before it, at most 5 each, and their mean."""
    prior = Window.partitionBy("symbol", "metric").orderBy("dt").rowsBetween(-lookback, -1)
    long_ = sessions.select("symbol", "dt", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))))
    z = long_.withColumns({"n": F.count("x").over(prior), "mean": F.avg("x").over(prior), "sd": F.stddev_pop("x").over(prior)}).filter(F.col("n") >= least)
    part = F.when(F.col("sd") < 1e-9, 0.0).otherwise(F.least(F.abs((F.col("x") - F.col("mean")) / F.col("sd")), F.lit(5.0)))
    return z.withColumn("part", part).groupBy("symbol", "dt").agg(F.round(F.avg("part"), 6).alias("score"), F.max_by("metric", F.struct(F.round("part", 6), "metric")).alias("oddest"))


def session_metrics(trades: DataFrame, flow: DataFrame) -> DataFrame:
    """The fourteen measures of a session that need no history: sizes, concentrations, flow quality, self trades.

    Trades are only ever summed by session and broker, pair or rate; the sessions are joined from those sums.
    """
    key, square = ["symbol", "dt"], lambda x: F.sum(x.cast("double") * x)
    vol, trade, brokers = F.col("volume").cast("double"), F.col("trades"), F.col("brokers")
    whole = trades.groupBy(*key).agg(F.count("*").alias("trades"), F.sum("qty").alias("volume"), F.sum("amt").alias("turnover"), F.sum(F.when(F.col("buyer") == F.col("seller"), F.col("qty")).otherwise(0)).alias("self"))
    by_broker = flow.groupBy(*key).agg(F.count("*").alias("brokers"), square(F.col("bought") + F.col("sold")).alias("gg"), square(F.col("bought")).alias("bb"), square(F.col("sold")).alias("ss"), F.sum(F.greatest("net", F.lit(0))).alias("pos"))
    by_pair = trades.groupBy(*key, "buyer", "seller").agg(F.sum("qty").alias("q")).groupBy(*key).agg(square(F.col("q")).alias("pp"), F.max("q").alias("top"))
    by_rate = trades.groupBy(*key, "rate").count().groupBy(*key).agg(F.max("count").alias("modal"))
    return whole.join(by_broker, key).join(by_pair, key).join(by_rate, key).select(
        *key, (vol / trade).alias("trade_size"), "volume", "turnover", (F.col("gg") / (4 * vol * vol)).alias("broker_concentration"), (F.col("bb") / (vol * vol)).alias("buyer_concentration"), (F.col("ss") / (vol * vol)).alias("seller_concentration"),
        (F.col("pp") / (vol * vol)).alias("pair_concentration"), (F.col("pos") / vol).alias("flow_quality"), (F.col("modal") / trade).alias("price_concentration"), trade.alias("trade_frequency"), brokers.alias("participation"),
        (trade / brokers).alias("fragmentation"), (F.col("self") / vol).alias("self_trade_pct"), (F.col("top") / vol).alias("top_pair_share"),
    )


def session_anomaly(trades: DataFrame, flow: DataFrame, least: int = 10) -> DataFrame:
    """How unusual a session is by fifteen measures: the mean of their |z| against all sessions before it, at most 5 each.

    The fifteenth is the net share of the broker whose net over those sessions is largest (the smallest wins ties),
    against that same broker's shares in them. Measures with |z| of 2 or more are flagged.
    """
    metrics = session_metrics(trades, flow)
    names = metrics.columns[2:]
    over = lambda *by: Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    stats = lambda w: {"n": F.count("x").over(w), "mean": F.avg("x").over(w), "sd": F.stddev_pop("x").over(w)}
    long_ = metrics.select("symbol", "dt", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in names)))).withColumns(stats(over("symbol", "metric")))
    grid = metrics.select("symbol", "dt", F.col("volume").alias("vol")).join(flow.select("symbol", "broker").distinct(), "symbol").join(flow.select("symbol", "dt", "broker", "net"), ["symbol", "dt", "broker"], "left")
    w = over("symbol", "broker")
    grid = grid.withColumn("x", F.coalesce("net", F.lit(0)) / F.col("vol")).withColumns({**stats(w), "base": F.abs(F.sum(F.coalesce("net", F.lit(0))).over(w))}).filter(F.col("n") >= least)
    fields = ["x", "n", "mean", "sd"]
    dominant = grid.groupBy("symbol", "dt").agg(F.max_by(F.struct(*fields), F.struct("base", -F.col("broker"))).alias("d")).select("symbol", "dt", F.lit("dominant_flow").alias("metric"), "d.*")
    z = long_.filter(F.col("n") >= least).unionByName(dominant).withColumn("z", F.when(F.col("sd") < 1e-9, 0.0).otherwise(F.abs((F.col("x") - F.col("mean")) / F.col("sd"))))
    part = F.least("z", F.lit(5.0))
    return z.groupBy("symbol", "dt").agg(
        F.round(F.avg(part), 6).alias("score"), F.max_by("metric", F.struct(F.round(part, 6), "metric")).alias("oddest"), F.array_sort(F.collect_list(F.when(F.round("z", 6) >= 2, F.col("metric")))).alias("flagged"), F.count("*").alias("metrics"), F.max("n").alias("baseline_sessions")
    )


def repeated_patterns(trades: DataFrame, flow: DataFrame, k: int = 3, large: float = 0.99) -> DataFrame:
    """The k most repeated of six kinds in each symbol, as (kind, a, b): pairs by sessions (buyer, seller), prices, price and
    quantity seen twice or more, net buyers and net sellers by sessions, and buyers of trades as large as the cut at `large`.

    The cut is the quantity at index floor(trades * large), found in the counts of each quantity. Share is of sessions, of
    trades, or of the large trades; the smallest (a, b) wins ties.
    """
    total = trades.groupBy("symbol").agg(F.count("*").alias("trades"), F.count_distinct("dt").alias("sessions"))
    kind = lambda df, name, a, b, of, more=F.lit(0): df.select("symbol", F.lit(name).alias("kind"), F.col(a).cast("double").alias("a"), (F.col(b) if b else F.lit(None)).cast("double").alias("b"), F.col("n"), more.cast("long").alias("more"), F.lit(of).alias("of"))
    counted = lambda df, *by: df.groupBy("symbol", *by).agg(F.count("*").alias("n"))
    pair = trades.groupBy("symbol", "buyer", "seller").agg(F.count_distinct("dt").alias("n"), F.sum("qty").alias("qty"))
    sizes = counted(trades, "qty").join(total.select("symbol", "trades"), "symbol").withColumn("upto", F.sum("n").over(Window.partitionBy("symbol").orderBy("qty")))
    cut = sizes.filter(F.col("upto") > F.least(F.col("trades") - 1, F.floor(F.col("trades") * F.lit(large)))).groupBy("symbol").agg(F.min("qty").alias("cut"))
    big = counted(trades.join(cut, "symbol").filter(F.col("qty") >= F.col("cut")), "buyer")
    all_ = kind(pair, "pair", "buyer", "seller", "sessions", F.col("qty"))
    for other in (
        kind(counted(trades, "rate"), "price", "rate", None, "trades"), kind(counted(trades, "rate", "qty").filter("n > 1"), "price_volume", "rate", "qty", "trades"),
        kind(counted(flow.filter("net > 0"), "broker"), "accumulator", "broker", None, "sessions"), kind(counted(flow.filter("net < 0"), "broker"), "distributor", "broker", None, "sessions"), kind(big, "large", "buyer", None, "large"),
    ):
        all_ = all_.unionByName(other)
    w = Window.partitionBy("symbol", "kind")
    ranked = all_.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), F.desc("more"), "a", "b")), "sum": F.sum("n").over(w)}).filter(F.col("rank") <= k).join(total, "symbol")
    below = F.when(F.col("of") == "sessions", F.col("sessions")).when(F.col("of") == "trades", F.col("trades")).otherwise(F.col("sum"))
    return ranked.select("symbol", "kind", "a", "b", "n", F.round(F.col("n") / below, 6).alias("share"), "rank")
