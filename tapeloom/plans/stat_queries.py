"""Statistics of sessions, sizes, prices and brokers."""

from pyspark.sql import functions as F

from ..functions.nulls import micro, ratio0
from ..operators import flow as fl
from ..operators import stats as op
from ..sources.tape import BARS_SQL, FLOW_SQL, TAPE_SQL, broker_flow, tape
from .bar_queries import day_bars
from .flow_queries import WINDOWED_SQL
from .registry import query


def six(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("session_stats", f"""WITH {TAPE_SQL} SELECT symbol, dt, count(*) AS trades, sum(qty)::BIGINT AS volume, round(sum(amt), 2) AS turnover, min(rate) AS low, max(rate) AS high, median(qty) AS median_qty, max(qty) AS max_qty,
  count(DISTINCT buyer) AS buyers, count(DISTINCT seller) AS sellers, micro(round(sum(amt), 2) / sum(qty)) AS vwap, round(stddev_pop(rate) / avg(rate), 6) AS cv, round(100 * (max(rate) - min(rate)) / min(rate), 6) AS range_pct, micro(sum(qty) / count(*)) AS mean_qty,
  max_by(rate, row(qty, ok, ln, pk, sk)) AS rate_of_largest FROM tape GROUP BY ALL""")
def session_stats(spark, sf_dir):
    return tape(spark, sf_dir).groupBy("symbol", "dt").agg(
        F.count("*").alias("trades"), F.sum("qty").alias("volume"), F.round(F.sum("amt"), 2).alias("turnover"), F.min("rate").alias("low"), F.max("rate").alias("high"), F.median("qty").alias("median_qty"), F.max("qty").alias("max_qty"),
        F.size(F.collect_set("buyer")).cast("long").alias("buyers"), F.size(F.collect_set("seller")).cast("long").alias("sellers"), micro(F.round(F.sum("amt"), 2) / F.sum("qty")).alias("vwap"), F.round(F.stddev_pop("rate") / F.avg("rate"), 6).alias("cv"),
        F.round(100 * (F.max("rate") - F.min("rate")) / F.min("rate"), 6).alias("range_pct"), micro(F.sum("qty") / F.count("*")).alias("mean_qty"), F.max_by("rate", F.struct("qty", "ok", "ln", "pk", "sk")).alias("rate_of_largest"),
    )


@query("price_stats", f"""WITH {TAPE_SQL}, m AS (SELECT symbol, rate, count(*) AS n, sum(qty) AS q FROM tape GROUP BY ALL), mode AS (SELECT symbol, max_by(rate, row(n, q, -rate)) AS mode_price, max_by(rate, row(q, n, -rate)) AS heaviest_price, count(*) AS levels FROM m GROUP BY symbol)
SELECT symbol, round(avg(rate), 6) AS mean, round(median(rate), 6) AS median, round(stddev_pop(rate), 6) AS sd, {', '.join(f'round(quantile_cont(rate, {p}), 6) AS p{int(p * 100)}' for p in (0.05, 0.25, 0.75, 0.95))},
  round(coalesce(kurtosis_pop(rate), 0), 6) AS kurtosis, round((avg(rate ** 3) - 3 * avg(rate) * var_pop(rate) - avg(rate) ** 3) / var_pop(rate) ** 1.5, 4) AS skew, any_value(mode_price) AS mode_price, any_value(heaviest_price) AS heaviest_price, any_value(levels) AS levels
FROM tape JOIN mode USING (symbol) GROUP BY symbol""")
def price_stats(spark, sf_dir):
    t = tape(spark, sf_dir)
    by = t.groupBy("symbol", "rate").agg(F.count("*").alias("n"), F.sum("qty").alias("q"))
    mode = by.groupBy("symbol").agg(F.max_by("rate", F.struct("n", "q", -F.col("rate"))).alias("mode_price"), F.max_by("rate", F.struct("q", "n", -F.col("rate"))).alias("heaviest_price"), F.count("*").alias("levels"))
    points = {"median": 0.5} | {f"p{int(p * 100)}": p for p in (0.05, 0.25, 0.75, 0.95)}
    q = op.linear_percentiles(by, "symbol", "rate", "n", points).select("symbol", *(F.round(c, 6).alias(c) for c in points))
    s = t.groupBy("symbol").agg(F.round(F.avg("rate"), 6).alias("mean"), F.round(F.stddev_pop("rate"), 6).alias("sd"), F.round(F.coalesce(F.kurtosis("rate"), F.lit(0.0)), 6).alias("kurtosis"), F.round(F.skewness("rate"), 4).alias("skew"))
    return s.join(q, "symbol").join(mode, "symbol").select("symbol", "mean", "median", "sd", *list(points)[1:], "kurtosis", "skew", "mode_price", "heaviest_price", "levels")


@query("size_moments", f"""WITH {TAPE_SQL}, s AS (SELECT symbol, count(*)::DOUBLE AS n, avg(qty) AS m, var_pop(qty) AS v, avg(qty ** 3) AS m3, kurtosis_pop(qty) AS k FROM tape GROUP BY symbol), g AS (SELECT *, (m3 - 3 * m * v - m ** 3) / v ** 1.5 AS g FROM s)
SELECT symbol, n::BIGINT AS n, round(g * sqrt(n * (n - 1)) / (n - 2), 6) AS skew_corrected, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6), 6) AS kurtosis_corrected FROM g""")
def size_moments(spark, sf_dir):
    return tape(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.round(op.corrected_skew("qty"), 6).alias("skew_corrected"), F.round(op.corrected_kurtosis("qty"), 6).alias("kurtosis_corrected"))


@query("vwap_set", f"""WITH {BARS_SQL}, d AS (SELECT symbol, dt, v, round(amount, 2) AS a, c FROM bars) SELECT symbol, dt, {', '.join(f'micro(round(sum(a) OVER w{n}, 2) / sum(v) OVER w{n}) AS vwap{n}' for n in (1, 3, 7, 15, 30))}, round(100 * (c / (round(sum(a) OVER w30, 2) / sum(v) OVER w30) - 1), 6) AS distance30
FROM d WINDOW {', '.join(f'w{n} AS (PARTITION BY symbol ORDER BY dt ROWS {n - 1} PRECEDING)' for n in (1, 3, 7, 15, 30))}""")
def vwap_set(spark, sf_dir):
    from ..operators.series import by_symbol

    b = day_bars(spark, sf_dir).withColumn("a", F.round("amount", 2))
    vwap = lambda n: F.round(F.sum("a").over(by_symbol().rowsBetween(1 - n, 0)), 2) / F.sum("v").over(by_symbol().rowsBetween(1 - n, 0))
    return b.select("symbol", "dt", *(micro(vwap(n)).alias(f"vwap{n}") for n in (1, 3, 7, 15, 30)), F.round(100 * (F.col("c") / vwap(30) - 1), 6).alias("distance30"))


PROFILE_SQL = f"""{TAPE_SQL}, span AS (SELECT symbol, min(rate) AS lo, max(rate) AS hi FROM tape GROUP BY symbol),
lev AS (SELECT symbol, least(floor((rate - lo) / ((hi - lo) / 24)), 23)::INT AS level, sum(qty)::BIGINT AS volume, count(*) AS trades FROM tape JOIN span USING (symbol) GROUP BY ALL)"""


@query("volume_profile", f"""WITH {PROFILE_SQL} SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, level) = 1 AS poc, round(volume / sum(volume) OVER (PARTITION BY symbol), 6) AS share, volume >= 1.5 * avg(volume) OVER (PARTITION BY symbol) AS heavy FROM lev""")
def volume_profile(spark, sf_dir):
    return six(op.volume_profile(tape(spark, sf_dir), ["symbol"]), "share")


@query("value_area", f"""WITH RECURSIVE {PROFILE_SQL}, full_ AS MATERIALIZED (SELECT s.symbol, g.level, coalesce(volume, 0) AS v FROM span s CROSS JOIN (SELECT unnest(range(0, 24))::INT AS level) g LEFT JOIN lev ON lev.symbol = s.symbol AND lev.level = g.level),
poc AS MATERIALIZED (SELECT symbol, max_by(level, row(v, -level)) AS poc, max(v) AS v, sum(v) AS total FROM full_ GROUP BY symbol),
va AS (SELECT symbol, poc, total, poc AS lo, poc AS hi, v::HUGEINT AS acc FROM poc UNION ALL
  SELECT symbol, poc, total, CASE WHEN u >= d THEN lo ELSE lo - 1 END, CASE WHEN u >= d THEN hi + 1 ELSE hi END, acc + greatest(u, d) FROM (
    SELECT va.*, CASE WHEN hi < 23 THEN (SELECT any_value(v) FROM full_ f WHERE f.symbol = va.symbol AND f.level = va.hi + 1) ELSE -1 END AS u, CASE WHEN lo > 0 THEN (SELECT any_value(v) FROM full_ f WHERE f.symbol = va.symbol AND f.level = va.lo - 1) ELSE -1 END AS d FROM va WHERE acc < 0.70 * total) WHERE u >= 0 OR d >= 0)
SELECT symbol, any_value(poc) AS poc, min(lo) AS va_low, max(hi) AS va_high, round(max(acc) / any_value(total), 6) AS held FROM va GROUP BY symbol""")
def value_area(spark, sf_dir):
    return op.value_area(op.volume_profile(tape(spark, sf_dir), ["symbol"]), ["symbol"])


@query("session_profile", f"""WITH {TAPE_SQL}, p AS (SELECT symbol, dt, rate, sum(qty) AS q FROM tape GROUP BY ALL), s AS (SELECT *, q / sum(q) OVER w AS p, min(rate) OVER w AS lo, max(rate) OVER w AS hi, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY symbol, dt))
SELECT symbol, dt, any_value(n) AS levels, round(CASE WHEN any_value(n) > 1 THEN -sum(p * ln(p)) / ln(any_value(n)) ELSE 0 END, 6) AS entropy, {', '.join(f'round(sum(CASE WHEN {c} THEN p ELSE 0 END), 6) AS {n}' for c, n in (('hi > lo AND (rate - lo) / (hi - lo) < 1/3::DOUBLE', 'low_third'), ('hi = lo OR ((rate - lo) / (hi - lo) >= 1/3::DOUBLE AND (rate - lo) / (hi - lo) < 2/3::DOUBLE)', 'mid_third'), ('hi > lo AND (rate - lo) / (hi - lo) >= 2/3::DOUBLE', 'high_third')))} FROM s GROUP BY symbol, dt""")
def session_profile(spark, sf_dir):
    """How a session's volume spreads over its prices: normalised entropy, and shares of the thirds of its range."""
    from pyspark.sql import Window

    p = tape(spark, sf_dir).groupBy("symbol", "dt", "rate").agg(F.sum("qty").alias("q"))
    w = Window.partitionBy("symbol", "dt")
    s = p.withColumns({"p": F.col("q") / F.sum("q").over(w), "lo": F.min("rate").over(w), "hi": F.max("rate").over(w), "n": F.count("*").over(w)})
    pos = F.when(F.col("hi") > F.col("lo"), (F.col("rate") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    third = lambda c: F.round(F.sum(F.when(c, F.col("p")).otherwise(0.0)), 6)
    s = s.withColumn("pos", pos)
    n = F.max("n")
    return s.groupBy("symbol", "dt").agg(
        n.alias("levels"), F.round(F.when(n > 1, -F.sum(F.col("p") * F.ln("p")) / F.ln(n)).otherwise(0.0), 6).alias("entropy"),
        third(F.col("pos") < 1 / 3).alias("low_third"), third((F.col("pos") >= 1 / 3) & (F.col("pos") < 2 / 3)).alias("mid_third"), third(F.col("pos") >= 2 / 3).alias("high_third"),
    )


@query("size_thresholds", f"""WITH {TAPE_SQL} SELECT symbol, quantile_cont(qty, 0.9) AS large_qty, quantile_cont(qty, 0.25) AS small_qty, median(qty) AS median_qty, round(quantile_cont(amt, 0.9), 4) AS large_amt, round(quantile_cont(amt, 0.25), 4) AS small_amt,
  list_sort(list(qty))[round_even(0.9 * (count(*) - 1), 0)::INT + 1] AS nearest_rank_90, list_sort(list(qty))[count(*) // 2 + 1] AS upper_median FROM tape GROUP BY symbol""")
def size_thresholds(spark, sf_dir):
    p = lambda c, q: F.percentile(c, F.lit(q))
    t = tape(spark, sf_dir)
    return t.groupBy("symbol").agg(
        p("qty", 0.9).alias("large_qty"), p("qty", 0.25).alias("small_qty"), F.median("qty").alias("median_qty"), F.round(p("amt", 0.9), 4).alias("large_amt"), F.round(p("amt", 0.25), 4).alias("small_amt"),
    ).join(op.ranked_values(t, "symbol", "qty"), "symbol")


@query("large_trades", f"""WITH {TAPE_SQL}, k AS (SELECT symbol, quantile_cont(qty, 0.9) AS cut FROM tape GROUP BY symbol) SELECT symbol, any_value(cut) AS cut, count(*) FILTER (qty >= cut) AS n, sum(qty) FILTER (qty >= cut)::BIGINT AS qty, round(sum(qty) FILTER (qty >= cut) / sum(qty), 6) AS share,
  count(DISTINCT buyer) FILTER (qty >= cut) AS buyers, count(DISTINCT seller) FILTER (qty >= cut) AS sellers, round(count(DISTINCT dt) FILTER (qty >= cut) / count(DISTINCT dt), 6) AS persistence, max(qty) AS largest FROM tape JOIN k USING (symbol) GROUP BY symbol""")
def large_trades(spark, sf_dir):
    return six(op.large_trades(tape(spark, sf_dir)), "share", "persistence")


@query("broker_size_signature", f"""WITH {TAPE_SQL}, k AS (SELECT symbol, quantile_cont(qty, 0.9) AS big, quantile_cont(qty, 0.25) AS small FROM tape GROUP BY symbol),
s AS (SELECT symbol, buyer AS broker, qty FROM tape UNION ALL SELECT symbol, seller, qty FROM tape)
SELECT symbol, broker, count(*) AS trades, round(avg(qty), 6) AS mean_qty, median(qty) AS median_qty, round(avg((qty >= big)::INT), 6) AS large_share, round(avg((qty <= small)::INT), 6) AS small_share, round(coalesce(stddev_pop(qty) / avg(qty), 0), 6) AS cv
FROM s JOIN k USING (symbol) GROUP BY symbol, broker HAVING count(*) >= 5""")
def broker_size_signature(spark, sf_dir):
    """Brokers with five trades or more in a symbol: how large and how even their trades are."""
    t = tape(spark, sf_dir)
    cuts = t.groupBy("symbol").agg(F.percentile("qty", F.lit(0.9)).alias("big"), F.percentile("qty", F.lit(0.25)).alias("small"))
    s = t.select("symbol", F.explode(F.array("buyer", "seller")).alias("broker"), "qty").join(cuts, "symbol")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return s.groupBy("symbol", "broker").agg(
        F.count("*").alias("trades"), F.round(F.avg("qty"), 6).alias("mean_qty"), F.median("qty").alias("median_qty"), share(F.col("qty") >= F.col("big")).alias("large_share"), share(F.col("qty") <= F.col("small")).alias("small_share"), F.round(ratio0(F.stddev_pop("qty"), F.avg("qty")), 6).alias("cv")
    ).filter("trades >= 5")


@query("concentration", f"""WITH {WINDOWED_SQL}, u AS (SELECT symbol, w, broker, 'buy' AS side, bought::DOUBLE AS x FROM win UNION ALL SELECT symbol, w, broker, 'sell', sold FROM win UNION ALL SELECT symbol, w, broker, 'gross', bought + sold FROM win),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol, w, side ORDER BY x DESC, broker) AS i, x / sum(x) OVER (PARTITION BY symbol, w, side) AS p FROM u WHERE x > 0)
SELECT symbol, w, side, {', '.join(f'round(sum(p) FILTER (i <= {k}), 6) AS top{k}' for k in (1, 3, 5, 10))}, round(sum(p * p), 6) AS hhi, round(-sum(p * ln(p)), 6) AS entropy, round(exp(-sum(p * ln(p))), 6) AS effective FROM p GROUP BY symbol, w, side""")
def concentration(spark, sf_dir):
    return six(op.concentration(fl.windowed(broker_flow(tape(spark, sf_dir))), ["symbol", "w"]), "top1", "top3", "top5", "top10", "hhi", "entropy", "effective")


@query("pareto", f"""WITH {FLOW_SQL}, b AS (SELECT symbol, broker, sum(bought + sold)::BIGINT AS gross FROM flow GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY gross DESC) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b)
SELECT symbol, {', '.join(f'round(sum(gross) FILTER (i <= greatest(1, ceil(n * {p}))) / sum(gross), 6) AS top{int(p * 100)}' for p in (0.05, 0.1, 0.2))} FROM r GROUP BY symbol""")
def pareto(spark, sf_dir):
    b = broker_flow(tape(spark, sf_dir)).groupBy("symbol", "broker").agg(F.sum(F.col("bought") + F.col("sold")).alias("gross"))
    return six(op.pareto(b, ["symbol"], "gross"), "top5", "top10", "top20")


@query("baseline_stats", f"""WITH {BARS_SQL} SELECT symbol, count(v) AS n, round(avg(v), 6) AS mean, median(v) AS median, round(stddev_pop(v), 6) AS sd, round(var_pop(v), 4) AS variance, min(v) AS least, max(v) AS most, {', '.join(f'round(quantile_cont(v, {p}), 6) AS p{int(p * 100)}' for p in (0.1, 0.25, 0.75, 0.9))},
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(stddev_pop(v) / avg(v), 6) AS cv, round((avg(v ** 3) - 3 * avg(v) * var_pop(v) - avg(v) ** 3) / var_pop(v) ** 1.5, 6) AS skew, round(kurtosis_pop(v), 6) AS kurtosis, round(avg((v > 0)::INT), 6) AS positive FROM bars GROUP BY symbol""")
def baseline_stats(spark, sf_dir):
    b = op.baseline(day_bars(spark, sf_dir), "symbol", "v")
    return six(b, "mean", "sd", "p10", "p25", "p75", "p90", "iqr", "cv", "skew", "kurtosis", "positive").withColumn("variance", F.round("variance", 4))


@query("pit_percentile", f"""WITH {BARS_SQL}, l AS (SELECT symbol, dt, v, list(v) OVER w AS p, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, v, CASE WHEN len(p) >= 20 THEN micro(100 * (len(list_filter(p, lambda x: x < v)) + 0.5 * len(list_filter(p, lambda x: x = v))) / len(p)) END AS pct, CASE WHEN len(p) >= 20 THEN round(CASE WHEN sd < 1e-12 THEN 0 ELSE (v - m) / sd END, 6) END AS z FROM l""")
def pit_percentile(spark, sf_dir):
    return op.point_in_time(day_bars(spark, sf_dir).select("symbol", "dt", "v"), "v", 60, 20).select("symbol", "dt", "v", micro(F.col("pct")).alias("pct"), F.round("z", 6).alias("z"))


@query("consensus", f"""WITH {WINDOWED_SQL}, g AS (SELECT *, bought + sold AS gross, net / (bought + sold) AS imb, CASE WHEN net > 0 THEN 1 WHEN net < 0 THEN -1 ELSE 0 END AS s FROM win)
SELECT symbol, w, count(*) FILTER (s > 0) AS buyers, count(*) FILTER (s < 0) AS sellers, round(sum(gross * s) / sum(gross), 6) AS weighted, round(stddev_pop(imb), 6) AS dispersion, round(max(gross) / sum(gross), 6) AS top_dependence,
  CASE WHEN count(*) FILTER (s > 0) >= 0.6 * count(*) THEN 'broad buying' WHEN count(*) FILTER (s < 0) >= 0.6 * count(*) THEN 'broad selling' ELSE 'split' END AS label FROM g GROUP BY symbol, w""")
def consensus(spark, sf_dir):
    """How far brokers agree: camps, gross-weighted sign, spread of imbalance, dependence on the largest."""
    w = fl.windowed(broker_flow(tape(spark, sf_dir)))
    g = w.withColumns({"gross": F.col("bought") + F.col("sold"), "s": F.signum(F.col("net").cast("double"))}).withColumn("imb", F.col("net") / F.col("gross"))
    buyers, sellers = F.count_if(F.col("s") > 0), F.count_if(F.col("s") < 0)
    return g.groupBy("symbol", "w").agg(
        buyers.alias("buyers"), sellers.alias("sellers"), F.round(F.sum(F.col("gross") * F.col("s")) / F.sum("gross"), 6).alias("weighted"), F.round(F.stddev_pop("imb"), 6).alias("dispersion"), F.round(F.max("gross") / F.sum("gross"), 6).alias("top_dependence"),
        F.when(buyers >= 0.6 * F.count("*"), "broad buying").when(sellers >= 0.6 * F.count("*"), "broad selling").otherwise("split").alias("label"),
    )


@query("breadth_trend", f"""WITH {WINDOWED_SQL}, b AS (SELECT symbol, w, count(*) FILTER (net > 0) / count(*) AS b FROM win GROUP BY ALL)
SELECT symbol, {', '.join(f'round(max(b) FILTER (w = {w}), 6) AS w{w}' for w in (3, 7, 15, 30))}, CASE WHEN max(b) FILTER (w = 3) > max(b) FILTER (w = 7) AND max(b) FILTER (w = 7) > max(b) FILTER (w = 15) THEN 'widening' WHEN max(b) FILTER (w = 3) < max(b) FILTER (w = 7) AND max(b) FILTER (w = 7) < max(b) FILTER (w = 15) THEN 'narrowing' ELSE 'mixed' END AS trend FROM b GROUP BY symbol""")
def breadth_trend(spark, sf_dir):
    b = fl.windowed(broker_flow(tape(spark, sf_dir))).groupBy("symbol").pivot("w", list(fl.WINDOWS)).agg(F.count_if(F.col("net") > 0) / F.count("broker"))
    a, m, z = F.col("3"), F.col("7"), F.col("15")
    trend = F.when((a > m) & (m > z), "widening").when((a < m) & (m < z), "narrowing").otherwise("mixed")
    return b.select("symbol", *(F.round(F.col(str(w)), 6).alias(f"w{w}") for w in fl.WINDOWS), trend.alias("trend"))


@query("fragmentation", f"""WITH {FLOW_SQL}, d AS (SELECT symbol, dt, dense_rank() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM tape), t AS (SELECT DISTINCT symbol, dt, age FROM d),
f AS (SELECT symbol, w, count(*) AS trades, sum(qty) AS q, count(DISTINCT buyer * 1000 + seller) AS pairs, count(DISTINCT buyer) AS buyers FROM tape JOIN t USING (symbol, dt), (SELECT unnest([3, 7, 15, 30]) AS w) WHERE age <= w GROUP BY ALL)
SELECT symbol, {', '.join(f'max(trades) FILTER (w = {w}) AS trades{w}, round(max(q / trades) FILTER (w = {w}), 6) AS mean_qty{w}, round(max(pairs / trades) FILTER (w = {w}), 6) AS pairs_per_trade{w}' for w in (3, 30))} FROM f GROUP BY symbol""")
def fragmentation(spark, sf_dir):
    t = fl.recent_sessions(tape(spark, sf_dir), 30)
    w = t.select("*", F.explode(F.filter(F.array(F.lit(3), F.lit(30)), lambda x: x >= F.col("age"))).alias("w"))
    f = w.groupBy("symbol", "w").agg(F.count("*").alias("trades"), F.sum("qty").alias("q"), F.count_distinct("buyer", "seller").alias("pairs"))
    at = lambda w, x: F.max(F.when(F.col("w") == w, x))
    return f.groupBy("symbol").agg(*(c for w in (3, 30) for c in (at(w, F.col("trades")).alias(f"trades{w}"), F.round(at(w, F.col("q") / F.col("trades")), 6).alias(f"mean_qty{w}"), F.round(at(w, F.col("pairs") / F.col("trades")), 6).alias(f"pairs_per_trade{w}"))))


@query("weighted_quantiles", f"""WITH {TAPE_SQL}, p AS (SELECT symbol, rate, sum(qty)::BIGINT AS q FROM tape GROUP BY ALL), c AS (SELECT *, sum(q) OVER (PARTITION BY symbol ORDER BY rate) AS cum, sum(q) OVER (PARTITION BY symbol) AS total FROM p)
SELECT symbol, min(rate) FILTER (cum >= 0.25 * total) AS q25, min(rate) FILTER (cum >= 0.5 * total) AS weighted_median, min(rate) FILTER (cum >= 0.75 * total) AS q75 FROM c GROUP BY symbol""")
def weighted_quantiles(spark, sf_dir):
    levels = tape(spark, sf_dir).groupBy("symbol", "rate").agg(F.sum("qty").alias("q"))
    parts = [op.weighted_quantile(levels, ["symbol"], "rate", "q", p, n) for p, n in ((0.25, "q25"), (0.5, "weighted_median"), (0.75, "q75"))]
    return parts[0].join(parts[1], "symbol").join(parts[2], "symbol")


@query("spearman_volume_return", f"""WITH {BARS_SQL}, r AS (SELECT symbol, dt, v, c / lag(c) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM bars), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2 AS ry FROM r WHERE ret IS NOT NULL)
SELECT symbol, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY symbol""")
def spearman_volume_return(spark, sf_dir):
    from ..operators.series import by_symbol

    r = day_bars(spark, sf_dir).select("symbol", "dt", "v", (F.col("c") / F.lag("c").over(by_symbol()) - 1).alias("ret"))
    return six(op.spearman(r, "v", "ret", ["symbol"]), "rho")
