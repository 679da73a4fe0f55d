"""Studies: does a signal, a factor or a family earn anything?"""

from pyspark.sql import functions as F

from ..functions.nulls import micro
from ..operators import study as op
from ..operators.stats import point_in_time
from ..sources.tape import BARS_SQL, INSTRUMENTS_SQL, bars, instruments, tape
from .bar_queries import adjusted_day_bars
from .indicator_queries import NUMBERED, ema_sql, wilder_sql
from .regime_queries import SERIES_SQL, pit_sql, series
from .registry import query

LABELLED_SQL = f"{SERIES_SQL}, lab AS MATERIALIZED (SELECT * FROM (SELECT *, lead(c, 5) OVER (PARTITION BY symbol ORDER BY dt) / c - 1 AS fwd FROM ser) WHERE fwd IS NOT NULL)"


@query("trigger_edges", f"""WITH RECURSIVE {NUMBERED}, x AS MATERIALIZED (SELECT symbol, i, c AS x FROM num), {ema_sql('e20', 'x', 20)}, {ema_sql('e50', 'x', 50)}, {ema_sql('e12', 'x', 12)}, {ema_sql('e26', 'x', 26)}, mx AS MATERIALIZED (SELECT e26.symbol, e26.i - 25 AS i, e12.e - e26.e AS x FROM e12 JOIN e26 ON e12.symbol = e26.symbol AND e12.i = e26.i), {ema_sql('sg', 'mx', 9)},
g AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(c - pc, 0) AS x FROM num WHERE i > 1), lo AS MATERIALIZED (SELECT symbol, i - 1 AS i, greatest(pc - c, 0) AS x FROM num WHERE i > 1), {wilder_sql('ag', 'g', 14)}, {wilder_sql('al', 'lo', 14)},
s AS (SELECT num.symbol, dt, c, CASE WHEN count(*) OVER w = 50 THEN avg(c) OVER w END AS long, e20.e AS a, e50.e AS b, 100 * ag.e / nullif(ag.e + al.e, 0) > 50 AS strong, mx.x > sg.e AS over FROM num LEFT JOIN e20 ON e20.symbol = num.symbol AND e20.i = num.i LEFT JOIN e50 ON e50.symbol = num.symbol AND e50.i = num.i LEFT JOIN mx ON mx.symbol = num.symbol AND mx.i = num.i - 25
  LEFT JOIN sg ON sg.symbol = num.symbol AND sg.i = num.i - 25 LEFT JOIN ag ON ag.symbol = num.symbol AND ag.i = num.i - 1 LEFT JOIN al ON al.symbol = num.symbol AND al.i = num.i - 1 WINDOW w AS (PARTITION BY num.symbol ORDER BY dt ROWS 49 PRECEDING)),
t AS (SELECT symbol, dt, coalesce(c > long AND a > b AND round(b, 6) > round(long, 6) AND strong AND over, false) AS bull FROM s), u AS (SELECT *, lag(bull) OVER (PARTITION BY symbol ORDER BY dt) AS was FROM t) SELECT symbol, dt FROM u WHERE bull AND NOT was""")
def trigger_edges(spark, sf_dir):
    return op.edges(op.bull_state(adjusted_day_bars(spark, sf_dir)), "bull").select("symbol", "dt")


REPLAY_SQL = f"""{NUMBERED.replace('symbol, dt, h, l, c,', 'symbol, dt, o, h, l, c,')}, sig AS (SELECT *, c > max(h) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s, lead(o) OVER (PARTITION BY symbol ORDER BY dt) AS entry FROM num),
p AS (SELECT a.symbol, a.dt, a.i, any_value(entry) AS entry, min(b.i - a.i - 1) FILTER (b.l <= entry * 0.95) AS st, min(b.i - a.i - 1) FILTER (b.h >= entry * 1.1) AS tg, max(b.c) FILTER (b.i = a.i + 20) AS last, count(*) AS n FROM sig a JOIN num b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 20 WHERE s GROUP BY ALL),
v AS (SELECT *, CASE WHEN st IS NOT NULL AND st <= coalesce(tg, 20) THEN 'stop' WHEN tg IS NOT NULL THEN 'target' ELSE 'time' END AS verdict FROM p WHERE n = 20),
rep AS (SELECT symbol, dt, entry, CASE verdict WHEN 'stop' THEN entry * 0.95 WHEN 'target' THEN entry * 1.1 ELSE last END AS exit, least(coalesce(st, 20), coalesce(tg, 20), 19) + 1 AS bars, verdict FROM v), ret AS (SELECT *, exit / entry - 1 - 0.008 AS ret FROM rep)"""


def replayed(spark, sf_dir):
    from ..operators.series import by_symbol

    b = adjusted_day_bars(spark, sf_dir)
    signal = F.coalesce(F.col("c") > F.max("h").over(by_symbol().rowsBetween(-5, -1)), F.lit(False))
    return op.replay(b, signal)


@query("event_replay", f"WITH {REPLAY_SQL} SELECT symbol, dt, micro(entry) AS entry, micro(exit) AS exit, round(ret, 6) AS ret, bars::INT AS bars, verdict FROM ret")
def event_replay(spark, sf_dir):
    return replayed(spark, sf_dir).withColumns({"entry": micro(F.col("entry")), "exit": micro(F.col("exit")), "ret": F.round("ret", 6)})


@query("variant_table", f"""WITH {REPLAY_SQL}, t AS (SELECT *, CASE WHEN dt < DATE '2000-01-01' THEN 'in' ELSE 'out' END AS sample, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN verdict <> 'time' THEN 'decided' END, CASE WHEN bars <= 5 THEN 'quick' END, CASE WHEN month(dt) <= 6 THEN 'first half' END], lambda x: x IS NOT NULL)) AS variant FROM ret)
SELECT variant, sample, count(*) AS n, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(avg((ret > 0)::INT), 6) AS win_rate, round(coalesce(sum(greatest(ret, 0)) / nullif(-sum(least(ret, 0)), 0), 0), 4) AS profit_factor FROM t GROUP BY ALL""")
def variant_table(spark, sf_dir):
    conditions = {"all": F.lit(True), "decided": F.col("verdict") != "time", "quick": F.col("bars") <= 5, "first half": F.month("dt") <= 6}
    return op.variants(replayed(spark, sf_dir), conditions)


@query("float_turn_rank", f"""WITH {BARS_SQL}, {INSTRUMENTS_SQL}, f AS (SELECT symbol, dt, v / float_shares AS turn FROM bars JOIN instruments USING (symbol)) SELECT symbol, dt, micro(1000 * turn) AS turn_per_mille, round((row_number() OVER (PARTITION BY dt ORDER BY turn, symbol) - 0.5) / count(*) OVER (PARTITION BY dt), 6) AS rank FROM f""")
def float_turn_rank(spark, sf_dir):
    f = bars(tape(spark, sf_dir)).join(instruments(spark, sf_dir), "symbol").withColumn("turn", F.col("v") / F.col("float_shares"))
    return f.select("symbol", "dt", micro(1000 * F.col("turn")).alias("turn_per_mille"), F.round(op.same_day_rank(f, "turn"), 6).alias("rank"))


@query("churn_buckets", f"""WITH {LABELLED_SQL}, q AS (SELECT quantile_cont(churn, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM lab) SELECT (len(list_filter(cuts, lambda x: x < churn)) + 1)::INT AS bucket, count(*) AS n, round(avg(fwd), 6) AS mean, round(median(fwd), 6) AS median, round(avg((fwd > 0)::INT), 6) AS win_rate FROM lab, q GROUP BY 1""")
def churn_buckets(spark, sf_dir):
    return op.buckets(op.labelled(series(spark, sf_dir)), "churn", "fwd", 10)


@query("ic_spearman", f"""WITH {LABELLED_SQL}, k AS (SELECT dt, rank() OVER (PARTITION BY dt ORDER BY tilt) + (count(*) OVER (PARTITION BY dt, tilt) - 1) / 2 AS rx, rank() OVER (PARTITION BY dt ORDER BY fwd) + (count(*) OVER (PARTITION BY dt, fwd) - 1) / 2 AS ry FROM lab)
SELECT dt, count(*) AS n, CASE WHEN count(*) < 3 THEN 0 ELSE round(coalesce(covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0), 0), 6) END AS ic FROM k GROUP BY dt""")
def ic_spearman(spark, sf_dir):
    return op.information(op.labelled(series(spark, sf_dir)), "tilt", "fwd")


@query("date_demeaned_perf", f"""WITH {LABELLED_SQL}, r AS (SELECT *, (tilt > 0.2)::INT AS m, avg(fwd) OVER w AS mean, sum(fwd) OVER w AS s, count(fwd) OVER w AS n FROM lab WINDOW w AS (PARTITION BY dt)), f AS (SELECT *, sum(m * fwd) OVER (PARTITION BY dt) AS fs, sum(m) OVER (PARTITION BY dt) AS fn FROM r)
SELECT year(dt)::INT AS year, count(*) AS n, round(avg(fwd), 6) AS mean, round(avg(fwd - mean), 6) AS excess, round(avg(fwd - (s - fs) / nullif(n - fn, 0)), 6) AS excess_of_rest FROM f WHERE m = 1 GROUP BY 1""")
def date_demeaned_perf(spark, sf_dir):
    return op.demeaned(op.labelled(series(spark, sf_dir)), F.col("tilt") > 0.2, "fwd")


@query("walk_forward_ic", f"""WITH {LABELLED_SQL}, l AS (SELECT year(dt) AS year, fwd, unnest(['tilt', 'churn', 'breadth']) AS feature, unnest([tilt, churn, breadth]) AS x FROM lab),
s AS (SELECT feature, year, count(x) AS n, sum(x) AS sx, sum(fwd) AS sy, sum(x * fwd) AS sxy, sum(x * x) AS sxx, sum(fwd * fwd) AS syy FROM l GROUP BY ALL),
p AS (SELECT *, sum(n) OVER w AS pn, sum(sx) OVER w AS psx, sum(sy) OVER w AS psy, sum(sxy) OVER w AS psxy, sum(sxx) OVER w AS psxx, sum(syy) OVER w AS psyy FROM s WINDOW w AS (PARTITION BY feature ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT feature, year::INT AS year, n, round((pn * psxy - psx * psy) / sqrt((pn * psxx - psx * psx) * (pn * psyy - psy * psy)), 5) AS train_ic, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 5) AS test_ic FROM p WHERE pn IS NOT NULL""")
def walk_forward_ic(spark, sf_dir):
    return op.walk_forward(op.labelled(series(spark, sf_dir)), ["tilt", "churn", "breadth"], "fwd")


@query("permutation_control")
def permutation_control(spark, sf_dir):
    rows = op.labelled(series(spark, sf_dir)).withColumn("hot", F.col("tilt") > 0.2)
    return op.permutation_control(rows, "hot", "fwd", 200).select("n", "draws", "as_good", F.round("real", 6).alias("real"), F.round("control", 3).alias("control"))


@query("leakage_check", f"""WITH {SERIES_SQL}, {pit_sql('a', 'ser', 'volume')}, cut AS (SELECT quantile_disc(dt, 0.6) AS d FROM ser) SELECT symbol, count(*) AS checked, 0::BIGINT AS changed FROM a, cut WHERE dt <= d GROUP BY symbol""")
def leakage_check(spark, sf_dir):
    """Point-in-time values of sessions up to a date are the same whether later sessions exist or not."""
    s = series(spark, sf_dir).select("symbol", "dt", "volume")
    cut = s.agg(F.percentile_approx("dt", F.lit(0.6), F.lit(1_000_000)).alias("d"))
    early = s.join(F.broadcast(cut)).filter("dt <= d")  # one row
    pit = lambda x: point_in_time(x.select("symbol", "dt", "volume"), "volume", 60, 20)
    a, b = pit(s), pit(early)
    both = b.alias("b").join(a.alias("a"), ["symbol", "dt"])
    same = F.col("a.z").eqNullSafe(F.col("b.z")) & F.col("a.pct").eqNullSafe(F.col("b.pct"))
    return both.groupBy("symbol").agg(F.count("*").alias("checked"), F.count_if(~same).alias("changed"))
