"""Bars at several periods, adjustment, filling, and what is derived from a series of them."""

from pyspark.sql import functions as F

from ..functions.nulls import micro
from ..operators import series as op
from ..sources.tape import BARS_SQL, FLOW_SQL, TAPE_SQL, TICKS_SQL, bars, broker_flow, tape, ticks
from .registry import query

ROUND = "micro(o) AS o, micro(h) AS h, micro(l) AS l, micro(c) AS c"
EX_SQL = f"""{BARS_SQL},
lagged AS (SELECT *, lag(c) OVER w AS prev, lag(dt) OVER w AS prev_dt FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
ex AS (SELECT symbol, dt, c / prev AS factor FROM lagged WHERE prev > 0 AND o / prev - 1 <= -0.105 AND c / prev - 1 <= -0.105 AND c / prev >= 0.2
       AND 365 * (year(dt) - year(prev_dt)) + 30 * (month(dt) - month(prev_dt)) + day(dt) - day(prev_dt) <= 60)"""
FACTOR_SQL = "exp(coalesce(sum(round(ln(factor) * 1e12)::BIGINT) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::DOUBLE / 1e12)"
#: Adjusted bars under the name of the plain ones, for what reads prices over time.
ADJUSTED_SQL = f"""{EX_SQL.replace("bars AS (", "raw AS (").replace("FROM bars ", "FROM raw ")},
bars AS MATERIALIZED (SELECT symbol, dt, o * adj AS o, h * adj AS h, l * adj AS l, c * adj AS c, v, amount FROM (SELECT raw.*, {FACTOR_SQL} AS adj FROM raw LEFT JOIN ex USING (symbol, dt)))"""
MINUTE_SQL = f"""{TICKS_SQL},
minutes AS (SELECT instrument, date_trunc('minute', ts) AS minute, min_by(price, seq) AS o, max(price) AS h, min(price) AS l, max_by(price, seq) AS c, count(*) AS n, round(sum(price), 4) AS amount FROM ticks GROUP BY ALL)"""


def rounded(df, *names):
    return df.withColumns({c: micro(F.col(c)) for c in names or "ohlc"})


def day_bars(spark, sf_dir):
    return bars(tape(spark, sf_dir))


def adjusted_day_bars(spark, sf_dir):
    return op.adjusted(day_bars(spark, sf_dir)).drop("adj")


@query("bars_daily", f"WITH {BARS_SQL} SELECT symbol, dt, {ROUND}, v, round(amount, 2) AS amount FROM bars")
def bars_daily(spark, sf_dir):
    return rounded(day_bars(spark, sf_dir)).withColumn("amount", F.round("amount", 2))


def _period_sql(expr):
    return f"""WITH {TAPE_SQL} SELECT symbol, {expr} AS dt, micro(min_by(rate, row(dt, ok, ln, pk, sk, qty, amt))) AS o, micro(max(rate)) AS h, micro(min(rate)) AS l,
  micro(max_by(rate, row(dt, ok, ln, pk, sk, qty, amt))) AS c, sum(qty)::BIGINT AS v FROM tape GROUP BY symbol, 2"""


@query("bars_monthly", _period_sql("CAST(date_trunc('month', dt) AS DATE)"))
def bars_monthly(spark, sf_dir):
    return rounded(bars(tape(spark, sf_dir), F.to_date(F.date_trunc("month", "dt")))).drop("amount")


@query("bars_iso_year", _period_sql("isoyear(dt)"))
def bars_iso_year(spark, sf_dir):
    return rounded(bars(tape(spark, sf_dir), F.expr("extract(yearofweek FROM dt)").cast("long"))).drop("amount")


@query("ex_dates", f"WITH {EX_SQL} SELECT symbol, dt, micro(factor) AS factor FROM ex")
def ex_dates(spark, sf_dir):
    return rounded(op.ex_dates(day_bars(spark, sf_dir)), "factor")


@query("adjusted_bars", f"""WITH {EX_SQL}, a AS (SELECT bars.*, {FACTOR_SQL} AS adj FROM bars LEFT JOIN ex USING (symbol, dt))
SELECT symbol, dt, micro(o * adj) AS o, micro(h * adj) AS h, micro(l * adj) AS l, micro(c * adj) AS c, v FROM a""")
def adjusted_bars(spark, sf_dir):
    return rounded(op.adjusted(day_bars(spark, sf_dir))).drop("amount", "adj")


@query("bar_changes", f"""WITH {BARS_SQL}, p AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY dt) AS prev FROM bars)
SELECT symbol, dt, micro((c - prev)) AS change, micro(100 * (c - prev) / prev) AS pct FROM p""")
def bar_changes(spark, sf_dir):
    prev = F.lag("c").over(op.by_symbol())
    return day_bars(spark, sf_dir).select("symbol", "dt", micro(F.col("c") - prev).alias("change"), micro(100 * (F.col("c") - prev) / prev).alias("pct"))


@query("daily_upsert", f"""WITH {BARS_SQL}, m AS (SELECT max(dt) AS d FROM bars),
u AS (SELECT symbol, dt, CASE WHEN dt = d THEN c * 1.04 ELSE c END AS c, CASE WHEN dt = d THEN v + 1 ELSE v END AS v FROM bars, m UNION ALL SELECT symbol, d + INTERVAL 7 DAY, c * 1.08, v FROM bars, m WHERE dt = d),
p AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY dt) AS prev FROM u)
SELECT symbol, CAST(dt AS DATE) AS dt, micro(c) AS c, v, CASE WHEN prev IS NULL THEN NULL ELSE round(c - prev, 2) IS NOT NULL END AS has_change FROM p""")
def daily_upsert(spark, sf_dir):
    """The newest session comes again with other closes, and then a session after it; both twice."""
    stored = day_bars(spark, sf_dir)
    newest = stored.join(F.broadcast(stored.agg(F.max("dt").alias("d"))), F.col("dt") == F.col("d")).drop("d")  # one row
    again = newest.withColumns({"c": F.col("c") * 1.04, "v": F.col("v") + 1})
    more = newest.withColumns({"dt": F.date_add("dt", 7), "c": F.col("c") * 1.08})
    out = op.bar_changes(op.newest_versions(stored, again, more, more))
    return out.select("symbol", "dt", micro(F.col("c")).alias("c"), "v", F.when(F.lag("c").over(op.by_symbol()).isNotNull(), F.col("change").isNotNull()).alias("has_change"))


@query("flow_upsert", f"""WITH {FLOW_SQL}, m AS (SELECT max(dt) AS d FROM flow)
SELECT symbol, dt, broker, bought, sold, net FROM flow, m WHERE dt <> d UNION ALL SELECT symbol, dt, broker, sum(bought)::BIGINT, sum(sold)::BIGINT, sum(net)::BIGINT FROM flow, m WHERE dt = d AND broker % 2 = 0 GROUP BY ALL""")
def flow_upsert(spark, sf_dir):
    """A session's flow is rebuilt from part of its brokers: rows of the others must go."""
    f = broker_flow(tape(spark, sf_dir)).select("symbol", "dt", "broker", "bought", "sold", "net")
    newest = f.join(F.broadcast(f.agg(F.max("dt").alias("d"))), F.col("dt") == F.col("d")).drop("d").filter("broker % 2 = 0")  # one row
    return op.upsert_partition(f, newest)


@query("minute_bars", f"WITH {MINUTE_SQL} SELECT instrument, minute, o, h, l, c, n, amount FROM minutes")
def minute_bars(spark, sf_dir):
    return op.minute_bars(ticks(spark, sf_dir))


@query("minute_fill", f"""WITH {MINUTE_SQL.replace("date_trunc('minute', ts)", "time_bucket(INTERVAL 15 MINUTE, ts)")}, b AS (SELECT instrument, CAST(minute AS DATE) AS day, min(minute) AS a, max(minute) AS z FROM minutes GROUP BY ALL),
g AS (SELECT instrument, day, unnest(generate_series(a, z, INTERVAL 15 MINUTE)) AS minute FROM b),
f AS (SELECT g.instrument, g.minute, m.o, m.h, m.l, m.n, last_value(m.c IGNORE NULLS) OVER (PARTITION BY g.instrument, g.day ORDER BY g.minute) AS c FROM g LEFT JOIN minutes m ON m.instrument = g.instrument AND m.minute = g.minute)
SELECT instrument, minute, coalesce(o, c) AS o, coalesce(h, c) AS h, coalesce(l, c) AS l, c, coalesce(n, 0) AS n FROM f""")
def minute_fill(spark, sf_dir):
    return op.filled_minutes(op.minute_bars(ticks(spark, sf_dir), 15, by_day=True), 15)


@query("resample_minutes", f"""WITH {TICKS_SQL} SELECT m, instrument, time_bucket(to_minutes(m), ts) AS bucket, min_by(price, seq) AS o, max(price) AS h, min(price) AS l, max_by(price, seq) AS c, count(*) AS n
FROM ticks, (SELECT unnest([5, 15, 30, 60]) AS m) GROUP BY ALL""")
def resample_minutes(spark, sf_dir):
    return op.resampled_all(ticks(spark, sf_dir), (5, 15, 30, 60))


@query("vwap_returns", f"""WITH {BARS_SQL}, v AS (SELECT symbol, dt, amount / v AS vwap FROM bars), r AS (SELECT *, ln(vwap / lag(vwap) OVER (PARTITION BY symbol ORDER BY dt)) AS ret FROM v)
SELECT symbol, dt, micro(vwap) AS vwap, micro(CASE WHEN abs(ret) > 0.2 THEN 0 ELSE ret END) AS ret FROM r""")
def vwap_returns(spark, sf_dir):
    return op.vwap_returns(day_bars(spark, sf_dir)).select("symbol", "dt", micro(F.col("vwap")).alias("vwap"), micro(F.col("ret")).alias("ret"))


@query("market_regime", f"""WITH {BARS_SQL}, i AS (SELECT dt, avg(c) AS c FROM bars GROUP BY dt), r AS (SELECT dt, c, CASE WHEN count(*) OVER w = 20 THEN avg(c) OVER w END AS mean FROM i WINDOW w AS (ORDER BY dt ROWS 19 PRECEDING))
SELECT dt, round(c, 4) AS c, round(mean, 4) AS mean, c > mean AS up FROM r""")
def market_regime(spark, sf_dir):
    r = op.market_regime(op.market_bars(day_bars(spark, sf_dir)))
    return r.select("dt", F.round("c", 4).alias("c"), F.round("mean", 4).alias("mean"), "up")


@query("forward_path", f"""WITH {BARS_SQL}, f AS (SELECT symbol, dt, lead(o) OVER w AS entry, lead(c, 10) OVER w AS exit, max(h) OVER n AS best, min(l) OVER n AS worst, count(*) OVER n AS bars FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY dt), n AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
SELECT symbol, dt, micro(entry) AS entry, micro(exit) AS exit, micro(best) AS best, micro(worst) AS worst, bars FROM f WHERE bars = 10""")
def forward_path(spark, sf_dir):
    return rounded(op.forward_path(day_bars(spark, sf_dir), 10), "entry", "exit", "best", "worst")


@query("last_bar", f"""WITH {BARS_SQL}, r AS (SELECT *, lag(c) OVER w AS prev, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt))
SELECT symbol, dt, micro(c) AS c, micro(100 * (c - prev) / prev) AS pct, round(coalesce(nullif(amount, 0), c * v), 2) AS turnover FROM r WHERE age = 1""")
def last_bar(spark, sf_dir):
    return op.last_two(day_bars(spark, sf_dir))
