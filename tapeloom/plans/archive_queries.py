"""An archive checked against itself, and the live feed laid over it."""

from pyspark.sql import functions as F

from ..operators import archive as op
from ..operators.series import ex_dates
from ..sources.tape import BARS_SQL, INSTRUMENTS_SQL, TAPE_SQL, TICKS_SQL, instruments, tape, ticks
from .bar_queries import EX_SQL, day_bars
from .market_queries import W, shown
from .regime_queries import SERIES_SQL, series
from .registry import query


@query("positive_bars", f"WITH {BARS_SQL} SELECT symbol, dt, micro(h) AS h, micro(l) AS l, micro(c) AS c FROM bars WHERE h > 0 AND l > 0 AND c > 0")
def positive_bars(spark, sf_dir):
    return shown(op.positive_bars(day_bars(spark, sf_dir)).select("symbol", "dt", "h", "l", "c"))


@query("unclassified", f"WITH {TAPE_SQL}, {INSTRUMENTS_SQL} SELECT DISTINCT symbol FROM tape WHERE symbol NOT IN (SELECT symbol FROM instruments WHERE sector <> 0)")
def unclassified(spark, sf_dir):
    return op.unclassified(tape(spark, sf_dir), instruments(spark, sf_dir).filter("sector != 0"))


@query("restatement_audit", f"""WITH {EX_SQL}, d AS (SELECT symbol, dt, 100 * (c / prev - 1) AS pct FROM lagged WHERE prev > 0 AND 100 * (c / prev - 1) < -10.5), n AS (SELECT symbol, year(dt) * 10000 + month(dt) * 100 + day(dt) AS e FROM ex)
SELECT symbol, dt, micro(pct) AS pct, EXISTS (SELECT 1 FROM n WHERE n.symbol = d.symbol AND abs(e - (year(dt) * 10000 + month(dt) * 100 + day(dt))) < 120) AS near FROM d""")
def restatement_audit(spark, sf_dir):
    """Ex-dates stand for book closures."""
    b = day_bars(spark, sf_dir)
    return shown(op.restatement_audit(b, ex_dates(b)))


@query("survivorship", f"""WITH {EX_SQL}, a AS (SELECT bars.*, exp(coalesce(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS adj FROM bars LEFT JOIN ex USING (symbol, dt)),
p AS (SELECT symbol, dt, lead(c * adj, 20) OVER w / lead(o * adj) OVER w - 1 AS ret FROM a WINDOW w AS ({W})), who AS (SELECT symbol, CASE WHEN min(dt) <= DATE '1992-01-06' THEN 'qualifying' ELSE 'late' END AS listed FROM bars GROUP BY symbol HAVING count(*) >= 30),
g AS (SELECT dt FROM (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS k FROM (SELECT DISTINCT dt FROM bars)) WHERE k % 5 = 0)
SELECT listed, count(DISTINCT symbol) AS symbols, count(*) AS n, micro(avg(ret)) AS mean, micro(median(ret)) AS median, micro(avg((ret > 0)::INT)) AS win_rate FROM p JOIN g USING (dt) JOIN who USING (symbol) WHERE ret IS NOT NULL GROUP BY listed""")
def survivorship(spark, sf_dir):
    return shown(op.survivorship(day_bars(spark, sf_dir), "1992-01-06", 30))


@query("rank_in_sample", f"""WITH {SERIES_SQL}, m AS (SELECT symbol, dt, round(avg(tilt) OVER w, 9) AS m, count(tilt) OVER w AS k FROM ser WINDOW w AS ({W} ROWS 6 PRECEDING)), n AS (SELECT symbol, max_by(m, dt) AS now FROM m WHERE k = 7 GROUP BY symbol)
SELECT symbol, micro(any_value(now)) AS value, micro(CASE WHEN count(*) < 5 THEN 0.5 ELSE (count(*) FILTER (m < now) + 0.5 * count(*) FILTER (m = now)) / count(*) END) AS rank FROM m JOIN n USING (symbol) WHERE k = 7 GROUP BY symbol""")
def rank_in_sample(spark, sf_dir):
    return shown(op.rank_in_sample(series(spark, sf_dir), "tilt"))


#: Instruments that the feed knows by another number, for the query.
ALIASES = {"1": "2", "2": "1"}


@query("live_overlay", f"""WITH {TICKS_SQL}, st AS (SELECT instrument::VARCHAR AS instrument, CAST(ts AS DATE) AS day, min_by(price, seq) AS o, max(price) AS h, min(price) AS l, max_by(price, seq) AS c FROM ticks WHERE seq % 2 = 0 GROUP BY ALL),
nb AS (SELECT *, CASE instrument WHEN '1' THEN '2' WHEN '2' THEN '1' ELSE instrument END AS feed FROM st QUALIFY day = max(day) OVER (PARTITION BY instrument)), q AS (SELECT instrument::VARCHAR AS feed, CAST(max_by(ts, seq) AS DATE) AS stamp, max_by(price, seq) AS q FROM ticks GROUP BY 1)
SELECT instrument, day, o, CASE WHEN stamp = day THEN greatest(h, q) ELSE h END AS h, CASE WHEN stamp = day THEN least(l, q) ELSE l END AS l, CASE WHEN stamp = day THEN q ELSE c END AS c, coalesce(stamp = day, false) AS live FROM nb LEFT JOIN q USING (feed)""")
def live_overlay(spark, sf_dir):
    """The archive has every second tick; the feed has the last of all."""
    t = ticks(spark, sf_dir).withColumn("instrument", F.col("instrument").cast("string"))
    stored = t.filter("seq % 2 = 0").groupBy("instrument", F.to_date("ts").alias("day")).agg(F.min_by("price", "seq").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "seq").alias("c"))
    quotes = t.groupBy("instrument").agg(F.max_by("ts", "seq").alias("ts"), F.max_by("price", "seq").alias("price"))
    return op.live_overlay(stored, quotes, ALIASES)
