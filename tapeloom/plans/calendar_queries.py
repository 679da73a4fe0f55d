"""Calendar, decoding and gates."""

from pyspark.sql import functions as F

from ..operators import calendar as op
from ..sources.tape import BARS_SQL, FLOW_SQL, bars, broker_flow, table, tape, ticks
from .registry import query

EVENTS_SQL = f"{BARS_SQL}, n AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i FROM bars), ev AS (SELECT symbol, dt FROM n WHERE i % 13 = 0)"


def book_closes(b):
    from ..operators.series import by_symbol

    return b.select("symbol", "dt", F.row_number().over(by_symbol()).alias("i")).filter("i % 13 = 0").select("symbol", "dt")


@query("session_state", """SELECT event_id, CASE WHEN isodow(ts) > 5 THEN 'CLOSED' WHEN m >= 630 AND m < 645 THEN 'PRE-OPEN' WHEN m >= 645 AND m < 660 THEN 'PRE-OPEN CLOSE' WHEN m >= 660 AND m < 900 THEN 'LIVE' ELSE 'CLOSED' END AS state FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events)""")
def session_state(spark, sf_dir):
    return ticks(spark, sf_dir).select(F.col("seq").alias("event_id"), op.session_state(F.col("ts")).alias("state"))


@query("missed_sessions", f"""WITH {BARS_SQL}, l AS (SELECT symbol, max(dt) AS last FROM bars GROUP BY symbol), t AS (SELECT max(dt) + 10 AS today FROM bars) SELECT symbol, last, len(list_filter(generate_series(last + INTERVAL 1 DAY, today, INTERVAL 1 DAY), lambda d: isodow(d) <= 5))::INT AS missed FROM l, t""")
def missed_sessions(spark, sf_dir):
    b = bars(tape(spark, sf_dir)).groupBy("symbol").agg(F.max("dt").alias("last"))
    today = b.agg(F.date_add(F.max("last"), 10).alias("today"))
    return b.join(F.broadcast(today)).select("symbol", "last", op.missed_sessions(F.col("last"), F.col("today")).alias("missed"))  # one row


@query("asof_book_close", f"""WITH {EVENTS_SQL} SELECT bars.symbol, bars.dt, min(ev.dt) AS book_close, (min(ev.dt) - bars.dt)::INT AS days_to_book_close FROM bars LEFT JOIN ev ON ev.symbol = bars.symbol AND ev.dt > bars.dt GROUP BY bars.symbol, bars.dt""")
def asof_book_close(spark, sf_dir):
    b = bars(tape(spark, sf_dir)).select("symbol", "dt")
    return op.next_event(b, book_closes(b), "book_close")


@query("blackout_gate", f"""WITH {EVENTS_SQL} SELECT symbol, dt FROM bars WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.symbol = bars.symbol AND ev.dt BETWEEN bars.dt - 7 AND bars.dt + 14)""")
def blackout_gate(spark, sf_dir):
    b = bars(tape(spark, sf_dir)).select("symbol", "dt")
    return op.blackout(b, book_closes(b), 7, 14)


@query("hyper_brokers", f"""WITH {FLOW_SQL}, t AS (SELECT symbol, broker, sum(net)::BIGINT AS net FROM flow GROUP BY ALL), l AS (SELECT symbol, max_by(broker, row(net, -broker)) AS broker FROM t GROUP BY symbol UNION ALL SELECT symbol, min_by(broker, row(net, broker)) FROM t GROUP BY symbol),
h AS (SELECT broker FROM l GROUP BY broker HAVING count(*) >= 4) SELECT symbol, broker, net FROM t WHERE broker NOT IN (SELECT broker FROM h)""")
def hyper_brokers(spark, sf_dir):
    """Leave out brokers that lead a side of four symbols or more."""
    t = broker_flow(tape(spark, sf_dir)).groupBy("symbol", "broker").agg(F.sum("net").alias("net"))
    lead = t.groupBy("symbol").agg(F.array(F.max_by("broker", F.struct("net", -F.col("broker"))), F.min_by("broker", F.struct("net", "broker"))).alias("l")).select(F.explode("l").alias("broker"))
    return t.join(lead.groupBy("broker").count().filter("count >= 4"), "broker", "left_anti").select("symbol", "broker", "net")


@query("liquidity_gate", f"""WITH {BARS_SQL}, r AS (SELECT symbol, amount, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM bars), m AS (SELECT symbol, list_sort(list(amount))[count(*) // 2 + 1] AS upper_median, median(amount) AS median FROM r WHERE age <= 20 GROUP BY symbol) SELECT symbol, round(upper_median, 2) AS upper_median, upper_median >= 500000 AS passes FROM m""")
def liquidity_gate(spark, sf_dir):
    from pyspark.sql import Window

    from ..operators.stats import upper_median

    r = bars(tape(spark, sf_dir)).select("symbol", "amount", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))).alias("age")).filter("age <= 20")
    return r.groupBy("symbol").agg(upper_median(F.col("amount")).alias("m")).select("symbol", F.round("m", 2).alias("upper_median"), (F.col("m") >= 500_000).alias("passes"))


@query("json_props", """SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type""")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long").k
    return ticks(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query("html_cells", r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1) AS cs FROM pages), u AS (SELECT page_id, unnest(cs) AS t, unnest(range(0, len(cs)))::INT AS pos FROM c)
SELECT page_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' ', 'g'), '[\s]+', ' ', 'g')) AS text FROM u""")
def html_cells(spark, sf_dir):
    return op.html_cells(table(spark, sf_dir, "pages"), "p")


@query("text_numbers", r"""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity::BIGINT || '.0' WHEN l_linenumber % 3 = 1 THEN ' 1,' || lpad((l_quantity::BIGINT)::VARCHAR, 3, '0') ELSE 'D' || lpad((l_quantity::BIGINT)::VARCHAR, 2, '0') END AS x FROM lineitem)
SELECT k, n, p, x, CASE WHEN x LIKE 'D%' THEN 900000 + substr(x, 2)::BIGINT ELSE TRY_CAST(replace(trim(x), ',', '') AS DOUBLE)::BIGINT END AS code FROM t""")
def text_numbers(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint").cast("string")
    x = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(".0"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(" 1,"), F.lpad(q, 3, "0"))).otherwise(F.concat(F.lit("D"), F.lpad(q, 2, "0")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), x.alias("x")).withColumn("code", op.broker_code(F.col("x")))


@query("symbol_merge", """SELECT DISTINCT lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS symbol FROM part UNION SELECT lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) FROM part""")
def symbol_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(op.key(F.col("p_brand")).alias("symbol")).union(part.select(op.key(F.col("p_type")))).distinct()


@query("store_freshness", f"""WITH {BARS_SQL}, m AS (SELECT symbol, max(dt) AS last FROM bars GROUP BY symbol), n AS (SELECT max(last) AS newest FROM m) SELECT newest, count(*) AS members, count(*) FILTER (last < newest) AS behind FROM m, n GROUP BY newest""")
def store_freshness(spark, sf_dir):
    m = bars(tape(spark, sf_dir)).groupBy("symbol").agg(F.max("dt").alias("last"))
    return m.join(F.broadcast(m.agg(F.max("last").alias("newest")))).groupBy("newest").agg(F.count("*").alias("members"), F.count_if(F.col("last") < F.col("newest")).alias("behind"))  # one row
