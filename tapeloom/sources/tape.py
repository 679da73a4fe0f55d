"""The canonical tables: trades ("tape"), bars, broker flow, instruments and ticks, from the warehouse tables.

A symbol is a brand, a session a week, a broker a nation. `ORDER` is a total order of trades within the tape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stored

ORDER = ["ok", "ln", "pk", "sk", "qty", "amt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each trade, from the stored fact table: the five tables are joined once, not in every query."""
    held = stored(spark, sf_dir, "tape", lambda: joined(spark, sf_dir), ["dt", "symbol"], ["ok", "ln"])
    return held.select("symbol", "dt", "buyer", "seller", F.col("quantity").cast("long").alias("qty"), (F.col("amt") / F.col("quantity")).alias("rate"), "amt", "ok", "ln", "pk", "sk")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of tape() from the warehouse tables, with quantity instead of what is derived from it.

    Only the columns named here reach the scans. Every table that trades are joined to is the built side of a shuffled hash
    join, whatever its size: trades are never sorted for a join, nothing is broadcast, and what is shuffled grows with the
    input and not by steps where a table outgrows a broadcast.
    """
    t = lambda n: table(spark, sf_dir, n)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", F.to_date(F.date_trunc("week", "l_shipdate")).alias("dt"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        line.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey").hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part").select("p_partkey", "p_brand").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("symbol"),
            "dt",
            F.col("c_nationkey").alias("buyer"),
            F.col("s_nationkey").alias("seller"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("amt"),
            F.col("l_orderkey").alias("ok"),
            F.col("l_linenumber").alias("ln"),
            F.col("l_partkey").alias("pk"),
            F.col("l_suppkey").alias("sk"),
        )
    )


def trade_order() -> Column:
    return F.struct(*ORDER)


def bars(trades: DataFrame, period: Column | None = None) -> DataFrame:
    """Open, high, low, close, volume and amount by symbol and session, or by a longer period of `dt`."""
    by = F.col("dt") if period is None else period
    first = F.struct("dt", *ORDER) if period is not None else trade_order()
    return trades.groupBy("symbol", by.alias("dt")).agg(
        F.min_by("rate", first).alias("o"), F.max("rate").alias("h"), F.min("rate").alias("l"), F.max_by("rate", first).alias("c"), F.sum("qty").alias("v"), F.sum("amt").alias("amount")
    )


def sides(trades: DataFrame) -> DataFrame:
    """Every trade twice, once for its buyer and once for its seller: one scan and no join."""
    buy = F.struct(F.col("buyer").alias("broker"), F.col("qty").alias("b"), F.lit(0).cast("long").alias("s"), F.col("amt").alias("ba"), F.lit(0.0).alias("sa"))
    sell = F.struct(F.col("seller").alias("broker"), F.lit(0).cast("long").alias("b"), F.col("qty").alias("s"), F.lit(0.0).alias("ba"), F.col("amt").alias("sa"))
    return trades.select("symbol", "dt", F.inline(F.array(buy, sell)))


def broker_flow(trades: DataFrame) -> DataFrame:
    """The fact table: bought, sold and net by symbol, session and broker."""
    return sides(trades).groupBy("symbol", "dt", "broker").agg(
        F.sum("b").alias("bought"), F.sum("s").alias("sold"), (F.sum("b") - F.sum("s")).alias("net"), F.sum("ba").alias("buy_amt"), F.sum("sa").alias("sell_amt"), F.count("*").alias("trades")
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_brand").alias("symbol")).agg((F.sum("p_size") * 100).alias("float_shares")).withColumn("sector", F.expr("cast(substr(symbol, 7) as int) % 5"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("price"), F.col("event_id").alias("seq"), "props")


#: The same tables as DuckDB CTEs; start an oracle with `WITH` and what it needs.
TAPE_SQL = """tape AS (
  SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, c_nationkey AS buyer, s_nationkey AS seller,
         CAST(l_quantity AS BIGINT) AS qty, l_extendedprice / l_quantity AS rate, l_extendedprice AS amt,
         l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
BARS_SQL = (
    TAPE_SQL
    + """,
bars AS (SELECT symbol, dt, min_by(rate, row(ok, ln, pk, sk, qty, amt)) AS o, max(rate) AS h, min(rate) AS l,
         max_by(rate, row(ok, ln, pk, sk, qty, amt)) AS c, sum(qty)::BIGINT AS v, sum(amt) AS amount FROM tape GROUP BY symbol, dt)"""
)
FLOW_SQL = (
    TAPE_SQL
    + """,
sides AS (SELECT symbol, dt, buyer AS broker, qty AS b, 0 AS s, amt AS ba, 0.0::DOUBLE AS sa FROM tape
          UNION ALL SELECT symbol, dt, seller, 0, qty, 0.0::DOUBLE, amt FROM tape),
flow AS (SELECT symbol, dt, broker, sum(b)::BIGINT AS bought, sum(s)::BIGINT AS sold, (sum(b) - sum(s))::BIGINT AS net,
         sum(ba) AS buy_amt, sum(sa) AS sell_amt, count(*) AS trades FROM sides GROUP BY symbol, dt, broker)"""
)
INSTRUMENTS_SQL = """instruments AS (SELECT p_brand AS symbol, (sum(p_size) * 100)::BIGINT AS float_shares, CAST(substr(p_brand, 7) AS INT) % 5 AS sector FROM part GROUP BY p_brand)"""
TICKS_SQL = "ticks AS (SELECT user_id AS instrument, ts, event_type, value AS price, event_id AS seq, props FROM events)"
