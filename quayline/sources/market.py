"""The market tables bound to the driver's star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.operators import bars
from quayline.storage import table

TRADE_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")  # together unique


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (day), OHLCV from lineitem: a trade is a line, its price that of one unit."""
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), *TRADE_ORDER
    )
    return bars.bars_from_ticks(t, ["symbol", "ts"], trade_order())


def trade_order() -> Column:
    """Order, part, supplier and line as the digits of one number, in this order; a number, unlike a struct, lets bars be hashed."""
    out = F.col("l_orderkey").cast("decimal(38,0)")
    for name, digits in (("l_partkey", 10), ("l_suppkey", 10), ("l_linenumber", 2)):
        out = (out * F.lit(10**digits).cast("decimal(12,0)") + F.col(name)).cast("decimal(38,0)")
    return out


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (hour), OHLCV from events; the volume counts events."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("ts").alias("at"), "event_id")
    return bars.bars_from_ticks(e, ["symbol", "hour"], F.struct("at", "event_id")).withColumnRenamed("hour", "ts")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, year and statement-like sums of a supplier's lines, with the supplier's balance."""
    li = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate").alias("year")
    f = li.groupBy(F.col("l_suppkey").alias("ticker"), year).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cost"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        F.sum("l_quantity").alias("units"),
        F.count(F.lit(1)).alias("lines"),
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").alias("cash"), F.col("s_nationkey").alias("nation"))
    return f.join(s, "ticker")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, strategy, entry, result_r, confidence, outcome: an order closes the trade that the customer's order before it opened.

    The result is the log of the prices' ratio; the customer's balance is the confidence, unknown for pending orders.
    """
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 0").withColumn("before", F.lag("o_totalprice").over(own)).filter("before IS NOT NULL")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    r = F.log(F.col("o_totalprice") / F.col("before"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("strategy"),
        F.col("o_orderdate").alias("entry"),
        r.alias("result_r"),
        F.when(F.col("o_orderstatus") != "P", F.floor((F.col("c_acctbal") + 1000) / 110)).alias("confidence"),
        F.when(r > 0.5, "target").when(r < -0.5, "stop").otherwise("timeout").alias("outcome"),
    )


SQL_TRADES = """
turns AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders WHERE o_totalprice > 0),
trades AS (SELECT o_orderkey AS id, o_orderpriority AS strategy, o_orderdate AS entry, ln(o_totalprice / before) AS result_r, CASE WHEN o_orderstatus <> 'P' THEN floor((c_acctbal + 1000) / 110) END AS confidence,
  CASE WHEN ln(o_totalprice / before) > 0.5 THEN 'target' WHEN ln(o_totalprice / before) < -0.5 THEN 'stop' ELSE 'timeout' END AS outcome
  FROM turns JOIN customer ON o_custkey = c_custkey WHERE before IS NOT NULL)"""

SQL_DAILY = """
ticks AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume,
                 l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
daily AS (SELECT symbol, ts,
                 first(price ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS open,
                 max(price) AS high, min(price) AS low,
                 last(price ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS close, sum(volume) AS volume
          FROM ticks GROUP BY symbol, ts),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM daily)"""

SQL_HOURLY = """
hourly AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
                  last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
           FROM events GROUP BY event_type, date_trunc('hour', ts))"""

SQL_FUNDAMENTALS = """
f AS (SELECT l_suppkey AS ticker, year(l_shipdate) AS year, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * l_discount) AS cost,
             sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS units, count(*) AS lines FROM lineitem GROUP BY ALL),
fundamentals AS (SELECT f.*, s_acctbal AS cash, s_nationkey AS nation FROM f JOIN supplier ON s_suppkey = ticker)"""
