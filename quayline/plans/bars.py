"""Bar queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import bars as ops
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, SQL_HOURLY, daily_bars as daily, hourly_bars as hourly

_FOLD = "min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume"


@query(f"WITH {SQL_DAILY} SELECT symbol, ts, open, high, low, close, volume FROM daily")
def daily_bars(spark, sf_dir):
    """Daily bars of every symbol."""
    return daily(spark, sf_dir)


@query(f"WITH {SQL_HOURLY} SELECT * FROM hourly")
def hourly_bars(spark, sf_dir):
    """Hourly bars of every event type."""
    return hourly(spark, sf_dir)


@query(f"WITH {SQL_DAILY} SELECT symbol, {_FOLD} FROM daily GROUP BY symbol, date_trunc('week', ts)")
def weekly_bars(spark, sf_dir):
    """Weekly bars (Monday weeks) folded from daily ones."""
    return ops.fold(daily(spark, sf_dir).withColumn("week", F.date_trunc("week", "ts")), ["symbol", "week"]).drop("week")


@query(f"WITH {SQL_DAILY} SELECT symbol, {_FOLD} FROM bars GROUP BY symbol, bar_idx // 4")
def resample_four(spark, sf_dir):
    """Four daily bars folded into one, running on over days."""
    return ops.resample(daily(spark, sf_dir), 4)


@query(
    f"WITH {SQL_HOURLY}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) - 1) // 4 AS g FROM hourly) "
    f"SELECT symbol, {_FOLD} FROM n GROUP BY symbol, CAST(n.ts AS DATE), g"
)
def session_fold_four(spark, sf_dir):
    """Four hourly bars folded into one, counting anew each day."""
    return ops.resample_sessions(hourly(spark, sf_dir), 4)


@query(
    f"""WITH {SQL_DAILY}, h AS (SELECT symbol, {_FOLD} FROM bars GROUP BY symbol, bar_idx // 3),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, date_trunc('week', ts) AS w,
  lead(date_trunc('week', ts)) OVER o AS nw, lead(volume) OVER o AS nv, lag(date_trunc('week', ts)) OVER o AS pw, lag(volume) OVER o AS pv
  FROM h WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, open, high, low, close, volume FROM n
WHERE NOT coalesce(k = 2 AND nw = w AND nv > volume, false) AND NOT coalesce(k = 1 AND pw = w AND pv >= volume, false)"""
)
def weekly_duplicate_removed(spark, sf_dir):
    """Three-day bars, without the lighter of two last ones that share a week."""
    return ops.drop_weekly_duplicate(ops.resample(daily(spark, sf_dir), 3))


@query(
    f"""WITH {SQL_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM daily)
SELECT symbol, arg_min(close, ts) AS first_close, arg_max(close, ts) AS last_close,
  floor((arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) * 100 * 100.0 + 0.5) / 100.0 AS change_pct,
  max(high) AS high, min(low) AS low, floor(avg(close) FILTER (k <= 50) * 10000.0 + 0.5) / 10000.0 AS ma50,
  floor(avg(close) FILTER (k <= 200) * 10000.0 + 0.5) / 10000.0 AS ma200, count(*) AS n
FROM n GROUP BY symbol HAVING count(*) >= 2"""
)
def period_summary(spark, sf_dir):
    """First, last, change, range and trailing means over each symbol's whole series."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    first, last = F.min_by("close", "ts"), F.max_by("close", "ts")
    return (
        daily(spark, sf_dir)
        .withColumn("k", place)
        .groupBy("symbol")
        .agg(
            first.alias("first_close"),
            last.alias("last_close"),
            rounded((last - first) / first * 100, 2).alias("change_pct"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            rounded(F.avg(F.when(F.col("k") <= 50, F.col("close")))).alias("ma50"),
            rounded(F.avg(F.when(F.col("k") <= 200, F.col("close")))).alias("ma200"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n >= 2")
    )


@query(f"WITH {SQL_HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM hourly) SELECT symbol, ts, open, high, low, close, volume FROM n WHERE k BETWEEN 2 AND 101")
def closed_bars_tail(spark, sf_dir):
    """The last hundred closed hourly bars; the forming one is left out."""
    return ops.tail(hourly(spark, sf_dir), 100, skip=1)


@query(
    """WITH e AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS price, event_id % 5 AS v FROM events),
b AS (SELECT symbol, ts, max(price) FILTER (v > 0) AS high, min(price) FILTER (v > 0) AS low, count(price) AS n, sum(v) AS volume FROM e GROUP BY symbol, ts)
SELECT symbol, ts, high, low, volume::DOUBLE AS volume FROM b WHERE high IS NOT NULL AND low IS NOT NULL AND NOT (volume = 0 AND high = low)"""
)
def cleaned_bars(spark, sf_dir):
    """Bars without incomplete or synthetic ones."""
    from quayline.storage import table

    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("price"), (F.col("event_id") % 5).alias("v")
    )
    high, low = F.max(F.when(F.col("v") > 0, F.col("price"))), F.min(F.when(F.col("v") > 0, F.col("price")))
    b = e.groupBy("symbol", "ts").agg(high.alias("high"), low.alias("low"), high.alias("open"), low.alias("close"), F.sum("v").cast("double").alias("volume"))
    return ops.drop_synthetic(ops.drop_incomplete(b)).select("symbol", "ts", "high", "low", "volume")
