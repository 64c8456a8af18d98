"""Aggregation and study queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import statistics as ops
from quayline.operators import windows as w
from quayline.operators.bootstrap import bootstrap_difference, bootstrap_mean, sql_bootstrap
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, SQL_HOURLY, SQL_TRADES, daily_bars, hourly_bars, trades
from quayline.storage import table

WITH = f"WITH {SQL_DAILY}"

@query(
    f"""WITH {SQL_TRADES}, e AS (SELECT *, sum(result_r::DOUBLE) OVER (PARTITION BY strategy ORDER BY entry, id) AS equity FROM trades),
p AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY strategy ORDER BY entry, id)) AS peak FROM e)
SELECT strategy, count(*) AS n, count(*) FILTER (result_r > 0) AS wins, count(*) FILTER (result_r < 0) AS losses,
  floor(count(*) FILTER (result_r > 0) / count(*) * 100 * 10.0 + 0.5) / 10.0 AS win_rate, floor(avg(result_r::DOUBLE) * 10000.0 + 0.5) / 10000.0 AS expectancy,
  floor(avg(result_r::DOUBLE) FILTER (result_r > 0) * 10000.0 + 0.5) / 10000.0 AS avg_win, floor(avg(result_r::DOUBLE) FILTER (result_r < 0) * 10000.0 + 0.5) / 10000.0 AS avg_loss,
  floor(sum(result_r::DOUBLE) * 100.0 + 0.5) / 100.0 AS total_r, floor(max(peak - equity) * 100.0 + 0.5) / 100.0 AS max_drawdown_r,
  count(*) FILTER (outcome = 'target') AS targets, count(*) FILTER (outcome = 'stop') AS stops, count(*) FILTER (outcome = 'timeout') AS timeouts
FROM p GROUP BY strategy"""
)
def backtest_metrics(spark, sf_dir):
    """Metrics of each strategy's trades, with the drawdown of their running sum."""
    return ops.trade_metrics(trades(spark, sf_dir), "strategy", ("entry", "id"))


@query(
    f"""WITH {SQL_TRADES} SELECT CASE WHEN count(*) FILTER (confidence >= 65) >= 3 THEN floor(avg(result_r::DOUBLE) FILTER (confidence >= 65) * 1000.0 + 0.5) / 1000.0 END AS high_confidence,
  CASE WHEN count(*) FILTER (confidence < 65) >= 3 THEN floor(avg(result_r::DOUBLE) FILTER (confidence < 65) * 1000.0 + 0.5) / 1000.0 END AS low_confidence FROM trades"""
)
def confidence_calibration(spark, sf_dir):
    """Expectancy of confident trades against the others; three of each are needed."""
    high, low = F.col("confidence") >= 65, F.col("confidence") < 65
    part = lambda t: F.when(F.count_if(t) >= 3, rounded(F.avg(F.when(t, F.col("result_r"))), 3))
    return trades(spark, sf_dir).agg(part(high).alias("high_confidence"), part(low).alias("low_confidence"))


@query(
    f"""WITH {SQL_TRADES}, samples AS (SELECT strategy AS g, 0 AS s, row_number() OVER (PARTITION BY strategy ORDER BY id) - 1 AS i, result_r AS v FROM trades),
{sql_bootstrap(1000, 42, 10)}
SELECT g AS strategy, n, mean, hit_rate, low, high FROM drawn"""
)
def bootstrap_ci(spark, sf_dir):
    """Deterministic bootstrap interval of each strategy's mean result."""
    return bootstrap_mean(trades(spark, sf_dir), "strategy", "result_r", "id")


@query(
    f"""WITH {SQL_TRADES}, samples AS (SELECT outcome AS g, 0 AS s, row_number() OVER (PARTITION BY outcome ORDER BY id) - 1 AS i, result_r AS v FROM trades),
{sql_bootstrap(2000, 20260801, 20)}
SELECT g AS outcome, n, mean, hit_rate, low, high FROM drawn"""
)
def bootstrap_by_outcome(spark, sf_dir):
    """The same with 2,000 resamples for each outcome; twenty values are needed."""
    return bootstrap_mean(trades(spark, sf_dir), "outcome", "result_r", "id", resamples=2000, seed=20260801, least=20)


@query(
    f"""WITH {SQL_TRADES}, samples AS (SELECT strategy AS g, s, row_number() OVER (PARTITION BY strategy, s ORDER BY id) - 1 AS i, result_r AS v
  FROM (SELECT *, 1 AS s FROM trades UNION ALL SELECT *, 0 FROM trades WHERE confidence >= 65)),
{sql_bootstrap(500, 20260801, 20)}
SELECT g AS strategy, n, mean, hit_rate, low, high FROM drawn"""
)
def confidence_excess(spark, sf_dir):
    """Confident trades' mean result less that of all trades of the strategy, with its two-sample interval."""
    return bootstrap_difference(trades(spark, sf_dir), "strategy", "result_r", "id", F.coalesce(F.col("confidence") >= 65, F.lit(False)), resamples=500)


@query(
    """SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) FILTER (l_returnflag = 'R') AS short, sum(l_quantity) FILTER (l_returnflag = 'A') AS exempt, sum(l_quantity) AS total,
  floor(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) / sum(l_quantity) * 100 * 100.0 + 0.5) / 100.0 AS short_pct
FROM lineitem GROUP BY 1 ORDER BY day DESC LIMIT 30"""
)
def daily_short_volume(spark, sf_dir):
    """The newest thirty days' volume over all venues, with the short share."""
    part = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    total = F.sum("l_quantity")
    d = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    return d.agg(part("R").alias("short"), part("A").alias("exempt"), total.alias("total"), rounded(F.coalesce(part("R"), F.lit(0.0)) / total * 100, 2).alias("short_pct")).orderBy(F.desc("day")).limit(30)


@query(
    """WITH t AS (SELECT o_custkey AS ticker, CASE WHEN o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%' THEN 'buy' WHEN o_orderpriority ILIKE '%low%' OR o_orderpriority ILIKE '%medium%' THEN 'sell' END AS side, o_totalprice AS v FROM orders),
s AS (SELECT ticker, coalesce(sum(v) FILTER (side = 'buy'), 0) AS buys, coalesce(sum(v) FILTER (side = 'sell'), 0) AS sells FROM t GROUP BY ticker)
SELECT ticker, floor(buys * 100.0 + 0.5) / 100.0 AS buys, floor(sells * 100.0 + 0.5) / 100.0 AS sells, CASE WHEN buys - sells > 100000 THEN 'net buying' WHEN buys - sells < -100000 THEN 'net selling' ELSE 'balanced' END AS verdict FROM s"""
)
def insider_verdict(spark, sf_dir):
    """Bought and sold values by ticker and what they amount to."""
    side = F.when(F.col("o_orderpriority").rlike("(?i)urgent|high"), "buy").when(F.col("o_orderpriority").rlike("(?i)low|medium"), "sell")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), side.alias("side"), F.col("o_totalprice").alias("v"))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("v"))), F.lit(0.0))
    s = t.groupBy("ticker").agg(part("buy").alias("b"), part("sell").alias("s"))
    net = F.col("b") - F.col("s")
    return s.select("ticker", rounded("b", 2).alias("buys"), rounded("s", 2).alias("sells"), F.when(net > 100000, "net buying").when(net < -100000, "net selling").otherwise("balanced").alias("verdict"))


_RATINGS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    f"""WITH c AS (SELECT o_custkey AS ticker, {', '.join(f"count(*) FILTER (o_orderpriority = '{r}') AS n{k}" for k, r in enumerate(_RATINGS, 1))} FROM orders GROUP BY 1),
m AS (SELECT ticker, n1 + n2 + n3 + n4 + n5 AS n, (n1 + 2 * n2 + 3 * n3 + 4 * n4 + 5 * n5) / nullif(n1 + n2 + n3 + n4 + n5, 0) AS mean FROM c)
SELECT ticker, n, floor(mean * 100.0 + 0.5) / 100.0 AS mean, CASE WHEN mean < 1.5 THEN 'strong buy' WHEN mean < 2.5 THEN 'buy' WHEN mean < 3.5 THEN 'hold' WHEN mean < 4.5 THEN 'sell' ELSE 'strong sell' END AS label FROM m"""
)
def consensus(spark, sf_dir):
    """Weighted mean rating of each ticker and its label."""
    counts = [F.count_if(F.col("o_orderpriority") == r) for r in _RATINGS]
    n, weighted = sum(counts[1:], counts[0]), sum((c * k for k, c in enumerate(counts[1:], 2)), counts[0])
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(n.alias("n"), (weighted / F.nullif(n, F.lit(0))).alias("m"))
    x = F.col("m")
    label = F.when(x < 1.5, "strong buy").when(x < 2.5, "buy").when(x < 3.5, "hold").when(x < 4.5, "sell").otherwise("strong sell")
    return m.select("ticker", "n", rounded("m", 2).alias("mean"), label.alias("label"))


@query(
    f"""WITH {SQL_HOURLY}, g AS (SELECT symbol, epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 3600 AS gap FROM hourly), k AS (SELECT symbol, gap, row_number() OVER (PARTITION BY symbol ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM g WHERE gap > 0.5 AND gap <= 24),
m AS (SELECT symbol, gap AS med FROM k WHERE i = n // 2), s AS (SELECT DISTINCT symbol FROM hourly)
SELECT s.symbol, CASE WHEN med IS NULL THEN 8 WHEN abs(1 - med) <= abs(2 - med) AND abs(1 - med) <= abs(4 - med) AND abs(1 - med) <= abs(8 - med) THEN 1 WHEN abs(2 - med) <= abs(4 - med) AND abs(2 - med) <= abs(8 - med) THEN 2 WHEN abs(4 - med) <= abs(8 - med) THEN 4 ELSE 8 END AS interval_hours
FROM s LEFT JOIN m USING (symbol)"""
)
def median_interval(spark, sf_dir):
    """Each series' usual spacing: the upper median gap, snapped to 1, 2, 4 or 8 hours."""
    return ops.median_interval(hourly_bars(spark, sf_dir))


@query(f"WITH {SQL_HOURLY} SELECT symbol, ts, floor(volume / sum(volume) OVER (PARTITION BY ts) * 100 * 100.0 + 0.5) / 100.0 AS share_pct FROM hourly")
def venue_share(spark, sf_dir):
    """Each series' share of an hour's volume."""
    return hourly_bars(spark, sf_dir).select("symbol", "ts", rounded(F.col("volume") / F.sum("volume").over(Window.partitionBy("ts")) * 100, 2).alias("share_pct"))


@query(
    f"""{WITH}, x AS (SELECT a.ts, a.close AS x, b.close AS y, row_number() OVER (ORDER BY a.ts) AS n, count(*) OVER () AS total FROM daily a JOIN daily b ON a.ts = b.ts AND a.symbol = 'A' AND b.symbol = 'R'),
f AS (SELECT regr_slope(y, x) AS m, regr_intercept(y, x) AS c FROM x WHERE n <= total // 2)
SELECT floor(m * 1000000.0 + 0.5) / 1000000.0 AS slope, floor(c * 10000.0 + 0.5) / 10000.0 AS intercept, floor(avg(abs(y - (m * x + c))) * 10000.0 + 0.5) / 10000.0 AS mae, count(*) AS tested FROM x, f WHERE n > total // 2 GROUP BY m, c"""
)
def ols_train_test(spark, sf_dir):
    """Least squares on the first half of the days, mean absolute error on the second."""
    d = daily_bars(spark, sf_dir)
    x = d.filter("symbol = 'A'").select("ts", F.col("close").alias("x")).join(d.filter("symbol = 'R'").select("ts", F.col("close").alias("y")), "ts")
    x = x.withColumn("n", F.row_number().over(Window.orderBy("ts"))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    half = F.floor(F.col("total") / 2)
    f = x.filter(F.col("n") <= half).agg(F.regr_slope("y", "x").alias("m"), F.regr_intercept("y", "x").alias("c"))
    off = F.abs(F.col("y") - (F.col("m") * F.col("x") + F.col("c")))
    t = x.filter(F.col("n") > half).crossJoin(F.broadcast(f)).groupBy("m", "c").agg(F.avg(off).alias("e"), F.count(F.lit(1)).alias("tested"))
    return t.select(rounded("m", 6).alias("slope"), rounded("c").alias("intercept"), rounded("e").alias("mae"), "tested")


@query("SELECT n_name, ceil(2 * power(1.96 + 0.84, 2) * power(sd / 500, 2))::BIGINT AS needed FROM (SELECT n_name, stddev_samp(c_acctbal) AS sd FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) > 2)")
def required_samples(spark, sf_dir):
    """Observations needed to see an effect of 500 with 80 % power."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    s = c.groupBy("n_name").agg(F.stddev_samp("c_acctbal").alias("sd"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return s.select("n_name", F.ceil(2 * F.pow(F.lit(1.96 + 0.84), F.lit(2.0)) * F.pow(F.col("sd") / 500, F.lit(2.0))).alias("needed"))


@query(
    f"{WITH}, z AS (SELECT symbol, ts, (close - avg(close) OVER p) / stddev_samp(close) OVER p AS z, count(*) OVER p AS n FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)), "
    "t AS (SELECT unnest([1.5, 2.0, 2.5]) AS t) SELECT symbol, t::DOUBLE AS threshold, count(*) FILTER (z >= t) AS high, count(*) FILTER (z <= -t) AS low FROM z, t WHERE n = 90 GROUP BY symbol, t"
)
def threshold_cells(spark, sf_dir):
    """Observations in the tails beyond each of three thresholds."""
    before = w.series().rowsBetween(-90, -1)
    z = daily_bars(spark, sf_dir).select("symbol", ((F.col("close") - F.avg("close").over(before)) / F.stddev_samp("close").over(before)).alias("z"), F.count("close").over(before).alias("n")).filter("n = 90")
    cells = z.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (1.5, 2.0, 2.5)])))
    return cells.groupBy("symbol", "threshold").agg(F.count_if(F.col("z") >= F.col("threshold")).alias("high"), F.count_if(F.col("z") <= -F.col("threshold")).alias("low"))
