"""Join and alignment queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions.numeric import pct_change, rounded
from quayline.operators import joins as ops
from quayline.operators import windows as w
from quayline.operators.bars import fold, with_index
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, SQL_HOURLY, daily_bars, hourly_bars
from quayline.storage import table

WITH = f"WITH {SQL_DAILY}"


@query(
    f"""{WITH}, wk AS (SELECT symbol, min(ts) AS ts FROM daily GROUP BY symbol, date_trunc('week', ts)),
n AS (SELECT d.symbol, d.ts, (SELECT count(*) FROM wk WHERE wk.symbol = d.symbol AND wk.ts < d.ts) AS n FROM daily d)
SELECT symbol, ts, CASE WHEN n >= 2 THEN n - 2 ELSE -1 END AS higher_idx FROM n"""
)
def asof_weekly_on_daily(spark, sf_dir):
    """For each daily bar, the last closed weekly bar; -1 where there is none yet."""
    d = daily_bars(spark, sf_dir)
    weekly = fold(d.withColumn("week", F.date_trunc("week", "ts")), ["symbol", "week"])
    return ops.asof_excluding_forming(d, weekly).fillna(-1, ["higher_idx"])


@query(
    f"""WITH {SQL_HOURLY} SELECT a.symbol, a.ts, a.close, floor((b.close - a.close) / nullif(a.close, 0) * 100 * 100.0 + 0.5) / 100.0 AS change_4h,
  floor((c.close - a.close) / nullif(a.close, 0) * 100 * 100.0 + 0.5) / 100.0 AS change_24h
FROM hourly a LEFT JOIN hourly b ON a.symbol = b.symbol AND b.ts = a.ts + INTERVAL 4 HOUR LEFT JOIN hourly c ON a.symbol = c.symbol AND c.ts = a.ts + INTERVAL 24 HOUR"""
)
def forward_by_hour(spark, sf_dir):
    """Change 4 and 24 hours on, by equi-joins on the hour; gaps give null."""
    h = hourly_bars(spark, sf_dir)
    x = ops.value_at_hour(h.select("symbol", "ts", "close"), h, 4, "c4")
    x = ops.value_at_hour(x, h, 24, "c24")
    return x.select("symbol", "ts", "close", pct_change("c4", "close").alias("change_4h"), pct_change("c24", "close").alias("change_24h"))


@query(
    f"{WITH} SELECT a.symbol, a.ts, a.close, b.close AS iv FROM daily a JOIN daily b ON a.ts = b.ts AND b.symbol = 'N' WHERE a.symbol <> 'N'"
)
def join_by_day(spark, sf_dir):
    """Bars with another series' value of the same day; days without one are skipped."""
    d = daily_bars(spark, sf_dir)
    return d.filter("symbol <> 'N'").select("symbol", "ts", "close").join(d.filter("symbol = 'N'").select("ts", F.col("close").alias("iv")), "ts")


@query(
    f"""WITH {SQL_HOURLY}, k AS (SELECT symbol, floor(epoch(ts) / 7200 + 0.5)::BIGINT AS bucket, max(close) AS v FROM hourly GROUP BY ALL), s AS (SELECT DISTINCT symbol FROM k ORDER BY symbol LIMIT 3),
r AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS no FROM s)
SELECT a.bucket, a.v AS v1, b.v AS v2, c.v AS v3 FROM k a JOIN r x ON a.symbol = x.symbol AND x.no = 1 JOIN k b ON a.bucket = b.bucket JOIN r y ON b.symbol = y.symbol AND y.no = 2
JOIN k c ON a.bucket = c.bucket JOIN r z ON c.symbol = z.symbol AND z.no = 3"""
)
def three_way_buckets(spark, sf_dir):
    """Two-hour buckets in which the first three series all have a value."""
    h = hourly_bars(spark, sf_dir).select("symbol", F.floor(F.unix_timestamp("ts") / 7200 + 0.5).alias("bucket"), "close").groupBy("symbol", "bucket").agg(F.max("close").alias("v"))
    names = h.select("symbol").distinct().orderBy("symbol").limit(3).withColumn("no", F.row_number().over(Window.orderBy("symbol")))
    k = h.join(F.broadcast(names), "symbol")  # three rows
    parts = [k.filter(F.col("no") == n).select("bucket", F.col("v").alias(f"v{n}")) for n in (1, 2, 3)]
    return parts[0].join(parts[1], "bucket").join(parts[2], "bucket")


@query(
    f"""{WITH}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS pos FROM daily),
j AS (SELECT a.symbol, a.pos, a.close, b.close AS bench FROM p a JOIN p b ON a.pos = b.pos AND b.symbol = 'A' WHERE a.symbol <> 'A'),
t AS (SELECT *, close / lag(close) OVER o - 1 AS ra, bench / lag(bench) OVER o - 1 AS rb FROM j WINDOW o AS (PARTITION BY symbol ORDER BY pos DESC))
SELECT symbol, count(ra) AS n, floor(corr(ra, rb) * 10000.0 + 0.5) / 10000.0 AS correlation, floor(covar_pop(ra, rb) / var_pop(rb) * 10000.0 + 0.5) / 10000.0 AS beta
FROM t GROUP BY symbol HAVING count(ra) >= 29"""
)
def benchmark_correlation(spark, sf_dir):
    """Correlation and beta of returns with a benchmark, aligned by position from the end."""
    d = daily_bars(spark, sf_dir)
    j = ops.by_position_from_end(d.filter("symbol <> 'A'"), d.filter("symbol = 'A'"))
    o = Window.partitionBy("symbol").orderBy(F.desc("pos"))
    t = j.withColumn("ra", F.col("close") / F.lag("close").over(o) - 1).withColumn("rb", F.col("bench_close") / F.lag("bench_close").over(o) - 1)
    out = t.groupBy("symbol").agg(F.count("ra").alias("n"), rounded(F.corr("ra", "rb")).alias("correlation"), rounded(F.covar_pop("ra", "rb") / F.var_pop("rb")).alias("beta"))
    return out.filter("n >= 29")


@query(
    f"""{WITH}, c AS (SELECT ts, max(close) FILTER (symbol = 'A') AS nominal, max(close) FILTER (symbol = 'R') AS "real" FROM daily GROUP BY ts)
SELECT ts, nominal, "real" AS real_yield, floor((nominal - "real") * 10000.0 + 0.5) / 10000.0 AS breakeven FROM c WHERE nominal IS NOT NULL"""
)
def breakeven_curve(spark, sf_dir):
    """Left join of one curve to another by date, and their difference where both exist."""
    d = daily_bars(spark, sf_dir)
    nominal, real = (d.filter(F.col("symbol") == s).select("ts", F.col("close").alias(n)) for s, n in (("A", "nominal"), ("R", "real_yield")))
    return nominal.join(real, "ts", "left").withColumn("breakeven", rounded(F.col("nominal") - F.col("real_yield")))


@query("SELECT e.event_id, e.user_id, coalesce(c.c_name, '?') AS author FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = (SELECT min(event_type) FROM events)")
def hydrate_authors(spark, sf_dir):
    """Events with their author's name; an unknown author is '?'."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return e.join(F.broadcast(first), "event_type").join(users, "user_id", "left").select("event_id", "user_id", F.coalesce("c_name", F.lit("?")).alias("author"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def missing_files(spark, sf_dir):
    """Keys that are indexed but have nothing behind them any more (anti-join)."""
    held = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def members_only(spark, sf_dir):
    """Rows whose key stands in another table (semi-join)."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(
    """WITH v AS (SELECT l_partkey AS id, max(l_discount) * 10 AS vector_score FROM lineitem WHERE l_quantity > 45 GROUP BY 1), k AS (SELECT l_partkey AS id, max(l_tax) * 10 AS keyword_score FROM lineitem WHERE l_quantity < 5 GROUP BY 1)
SELECT coalesce(v.id, k.id) AS id, coalesce(vector_score, 0) AS vector_score, coalesce(keyword_score, 0) AS keyword_score FROM v FULL JOIN k ON v.id = k.id"""
)
def merge_candidate_scores(spark, sf_dir):
    """Two candidate lists merged by id; the missing side scores 0."""
    li = table(spark, sf_dir, "lineitem")
    v = li.filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("id")).agg((F.max("l_discount") * 10).alias("vector_score"))
    k = li.filter("l_quantity < 5").groupBy(F.col("l_partkey").alias("id")).agg((F.max("l_tax") * 10).alias("keyword_score"))
    return ops.merge_scores(v, k, "id")


@query(
    f"""{WITH}, x AS (SELECT *, bar_idx AS i FROM bars), f AS (SELECT symbol, i, close * 0.9 AS stop, close * 1.1 AS target FROM x WHERE i % 25 = 0),
j AS (SELECT f.symbol, f.i AS fill, x.i, CASE WHEN x.low <= f.stop THEN 'stop' WHEN x.high >= f.target THEN 'target' END AS hit FROM f JOIN x ON x.symbol = f.symbol AND x.i > f.i AND x.i <= f.i + 10)
SELECT symbol, fill, coalesce(arg_min(hit, i) FILTER (hit IS NOT NULL), 'timeout') AS outcome, coalesce(min(i) FILTER (hit IS NOT NULL), max(i)) - fill AS held FROM j GROUP BY symbol, fill"""
)
def exits_after_fill(spark, sf_dir):
    """First stop or target among the ten bars after a fill, the stop going first on one bar.

    The range of bars is unrolled to ten keys a fill, so the join is an equi-join.
    """
    x = with_index(daily_bars(spark, sf_dir))
    f = x.filter("bar_idx % 25 = 0").select("symbol", F.col("bar_idx").alias("fill"), (F.col("close") * 0.9).alias("stop"), (F.col("close") * 1.1).alias("target"))
    keyed = f.withColumn("bar_idx", F.explode(F.sequence(F.col("fill") + 1, F.col("fill") + 10)))
    hit = F.when(F.col("low") <= F.col("stop"), "stop").when(F.col("high") >= F.col("target"), "target")
    j = keyed.join(x, ["symbol", "bar_idx"]).withColumn("hit", hit)
    first = F.when(F.col("hit").isNotNull(), F.col("bar_idx"))
    return j.groupBy("symbol", "fill").agg(
        F.coalesce(F.min_by("hit", first), F.lit("timeout")).alias("outcome"), (F.coalesce(F.min(first), F.max("bar_idx")) - F.col("fill")).alias("held")
    )


@query(f"WITH {SQL_HOURLY} SELECT ts FROM hourly WHERE symbol = (SELECT min(symbol) FROM hourly) INTERSECT SELECT ts FROM hourly WHERE symbol = (SELECT max(symbol) FROM hourly)")
def common_hours(spark, sf_dir):
    """Hours that two series share."""
    h = hourly_bars(spark, sf_dir).select("symbol", "ts")
    ends = h.agg(F.min("symbol").alias("lo"), F.max("symbol").alias("hi"))
    k = h.join(F.broadcast(ends), (F.col("symbol") == F.col("lo")) | (F.col("symbol") == F.col("hi")))  # one row
    return k.filter("symbol = lo").select("ts").intersect(k.filter("symbol = hi").select("ts"))


@query(f"{WITH}, s AS (SELECT symbol, ts, close, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM daily) SELECT symbol, ts, floor((later - close) / close * 100 * 100.0 + 0.5) / 100.0 AS forward_pct FROM s WHERE later IS NOT NULL")
def forward_by_bars(spark, sf_dir):
    """Return over the five bars ahead; bars without them are dropped."""
    return daily_bars(spark, sf_dir).withColumn("later", F.lead("close", 5).over(w.series())).filter("later IS NOT NULL").select("symbol", "ts", pct_change("later", "close").alias("forward_pct"))
