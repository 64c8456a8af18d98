"""Queries of the rule ladders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions import rules
from quayline.functions.numeric import rounded
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, SQL_HOURLY, daily_bars, hourly_bars
from quayline.storage import table


@query("""WITH n AS (SELECT p_partkey, upper(CASE p_partkey % 5 WHEN 0 THEN 'btc' WHEN 1 THEN ' eth-usd ' WHEN 2 THEN 'aapl' WHEN 3 THEN 'solusdt' ELSE 'msft' END) AS s FROM part), t AS (SELECT p_partkey, trim(s) AS s FROM n)
SELECT p_partkey, CASE WHEN s IN ('BTC', 'ETH-USD', 'SOLUSDT') THEN 'crypto' ELSE 'equity' END AS market, CASE s WHEN 'BTC' THEN 'BTCUSDT' WHEN 'ETH-USD' THEN 'ETHUSDT' ELSE s END AS symbol FROM t""")
def symbol_resolution(spark, sf_dir):
    """Market and venue symbol of user input."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "btc").when(k == 1, " eth-usd ").when(k == 2, "aapl").when(k == 3, "solusdt").otherwise("msft")
    return table(spark, sf_dir, "part").select("p_partkey", rules.resolve_symbol(name).alias("r")).select("p_partkey", "r.market", "r.symbol")


_ERRORS = (
    "HTTP 429 Too Many Requests",
    "upstream request Timed Out",
    "Invalid API key given",
    "status: 402 for this account",
    "server Overloaded, try again",
    "boom",
    "This model's maximum context length is 8192",
    "tokens per minute: maximum context length reached",
    "max_tokens would exceed the context window",
    "error 413: payload too large",
    "code 4031 raised",
    "403 Forbidden",
    "context deadline exceeded",
    "",
)


def _told(patterns: str, *texts: str) -> str:
    tests = [f"regexp_matches(t, '{patterns}')"] if patterns else []
    return "(" + " OR ".join(tests + [f"contains(t, '{x}')" for x in texts]) + ")"


@query(
    f"""WITH x AS (SELECT event_id, lower([{', '.join("'" + e.replace("'", "''") + "'" for e in _ERRORS)}][event_id % {len(_ERRORS)} + 1] || ' ' || CASE WHEN event_id % 3 = 0 AND event_id % {len(_ERRORS)} <> 13 THEN event_type ELSE '' END) AS t FROM events)
SELECT event_id, CASE WHEN NOT (contains(t, 'tpm') OR contains(t, 'tokens per minute')) AND ({_told('', 'maximum context length', 'prompt is too long', 'context overflow')} OR (contains(t, 'max_tokens') AND contains(t, 'exceed') AND contains(t, 'context')) OR (contains(t, '413') AND contains(t, 'too large'))) THEN 'context_overflow'
  WHEN {_told('rate[_ ]limit|too many requests|429', 'quota exceeded', 'tpm', 'tokens per minute')} THEN 'rate_limit' WHEN {_told('(status|code)[^a-z0-9]*[:=][ ]*402\\b', 'payment required')} THEN 'billing'
  WHEN {_told('invalid[_ ]?api[_ ]?key|\\b401\\b|\\b403\\b', 'unauthorized', 'forbidden')} THEN 'auth' WHEN {_told('', 'timeout', 'timed out', 'deadline exceeded')} THEN 'timeout' WHEN {_told('', 'overloaded', 'service unavailable')} THEN 'overloaded' ELSE 'unknown' END AS class FROM x"""
)
def error_classes(spark, sf_dir):
    """Class of an error by its text, first class told wins."""
    k = F.col("event_id") % len(_ERRORS)
    text = F.concat(F.element_at(F.array(*[F.lit(t) for t in _ERRORS]), (k + 1).cast("int")), F.when((F.col("event_id") % 3 == 0) & (k != 13), F.concat(F.lit(" "), "event_type")).otherwise(" "))
    return table(spark, sf_dir, "events").select("event_id", rules.error_class(text).alias("class"))


@query("SELECT event_id FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5 AND strftime(ts, '%H:%M') BETWEEN '09:00' AND '17:30'")
def active_hours(spark, sf_dir):
    """Events on weekdays between nine and half past five."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter(rules.active("ts", (2, 3, 4, 5, 6), "09:00", "17:30")).select("event_id")


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, m WHERE ts >= now - INTERVAL 3 HOUR")
def since_shorthand(spark, sf_dir):
    """Events of the last three hours before the newest."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bound = e.agg(F.max("ts").alias("now")).withColumn("bound", rules.since(F.lit("3h"), F.col("now")) + F.make_dt_interval(secs=F.extract(F.lit("SECOND"), "now") % 1))
    return e.crossJoin(F.broadcast(bound)).filter(F.col("ts") >= F.col("bound")).select("event_id")


@query("SELECT o_orderkey, a + ceil((n - a) / e::DOUBLE)::BIGINT * e + CASE WHEN a + ceil((n - a) / e::DOUBLE)::BIGINT * e <= n THEN e ELSE 0 END AS next_at, CASE WHEN k = 0 THEN 0 WHEN k >= 5 THEN 3600 ELSE [30, 60, 300, 900][k] END AS wait FROM (SELECT o_orderkey, o_orderkey % 1000 AS a, 60 + o_orderkey % 7 AS e, 5000 AS n, o_orderkey % 8 AS k FROM orders)")
def schedules(spark, sf_dir):
    """Next run of interval schedules and the wait after errors."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.next_run(k % 1000, 60 + k % 7, F.lit(5000)).alias("next_at"), rules.backoff(k % 8).alias("wait"))


@query(f"""WITH {SQL_HOURLY} SELECT symbol, arg_max(close, ts) AS latest, floor(avg(close) * 10000.0 + 0.5) / 10000.0 AS mean, floor(arg_max(close, ts) / 10000 * 24 / 8 * 365 * 100 * 100.0 + 0.5) / 100.0 AS annualised_pct,
  floor((arg_max(volume, ts) - arg_min(volume, ts)) / arg_min(volume, ts) * 100 * 100.0 + 0.5) / 100.0 AS oi_change_pct FROM hourly GROUP BY symbol""")
def funding_summary(spark, sf_dir):
    """Latest and mean rate, annualised, and the change of open interest over the window."""
    first, last = F.min_by("volume", "ts"), F.max_by("volume", "ts")
    latest = F.max_by("close", "ts")
    return hourly_bars(spark, sf_dir).groupBy("symbol").agg(latest.alias("latest"), rounded(F.avg("close")).alias("mean"), rules.annualised(latest / 10000, 8).alias("annualised_pct"), rounded((last - first) / first * 100, 2).alias("oi_change_pct"))


@query(f"""WITH {SQL_DAILY}, p AS (SELECT ts, max(close) FILTER (symbol = 'A') AS y2, max(close) FILTER (symbol = 'N') AS y3m, max(close) FILTER (symbol = 'R') AS y10 FROM daily GROUP BY ts)
SELECT ts, floor((y10 - y2) * 10000.0 + 0.5) / 10000.0 AS spread_10y_2y, floor((y10 - y3m) * 10000.0 + 0.5) / 10000.0 AS spread_10y_3m, y10 < y2 AS inverted FROM p WHERE y10 IS NOT NULL AND y2 IS NOT NULL AND y3m IS NOT NULL""")
def curve_spreads(spark, sf_dir):
    """Spreads between maturities and inversion."""
    p = daily_bars(spark, sf_dir).groupBy("ts").pivot("symbol", ["A", "N", "R"]).agg(F.max("close")).dropna()
    return p.select("ts", rounded(F.col("R") - F.col("A")).alias("spread_10y_2y"), rounded(F.col("R") - F.col("N")).alias("spread_10y_3m"), (F.col("R") < F.col("A")).alias("inverted"))


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS size FROM conversations), s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id) AS total, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY size DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT conv_id, turn, total - before > 500 AS spilled FROM s""")
def budget_spill(spark, sf_dir):
    """Largest results first go to files until the rest fits in 500 characters."""
    size = F.length("text")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("size"))
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("size").over(whole.orderBy(F.desc("size"), "turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("conv_id", "turn", (F.sum("size").over(whole) - before > 500).alias("spilled"))


@query("""WITH r AS (SELECT c_custkey AS peer, c_nationkey AS account, c_mktsegment AS channel FROM customer), m AS (
  SELECT o.o_orderkey, CASE WHEN o.o_custkey % 4 = 0 THEN 'peer:' || r.peer WHEN o.o_custkey % 4 = 1 THEN 'account:' || r.account WHEN o.o_custkey % 4 = 2 THEN 'channel:' || r.channel ELSE 'default' END AS route FROM orders o JOIN r ON r.peer = o.o_custkey)
SELECT * FROM m""")
def route_matching(spark, sf_dir):
    """The most specific route of each message: peer, account, channel, default."""
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("account"), F.col("c_mktsegment").alias("channel"))
    k = F.col("o_custkey") % 4
    options = F.array(
        F.when(k == 0, F.concat(F.lit("peer:"), F.col("o_custkey").cast("string"))),
        F.when(k <= 1, F.concat(F.lit("account:"), F.col("account").cast("string"))),
        F.when(k <= 2, F.concat(F.lit("channel:"), F.col("channel"))),
        F.lit("default"),
    )
    return table(spark, sf_dir, "orders").join(r, "o_custkey").select("o_orderkey", F.array_compact(options)[0].alias("route"))


@query("SELECT p_partkey, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024.0) ELSE printf('%.1fMB', b / 1048576.0) END AS size FROM (SELECT p_partkey, p_partkey * p_partkey * 7 AS b FROM part)")
def byte_sizes(spark, sf_dir):
    """Sizes in bytes as text."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.byte_size(F.col("p_partkey") * F.col("p_partkey") * 7).alias("size"))


@query("""WITH v AS (SELECT s_suppkey AS ticker, s_acctbal AS cash, s_suppkey % 120 AS payout, s_suppkey % 25 / 10.0 AS coverage FROM supplier)
SELECT ticker, CASE WHEN payout > 100 OR coverage < 1 THEN 'at risk' WHEN payout > 75 OR coverage < 1.5 OR cash < 0 THEN 'watch' ELSE 'safe' END AS safety FROM v""")
def dividend_safety(spark, sf_dir):
    """Safety of a dividend by payout, coverage and cash."""
    payout, cover = F.col("s_suppkey") % 120, F.col("s_suppkey") % 25 / 10.0
    safety = F.when((payout > 100) | (cover < 1), "at risk").when((payout > 75) | (cover < 1.5) | (F.col("s_acctbal") < 0), "watch").otherwise("safe")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), safety.alias("safety"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS day FROM orders), t AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1),
m AS (SELECT day FROM t QUALIFY row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY total DESC, day) = 1)
SELECT ticker, day FROM e WHERE EXISTS (SELECT 1 FROM m WHERE abs(date_diff('day', e.day, m.day)) <= 2)""")
def event_collisions(spark, sf_dir):
    """Dates of a ticker within two days of the market's calendar, which holds each month's busiest day; the range is unrolled to day keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    month = Window.partitionBy(F.trunc("day", "month")).orderBy(F.desc("total"), "day")
    calendar = o.groupBy("day").agg(F.sum("o_totalprice").alias("total")).withColumn("n", F.row_number().over(month)).filter("n = 1")
    near = calendar.select(F.explode(F.array(*[F.date_add("day", d) for d in range(-2, 3)])).alias("day")).distinct()
    return o.select("ticker", "day").distinct().join(near, "day", "left_semi").select("ticker", "day")
