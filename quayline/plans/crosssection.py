"""Cross-section, screening and fundamental queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions.numeric import pct_change, rounded
from quayline.functions.text import maturity, title_key, us_date
from quayline.operators.screening import first_by_key, ladder, screen
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, SQL_FUNDAMENTALS, daily_bars, fundamentals
from quayline.storage import table

WF = f"WITH {SQL_FUNDAMENTALS}"


def _r(x: str, d: int = 4) -> str:
    return f"floor(({x}) * {10.0**d} + 0.5) / {10.0**d}"


@query(f"WITH {SQL_DAILY}, m AS (SELECT symbol, ts, {_r('(close - open) / open * 100', 2)} AS change_pct FROM daily) SELECT * FROM m ORDER BY change_pct DESC, ts, symbol LIMIT 25")
def top_movers(spark, sf_dir):
    """The 25 largest rises within a day."""
    m = daily_bars(spark, sf_dir).select("symbol", "ts", pct_change("close", "open").alias("change_pct"))
    return m.orderBy(F.desc("change_pct"), "ts", "symbol").limit(25)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000 AND lower(c_mktsegment) = 'building' AND c_nationkey IN (1, 2, 3, 4, 5) ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def screener(spark, sf_dir):
    """Customers that pass a conjunction of filter rows, the richest ten."""
    c = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey")
    return screen(c, [("c_acctbal", "gt", 9000), ("c_mktsegment", "eq", "building"), ("c_nationkey", "in", [1, 2, 3, 4, 5])]).select("c_custkey", "c_name", "c_acctbal")


@query("WITH s AS (SELECT n_name AS sector, avg(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name) SELECT sector, row_number() OVER (ORDER BY v DESC NULLS LAST, sector) AS rank FROM s")
def sector_rank(spark, sf_dir):
    """Sectors ranked by their mean, nulls last."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    s = c.groupBy(F.col("n_name").alias("sector")).agg(F.avg("c_acctbal").alias("v"))
    return s.select("sector", F.row_number().over(Window.orderBy(F.desc_nulls_last("v"), "sector")).alias("rank"))


@query("SELECT doc_id, key FROM (SELECT doc_id, substr(lower(text), 1, 60) AS key, row_number() OVER (PARTITION BY substr(lower(text), 1, 60) ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_title(spark, sf_dir):
    """Stories distinct by the start of their title; the first feed wins."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", title_key("text").alias("key"))
    return first_by_key(d, "key", "source", "doc_id").select("doc_id", "key")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def latest_per_key(spark, sf_dir):
    """The most recent order of each customer."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 50")
def priority_dequeue(spark, sf_dir):
    """The next fifty messages: by priority, then by arrival."""
    o = table(spark, sf_dir, "orders").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(50)
    return o.withColumn("place", F.row_number().over(Window.orderBy("o_orderpriority", "o_orderdate", "o_orderkey"))).select("o_orderkey", "o_orderpriority", "place")


@query(f"{WF} SELECT ticker, year, {_r('(revenue - lag(revenue) OVER o) / lag(revenue) OVER o * 100', 2)} AS revenue_growth, {_r('(revenue - cost) / revenue * 100', 1)} AS gross_margin FROM fundamentals WINDOW o AS (PARTITION BY ticker ORDER BY year)")
def yoy_growth(spark, sf_dir):
    """Growth on the year before and margins."""
    before = F.lag("revenue").over(Window.partitionBy("ticker").orderBy("year"))
    return fundamentals(spark, sf_dir).select("ticker", "year", pct_change("revenue", before).alias("revenue_growth"), rounded((F.col("revenue") - F.col("cost")) / F.col("revenue") * 100, 1).alias("gross_margin"))


_Z = "1.2 * cash / revenue + 1.4 * (revenue - cost - tax) / revenue + 3.3 * (revenue - cost) / revenue / 10 + 0.6 * units / lines / 50 + 1.0"


@query(f"{WF}, z AS (SELECT ticker, year, {_Z} AS z FROM fundamentals) SELECT ticker, year, {_r('z', 3)} AS z, CASE WHEN z > 2.99 THEN 'safe' WHEN z < 1.81 THEN 'distress' ELSE 'grey' END AS zone FROM z")
def altman_like(spark, sf_dir):
    """Z score with its published weights and zones over statement-like ratios."""
    rev = F.col("revenue")
    z = 1.2 * F.col("cash") / rev + 1.4 * (rev - F.col("cost") - F.col("tax")) / rev + 3.3 * (rev - F.col("cost")) / rev / 10 + 0.6 * F.col("units") / F.col("lines") / 50 + 1.0
    f = fundamentals(spark, sf_dir).select("ticker", "year", z.alias("v"))
    return f.select("ticker", "year", rounded("v", 3).alias("z"), F.when(F.col("v") > 2.99, "safe").when(F.col("v") < 1.81, "distress").otherwise("grey").alias("zone"))


@query(
    f"""{WF}, p AS (SELECT *, lag(revenue) OVER o AS r0, lag(cost) OVER o AS c0, lag(units) OVER o AS u0, lag(tax) OVER o AS t0, lag(lines) OVER o AS l0 FROM fundamentals WINDOW o AS (PARTITION BY ticker ORDER BY year))
SELECT ticker, year, ((revenue - cost - tax > 0)::INT + (cash > 0)::INT + (revenue > r0)::INT + (cost / revenue < c0 / r0)::INT + (tax / revenue < t0 / r0)::INT + (units / lines > u0 / l0)::INT + (lines >= l0)::INT + (revenue / units > r0 / u0)::INT + (revenue - cost > r0 - c0)::INT) AS score FROM p WHERE r0 IS NOT NULL"""
)
def piotroski_like(spark, sf_dir):
    """Nine yes-or-no tests on a year and the one before."""
    o = Window.partitionBy("ticker").orderBy("year")
    p = fundamentals(spark, sf_dir).withColumns({k: F.lag(c).over(o) for k, c in (("r0", "revenue"), ("c0", "cost"), ("u0", "units"), ("t0", "tax"), ("l0", "lines"))}).filter("r0 IS NOT NULL")
    tests = (
        "revenue - cost - tax > 0",
        "cash > 0",
        "revenue > r0",
        "cost / revenue < c0 / r0",
        "tax / revenue < t0 / r0",
        "units / lines > u0 / l0",
        "lines >= l0",
        "revenue / units > r0 / u0",
        "revenue - cost > r0 - c0",
    )
    return p.select("ticker", "year", sum((F.expr(t).cast("int") for t in tests[1:]), F.expr(tests[0]).cast("int")).alias("score"))


@query(
    f"""{WF}, g AS (SELECT ticker, arg_max(revenue - cost - tax, year) AS fcf, arg_max(cash, year) AS cash, least(0.15, greatest(0, power(arg_max(revenue, year) / arg_min(revenue, year), 1.0 / nullif(max(year) - min(year), 0)) - 1)) AS g FROM fundamentals GROUP BY ticker HAVING count(*) > 1),
w AS (SELECT unnest([0.08, 0.09, 0.10]) AS wacc), t AS (SELECT unnest([0.02, 0.025, 0.03]) AS tg),
y1 AS (SELECT *, fcf * (1 + g * 0.95) AS f1 FROM g, w, t), y2 AS (SELECT *, f1 * (1 + g * 0.95 * 0.9) AS f2 FROM y1), y3 AS (SELECT *, f2 * (1 + g * 0.95 * 0.9 * 0.85) AS f3 FROM y2)
SELECT ticker, wacc::DOUBLE AS wacc, tg::DOUBLE AS terminal_growth, {_r('(f1 / (1 + wacc::DOUBLE) + f2 / power(1 + wacc::DOUBLE, 2) + f3 / power(1 + wacc::DOUBLE, 3) + f3 * (1 + tg::DOUBLE) / (wacc::DOUBLE - tg::DOUBLE) / power(1 + wacc::DOUBLE, 3) + cash) / 1000', 2)} AS value FROM y3"""
)
def dcf_grid(spark, sf_dir):
    """Discounted cash flows on a three by three grid of discount and terminal rates."""
    years = F.max("year") - F.min("year")
    cagr = F.pow(F.max_by("revenue", "year") / F.min_by("revenue", "year"), F.lit(1.0) / years) - 1
    g = fundamentals(spark, sf_dir).withColumn("flow", F.col("revenue") - F.col("cost") - F.col("tax")).groupBy("ticker")
    g = g.agg(F.max_by("flow", "year").alias("fcf"), F.max_by("cash", "year").alias("cash"), F.count(F.lit(1)).alias("n"), F.least(F.lit(0.15), F.greatest(F.lit(0.0), cagr)).alias("g")).filter("n > 1")
    x = g.withColumn("wacc", F.explode(F.array(*[F.lit(v) for v in (0.08, 0.09, 0.10)]))).withColumn("terminal_growth", F.explode(F.array(*[F.lit(v) for v in (0.02, 0.025, 0.03)])))
    rate, value, flow, part = F.col("g"), F.col("cash"), F.col("fcf"), 1.0
    for year, decay in enumerate((0.95, 0.9, 0.85), 1):
        part *= decay
        flow = flow * (1 + rate * part)
        value = value + flow / F.pow(1 + F.col("wacc"), F.lit(float(year)))
    value = value + flow * (1 + F.col("terminal_growth")) / (F.col("wacc") - F.col("terminal_growth")) / F.pow(1 + F.col("wacc"), F.lit(3.0))
    return x.select("ticker", "wacc", "terminal_growth", rounded(value / 1000, 2).alias("value"))


@query(
    f"""{WF}, s AS (SELECT ticker, year, CASE WHEN (revenue - cost) / revenue >= 0.955 THEN 20 WHEN (revenue - cost) / revenue >= 0.95 THEN 12 ELSE 5 END + CASE WHEN revenue >= 3000000 THEN 30 WHEN revenue >= 2000000 THEN 20 WHEN revenue >= 1000000 THEN 10 ELSE 0 END + CASE WHEN cash >= 5000 THEN 25 WHEN cash >= 0 THEN 15 ELSE 0 END AS score FROM fundamentals)
SELECT ticker, year, score::DOUBLE AS score, CASE WHEN score >= 60 THEN 'strong' WHEN score >= 40 THEN 'fair' ELSE 'weak' END AS rating FROM s"""
)
def multi_factor(spark, sf_dir):
    """Points by ladders of margin, size and balance, and the rating band."""
    margin = (F.col("revenue") - F.col("cost")) / F.col("revenue")
    score = ladder(margin, [(0.955, 20.0), (0.95, 12.0)], 5.0) + ladder(F.col("revenue"), [(3e6, 30.0), (2e6, 20.0), (1e6, 10.0)]) + ladder(F.col("cash"), [(5000, 25.0), (0, 15.0)])
    f = fundamentals(spark, sf_dir).select("ticker", "year", score.alias("score"))
    return f.withColumn("rating", F.when(F.col("score") >= 60, "strong").when(F.col("score") >= 40, "fair").otherwise("weak"))


@query("WITH p AS (SELECT n_regionkey AS book, n_name AS sector, sum(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), s AS (SELECT *, v / sum(v) OVER (PARTITION BY book) * 100 AS share FROM p) SELECT book, sector, " + _r("share", 2) + " AS share_pct, share > 22 AS concentrated FROM s")
def concentration(spark, sf_dir):
    """Each sector's share of its book, with an alert above 22 percent."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    p = c.groupBy(F.col("n_regionkey").alias("book"), F.col("n_name").alias("sector")).agg(F.sum("c_acctbal").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy("book")) * 100
    return p.withColumn("share", share).select("book", "sector", rounded("share", 2).alias("share_pct"), (F.col("share") > 22).alias("concentrated"))


@query("SELECT source, " + _r("(count(*) FILTER (doc_id % 3 = 0) - count(*) FILTER (doc_id % 3 = 1)) / count(*) * 50 + 50", 1) + " AS sentiment, count(*) AS n FROM documents GROUP BY source")
def sentiment_score(spark, sf_dir):
    """Balance of positive and negative items on a scale of 0 to 100."""
    good, bad, n = F.count_if(F.col("doc_id") % 3 == 0), F.count_if(F.col("doc_id") % 3 == 1), F.count(F.lit(1))
    return table(spark, sf_dir, "documents").groupBy("source").agg(rounded((good - bad) / n * 50 + 50, 1).alias("sentiment"), n.alias("n"))


@query("PIVOT (SELECT n_regionkey AS region, c_mktsegment AS segment, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey) ON segment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') USING count(c_custkey) GROUP BY region")
def peer_table(spark, sf_dir):
    """Counts of three segments by region, side by side."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.groupBy(F.col("n_regionkey").alias("region")).pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).agg(F.count("c_custkey")).fillna(0)


@query("SELECT event_type, date_trunc('day', ts) AS day, CASE WHEN avg(value) < 40 THEN 'calm' WHEN avg(value) < 60 THEN 'normal' ELSE 'stressed' END AS regime FROM events GROUP BY ALL")
def volatility_regime(spark, sf_dir):
    """Level of each series by day, in three bands."""
    mean = F.avg("value")
    e = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day"))
    return e.agg(F.when(mean < 40, "calm").when(mean < 60, "normal").otherwise("stressed").alias("regime"))


@query("SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 10) AS iso, 'Q' || quarter(o_orderdate) || ' ' || strftime(o_orderdate, '%y') AS quarter, (1 + o_orderkey % 30)::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'Y' END AS maturity FROM orders")
def date_labels(spark, sf_dir):
    """US dates as ISO, quarter labels and normalised maturities."""
    us = F.date_format("o_orderdate", "M/d/yyyy")
    label = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.date_format("o_orderdate", "yy"))
    raw = F.concat((1 + F.col("o_orderkey") % 30).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " Mo").otherwise(" YR"))
    return table(spark, sf_dir, "orders").select("o_orderkey", us_date(us).alias("iso"), label.alias("quarter"), maturity(raw).alias("maturity"))


@query("WITH t AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id FROM t WHERE p IS NULL OR ts - p > INTERVAL 24 HOUR")
def suppress_repeats(spark, sf_dir):
    """Events whose like did not come from the same user within the last 24 hours."""
    o = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    t = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("p", F.lag("ts").over(o))
    return t.filter(F.col("p").isNull() | (F.unix_micros("ts") - F.unix_micros("p") > 86_400_000_000)).select("event_id", "user_id")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    """A field of JSON text; malformed text gives null."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
