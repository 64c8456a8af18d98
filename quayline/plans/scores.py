"""Scores of statements and news, on statement fields bound to a supplier's lines of a year."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.plans.registry import query
from quayline.storage import table

#: a statement's field -> what is summed over a supplier's lines of a year
FIELDS = {
    "revenue": "l_extendedprice * (1 - l_discount)",
    "cogs": "l_extendedprice * (0.3 + 3 * l_discount)",
    "net_income": "l_extendedprice * (0.05 - l_tax)",
    "op_cash": "l_extendedprice * (0.06 - l_tax)",
    "assets": "l_extendedprice * 0.9",
    "long_debt": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.4 ELSE 0 END",
    "current_assets": "CASE WHEN l_returnflag = 'N' THEN l_extendedprice * 0.5 ELSE 0 END",
    "current_liabilities": "CASE WHEN l_returnflag = 'A' THEN l_extendedprice * 0.4 ELSE 0 END",
    "shares": "l_quantity",
    "retained": "l_extendedprice * (0.3 - 4 * l_discount)",
    "ebit": "l_extendedprice * (0.15 - l_tax)",
    "market_cap": "l_extendedprice * 1.2",
    "capex": "l_extendedprice * -0.02",
}
_SQL = "s AS (SELECT l_suppkey AS ticker, year(l_shipdate) AS year, " + ", ".join(f"sum({e}) AS {c}" for c, e in FIELDS.items()) + " FROM lineitem GROUP BY ALL)"


def statements(spark, sf_dir):
    """ticker, year and the fields of FIELDS."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("year")).agg(*[F.sum(F.expr(e)).alias(c) for c, e in FIELDS.items()])


def piotroski_tests(before) -> dict[str, Column]:
    """The nine tests of a year against the one before, each true, false or null where a number is missing."""
    now = F.col
    average = (now("assets") + before("assets")) / 2
    last = (before("assets") + F.lag("assets", 2).over(Window.partitionBy("ticker").orderBy("year"))) / 2
    margin = lambda f: (f("revenue") - f("cogs")) / f("revenue")
    return {
        "income": now("net_income") > 0,
        "return": F.when(average != 0, now("net_income") / average > 0),
        "cash": now("op_cash") > 0,
        "quality": now("op_cash") > now("net_income"),
        "leverage": F.when((now("assets") != 0) & (before("assets") != 0), now("long_debt") / now("assets") < before("long_debt") / before("assets")),
        "liquidity": F.when((now("current_liabilities") != 0) & (before("current_liabilities") != 0), now("current_assets") / now("current_liabilities") > before("current_assets") / before("current_liabilities")),
        "dilution": now("shares") <= before("shares"),
        "margin": F.when((now("revenue") != 0) & (before("revenue") != 0), margin(now) > margin(before)),
        "turnover": F.when((average != 0) & (last != 0), now("revenue") / average > before("revenue") / last),
    }


@query(
    f"""WITH {_SQL}, p AS (SELECT *, {', '.join(f'lag({c}) OVER o AS p_{c}' for c in FIELDS)}, lag(assets, 2) OVER o AS q_assets FROM s WINDOW o AS (PARTITION BY ticker ORDER BY year))
SELECT ticker, year, coalesce((net_income > 0)::INT, 0) + coalesce((net_income / nullif((assets + p_assets) / 2, 0) > 0)::INT, 0) + coalesce((op_cash > 0)::INT, 0) + coalesce((op_cash > net_income)::INT, 0)
  + coalesce((long_debt / nullif(assets, 0) < p_long_debt / nullif(p_assets, 0))::INT, 0) + coalesce((current_assets / nullif(current_liabilities, 0) > p_current_assets / nullif(p_current_liabilities, 0))::INT, 0) + coalesce((shares <= p_shares)::INT, 0)
  + coalesce(((revenue - cogs) / nullif(revenue, 0) > (p_revenue - p_cogs) / nullif(p_revenue, 0))::INT, 0) + coalesce((revenue / nullif((assets + p_assets) / 2, 0) > p_revenue / nullif((p_assets + q_assets) / 2, 0))::INT, 0) AS score FROM p"""
)
def piotroski(spark, sf_dir):
    """The nine tests of profit, leverage and efficiency, year on year; a missing number gives no point."""
    series = Window.partitionBy("ticker").orderBy("year")
    tests = piotroski_tests(lambda c: F.lag(c).over(series))
    return statements(spark, sf_dir).select("ticker", "year", sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests.values()), F.lit(0)).alias("score"))


@query(
    f"""WITH {_SQL}, x AS (SELECT ticker, year, (current_assets - current_liabilities) / assets AS x1, retained / assets AS x2, ebit / assets AS x3, market_cap / (long_debt + current_liabilities) AS x4, revenue / assets AS x5 FROM s WHERE assets > 0 AND long_debt + current_liabilities > 0),
z AS (SELECT ticker, year, 1.2 * x1 + 1.4 * x2 + 3.3 * x3 + 0.6 * x4 + 1.0 * x5 AS z, 6.56 * x1 + 3.26 * x2 + 6.72 * x3 + 1.05 * x4 AS z2 FROM x)
SELECT ticker, year, floor(z * 10000.0 + 0.5) / 10000.0 AS z, CASE WHEN z > 2.99 THEN 'safe' WHEN z >= 1.81 THEN 'grey' ELSE 'distress' END AS zone, floor(z2 * 10000.0 + 0.5) / 10000.0 AS z_service FROM z"""
)
def altman_z(spark, sf_dir):
    """The distress score of makers with its zones, and that of service companies."""
    owed = F.col("long_debt") + F.col("current_liabilities")
    s = statements(spark, sf_dir).filter((F.col("assets") > 0) & (owed > 0))
    x = [(F.col("current_assets") - F.col("current_liabilities")) / F.col("assets"), F.col("retained") / F.col("assets"), F.col("ebit") / F.col("assets"), F.col("market_cap") / owed, F.col("revenue") / F.col("assets")]
    z = 1.2 * x[0] + 1.4 * x[1] + 3.3 * x[2] + 0.6 * x[3] + 1.0 * x[4]
    service = 6.56 * x[0] + 3.26 * x[1] + 6.72 * x[2] + 1.05 * x[3]
    return s.select("ticker", "year", rounded(z).alias("z"), F.when(z > 2.99, "safe").when(z >= 1.81, "grey").otherwise("distress").alias("zone"), rounded(service).alias("z_service"))


@query(f"WITH {_SQL} SELECT ticker, year, floor((op_cash - abs(capex)) * 100.0 + 0.5) / 100.0 AS free_cash FROM s")
def free_cash_flow(spark, sf_dir):
    """Operating cash less what was spent on assets, whatever its sign in the statement."""
    return statements(spark, sf_dir).select("ticker", "year", rounded(F.col("op_cash") - F.abs("capex"), 2).alias("free_cash"))


@query(
    """WITH w AS (SELECT source, lang, CASE source WHEN 'web' THEN 1.0 WHEN 'forum' THEN 0.5 ELSE 1.5 END::DOUBLE AS weight, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT lang, weight, len(list_filter(t, lambda x: x IN ('good', 'great', 'up', 'well', 'best', 'new'))) AS b, len(list_filter(t, lambda x: x IN ('bad', 'poor', 'down', 'ill', 'worst', 'old'))) AS r FROM w),
d AS (SELECT lang, weight, CASE WHEN b > r THEN 1 WHEN b < r THEN -1 ELSE 0 END AS side FROM c), s AS (SELECT lang, sum(weight) AS total, sum(weight * side) AS net FROM d GROUP BY lang), g AS (SELECT lang, floor(net / total * 50 + 50 + 0.5) AS score FROM s WHERE total > 0)
SELECT lang, score, CASE WHEN score >= 75 THEN 'very positive' WHEN score >= 60 THEN 'positive' WHEN score >= 45 THEN 'neutral' WHEN score >= 25 THEN 'negative' ELSE 'very negative' END AS label FROM g"""
)
def news_sentiment(spark, sf_dir):
    """Score of each language's texts from 0 to 100: texts with more good or more bad words, weighed by their source."""
    words = lambda *w: F.regexp_count(F.lower("text"), F.lit("(?<![a-z])(" + "|".join(w) + ")(?![a-z])"))
    b, r = words("good", "great", "up", "well", "best", "new"), words("bad", "poor", "down", "ill", "worst", "old")
    weight = F.when(F.col("source") == "web", 1.0).when(F.col("source") == "forum", 0.5).otherwise(1.5)
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("lang", weight.alias("w"), F.when(b > r, 1).when(b < r, -1).otherwise(0).alias("side"))
    s = d.groupBy("lang").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("side")).alias("net")).filter("total > 0")
    score = F.floor(F.col("net") / F.col("total") * 50 + 50 + 0.5).cast("double")
    label = F.when(score >= 75, "very positive").when(score >= 60, "positive").when(score >= 45, "neutral").when(score >= 25, "negative").otherwise("very negative")
    return s.select("lang", score.alias("score"), label.alias("label"))


@query(
    f"""WITH {_SQL}, p AS (SELECT *, lag(revenue) OVER (PARTITION BY ticker ORDER BY year) AS p_revenue FROM s),
c AS (SELECT ticker, year, CASE WHEN revenue > 1.5 * p_revenue THEN 3 WHEN revenue > 1.1 * p_revenue THEN 2 WHEN revenue > p_revenue THEN 1 ELSE 0 END + CASE WHEN revenue > 300000 THEN 2 WHEN revenue > 150000 THEN 1 ELSE 0 END
  + CASE WHEN (revenue - cogs) / revenue > 0.6 THEN 2 WHEN (revenue - cogs) / revenue > 0.5 THEN 1 ELSE 0 END + CASE WHEN ticker % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN market_cap / revenue < 1.26 THEN 2 WHEN market_cap / revenue < 1.3 THEN 1 ELSE 0 END AS score FROM p WHERE p_revenue IS NOT NULL AND revenue > 0)
SELECT ticker, year, score, row_number() OVER (PARTITION BY year ORDER BY score DESC, ticker) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY year ORDER BY score DESC, ticker) <= 5"""
)
def ipo_scores(spark, sf_dir):
    """Five weighted criteria, ten points in all; the five best of each year."""
    x = statements(spark, sf_dir).withColumn("before", F.lag("revenue").over(Window.partitionBy("ticker").orderBy("year"))).filter("before IS NOT NULL AND revenue > 0")
    margin, price = (F.col("revenue") - F.col("cogs")) / F.col("revenue"), F.col("market_cap") / F.col("revenue")
    ladder = lambda c, *steps: F.coalesce(*[F.when(c > at, points) for at, points in steps], F.lit(0))
    above = lambda k: F.col("revenue") > k * F.col("before")
    traction = F.when(above(1.5), 3).when(above(1.1), 2).when(above(1), 1).otherwise(0)
    score = traction + ladder(F.col("revenue"), (300_000, 2), (150_000, 1)) + ladder(margin, (0.6, 2), (0.5, 1)) + F.when(F.col("ticker") % 5 == 0, 1).otherwise(0) + F.when(price < 1.26, 2).when(price < 1.3, 1).otherwise(0)
    ranked = x.select("ticker", "year", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("score"), "ticker")))
    return ranked.filter("rank <= 5")


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) / sum(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 5 WHEN c_acctbal < 2500 THEN 3 ELSE 1 END + CASE WHEN coalesce(n, 0) < 5 THEN 5 WHEN n < 12 THEN 3 ELSE 1 END
  + CASE WHEN urgent > 0.4 * n THEN 5 WHEN urgent > 0.2 * n THEN 3 ELSE 1 END + CASE WHEN top > 0.3 THEN 5 WHEN top > 0.15 THEN 3 ELSE 1 END AS risk FROM customer LEFT JOIN o ON o_custkey = c_custkey"""
)
def risk_matrix(spark, sf_dir):
    """Four ratings from one to five, summed: balance, activity, urgency and concentration."""
    total = F.sum("o_totalprice")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.max("o_totalprice") / total).alias("top"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    rating = lambda worst, middle: F.when(worst, 5).when(middle, 3).otherwise(1)
    n, urgent, top, balance = F.col("n"), F.col("urgent"), F.col("top"), F.col("c_acctbal")
    risk = rating(balance < 0, balance < 2500) + rating(F.coalesce(n, F.lit(0)) < 5, n < 12) + rating(urgent > 0.4 * n, urgent > 0.2 * n) + rating(top > 0.3, top > 0.15)
    return c.select("c_custkey", risk.alias("risk"))
