"""Queries of feeds and source tables: typed rows from raw shapes, fallbacks, unions, latest rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.plans.registry import query
from quayline.sources.market import hourly_bars
from quayline.sources.feeds import rss_items
from quayline.storage import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _r(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"


@query(
    f"""SELECT event_type AS symbol, ts, {_r('value')} AS open, {_r('value * 1.01')} AS high, {_r('value * 0.99')} AS low, {_r('value * 1.005')} AS close FROM events WHERE event_id % 7 <> 0"""
)
def candles_from_arrays(spark, sf_dir):
    """Candles from positional arrays of text; rows without a number for high, low or close go."""
    num = lambda k: (F.col("value") * k).cast("string")
    bad = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(num(1.005))
    raw = _events(spark, sf_dir).select("event_type", "ts", F.to_json(F.array(num(1.0), num(1.01), num(0.99), bad)).alias("line"))
    cell = F.from_json("line", "array<string>")
    x = raw.select(F.col("event_type").alias("symbol"), "ts", *[cell[k].try_cast("double").alias(c) for k, c in enumerate(("open", "high", "low", "close"))])
    return x.filter("high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL").select("symbol", "ts", *[rounded(c).alias(c) for c in ("open", "high", "low", "close")])


@query(f"SELECT event_type AS kind, ts, event_id, {_r('value')} AS rate FROM events WHERE event_type IN ('click', 'view', 'purchase') QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 10")
def newest_rates(spark, sf_dir):
    """The ten newest values of each of three kinds."""
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    x = _events(spark, sf_dir).filter(F.col("event_type").isin("click", "view", "purchase")).withColumn("n", n).filter("n <= 10")
    return x.select(F.col("event_type").alias("kind"), "ts", "event_id", rounded("value").alias("rate"))


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'")
def dated_range(spark, sf_dir):
    """Rows of one status within a range of dates; both filters reach the scan."""
    x = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    return x.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 50 = 0 AND l_linenumber IN (1, 3, 5)")
def filing_items(spark, sf_dir):
    """Named items of named filings."""
    x = table(spark, sf_dir, "lineitem").filter((F.col("l_orderkey") % 50 == 0) & F.col("l_linenumber").isin(1, 3, 5))
    return x.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    f"""WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type AS venue, avg(value) AS oi FROM events GROUP BY ALL), v AS (SELECT hour, max(oi) FILTER (venue = 'click') AS a, max(oi) FILTER (venue = 'view') AS b, max(oi) FILTER (venue = 'purchase') AS c FROM h GROUP BY hour)
SELECT hour, {_r('a')} AS click, {_r('b')} AS view, {_r('c')} AS purchase, {_r('(a + b + c) / 3')} AS mean FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"""
)
def venue_mean(spark, sf_dir):
    """Three venues' interest in one row an hour, and their equal-weight mean."""
    h = _events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("venue")).agg(F.avg("value").alias("oi"))
    v = h.groupBy("hour").pivot("venue", ["click", "view", "purchase"]).agg(F.max("oi")).dropna()
    return v.select("hour", *[rounded(c).alias(c) for c in ("click", "view", "purchase")], rounded((F.col("click") + F.col("view") + F.col("purchase")) / 3).alias("mean"))


@query("SELECT s_suppkey AS id, s_name AS name, rank FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier WHERE s_nationkey < 12) WHERE rank <= 25")
def ranked_list(spark, sf_dir):
    """The 25 largest of a category, typed and ranked."""
    top = table(spark, sf_dir, "supplier").filter("s_nationkey < 12").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25)
    rank = F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey"))  # of 25 rows
    return top.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), rank.alias("rank"))


@query(
    """WITH d AS (SELECT event_type AS kind, CAST(ts AS DATE) AS day, CAST(floor(avg(value)) AS BIGINT) AS score FROM events GROUP BY ALL), s AS (SELECT kind, first(score ORDER BY day DESC) AS now, last(score ORDER BY day DESC) AS oldest, count(*) AS days FROM d GROUP BY kind)
SELECT *, now - oldest AS trend, CASE WHEN now > oldest THEN 'rising' WHEN now < oldest THEN 'falling' ELSE 'flat' END AS way FROM s"""
)
def index_trend(spark, sf_dir):
    """Newest and oldest score of an index, and where it went."""
    d = _events(spark, sf_dir).groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day")).agg(F.floor(F.avg("value")).alias("score"))
    s = d.groupBy("kind").agg(F.max_by("score", "day").alias("now"), F.min_by("score", "day").alias("oldest"), F.count(F.lit(1)).alias("days"))
    return s.withColumn("trend", F.col("now") - F.col("oldest")).withColumn("way", F.when(F.col("now") > F.col("oldest"), "rising").when(F.col("now") < F.col("oldest"), "falling").otherwise("flat"))


@query("SELECT 'part' AS feed, p_partkey AS id, p_name AS title, p_retailprice AS price FROM part WHERE p_size > 40 UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier WHERE s_acctbal > 5000")
def two_feeds(spark, sf_dir):
    """Two feeds in one shape; what one lacks is null."""
    p = table(spark, sf_dir, "part").filter("p_size > 40").select(F.lit("part").alias("feed"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.lit("supplier").alias("feed"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return p.unionByName(s, allowMissingColumns=True)


@query(
    """WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 2), b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, b.n) AS n, CASE WHEN a.day IS NULL THEN 'secondary' ELSE 'primary' END AS feed FROM a FULL JOIN b ON a.day = b.day"""
)
def feed_with_fallback(spark, sf_dir):
    """A calendar's days from the primary feed, from the secondary where that has none."""
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    a = e.filter("event_type = 'purchase'").groupBy("day").agg(F.count(F.lit(1)).alias("n1")).filter("n1 > 2")
    b = e.filter("event_type = 'view'").groupBy("day").agg(F.count(F.lit(1)).alias("n2"))
    return a.join(b, "day", "full").select("day", F.coalesce("n1", "n2").alias("n"), F.when(F.col("n1").isNull(), "secondary").otherwise("primary").alias("feed"))


@query("SELECT a.conv_id, a.turn, 'User: ' || a.text || chr(10) || 'Assistant: ' || b.text AS text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND a.text IS NOT NULL AND b.text IS NOT NULL")
def transcripts(spark, sf_dir):
    """Whole exchanges of a chat as text; a question without an answer is skipped."""
    series = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").withColumns({"r2": F.lead("role").over(series), "t2": F.lead("text").over(series), "n2": F.lead("turn").over(series)})
    x = x.filter("role = 'user' AND r2 = 'assistant' AND n2 = turn + 1 AND text IS NOT NULL AND t2 IS NOT NULL")
    return x.select("conv_id", "turn", F.concat(F.lit("User: "), "text", F.lit("\nAssistant: "), "t2").alias("text"))


@query(
    f"""WITH p AS (SELECT event_type AS symbol, max(value) AS top, count(*) AS n FROM events GROUP BY 1), q AS (SELECT event_type AS symbol, avg(value) AS mean FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type AS symbol, last(value ORDER BY ts, event_id) AS now FROM events GROUP BY 1)
SELECT symbol, {_r('top')} AS top, n, {_r('mean')} AS mean, {_r('now')} AS now FROM p JOIN q USING (symbol) JOIN r USING (symbol)"""
)
def positioning(spark, sf_dir):
    """One record a symbol from three endpoints' tables."""
    e = _events(spark, sf_dir).withColumnRenamed("event_type", "symbol")
    p, q = e.groupBy("symbol").agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n")), e.filter("event_id % 2 = 0").groupBy("symbol").agg(F.avg("value").alias("mean"))
    r = e.groupBy("symbol").agg(F.max_by("value", F.struct("ts", "event_id")).alias("now"))
    return p.join(q, "symbol").join(r, "symbol").select("symbol", rounded("top").alias("top"), "n", rounded("mean").alias("mean"), rounded("now").alias("now"))


@query(
    """WITH w AS (SELECT event_type AS kind, max(ts) OVER () AS last, ts FROM events), c AS (SELECT kind, count(*) FILTER (ts > last - INTERVAL 3 DAY) / 3.0 AS three, count(*) FILTER (ts > last - INTERVAL 7 DAY) / 7.0 AS seven FROM w GROUP BY kind)
SELECT kind, CASE WHEN three > 1.5 * seven THEN 'accelerating' WHEN three < 0.7 * seven THEN 'fading' ELSE 'steady' END AS momentum FROM c"""
)
def news_momentum(spark, sf_dir):
    """Daily rate of the last three days against the last seven."""
    e = _events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("last"))
    recent = lambda d: F.count_if(F.col("ts") > F.col("last") - F.expr(f"INTERVAL {d} DAY")) / d
    c = e.crossJoin(F.broadcast(last)).groupBy(F.col("event_type").alias("kind")).agg(recent(3).alias("three"), recent(7).alias("seven"))
    return c.select("kind", F.when(F.col("three") > 1.5 * F.col("seven"), "accelerating").when(F.col("three") < 0.7 * F.col("seven"), "fading").otherwise("steady").alias("momentum"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_by_id(spark, sf_dir):
    """The first row of each id in order of arrival."""
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("f"))
    return x.select("f.o_orderkey", "o_custkey", "f.o_totalprice")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(try_strptime(CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d'), TIMESTAMP '1970-01-01') DESC, o_orderkey) AS place FROM orders")
def date_order(spark, sf_dir):
    """Newest first within each owner; a date that can't be read counts as the epoch."""
    said = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    when = F.coalesce(F.try_to_timestamp(said, F.lit("yyyy-MM-dd")), F.lit("1970-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(when.desc(), "o_orderkey")).alias("place"))


@query("WITH ids AS (SELECT unnest([40, 7, 999999999, 12, 3]) AS id, unnest([0, 1, 2, 3, 4]) AS place) SELECT place, p_partkey, p_name FROM ids JOIN part ON p_partkey = id")
def details_in_order(spark, sf_dir):
    """Rows of a list of ids with their places in it; unknown ids are dropped."""
    ids = spark.createDataFrame([(i, k) for k, i in enumerate((40, 7, 999_999_999, 12, 3))], "p_partkey long, place int")
    return table(spark, sf_dir, "part").join(F.broadcast(ids), "p_partkey").select("place", "p_partkey", "p_name")


@query("SELECT c_custkey, hash_ FROM (SELECT c_custkey, md5(c_custkey || '-7') AS hash_ FROM customer) ORDER BY hash_ LIMIT 40")
def shuffled_sample(spark, sf_dir):
    """Forty rows in an order that a seed fixes."""
    x = table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("-7")).cast("binary")).alias("hash_"))
    return x.orderBy("hash_").limit(40)


@query(f"WITH h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts FROM events GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM h) SELECT symbol, ts FROM x WHERE i % 6 = 0")
def every_sixth_hour(spark, sf_dir):
    """Every sixth bar of each series."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    return hourly_bars(spark, sf_dir).withColumn("i", i).filter("i % 6 = 0").select("symbol", "ts")


@query("SELECT conv_id, turn, sum(CAST(ceil(length(text) / 3.5) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS tokens FROM conversations WHERE text IS NOT NULL")
def token_totals(spark, sf_dir):
    """Running token estimate of each chat."""
    x = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return x.select("conv_id", "turn", F.sum(F.ceil(F.length("text") / 3.5)).over(Window.partitionBy("conv_id").orderBy("turn")).alias("tokens"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier)
SELECT n_name AS feed, place::INT AS place, 'suppliers' AS source, s_name || ' & Co' AS title, '2026-01-05' AS date, 'http://s/' || s_suppkey AS url, left('key ' || s_suppkey || ' of ' || n_name, 200) AS summary
FROM r JOIN nation ON n_nationkey = s_nationkey WHERE place < 10"""
)
def rss_feed(spark, sf_dir):
    """An RSS response a nation, read again: its first ten items, entities resolved and tags gone."""
    item = F.concat(F.lit("<item><title>"), "s_name", F.lit(" &amp;amp; Co</title><link>http://s/"), F.col("s_suppkey").cast("string"), F.lit("</link><pubDate>2026-01-05</pubDate><description>&lt;i&gt;key&lt;/i&gt; "), F.col("s_suppkey").cast("string"), F.lit(" of "), "n_name", F.lit("</description></item>"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).withColumn("item", item)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "item"))), lambda x: x["item"]), "")
    responses = rows.groupBy(F.col("n_name").alias("feed")).agg(F.concat(F.lit("<rss><channel><title>t</title>"), listed, F.lit("</channel></rss>")).alias("body"))
    return rss_items(responses, "suppliers")
