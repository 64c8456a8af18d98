"""Indicator queries over daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import recurrences
from quayline.operators import windows as w
from quayline.operators.bars import with_index
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, SQL_HOURLY, daily_bars, hourly_bars

WITH = f"WITH {SQL_DAILY}"
S = "PARTITION BY symbol ORDER BY ts"


def r(x: str, d: int = 4) -> str:
    return f"floor(({x}) * {10.0**d} + 0.5) / {10.0**d}"


def last(n: int) -> str:
    return f"({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, over: str, n: int) -> str:
    return f"CASE WHEN count({over}) OVER {last(n)} = {n} THEN {x} END"


@query(
    f"""{WITH}, x AS (SELECT *, {full(f'avg(close) OVER {last(20)}', 'close', 20)} AS mid, {full(f'stddev_pop(close) OVER {last(20)}', 'close', 20)} AS sd,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars)
SELECT symbol, ts, close, {r('mid')} AS sma20, {r('mid + 2 * sd')} AS upper, {r('mid - 2 * sd')} AS lower, {r('4 * sd / mid * 100')} AS bandwidth,
  {r('CASE WHEN sd = 0 THEN 0.5 ELSE (close - mid + 2 * sd) / (4 * sd) END')} AS percent_b FROM x WHERE k = 1"""
)
def sma_bollinger(spark, sf_dir):
    """SMA(20) and Bollinger bands on the latest bar of every symbol."""
    return _bollinger(daily_bars(spark, sf_dir)).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter("k = 1").drop("k")


def _bollinger(bars):
    mid, sd = F.col("mid"), F.col("sd")
    x = bars.withColumn("mid", w.sma("close", 20)).withColumn("sd", w.full(F.stddev_pop("close").over(w.back(20)), "close", 20))
    return x.select(
        "symbol",
        "ts",
        "close",
        rounded(mid).alias("sma20"),
        rounded(mid + 2 * sd).alias("upper"),
        rounded(mid - 2 * sd).alias("lower"),
        rounded(4 * sd / mid * 100).alias("bandwidth"),
        rounded(F.when(sd == 0, 0.5).otherwise((F.col("close") - mid + 2 * sd) / (4 * sd))).alias("percent_b"),
    )


@query(
    f"""{WITH}, x AS (SELECT *, {full(f'avg(close) OVER {last(20)}', 'close', 20)} AS mid, {full(f'stddev_pop(close) OVER {last(20)}', 'close', 20)} AS sd FROM bars)
SELECT symbol, ts, close, {r('mid')} AS sma20, {r('mid + 2 * sd')} AS upper, {r('mid - 2 * sd')} AS lower, {r('4 * sd / mid * 100')} AS bandwidth,
  {r('CASE WHEN sd = 0 THEN 0.5 ELSE (close - mid + 2 * sd) / (4 * sd) END')} AS percent_b FROM x"""
)
def bollinger_series(spark, sf_dir):
    """Bollinger bands on every bar."""
    return _bollinger(daily_bars(spark, sf_dir))


@query(f"{WITH} SELECT symbol, ts, {full(f'max(high) OVER {last(20)}', 'close', 20)} AS upper, {full(f'min(low) OVER {last(20)}', 'close', 20)} AS lower, {r(full(f'(max(high) OVER {last(20)} + min(low) OVER {last(20)}) / 2', 'close', 20))} AS middle FROM bars")
def donchian(spark, sf_dir):
    """Donchian(20) channel."""
    high, low = F.max("high").over(w.back(20)), F.min("low").over(w.back(20))
    return daily_bars(spark, sf_dir).select("symbol", "ts", w.full(high, "close", 20).alias("upper"), w.full(low, "close", 20).alias("lower"), rounded(w.full((high + low) / 2, "close", 20)).alias("middle"))


@query(
    f"""{WITH}, a AS (SELECT *, max(high) OVER {last(14)} AS h, min(low) OVER {last(14)} AS l FROM bars),
b AS (SELECT *, {full('CASE WHEN h = l THEN 50.0 ELSE (close - l) / (h - l) * 100 END', 'close', 14)} AS raw FROM a),
c AS (SELECT *, {full(f'avg(raw) OVER {last(3)}', 'raw', 3)} AS k FROM b)
SELECT symbol, ts, {r('k')} AS k, {r(full(f'avg(k) OVER {last(3)}', 'k', 3))} AS d FROM c"""
)
def stochastic_kd(spark, sf_dir):
    """Slow stochastic: %K(14, 3) and %D(3); a flat range counts as 50."""
    x = daily_bars(spark, sf_dir).withColumn("raw", w.stochastic_raw(14)).withColumn("k", w.sma("raw", 3)).withColumn("d", w.sma("k", 3))
    return x.select("symbol", "ts", rounded("k").alias("k"), rounded("d").alias("d"))


@query(f"{WITH}, p AS (SELECT *, lag(close) OVER ({S}) AS pc FROM bars) SELECT symbol, ts, {r('CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END')} AS true_range FROM p")
def true_range(spark, sf_dir):
    """True range; the first bar's is its own range."""
    return daily_bars(spark, sf_dir).select("symbol", "ts", rounded(w.true_range()).alias("true_range"))


@query(f"{WITH}, p AS (SELECT *, lag(close, 10) OVER ({S}) AS pc FROM bars) SELECT symbol, ts, {r('CASE WHEN pc <> 0 THEN (close - pc) / pc * 100 END')} AS roc10 FROM p")
def roc(spark, sf_dir):
    """Rate of change over ten bars."""
    return daily_bars(spark, sf_dir).select("symbol", "ts", rounded(w.roc("close", 10)).alias("roc10"))


@query(f"{WITH}, p AS (SELECT *, lag(close) OVER ({S}) AS pc FROM bars) SELECT symbol, ts, sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER ({S}) AS obv FROM p")
def obv(spark, sf_dir):
    """On-balance volume from 0."""
    x = daily_bars(spark, sf_dir).withColumn("signed", w.signed_volume())
    return x.select("symbol", "ts", F.sum("signed").over(w.series()).alias("obv"))


@query(
    f"{WITH}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars) SELECT symbol, ts, {r(f'sum(tp * volume) OVER {last(20)} / nullif(sum(volume) OVER {last(20)}, 0)')} AS vwap20, "
    f"{r(f'sum(tp * volume) OVER ({S} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER ({S} ROWS UNBOUNDED PRECEDING), 0)')} AS vwap FROM t"
)
def vwap(spark, sf_dir):
    """VWAP, rolling over 20 bars without warm-up and cumulative."""
    return daily_bars(spark, sf_dir).select("symbol", "ts", rounded(w.vwap(20)).alias("vwap20"), rounded(w.vwap()).alias("vwap"))


@query(
    f"""{WITH}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), d AS (SELECT *, lag(tp) OVER ({S}) AS pt FROM t),
x AS (SELECT symbol, ts, pt, sum(CASE WHEN tp > pt THEN tp * volume ELSE 0 END) OVER {last(14)} AS up, sum(CASE WHEN tp < pt THEN tp * volume ELSE 0 END) OVER {last(14)} AS down, count(pt) OVER {last(14)} AS n FROM d)
SELECT symbol, ts, {r('CASE WHEN n = 14 THEN CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END')} AS mfi14 FROM x"""
)
def mfi(spark, sf_dir):
    """Money flow index(14); no negative flow counts as 100."""
    t = daily_bars(spark, sf_dir).withColumn("tp", w.typical()).withColumn("pt", F.lag("tp").over(w.series())).withColumn("flow", F.col("tp") * F.col("volume"))
    up = F.sum(F.when(F.col("tp") > F.col("pt"), F.col("flow")).otherwise(0.0)).over(w.back(14))
    down = F.sum(F.when(F.col("tp") < F.col("pt"), F.col("flow")).otherwise(0.0)).over(w.back(14))
    return t.select("symbol", "ts", rounded(w.full(F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down)), "pt", 14)).alias("mfi14"))


@query(f"{WITH}, x AS (SELECT *, avg(volume) OVER ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m, count(*) OVER ({S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM bars) SELECT symbol, ts, {r('CASE WHEN n = 20 AND m <> 0 THEN volume / m END')} AS relative_volume FROM x")
def relative_volume(spark, sf_dir):
    """Volume against the mean of the twenty bars before."""
    before = w.series().rowsBetween(-20, -1)
    mean = F.avg("volume").over(before)
    return daily_bars(spark, sf_dir).select("symbol", "ts", rounded(F.when((F.count("volume").over(before) == 20) & (mean != 0), F.col("volume") / mean)).alias("relative_volume"))


@query(
    f"{WITH}, p AS (SELECT *, lag(close) OVER ({S}) AS pc FROM bars), l AS (SELECT *, CASE WHEN pc > 0 AND close > 0 THEN ln(close / pc) END AS lr FROM p) "
    f"SELECT symbol, ts, {r(f'CASE WHEN count(lr) OVER {last(20)} = 20 THEN stddev_samp(lr) OVER {last(20)} * sqrt(252) * 100 END')} AS realized_vol FROM l"
)
def realized_vol(spark, sf_dir):
    """Annualised volatility of twenty log returns."""
    x = daily_bars(spark, sf_dir).withColumn("log_return", w.log_return())
    return x.select("symbol", "ts", rounded(w.realized_vol(20, 252)).alias("realized_vol"))


@query(f"{WITH}, p AS (SELECT *, max(close) OVER ({S}) AS peak FROM bars) SELECT symbol, {r('max((peak - close) / peak * 100)')} AS max_drawdown FROM p GROUP BY symbol")
def max_drawdown(spark, sf_dir):
    """Largest fall from a running peak, in percent."""
    peak = F.max("close").over(w.series())
    return daily_bars(spark, sf_dir).withColumn("peak", peak).groupBy("symbol").agg(rounded(F.max((F.col("peak") - F.col("close")) / F.col("peak") * 100)).alias("max_drawdown"))


@query(f"{WITH} SELECT symbol, ts, {r(full(f'regr_slope(close, bar_idx) OVER {last(20)} / avg(close) OVER {last(20)} * 100', 'close', 20))} AS slope_pct FROM bars")
def regression_slope(spark, sf_dir):
    """Least-squares slope of twenty closes in percent of their mean per bar."""
    return with_index(daily_bars(spark, sf_dir)).select("symbol", "ts", rounded(w.slope_pct(20)).alias("slope_pct"))


@query(
    f"""{WITH}, p AS (SELECT symbol, ts, lag(high) OVER ({S}) AS h, lag(low) OVER ({S}) AS l, lag(close) OVER ({S}) AS c FROM bars), q AS (SELECT *, (h + l + c) / 3 AS p FROM p)
SELECT symbol, ts, {r('p')} AS p, {r('2 * p - l')} AS r1, {r('p + (h - l)')} AS r2, {r('h + 2 * (p - l)')} AS r3, {r('2 * p - h')} AS s1, {r('p - (h - l)')} AS s2, {r('l - 2 * (h - p)')} AS s3 FROM q WHERE p IS NOT NULL"""
)
def pivots(spark, sf_dir):
    """Floor pivots from the bar before."""
    h, lo, c = (F.lag(x).over(w.series()) for x in ("high", "low", "close"))
    x = daily_bars(spark, sf_dir).select("symbol", "ts", h.alias("h"), lo.alias("l"), c.alias("c")).withColumn("p", (F.col("h") + F.col("l") + F.col("c")) / 3).filter("p IS NOT NULL")
    h, lo, p = F.col("h"), F.col("l"), F.col("p")
    lines = {"p": p, "r1": 2 * p - lo, "r2": p + (h - lo), "r3": h + 2 * (p - lo), "s1": 2 * p - h, "s2": p - (h - lo), "s3": lo - 2 * (h - p)}
    return x.select("symbol", "ts", *[rounded(v).alias(k) for k, v in lines.items()])


def _swing_sql(k: int = 3) -> str:
    before, after = f"({S} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)", f"({S} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    side = lambda c, best, worst, ge, gt: (
        f"SELECT symbol, ts, {c} AS price, '{c}' AS kind FROM (SELECT *, count(*) OVER {before} AS nb, count(*) OVER {after} AS na, {best}({c}) OVER {before} AS b1, {best}({c}) OVER {after} AS b2, "
        f"{worst}({c}) OVER {before} AS w1, {worst}({c}) OVER {after} AS w2 FROM bars) WHERE nb = {k} AND na = {k} AND {c} {ge} b1 AND {c} {ge} b2 AND {c} {gt} w1 AND {c} {gt} w2"
    )
    return f"{WITH} {side('high', 'max', 'min', '>=', '>')} UNION ALL {side('low', 'min', 'max', '<=', '<')}"


@query(_swing_sql())
def swing_points(spark, sf_dir):
    """Swing highs and lows with three bars on either side; a bar may be both."""
    x = daily_bars(spark, sf_dir).withColumn("sh", w.swing("high", 3, True)).withColumn("sl", w.swing("low", 3, False))
    points = F.array(F.when(F.col("sh"), F.struct(F.col("high").alias("price"), F.lit("high").alias("kind"))), F.when(F.col("sl"), F.struct(F.col("low").alias("price"), F.lit("low").alias("kind"))))
    return x.select("symbol", "ts", F.explode(F.array_compact(points)).alias("p")).select("symbol", "ts", "p.price", "p.kind")


@query(
    f"{WITH}, x AS (SELECT symbol, max(high) AS h, min(low) AS l FROM bars GROUP BY symbol), f AS (SELECT unnest([0.0, 23.6, 38.2, 50.0, 61.8, 78.6, 100.0, 161.8]) AS pct) "
    f"SELECT symbol, pct::DOUBLE AS pct, {r('CASE WHEN pct > 100 THEN l + (h - l) * pct / 100 ELSE h - (h - l) * pct / 100 END')} AS price FROM x, f"
)
def fibonacci(spark, sf_dir):
    """Retracements and one extension of each symbol's whole range."""
    pct = F.array(*[F.lit(x) for x in (0.0, 23.6, 38.2, 50.0, 61.8, 78.6, 100.0, 161.8)])
    x = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.max("high").alias("h"), F.min("low").alias("l")).withColumn("pct", F.explode(pct))
    wide = F.col("h") - F.col("l")
    return x.select("symbol", "pct", rounded(F.when(F.col("pct") > 100, F.col("l") + wide * F.col("pct") / 100).otherwise(F.col("h") - wide * F.col("pct") / 100)).alias("price"))


@query(f"{WITH}, x AS (SELECT *, sum(CASE WHEN close > pc THEN 1 ELSE 0 END) OVER {last(14)} AS up, count(pc) OVER {last(14)} AS n FROM (SELECT *, lag(close) OVER ({S}) AS pc FROM bars)) SELECT symbol, ts, {r('CASE WHEN n = 14 THEN up / 14.0 * 100 END')} AS up_share FROM x")
def up_day_share(spark, sf_dir):
    """Share of rising days among fourteen."""
    x = daily_bars(spark, sf_dir).withColumn("pc", F.lag("close").over(w.series()))
    up = F.sum((F.col("close") > F.col("pc")).cast("int")).over(w.back(14))
    return x.select("symbol", "ts", rounded(w.full(up / 14.0 * 100, "pc", 14)).alias("up_share"))


@query(f"{WITH} SELECT symbol, ts, {r(full(f'avg(volume) OVER {last(7)} / avg(volume) OVER {last(30)}', 'volume', 30))} AS ratio_7_30, {r(full(f'avg(volume) OVER {last(7)} / avg(volume) OVER ({S} ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING)', 'volume', 14))} AS ratio_7_prior FROM bars")
def volume_ratios(spark, sf_dir):
    """Seven-day volume against thirty days and against the week before."""
    week = F.avg("volume").over(w.back(7))
    prior = F.avg("volume").over(w.series().rowsBetween(-13, -7))
    return daily_bars(spark, sf_dir).select("symbol", "ts", rounded(w.full(week / F.avg("volume").over(w.back(30)), "volume", 30)).alias("ratio_7_30"), rounded(w.full(week / prior, "volume", 14)).alias("ratio_7_prior"))


@query(
    f"""{WITH}, x AS (SELECT *, lag(close) OVER ({S}) AS pc, lead(close, 5) OVER ({S}) AS f5, max(high) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS fh,
  min(low) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS fl FROM bars), y AS (SELECT *, close / pc - 1 AS ret FROM x)
SELECT symbol, ts, {r('(f5 - close) / close * 100')} AS forward_return, {r('CASE WHEN f5 IS NOT NULL THEN (fh - fl) / close * 100 END')} AS forward_range,
  {r(f'CASE WHEN f5 IS NOT NULL THEN stddev_samp(ret) OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) * 100 END')} AS forward_vol FROM y"""
)
def forward_moves(spark, sf_dir):
    """Return, range and deviation of returns over the five bars ahead."""
    ahead = w.series().rowsBetween(1, 5)
    x = daily_bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(w.series()) - 1).withColumn("f5", F.lead("close", 5).over(w.series()))
    there = F.col("f5").isNotNull()
    return x.select(
        "symbol",
        "ts",
        rounded((F.col("f5") - F.col("close")) / F.col("close") * 100).alias("forward_return"),
        rounded(F.when(there, (F.max("high").over(ahead) - F.min("low").over(ahead)) / F.col("close") * 100)).alias("forward_range"),
        rounded(F.when(there, F.stddev_samp("ret").over(ahead) * 100)).alias("forward_vol"),
    )


@query(
    f"{WITH}, x AS (SELECT *, avg(close) OVER p AS m, stddev_samp(close) OVER p AS sd, count(*) OVER p AS n FROM bars WINDOW p AS ({S} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)) "
    f"SELECT symbol, ts, {r('(close - m) / sd')} AS z FROM x WHERE n = 90 AND sd > 0 AND abs((close - m) / sd) >= 1.5"
)
def zscore_events(spark, sf_dir):
    """Closes at least 1.5 deviations from the ninety before."""
    before = w.series().rowsBetween(-90, -1)
    x = daily_bars(spark, sf_dir).withColumn("m", F.avg("close").over(before)).withColumn("sd", F.stddev_samp("close").over(before)).withColumn("n", F.count("close").over(before))
    z = (F.col("close") - F.col("m")) / F.col("sd")
    return x.filter((F.col("n") == 90) & (F.col("sd") > 0) & (F.abs(z) >= 1.5)).select("symbol", "ts", rounded(z).alias("z"))


@query(
    f"{WITH}, x AS (SELECT symbol, ts, close, list(close) OVER {last(252)} AS l FROM bars) SELECT symbol, ts, "
    f"{r('CASE WHEN len(l) >= 100 THEN len(list_filter(l, lambda v: v < close)) / len(l) * 100 END', 2)} AS rank_pct FROM x"
)
def trailing_rank(spark, sf_dir):
    """Share of the trailing 252 values below the current one; a hundred are needed."""
    x = daily_bars(spark, sf_dir).withColumn("l", F.collect_list("close").over(w.back(252)))
    below = F.size(F.filter("l", lambda v: v < F.col("close")))
    return x.select("symbol", "ts", rounded(F.when(F.size("l") >= 100, below / F.size("l") * 100), 2).alias("rank_pct"))


@query(f"WITH {SQL_HOURLY}, x AS (SELECT *, lag(close) OVER ({S}) AS pc FROM hourly) SELECT symbol, ts, {r('CASE WHEN pc > 0 THEN (close - pc) / pc * 100 END')} AS change_pct FROM x")
def percent_changes(spark, sf_dir):
    """Hourly change in percent where the base is positive."""
    before = F.lag("close").over(w.series())
    return hourly_bars(spark, sf_dir).select("symbol", "ts", rounded(F.when(before > 0, (F.col("close") - before) / before * 100)).alias("change_pct"))


# recurrences: the oracle walks the series with a recursive query

_SEED = "(SELECT avg({x}) FROM b2 b WHERE b.symbol = b1.symbol AND b.i BETWEEN {lo} AND {hi})"


def _recursive(name: str, source: str, x: str, n: int, alpha: str, first: int = 0) -> str:
    """CTE ``name``: symbol, i, v; seeded by the mean of n values from ``first`` on, then v + alpha (x - v)."""
    at = first + n - 1
    return f"""{name} AS (
  SELECT symbol, {at}::BIGINT AS i, avg({x})::DOUBLE AS v FROM {source} WHERE i BETWEEN {first} AND {at} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT s.symbol, s.i, p.v + ({alpha}) * (s.{x} - p.v) FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.i = p.i + 1)"""


_IDX = f"WITH RECURSIVE {SQL_DAILY}, z AS (SELECT symbol, ts, bar_idx AS i, open, high, low, close, volume, lag(close) OVER ({S}) AS pc, lag(high) OVER ({S}) AS ph, lag(low) OVER ({S}) AS pl FROM bars)"

SQL_ATR = f"""{_IDX}, t AS (SELECT symbol, i, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM z),
{_recursive('a14', 't', 'tr', 14, '1.0/14')},
atr AS (SELECT z.symbol, z.ts, z.i AS bar_idx, z.high, z.low, z.close, a14.v / z.close * 100 AS atr_pct FROM z LEFT JOIN a14 USING (symbol, i))"""


@query(
    f"""{_IDX}, {_recursive('e12', 'z', 'close', 12, '2.0/13')}, {_recursive('e26', 'z', 'close', 26, '2.0/27')},
m AS (SELECT e26.symbol, e26.i, e12.v - e26.v AS macd FROM e26 JOIN e12 USING (symbol, i)), {_recursive('sg', 'm', 'macd', 9, '2.0/10', 25)}
SELECT z.symbol, z.ts, {r('e12.v')} AS ema12, {r('e26.v')} AS ema26, {r('m.macd')} AS macd, {r('sg.v')} AS signal, {r('m.macd - sg.v')} AS histogram
FROM z LEFT JOIN e12 USING (symbol, i) LEFT JOIN e26 USING (symbol, i) LEFT JOIN m USING (symbol, i) LEFT JOIN sg USING (symbol, i)"""
)
def ema_macd(spark, sf_dir):
    """EMA(12), EMA(26) and MACD with its signal, seeded by simple means."""
    x = recurrences.indicators(daily_bars(spark, sf_dir))
    return x.select("symbol", "ts", *[rounded(c).alias(c) for c in ("ema12", "ema26", "macd", "signal", "histogram")])


@query(
    f"""{_IDX}, d AS (SELECT symbol, i, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down FROM z WHERE pc IS NOT NULL),
{_recursive('g', 'd', 'up', 14, '1.0/14', 1)}, {_recursive('l', 'd', 'down', 14, '1.0/14', 1)}
SELECT z.symbol, z.ts, {r('CASE WHEN l.v = 0 THEN 100 ELSE 100 - 100 / (1 + g.v / l.v) END')} AS rsi14 FROM z LEFT JOIN g USING (symbol, i) LEFT JOIN l USING (symbol, i)"""
)
def rsi_wilder(spark, sf_dir):
    """RSI(14) by Wilder's smoothing; no losses count as 100."""
    return recurrences.indicators(daily_bars(spark, sf_dir)).select("symbol", "ts", rounded("rsi14").alias("rsi14"))


@query(
    f"""{_IDX}, t AS (SELECT symbol, i, close, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM z),
{_recursive('a14', 't', 'tr', 14, '1.0/14')}, {_recursive('a10', 't', 'tr', 10, '1.0/10')}, {_recursive('e20', 'z', 'close', 20, '2.0/21')},
bb AS (SELECT symbol, i, ts, close, CASE WHEN i >= 19 THEN avg(close) OVER {last(20)} END AS mid, CASE WHEN i >= 19 THEN stddev_pop(close) OVER {last(20)} END AS sd FROM z)
SELECT bb.symbol, bb.ts, {r('a14.v')} AS atr14, {r('a14.v / close * 100')} AS atr_pct, {r('e20.v + 1.5 * a10.v')} AS keltner_upper, {r('e20.v - 1.5 * a10.v')} AS keltner_lower,
  coalesce(mid + 2 * sd < e20.v + 1.5 * a10.v AND mid - 2 * sd > e20.v - 1.5 * a10.v, false) AS squeeze
FROM bb LEFT JOIN a14 USING (symbol, i) LEFT JOIN a10 USING (symbol, i) LEFT JOIN e20 USING (symbol, i)"""
)
def atr_keltner_squeeze(spark, sf_dir):
    """ATR(14), Keltner(20, 1.5, ATR10) and the squeeze of the Bollinger bands inside it."""
    x = recurrences.indicators(daily_bars(spark, sf_dir))
    mid, sd = w.sma("close", 20), w.full(F.stddev_pop("close").over(w.back(20)), "close", 20)
    inside = (mid + 2 * sd < F.col("keltner_upper")) & (mid - 2 * sd > F.col("keltner_lower"))
    return x.select("symbol", "ts", *[rounded(c).alias(c) for c in ("atr14", "atr_pct", "keltner_upper", "keltner_lower")], F.coalesce(inside, F.lit(False)).alias("squeeze"))


@query(
    f"""{_IDX}, d AS (SELECT symbol, i, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM z WHERE pc IS NOT NULL),
{_recursive('p', 'd', 'pdm', 14, '1.0/14', 1)}, {_recursive('m', 'd', 'mdm', 14, '1.0/14', 1)}, {_recursive('t', 'd', 'tr', 14, '1.0/14', 1)},
x AS (SELECT symbol, i, 100 * p.v / t.v AS pdi, 100 * m.v / t.v AS mdi FROM p JOIN m USING (symbol, i) JOIN t USING (symbol, i) WHERE t.v <> 0),
y AS (SELECT *, CASE WHEN pdi + mdi = 0 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM x), {_recursive('a', 'y', 'dx', 14, '1.0/14', 14)}
SELECT z.symbol, z.ts, {r('a.v')} AS adx14, {r('y.pdi')} AS plus_di, {r('y.mdi')} AS minus_di FROM z LEFT JOIN y USING (symbol, i) LEFT JOIN a USING (symbol, i)"""
)
def adx_di(spark, sf_dir):
    """ADX(14) with its directional indicators."""
    return recurrences.indicators(daily_bars(spark, sf_dir)).select("symbol", "ts", *[rounded(c).alias(c) for c in ("adx14", "plus_di", "minus_di")])
