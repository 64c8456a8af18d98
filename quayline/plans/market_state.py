"""Market-state queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import bars as bar_ops
from quayline.operators import market_state as ops
from quayline.operators import recurrences
from quayline.plans.indicators import _IDX, S, _recursive, _swing_sql, full, last
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, daily_bars

_STATE = f"""{_IDX}, {_recursive('e12', 'z', 'close', 12, '2.0/13')}, {_recursive('e26', 'z', 'close', 26, '2.0/27')}, {_recursive('e20', 'z', 'close', 20, '2.0/21')},
md AS (SELECT e26.symbol, e26.i, e12.v - e26.v AS macd FROM e26 JOIN e12 USING (symbol, i)), {_recursive('sg', 'md', 'macd', 9, '2.0/10', 25)},
dl AS (SELECT symbol, i, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down FROM z WHERE pc IS NOT NULL), {_recursive('g', 'dl', 'up', 14, '1.0/14', 1)}, {_recursive('lo', 'dl', 'down', 14, '1.0/14', 1)},
t AS (SELECT symbol, i, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM z), {_recursive('a14', 't', 'tr', 14, '1.0/14')}, {_recursive('a10', 't', 'tr', 10, '1.0/10')},
dm AS (SELECT symbol, i, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM z WHERE pc IS NOT NULL),
{_recursive('pp', 'dm', 'pdm', 14, '1.0/14', 1)}, {_recursive('mm', 'dm', 'mdm', 14, '1.0/14', 1)}, {_recursive('tt', 'dm', 'tr', 14, '1.0/14', 1)},
di AS (SELECT symbol, i, 100 * pp.v / tt.v AS pdi, 100 * mm.v / tt.v AS mdi FROM pp JOIN mm USING (symbol, i) JOIN tt USING (symbol, i) WHERE tt.v <> 0),
dx AS (SELECT *, CASE WHEN pdi + mdi = 0 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM di), {_recursive('ax', 'dx', 'dx', 14, '1.0/14', 14)},
f AS (SELECT z.symbol, z.i, z.ts, z.close, ax.v AS adx, dx.pdi, dx.mdi, CASE WHEN lo.v = 0 THEN 100 ELSE 100 - 100 / (1 + g.v / lo.v) END AS rsi, md.macd, md.macd - sg.v AS hist, a14.v AS atr, e20.v AS ema20, a10.v AS atr10,
  {full(f'regr_slope(z.close, z.i) OVER {last(20)} / avg(z.close) OVER {last(20)} * 100', 'z.close', 20)} AS slope, {full(f'avg(z.close) OVER {last(20)}', 'z.close', 20)} AS mid, {full(f'stddev_pop(z.close) OVER {last(20)}', 'z.close', 20)} AS sd,
  {full(f'max(high) OVER {last(20)}', 'z.close', 20)} AS dh, {full(f'min(low) OVER {last(20)}', 'z.close', 20)} AS dlow,
  sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER ({S}) AS obv
  FROM z LEFT JOIN ax USING (symbol, i) LEFT JOIN dx USING (symbol, i) LEFT JOIN g USING (symbol, i) LEFT JOIN lo USING (symbol, i) LEFT JOIN md USING (symbol, i) LEFT JOIN sg USING (symbol, i)
  LEFT JOIN a14 USING (symbol, i) LEFT JOIN a10 USING (symbol, i) LEFT JOIN e20 USING (symbol, i)),
s AS (SELECT *, lag(hist) OVER o AS hist0, lag(obv, 20) OVER o AS obv0, coalesce(mid + 2 * sd < ema20 + 1.5 * atr10 AND mid - 2 * sd > ema20 - 1.5 * atr10, false) AS sq,
  CASE WHEN adx >= 20 AND pdi IS NOT NULL THEN CASE WHEN pdi > mdi THEN 'up' ELSE 'down' END WHEN abs(slope) > 0.1 THEN CASE WHEN slope > 0 THEN 'up' ELSE 'down' END ELSE 'sideways' END AS direction,
  CASE WHEN adx >= 20 AND pdi IS NOT NULL THEN 'adx' WHEN abs(slope) > 0.1 THEN 'slope' ELSE 'none' END AS direction_source,
  CASE WHEN dh <> dlow THEN (close - dlow) / (dh - dlow) END AS pos, CASE WHEN atr > 0 THEN abs(close - ema20) / atr END AS far, CASE WHEN macd < 0 THEN 'short' ELSE 'long' END AS bias FROM f WINDOW o AS ({S})),
st AS (SELECT *, CASE WHEN sq AND NOT coalesce(adx >= 30, false) THEN 'compressed' WHEN adx >= 25 THEN 'trending' WHEN atr / close * 100 > 4 THEN 'volatile-expansion' ELSE 'ranging' END AS regime,
  coalesce(adx >= 22, false) AS tr, (bias = 'long' AND direction = 'up') OR (bias = 'short' AND direction = 'down') AS al FROM s)"""


@query(
    f"""{_STATE} SELECT symbol, ts, direction, direction_source, regime, CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi >= 55 THEN 'bullish' WHEN rsi > 45 THEN 'neutral' WHEN rsi > 30 THEN 'bearish' ELSE 'oversold' END AS rsi_state,
  CASE WHEN hist > 0 AND NOT hist0 > 0 THEN 'bullish' WHEN NOT hist > 0 AND hist0 > 0 THEN 'bearish' ELSE 'none' END AS macd_cross,
  CASE WHEN obv > obv0 THEN 'accumulation' WHEN obv < obv0 THEN 'distribution' ELSE 'flat' END AS obv_trend,
  CASE WHEN regime = 'compressed' THEN 'breakout' WHEN tr AND al THEN CASE WHEN far > 2 THEN 'none' ELSE 'trend-pullback' END
    WHEN (regime = 'ranging' OR NOT tr) AND coalesce((bias = 'long' AND pos < 0.3) OR (bias = 'short' AND pos > 0.7), false) THEN 'range-reversion' ELSE 'none' END AS strategy,
  CASE WHEN regime = 'compressed' THEN 'wait-breakout' WHEN tr AND al THEN CASE WHEN far > 2 THEN 'stand-aside' WHEN (bias = 'long' AND rsi > 72) OR (bias = 'short' AND rsi < 28) THEN 'wait-pullback' WHEN far <= 1 THEN 'enter-now' ELSE 'wait-pullback' END
    WHEN (regime = 'ranging' OR NOT tr) AND coalesce((bias = 'long' AND pos < 0.3) OR (bias = 'short' AND pos > 0.7), false) THEN 'enter-now' ELSE 'stand-aside' END AS timing
FROM st WHERE i >= 60"""
)
def market_state(spark, sf_dir):
    """Direction, regime, momentum and strategy of every bar from the sixtieth on."""
    x = ops.market_states(recurrences.indicators(daily_bars(spark, sf_dir))).filter("bar_idx >= 60")
    return x.select("symbol", "ts", "direction", "direction_source", "regime", "rsi_state", "macd_cross", "obv_trend", "strategy", "timing")


@query(f"{_STATE} SELECT symbol, regime, strategy, count(*) AS bars FROM (SELECT symbol, regime, CASE WHEN regime = 'compressed' THEN 'breakout' WHEN tr AND al THEN CASE WHEN far > 2 THEN 'none' ELSE 'trend-pullback' END WHEN (regime = 'ranging' OR NOT tr) AND coalesce((bias = 'long' AND pos < 0.3) OR (bias = 'short' AND pos > 0.7), false) THEN 'range-reversion' ELSE 'none' END AS strategy FROM st WHERE i >= 60) GROUP BY ALL")
def state_counts(spark, sf_dir):
    """How often each regime leads to each strategy."""
    x = ops.market_states(recurrences.indicators(daily_bars(spark, sf_dir))).filter("bar_idx >= 60")
    return x.groupBy("symbol", "regime", "strategy").agg(F.count(F.lit(1)).alias("bars"))


_NEWEST = lambda kind: f"SELECT symbol, since, price, before FROM ev WHERE kind = '{kind}'"


@query(
    f"""WITH {SQL_DAILY}, sw AS ({_swing_sql()}), ev AS (SELECT s.symbol, b.bar_idx + 3 AS since, kind, price, lag(price) OVER (PARTITION BY s.symbol, kind ORDER BY b.bar_idx) AS before FROM sw s JOIN bars b USING (symbol, ts)),
h AS ({_NEWEST('high')}), l AS ({_NEWEST('low')}),
x AS (SELECT b.symbol, b.ts, h.price AS h1, h.before AS h0, l.price AS l1, l.before AS l0 FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.bar_idx >= h.since ASOF LEFT JOIN l ON b.symbol = l.symbol AND b.bar_idx >= l.since)
SELECT symbol, ts, CASE WHEN h0 IS NULL OR l0 IS NULL THEN 'unclear' ELSE CASE WHEN h1 > h0 THEN 'HH' ELSE 'LH' END || '-' || CASE WHEN l1 > l0 THEN 'HL' ELSE 'LL' END END AS structure FROM x"""
)
def swing_structure(spark, sf_dir):
    """Class of the last two confirmed swing highs and lows at every bar."""
    return ops.with_structure(daily_bars(spark, sf_dir)).select("symbol", "ts", "structure")


@query()
def timeframe_alignment(spark, sf_dir):
    """Whether daily, four-day and weekly bars point the same way."""
    d = daily_bars(spark, sf_dir)
    weekly = bar_ops.fold(d.withColumn("week", F.date_trunc("week", "ts")), ["symbol", "week"]).drop("week")
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    reads = None
    for name, frame in (("1d", d), ("4d", bar_ops.resample(d, 4)), ("1w", weekly)):
        one = ops.market_states(recurrences.indicators(frame)).withColumn("_n", newest).filter("_n = 1").select("symbol", F.lit(name).alias("frame"), "direction")
        reads = one if reads is None else reads.unionByName(one)
    return ops.alignment(reads)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(units * 10000.0 + 0.5) / 10000.0 AS units, floor(units * entry * 100.0 + 0.5) / 100.0 AS notional FROM (SELECT *, l_extendedprice / l_quantity AS entry, CASE WHEN l_tax > 0 THEN 100.0 / (l_extendedprice / l_quantity - l_extendedprice / l_quantity * (1 - l_tax)) ELSE 0 END AS units FROM lineitem WHERE l_tax > 0 AND l_quantity = 50)")
def position_sizes(spark, sf_dir):
    """Units whose loss at a stop of l_tax below entry is one percent of 10,000."""
    from quayline.storage import table

    x = table(spark, sf_dir, "lineitem").filter("l_tax > 0 AND l_quantity = 50").withColumn("entry", F.col("l_extendedprice") / F.col("l_quantity"))
    size = ops.position_size(F.col("entry"), F.col("entry") * (1 - F.col("l_tax")), 10_000, 1)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(size["units"]).alias("units"), rounded(size["notional"], 2).alias("notional"))
