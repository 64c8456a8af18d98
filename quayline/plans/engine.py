"""Queries of the market read, trade setups and their simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import bars as bar_ops
from quayline.operators import recurrences, setups, slices
from quayline.operators import windows as w
from quayline.operators.bootstrap import bootstrap_mean
from quayline.plans.market_state import _STATE
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, daily_bars
from quayline.storage import materialise

_TAIL = SQL_DAILY.replace("FROM daily)", "FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 260))")


def _r(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"


@query(
    f"""{_STATE.replace(SQL_DAILY, _TAIL)} SELECT symbol, ts, direction, direction_source, regime, CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi >= 55 THEN 'bullish' WHEN rsi > 45 THEN 'neutral' WHEN rsi > 30 THEN 'bearish' ELSE 'oversold' END AS rsi_state,
  {_r('adx', 1)} AS adx, {_r('rsi', 1)} AS rsi, {_r('ema20')} AS ema20, {_r('atr')} AS atr, {_r('hist')} AS histogram, {_r('slope')} AS slope, {_r('pos', 3)} AS range_position,
  CASE WHEN obv > obv0 THEN 'accumulation' WHEN obv < obv0 THEN 'distribution' ELSE 'flat' END AS obv_trend
FROM st QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1"""
)
def market_read(spark, sf_dir):
    """The read of each symbol's newest bar on its last 260 bars."""
    x = slices.slice_reads(bar_ops.tail(daily_bars(spark, sf_dir), 260))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    x = setups.with_read_states(x.withColumn("_n", newest).filter("_n = 1"))
    numbers = {"adx": 1, "rsi": 1, "ema20": 4, "atr": 4, "histogram": 4, "slope": 4}
    return x.select("symbol", "ts", "direction", "direction_source", "regime", "rsi_state", *[rounded(c, d).alias(c) for c, d in numbers.items()], "range_position", "obv_trend")


@query()
def slice_reads(spark, sf_dir):
    """Every bar's read on its own 260-bar slice, with what it says."""
    x = setups.with_read_states(slices.slice_reads(daily_bars(spark, sf_dir)))
    return x.select("symbol", "ts", "direction", "regime", "structure", "rsi_state", "stoch_state", "macd_cross", "obv_trend", "vwap_distance", "signals", "support", "resistance")


_LAST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_BOUND = f"""WITH {SQL_DAILY}, z AS (SELECT *, bar_idx AS i, lag(close) OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl, row_number() OVER s AS k FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
t AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, (ph + pl + pc) / 3 AS p FROM z),
b AS (SELECT symbol, ts, i, {_r('close')} AS price, {_r(f'avg(tr) {_LAST.format(n=13)}')} AS atr, {_r(f'avg(close) {_LAST.format(n=19)}')} AS ema20, {_r(f'max(high) {_LAST.format(n=19)}')} AS dh, {_r(f'min(low) {_LAST.format(n=19)}')} AS dl,
  min(low) {_LAST.format(n=9)} AS sl, max(high) {_LAST.format(n=9)} AS sh, [2 * p - ph, p - (ph - pl)] AS sup, [2 * p - pl, p + (ph - pl)] AS res,
  ['breakout', 'trend-pullback', 'range-reversion', 'reversal'][i % 4 + 1] AS strategy, CASE WHEN i % 8 < 4 THEN 'long' ELSE 'short' END AS side, close > pc AS rose, volume / avg(volume) {_LAST.format(n=19)} AS rv FROM t),
c AS (SELECT *, CASE WHEN atr > 0 THEN atr ELSE price * 0.02 END AS a, CASE WHEN side = 'long' THEN 1.0 ELSE -1.0 END::DOUBLE AS sg, CASE WHEN side = 'long' THEN sup[1] ELSE res[1] END AS near, CASE WHEN side = 'long' THEN dh ELSE dl END AS outer_, CASE WHEN side = 'long' THEN dl ELSE dh END AS inner_,
  CASE WHEN side = 'long' THEN res ELSE sup END AS ahead FROM b WHERE i >= 30),
d AS (SELECT *, CASE strategy WHEN 'breakout' THEN outer_ + sg * 0.15 * a WHEN 'trend-pullback' THEN CASE WHEN side = 'long' THEN greatest(ema20, near) ELSE least(ema20, near) END WHEN 'range-reversion' THEN near ELSE price END AS ideal FROM c),
e AS (SELECT *, list_filter([near, CASE WHEN side = 'long' THEN sl ELSE sh END, CASE WHEN strategy = 'breakout' THEN inner_ END], lambda v: v IS NOT NULL AND (ideal - v) * sg > 0) AS held, CASE WHEN strategy = 'range-reversion' THEN 0.4 ELSE 0.5 END * a AS reach FROM d),
f AS (SELECT *, CASE WHEN side = 'long' THEN list_max(held) ELSE list_min(held) END AS base FROM e),
g AS (SELECT *, coalesce(base, ideal) - sg * (CASE WHEN base IS NOT NULL THEN 1.0 ELSE 2.0 END * a) AS stop0, least(3.5 * a, 12 / 100.0 * ideal) AS most FROM f),
h AS (SELECT *, abs(ideal - stop0) > most AND most > 0 AS capped, CASE WHEN abs(ideal - stop0) > most AND most > 0 THEN most ELSE abs(ideal - stop0) END AS risk FROM g),
j AS (SELECT *, CASE WHEN capped THEN ideal - sg * risk ELSE stop0 END AS stop1, list_filter(ahead, lambda v: (v - (ideal + sg * 0.8 * risk)) * sg > 0)[1] AS l1 FROM h),
k AS (SELECT *, coalesce(l1, {_r('ideal + sg * 1.5 * risk')}) AS t1 FROM j),
l AS (SELECT *, list_filter(ahead, lambda v: (v - t1 * (1 + sg * 0.001)) * sg > 0)[1] AS l2 FROM k),
m AS (SELECT *, coalesce(l2, {_r('ideal + sg * 2.0 * risk')}) AS t2, outer_ + sg * (dh - dl) AS p3 FROM l),
n AS (SELECT *, CASE WHEN l1 IS NULL THEN 1.5 ELSE {_r('abs(t1 - ideal) / risk', 2)} END AS r1, CASE WHEN l2 IS NULL THEN 2.0 ELSE {_r('abs(t2 - ideal) / risk', 2)} END AS r2 FROM m WHERE risk > 0),
q AS (SELECT *, list_filter([{{'price': t1, 'r': r1}}, {{'price': t2, 'r': r2}}, CASE WHEN (p3 - t2) * sg > 0 THEN {{'price': {_r('p3')}, 'r': {_r('abs(p3 - ideal) / risk', 2)}}} END], lambda g: g.price > 0) AS goals FROM n),
pl AS (SELECT *, coalesce(goals[2], goals[1]) AS main FROM q)"""


def _bound(spark, sf_dir):
    """Bars with levels from the pivots of the bar before, and strategies and sides dealt out in turn."""
    p, i = (F.col("ph") + F.col("pl") + F.col("pc")) / 3, F.col("bar_idx")
    level = lambda *prices: F.array(*[F.struct(x.alias("price"), F.lit(1).alias("touches")) for x in prices])
    x = bar_ops.with_index(daily_bars(spark, sf_dir))
    x = x.withColumns({"pc": F.lag("close").over(w.series()), "ph": F.lag("high").over(w.series()), "pl": F.lag("low").over(w.series()), "tr": w.true_range()})
    x = x.withColumns(
        {
            "price": F.col("close"),
            "atr": F.avg("tr").over(w.back(14)),
            "ema20": F.avg("close").over(w.back(20)),
            "donchian_high": F.max("high").over(w.back(20)),
            "donchian_low": F.min("low").over(w.back(20)),
            "swing_low": F.min("low").over(w.back(10)),
            "swing_high": F.max("high").over(w.back(10)),
            "relative_volume": F.col("volume") / F.avg("volume").over(w.back(20)),
            "support": level(2 * p - F.col("ph"), p - (F.col("ph") - F.col("pl"))),
            "resistance": level(2 * p - F.col("pl"), p + (F.col("ph") - F.col("pl"))),
            "strategy": F.element_at(F.array(*[F.lit(s) for s in ("breakout", "trend-pullback", "range-reversion", "reversal")]), (i % 4 + 1).cast("int")),
            "side": F.when(i % 8 < 4, "long").otherwise("short"),
        }
    )
    return setups.with_levels(x.filter("bar_idx >= 30"), setups.HORIZONS["swing"])


@query(
    f"""{_BOUND} SELECT symbol, ts, side, strategy, {_r('ideal')} AS entry, {_r("CASE WHEN strategy = 'breakout' AND side = 'long' THEN outer_ ELSE ideal - reach END")} AS zone_low, {_r("CASE WHEN strategy = 'breakout' AND side = 'short' THEN outer_ ELSE ideal + reach END")} AS zone_high,
  {_r('stop1')} AS stop, capped AS stop_capped, {_r('risk / a', 2)} AS stop_atr, {_r('main.price', 2)} AS target, {_r('main.r', 1)} AS reward_risk, len(goals) AS n_targets FROM pl"""
)
def trade_levels(spark, sf_dir):
    """Entry zone, stop and targets of every bar, with levels from pivots."""
    x = _bound(spark, sf_dir)
    return x.select("symbol", "ts", "side", "strategy", "entry", "zone_low", "zone_high", "stop", "stop_capped", "stop_atr", rounded("target", 2).alias("target"), rounded("reward_risk", 1).alias("reward_risk"), F.size("targets").cast("long").alias("n_targets"))


@query(
    f"""{_BOUND}, s AS (SELECT *, side = 'long' AS up, CASE i % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'sideways' END AS way, ['HH-HL', 'LH-LL', 'HH-LL'][i % 3 + 1] AS structure, i * 7 % 45 AS adx, i * 13 % 100 AS rsi, {_r('rv', 2)} AS rvol, i % 5 AS dv, {_r('price - ema20')} AS hist FROM pl),
v AS (SELECT symbol, ts, CASE WHEN (up AND way = 'up') OR (NOT up AND way = 'down') THEN CASE WHEN i % 2 = 0 THEN 25 ELSE 12 END WHEN way = 'sideways' THEN 8 ELSE 0 END AS points_bias,
  CASE WHEN (up AND way = 'up') OR (NOT up AND way = 'down') THEN CASE WHEN structure IN ('HH-HL', 'LH-LL') THEN 15 ELSE 8 END WHEN way = 'sideways' THEN 6 ELSE 0 END AS points_alignment,
  CASE WHEN adx >= 30 THEN 10 WHEN adx >= 22 THEN 7 WHEN adx >= 18 THEN 3 ELSE 0 END AS points_strength, CASE WHEN CASE WHEN up THEN rsi < 68 ELSE rsi > 32 END THEN 10 ELSE 2 END AS points_headroom,
  CASE WHEN rvol > 1.2 THEN 5 WHEN rvol > 0.7 THEN 3 ELSE 0 END + CASE WHEN rose = up THEN 5 ELSE 0 END AS points_participation,
  CASE WHEN main.r >= 3.0 THEN 20 WHEN main.r >= 2.0 THEN 15 WHEN main.r >= 1.5 THEN 7 ELSE 0 END AS points_reward, CASE WHEN (up AND dv = 0) OR (NOT up AND dv = 1) THEN 0 ELSE 10 END AS points_divergence,
  CASE WHEN CASE WHEN up THEN hist > 0 ELSE hist < 0 END THEN 5 ELSE 0 END AS points_confirmation, CASE WHEN capped THEN -12 ELSE 0 END AS points_stop, CASE WHEN strategy = 'reversal' THEN -10 ELSE 0 END AS points_counter_trend FROM s)
SELECT *, greatest(0, least(100, points_bias + points_alignment + points_strength + points_headroom + points_participation + points_reward + points_divergence + points_confirmation + points_stop + points_counter_trend)) AS confidence FROM v"""
)
def trade_confidence(spark, sf_dir):
    """Points of every factor of the plans of trade_levels, on states dealt out in turn."""
    i = F.col("bar_idx")
    way = F.when(i % 3 == 0, "up").when(i % 3 == 1, "down").otherwise("sideways")
    x = _bound(spark, sf_dir).withColumns(
        {
            "trend_direction": way,
            "direction": way,
            "trend_source": F.when(i % 2 == 0, "adx").otherwise("slope"),
            "structure": F.element_at(F.array(*[F.lit(s) for s in ("HH-HL", "LH-LL", "HH-LL")]), (i % 3 + 1).cast("int")),
            "adx": (i * 7 % 45).cast("double"),
            "rsi": (i * 13 % 100).cast("double"),
            "obv_trend": F.when(F.col("close") > F.col("pc"), "accumulation").otherwise("distribution"),
            "divergences": F.when(i % 5 == 0, F.array(F.lit("regular bearish"))).when(i % 5 == 1, F.array(F.lit("regular bullish"))).otherwise(F.array().cast("array<string>")),
            "entry_histogram": rounded("price") - rounded("ema20"),
            "entry_rsi_state": F.lit(None).cast("string"),
        }
    )
    points = setups.confidence(setups.HORIZONS["swing"])
    return x.select("symbol", "ts", *[v.alias(k) for k, v in points.items() if k != "points_forced"])


@query()
def trade_plans(spark, sf_dir):
    """The whole plan of every bar on its slice: strategy, levels, confidence."""
    x = setups.plans(slices.slice_reads(daily_bars(spark, sf_dir)), setups.HORIZONS["medium"])
    return x.select("symbol", "ts", "side", "strategy", "timing", "entry", "zone_low", "zone_high", "stop", "targets", "reward_risk", "confidence")


_ORDERS = f"""WITH {SQL_DAILY}, n AS (SELECT symbol, max(bar_idx) AS last FROM bars GROUP BY symbol),
o AS (SELECT symbol, bar_idx AS i, CASE WHEN bar_idx % 2 = 0 THEN 'long' ELSE 'short' END AS side, ['enter-now', 'wait-pullback', 'wait-breakout'][bar_idx % 3 + 1] AS timing, close,
  CASE WHEN bar_idx % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sg, [0.0, -0.02, 0.02][bar_idx % 3 + 1]::DOUBLE AS off FROM bars WHERE bar_idx >= 20 AND bar_idx % 5 = 0),
p AS (SELECT *, close * (1 + sg * off) AS entry, close * (1 - sg * 0.06) AS stop, close * (1 + sg * 0.12) AS target FROM o),
c AS (SELECT p.*, b.bar_idx AS f, b.ts AS fts, CASE WHEN timing = 'enter-now' THEN b.open WHEN (timing = 'wait-pullback') = (side = 'long') THEN CASE WHEN b.low <= entry THEN least(entry, b.open) END ELSE CASE WHEN b.high >= entry THEN greatest(entry, b.open) END END AS fill
  FROM p JOIN n USING (symbol) JOIN bars b ON b.symbol = p.symbol AND b.bar_idx BETWEEN p.i + 1 AND least(p.i + 6, n.last - 1)),
f AS (SELECT * FROM c WHERE fill IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY f) = 1),
g AS (SELECT * FROM f WHERE NOT (fill < close * 0.9 * 0.999 OR fill > close * 1.1 * 1.001) AND CASE WHEN side = 'long' THEN fill > stop ELSE fill < stop END),
e AS (SELECT g.symbol, g.i, b.bar_idx AS x, b.ts AS xts, b.close AS xc, CASE WHEN side = 'long' THEN b.low <= stop ELSE b.high >= stop END AS st, CASE WHEN side = 'long' THEN b.high >= target ELSE b.low <= target END AS tg FROM g JOIN bars b ON b.symbol = g.symbol AND b.bar_idx BETWEEN g.f + 1 AND g.f + 20),
h AS (SELECT * FROM e WHERE st OR tg QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY x) = 1),
t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY x DESC) = 1),
r AS (SELECT g.*, coalesce(h.xts, t.xts, g.fts) AS exit_ts, coalesce(h.x, t.x, g.f) - g.f AS held, CASE WHEN h.st THEN 'stop' WHEN h.tg THEN 'target' ELSE 'timeout' END AS outcome, CASE WHEN h.st THEN stop WHEN h.tg THEN target ELSE t.xc END AS leave FROM g LEFT JOIN h USING (symbol, i) LEFT JOIN t USING (symbol, i))"""


@query(f"{_ORDERS} SELECT symbol, i AS bar_idx, side, timing, fts AS entry_ts, {_r('fill', 6)} AS entry_price, exit_ts, {_r('leave', 6)} AS exit_price, outcome, held AS bars_held, {_r('(leave - fill) * sg / abs(fill - stop) - 0.001 * fill / abs(fill - stop)')} AS result_r FROM r")
def order_outcomes(spark, sf_dir):
    """Fills and exits of market, limit and stop orders, with gaps, costs and a time limit."""
    bars = bar_ops.with_index(daily_bars(spark, sf_dir)).withColumn("histogram", F.lit(0.0))
    i, sign = F.col("bar_idx"), F.when(F.col("bar_idx") % 2 == 0, 1.0).otherwise(-1.0)
    off = F.element_at(F.array(F.lit(0.0), F.lit(-0.02), F.lit(0.02)), (i % 3 + 1).cast("int"))
    orders = bars.filter("bar_idx >= 20 AND bar_idx % 5 = 0").select(
        "symbol",
        "bar_idx",
        F.when(i % 2 == 0, "long").otherwise("short").alias("side"),
        F.element_at(F.array(*[F.lit(t) for t in ("enter-now", "wait-pullback", "wait-breakout")]), (i % 3 + 1).cast("int")).alias("timing"),
        (F.col("close") * (1 + sign * off)).alias("entry"),
        (F.col("close") * 0.9).alias("zone_low"),
        (F.col("close") * 1.1).alias("zone_high"),
        (F.col("close") * (1 - sign * 0.06)).alias("stop"),
        (F.col("close") * (1 + sign * 0.12)).alias("target"),
    )
    x = setups.outcomes(bars, orders, hold=20)
    return x.select("symbol", F.col("bar_idx").cast("long").alias("bar_idx"), "side", "timing", "entry_ts", "entry_price", "exit_ts", "exit_price", "outcome", F.col("bars_held").cast("long").alias("bars_held"), "result_r")


def _trades(spark, sf_dir, horizon):
    d = daily_bars(spark, sf_dir)
    return setups.walk_forward(bar_ops.with_index(recurrences.indicators(d)), slices.slice_reads(d), horizon, hold=40)


@query()
def walk_forward_trades(spark, sf_dir):
    """Trades of the walk-forward over daily bars on the medium horizon."""
    return _trades(spark, sf_dir, "medium").drop("resume")


@query()
def walk_forward_report(spark, sf_dir):
    """Trades, expectancy, its interval and the win rate of each horizon and strategy, marked where the interval leaves out zero."""
    x = None
    for h in ("swing", "medium"):
        one = _trades(spark, sf_dir, h)
        x = one if x is None else x.unionByName(one)
    x = materialise(x, "walk-forward").withColumns({"_cell": F.concat_ws("|", "horizon", "strategy"), "_order": F.struct("entry_ts", "symbol")})
    plain = x.groupBy("_cell", "horizon", "strategy").agg(F.count(F.lit(1)).alias("trades"), rounded(F.avg("result_r")).alias("expectancy_r"))
    drawn = bootstrap_mean(x, "_cell", "result_r", "_order").select("_cell", F.col("hit_rate").alias("win_rate"), "low", "high")
    mark = F.when(F.col("low") > 0, "*").when(F.col("high") < 0, "!").otherwise("")
    return plain.join(drawn, "_cell").drop("_cell").withColumn("mark", mark)


def _frames(spark, sf_dir):
    """Daily bars as entry frame, weekly and monthly ones as structure and trend."""
    d = daily_bars(spark, sf_dir)
    fold = lambda unit: bar_ops.fold(d.withColumn("_unit", F.date_trunc(unit, "ts")), ["symbol", "_unit"]).drop("_unit")
    return d, fold("week"), fold("month")


_FRAME = lambda unit: f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k FROM (SELECT symbol, min(ts) AS ts, last(close ORDER BY ts) AS close, max(high) AS high FROM daily GROUP BY symbol, date_trunc('{unit}', ts))"


@query(
    f"""WITH {SQL_DAILY}, wk AS ({_FRAME('week')}), mo AS ({_FRAME('month')}),
a AS (SELECT d.symbol, d.ts, d.close, d.bar_idx, (SELECT count(*) FROM wk WHERE wk.symbol = d.symbol AND wk.ts < d.ts) - 2 AS kw, (SELECT count(*) FROM mo WHERE mo.symbol = d.symbol AND mo.ts < d.ts) - 2 AS km FROM bars d)
SELECT a.symbol, a.ts, {_r('a.close')} AS entry_price, wk.ts AS structure_ts, {_r('wk.close')} AS structure_price, mo.ts AS trend_ts, {_r('mo.close')} AS trend_price, least(kw + 1, 260) AS structure_bars, least(km + 1, 260) AS trend_bars
FROM a JOIN wk ON wk.symbol = a.symbol AND wk.k = kw JOIN mo ON mo.symbol = a.symbol AND mo.k = km WHERE bar_idx >= 29 AND kw >= 29 AND km >= 29"""
)
def plan_frames(spark, sf_dir):
    """The closed weekly and monthly read that each day's plan rests on."""
    x = setups.framed_reads(*_frames(spark, sf_dir))
    return x.select(
        "symbol", "ts", rounded("entry.price").alias("entry_price"), F.col("structure.ts").alias("structure_ts"), rounded("structure.price").alias("structure_price"),
        F.col("trend.ts").alias("trend_ts"), rounded("trend.price").alias("trend_price"), F.col("structure.bars").cast("long").alias("structure_bars"), F.col("trend.bars").cast("long").alias("trend_bars"),
    )


@query()
def framed_plans(spark, sf_dir):
    """Every day's plan on the long horizon: monthly bias, weekly structure, daily trigger."""
    x = setups.framed_plans(setups.framed_reads(*_frames(spark, sf_dir)), setups.HORIZONS["long"])
    return x.select("symbol", "ts", "trend_ts", "structure_ts", "bias", "side", "strategy", "timing", "entry", "zone_low", "zone_high", "stop", "targets", "reward_risk", "poor_reward", "confidence", "signals")


@query(
    f"""WITH {SQL_DAILY}, x AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM daily), c AS (SELECT symbol, year(ts) AS year, count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM x WHERE d IS NOT NULL GROUP BY ALL HAVING count(d) >= 20)
SELECT symbol, count(*) AS tested, count(*) FILTER (abs(m) > 1.96 * s / sqrt(n)) AS apart, {_r('0.05 * count(*)', 2)} AS expected FROM c GROUP BY symbol"""
)
def multiple_comparisons(spark, sf_dir):
    """Cells tested, cells whose interval excludes zero, and how many would by chance."""
    x = daily_bars(spark, sf_dir).withColumn("d", F.col("close") - F.lag("close").over(w.series())).filter("d IS NOT NULL")
    c = x.groupBy("symbol", F.year("ts").alias("year")).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).filter("n >= 20")
    return c.groupBy("symbol").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.abs("m") > 1.96 * F.col("s") / F.sqrt("n")).alias("apart"), rounded(0.05 * F.count(F.lit(1)), 2).alias("expected"))


@query(
    f"""WITH {SQL_DAILY}, r AS (SELECT symbol, count(*) AS n, avg(close - open) AS m, stddev_samp(close - open) AS s FROM daily GROUP BY symbol),
k AS (SELECT 'A' AS symbol, 'own' AS basis UNION ALL SELECT 'N', 'own')
SELECT symbol, n, coalesce(basis, 'horizon') AS basis, CASE WHEN m - 1.96 * s / sqrt(n) <= 0 AND m + 1.96 * s / sqrt(n) >= 0 THEN 'no edge' WHEN m > 0 THEN 'edge' ELSE 'loss' END AS verdict FROM r LEFT JOIN k USING (symbol)"""
)
def calibration_verdict(spark, sf_dir):
    """Whose record counts, a strategy's own or the horizon's, and whether its interval spans zero."""
    d = F.col("close") - F.col("open")
    r = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    own = spark.createDataFrame([("A", "own"), ("N", "own")], "symbol string, basis string")
    e = 1.96 * F.col("s") / F.sqrt("n")
    verdict = F.when((F.col("m") - e <= 0) & (F.col("m") + e >= 0), "no edge").when(F.col("m") > 0, "edge").otherwise("loss")
    return r.join(F.broadcast(own), "symbol", "left").select("symbol", "n", F.coalesce("basis", F.lit("horizon")).alias("basis"), verdict.alias("verdict"))


@query(
    f"""WITH {SQL_DAILY}, x AS (SELECT symbol, ts, bar_idx, close, volume, abs(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS mv FROM bars)
SELECT symbol, count(*) AS bars, {_r('coalesce(CASE WHEN isfinite(corr(volume, mv)) THEN corr(volume, mv) END, 0)')} AS level_corr, count(*) FILTER (bar_idx % 5 = 0) AS every_fifth, last(close ORDER BY ts) - first(close ORDER BY ts) AS trend FROM x GROUP BY symbol"""
)
def series_summary(spark, sf_dir):
    """Correlation of levels, every fifth bar, last less first."""
    x = bar_ops.with_index(daily_bars(spark, sf_dir)).withColumn("mv", F.abs(F.col("close") - F.lag("close").over(w.series())))
    return x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        rounded(F.coalesce(F.nanvl(F.corr("volume", "mv"), F.lit(None).cast("double")), F.lit(0.0))).alias("level_corr"),
        F.count_if(F.col("bar_idx") % 5 == 0).alias("every_fifth"),
        (F.max_by("close", "ts") - F.min_by("close", "ts")).alias("trend"),
    )


@query(f"WITH {SQL_DAILY}, x AS (SELECT *, CASE WHEN close > open THEN close END AS up FROM daily) SELECT symbol, ts, last_value(up IGNORE NULLS) OVER s AS last_up, lag(close, 5) OVER s AS five_back FROM x WINDOW s AS (PARTITION BY symbol ORDER BY ts)")
def last_and_back(spark, sf_dir):
    """The last close of a rising bar, and the close five bars back."""
    x = daily_bars(spark, sf_dir).withColumn("up", F.when(F.col("close") > F.col("open"), F.col("close")))
    return x.select("symbol", "ts", F.last("up", ignorenulls=True).over(w.series()).alias("last_up"), F.lag("close", 5).over(w.series()).alias("five_back"))
