"""Queries of the studies: extreme values, implied volatility, agreement of venues."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayline.operators import recurrences, studies
from quayline.operators.bars import with_index
from quayline.operators.bootstrap import sql_bootstrap
from quayline.operators.structure import thin
from quayline.plans.indicators import SQL_ATR
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, SQL_HOURLY, daily_bars, hourly_bars

HORIZONS, THRESHOLDS = (24, 72, 168, 336), (1.5, 2.0, 2.5)  # hours: a day, three, a week, two
SPLIT = 883612800  # 1998-01-01
RESAMPLES = 500
IV_HORIZONS = (10, 21)


def _rates(spark, sf_dir):
    """Daily volume stands for the rate that is paid, the close for the price."""
    bars = daily_bars(spark, sf_dir)
    return bars.select("symbol", "ts", F.col("volume").alias("rate")), bars.select("symbol", "ts", "close")


# each kept time is followed by the first one at least the horizon later
SQL_PICKED = f"""
z AS (SELECT symbol, ts, epoch(ts::TIMESTAMP)::BIGINT AS t, (volume - avg(volume) OVER p) / nullif(stddev_samp(volume) OVER p, 0) AS z, count(*) OVER p AS n
      FROM daily WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)),
horizons AS (SELECT unnest({list(HORIZONS)}) AS horizon),
moved AS (SELECT z.symbol, z.t, z.z, h.horizon, (b.close - a.close) / a.close * 100 AS move FROM z JOIN daily a USING (symbol, ts), horizons h
          JOIN daily b ON b.symbol = z.symbol AND epoch(b.ts::TIMESTAMP)::BIGINT = z.t + h.horizon * 3600 AND b.close > 0 WHERE n = 90 AND z.z IS NOT NULL AND a.close > 0),
whole AS (SELECT * FROM moved QUALIFY count(*) OVER (PARTITION BY symbol, t) = {len(HORIZONS)}),
firsts AS MATERIALIZED (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY horizon, t ORDER BY symbol) = 1),
nexts AS MATERIALIZED (SELECT a.horizon, a.t, b.t AS later FROM firsts a ASOF LEFT JOIN firsts b ON a.horizon = b.horizon AND a.t + a.horizon * 3600 <= b.t),
picked AS (
  SELECT * FROM (WITH RECURSIVE p(horizon, t) AS (
    SELECT horizon, min(t) FROM firsts GROUP BY horizon UNION ALL SELECT p.horizon, n.later FROM p JOIN nexts n USING (horizon, t) WHERE n.later IS NOT NULL) SELECT * FROM p)),
pool AS MATERIALIZED (SELECT f.* FROM firsts f JOIN picked USING (horizon, t)),
cells AS (SELECT 'all' AS part, tail, threshold FROM (SELECT unnest(['high', 'low']) AS tail), (SELECT unnest({list(THRESHOLDS)})::DOUBLE AS threshold)
          UNION ALL SELECT unnest(['train', 'test']), 'high', 2.0),
inside AS (SELECT horizon || '|' || part || '|' || tail || '|' || threshold AS g, horizon, part, tail, threshold, t, move, CASE WHEN tail = 'high' THEN z >= threshold ELSE z <= -threshold END AS hit
           FROM pool, cells WHERE part = 'all' OR (part = 'train') = (t < {SPLIT})),
samples AS (SELECT g, s, row_number() OVER (PARTITION BY g, s ORDER BY t) - 1 AS i, move AS v FROM (SELECT g, t, move, 1 AS s FROM inside UNION ALL SELECT g, t, move, 0 FROM inside WHERE hit)),
{sql_bootstrap(RESAMPLES, 20260801, 20)},
plain AS (SELECT g, horizon, part, tail, threshold, count(*) FILTER (hit) AS n, count(*) AS baseline_n, floor(avg(move) FILTER (hit) * 10000.0 + 0.5) / 10000.0 AS mean FROM inside GROUP BY ALL),
study AS (SELECT horizon, part, tail, threshold, p.n, baseline_n, p.mean, hit_rate, d.mean AS excess, low, high, coalesce(low > 0 OR high < 0, false) AS clears FROM plain p JOIN drawn d USING (g))"""


def _study(spark, sf_dir):
    return studies.threshold_study(studies.observations(*_rates(spark, sf_dir), HORIZONS), HORIZONS, THRESHOLDS, SPLIT, RESAMPLES)


@query(f"WITH {SQL_DAILY}, {SQL_PICKED} SELECT * FROM study")
def funding_study(spark, sf_dir):
    """Moves after extreme volumes in 24 cells and the split, each against its thinned baseline."""
    return _study(spark, sf_dir)


@query(f"WITH {SQL_DAILY}, {SQL_PICKED} SELECT count(*) AS cells, count(*) FILTER (clears) AS cleared, floor(count(*) * 0.05 * 10.0 + 0.5) / 10.0 AS expected FROM study WHERE part = 'all'")
def funding_findings(spark, sf_dir):
    """Cells tested, cells that clear zero, and what chance would give."""
    return studies.findings(_study(spark, sf_dir))


@query(
    f"""WITH {SQL_HOURLY}, t AS (SELECT symbol, epoch(ts)::BIGINT AS t FROM hourly), n AS MATERIALIZED (SELECT a.symbol, a.t, b.t AS later FROM t a ASOF LEFT JOIN t b ON a.symbol = b.symbol AND a.t + 28800 <= b.t)
SELECT symbol, t AS ts FROM (WITH RECURSIVE p(symbol, t) AS (SELECT symbol, min(t) FROM t GROUP BY symbol UNION ALL SELECT p.symbol, n.later FROM p JOIN n USING (symbol, t) WHERE n.later IS NOT NULL) SELECT * FROM p)"""
)
def thinned_hours(spark, sf_dir):
    """Hourly bars thinned greedily to one in eight hours."""
    return thin(hourly_bars(spark, sf_dir), "symbol", "ts", 8 * 3600)


_AHEAD = lambda h: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
SQL_FORECAST = f"""
paired AS (SELECT a.*, b.close AS iv FROM atr a LEFT JOIN daily b ON b.ts = a.ts AND b.symbol = CASE a.symbol WHEN 'A' THEN 'R' WHEN 'R' THEN 'N' ELSE 'A' END),
logs AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr, count(*) OVER (PARTITION BY symbol) AS n_bars FROM paired),
seen AS (SELECT *, list(iv) FILTER (iv IS NOT NULL) OVER b252 AS ivs, stddev_samp(lr) OVER b20 * sqrt(252) * 100 AS trailing_vol, count(lr) OVER b20 AS n20,
  {', '.join(f"stddev_samp(lr) OVER {_AHEAD(h)} * sqrt(252) * 100 AS vol_{h}, (max(high) OVER {_AHEAD(h)} - min(low) OVER {_AHEAD(h)}) / close * 100 AS move_{h}, (lead(close, {h}) OVER (PARTITION BY symbol ORDER BY ts) - close) / close * 100 AS return_{h}" for h in IV_HORIZONS)}
  FROM logs WINDOW b252 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), b20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
kept AS (SELECT *, len(list_filter(ivs, lambda v: v < iv)) / len(ivs) * 100 AS iv_rank, atr_pct * sqrt(252) AS atr_annual FROM seen
  WHERE bar_idx >= 260 AND bar_idx < n_bars - {max(IV_HORIZONS)} - 1 AND iv IS NOT NULL AND atr_pct IS NOT NULL AND n20 = 20 AND len(ivs) >= 100),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS n_rows FROM kept)"""


def _forecast(spark, sf_dir):
    """Each series is held against another one's level, which stands for its implied volatility."""
    bars = with_index(recurrences.indicators(daily_bars(spark, sf_dir)))
    of = F.create_map(*[F.lit(x) for pair in (("R", "A"), ("N", "R"), ("A", "N")) for x in pair])
    implied = daily_bars(spark, sf_dir).select(of[F.col("symbol")].alias("symbol"), "ts", F.col("close").alias("iv"))
    return studies.forecast_rows(bars, implied, IV_HORIZONS)


@query(
    f"""{SQL_ATR}, {SQL_FORECAST},
trials AS ({' UNION ALL '.join(f"SELECT symbol, place < n_rows // 2 AS train, {h} AS horizon, '{t}' AS target, '{n}' AS predictor, {p} AS x, {t}_{h} AS y FROM rows_" for h in IV_HORIZONS for t in ("vol", "move") for p, n in (("iv", "implied"), ("atr_annual", "range"), ("trailing_vol", "trailing")))}),
fit AS (SELECT symbol, horizon, target, predictor, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM trials WHERE train GROUP BY ALL)
SELECT symbol, horizon, target, predictor, count(*) AS n_test, floor(corr(x, y) * 10000.0 + 0.5) / 10000.0 AS correlation, floor(avg(abs(a * x + b - y)) * 10000.0 + 0.5) / 10000.0 AS mae
FROM trials JOIN fit USING (symbol, horizon, target, predictor) WHERE NOT train GROUP BY ALL"""
)
def iv_forecast(spark, sf_dir):
    """Implied, range and trailing volatility as forecasts of what came, fitted on the first half and tried on the second."""
    return studies.forecast_study(_forecast(spark, sf_dir), IV_HORIZONS)


@query(
    f"""{SQL_ATR}, {SQL_FORECAST},
moves AS ({' UNION ALL '.join(f"SELECT symbol, {h} AS horizon, place, iv_rank, return_{h} AS move FROM rows_ WHERE place % {h} = 0" for h in IV_HORIZONS)}),
binned AS (SELECT symbol || '|' || horizon || '|' || bin AS g, *, CASE bin WHEN 'calm' THEN iv_rank < 20 WHEN 'panic' THEN iv_rank > 80 ELSE iv_rank BETWEEN 20 AND 80 END AS hit FROM moves, (SELECT unnest(['calm', 'middle', 'panic']) AS bin)),
samples AS (SELECT g, s, row_number() OVER (PARTITION BY g, s ORDER BY place) - 1 AS i, move AS v FROM (SELECT g, place, move, 1 AS s FROM binned UNION ALL SELECT g, place, move, 0 FROM binned WHERE hit)),
{sql_bootstrap(RESAMPLES, 20260801, 20)},
plain AS (SELECT g, symbol, horizon, bin, count(*) FILTER (hit) AS n, count(*) AS thinned_n FROM binned GROUP BY ALL)
SELECT symbol, horizon, bin, p.n, thinned_n, d.mean AS excess, low, high, coalesce(low > 0 OR high < 0, false) AS clears FROM plain p JOIN drawn d USING (g)"""
)
def iv_rank_study(spark, sf_dir):
    """Returns after calm, middle and panic ranks against all, on windows that don't overlap."""
    return studies.rank_study(_forecast(spark, sf_dir), IV_HORIZONS, RESAMPLES)


VENUES = ("click", "view", "signup")


@query(
    f"""WITH {SQL_HOURLY}, c AS (SELECT symbol, ts, volume, lag(volume) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM hourly),
d AS (SELECT symbol, ts, (volume - b) / b * 100 AS d FROM c WHERE b > 0),
w AS (SELECT a.d AS first, (a.d + b.d + c.d) / 3 AS mean FROM d a JOIN d b ON a.ts = b.ts AND a.symbol = 'click' AND b.symbol = 'view' JOIN d c ON a.ts = c.ts AND c.symbol = 'signup'),
s AS (SELECT count(*) AS shared, floor(corr(first, mean) * 1000.0 + 0.5) / 1000.0 AS correlation, count(*) FILTER (abs(mean) > 0.2 AND sign(first) <> sign(mean)) AS sign_mismatch, count(*) FILTER (abs(first) > 1) AS flags,
  count(*) FILTER (abs(first) > 1 AND (sign(first) <> sign(mean) OR abs(mean) < 0.5)) AS unconfirmed, floor(stddev_samp(first) * 1000.0 + 0.5) / 1000.0 AS first_sd, floor(stddev_samp(mean) * 1000.0 + 0.5) / 1000.0 AS mean_sd FROM w),
e AS (SELECT unnest([0.5, 0.25, 0.1]) AS effect), n AS (SELECT effect::DOUBLE AS effect, ceil(2 * power(1.96 + 0.84, 2) * power(3.0 / effect, 2))::BIGINT AS needed FROM e)
SELECT shared, CASE WHEN shared >= 30 THEN correlation END AS correlation, CASE WHEN shared >= 30 THEN sign_mismatch END AS sign_mismatch, CASE WHEN shared >= 30 THEN flags END AS flags,
  CASE WHEN shared >= 30 THEN unconfirmed END AS unconfirmed, CASE WHEN shared >= 30 THEN first_sd END AS first_sd, CASE WHEN shared >= 30 THEN mean_sd END AS mean_sd, effect, needed, shared >= needed AS testable FROM s, n"""
)
def agreement_study(spark, sf_dir):
    """Do three venues' changes agree, and is the sample large enough to test an effect?"""
    points = hourly_bars(spark, sf_dir).select(F.col("symbol").alias("venue"), "ts", F.col("volume").alias("value"))
    return studies.agreement_study(points, VENUES, (0.5, 0.25, 0.1))
