"""Level, divergence, thinning and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import recurrences
from quayline.operators import structure as ops
from quayline.operators.bars import tail
from quayline.plans.indicators import _IDX, S, _recursive
from quayline.plans.registry import query
from quayline.sources.market import SQL_DAILY, daily_bars
from quayline.storage import table


def _swings(source: str, k: int = 3) -> str:
    before, after = f"({S} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)", f"({S} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
    side = lambda c, best, worst, ge, gt: (
        f"SELECT * EXCLUDE (nb, na, b1, b2, w1, w2), {c} AS price, '{c}' AS kind FROM (SELECT *, count(*) OVER {before} AS nb, count(*) OVER {after} AS na, {best}({c}) OVER {before} AS b1, {best}({c}) OVER {after} AS b2, "
        f"{worst}({c}) OVER {before} AS w1, {worst}({c}) OVER {after} AS w2 FROM {source}) WHERE nb = {k} AND na = {k} AND {c} {ge} b1 AND {c} {ge} b2 AND {c} {gt} w1 AND {c} {gt} w2"
    )
    return f"{side('high', 'max', 'min', '>=', '>')} UNION ALL {side('low', 'min', 'max', '<=', '<')}"


_TAIL = SQL_DAILY.replace("FROM daily)", "FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 260))")


@query(
    f"""{_IDX.replace(SQL_DAILY, _TAIL)}, tr AS (SELECT symbol, i, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM z), {_recursive('a14', 'tr', 'tr', 14, '1.0/14')},
x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars), n AS (SELECT x.symbol, close AS now, least(greatest(a14.v / close * 100, 0.5), 4) AS tol FROM x JOIN a14 ON a14.symbol = x.symbol AND a14.i = x.bar_idx WHERE back = 1),
sw AS (SELECT symbol, price, back, tol, row_number() OVER (PARTITION BY symbol ORDER BY price, back DESC) AS k FROM ({_swings('x')}) JOIN n USING (symbol)),
c AS (SELECT symbol, k, price, back, price AS anchor, 1 AS cl FROM sw WHERE k = 1 UNION ALL
  SELECT s.symbol, s.k, s.price, s.back, CASE WHEN abs(s.price - c.anchor) / c.anchor * 100 <= s.tol THEN c.anchor ELSE s.price END, CASE WHEN abs(s.price - c.anchor) / c.anchor * 100 <= s.tol THEN c.cl ELSE c.cl + 1 END
  FROM c JOIN sw s ON s.symbol = c.symbol AND s.k = c.k + 1),
g AS (SELECT symbol, cl, sum(price) / count(*) AS p, count(*) AS touches, min(back) - 1 AS age FROM c GROUP BY symbol, cl),
l AS (SELECT symbol, CASE WHEN p < now THEN 'support' ELSE 'resistance' END AS side, floor(p * 10000.0 + 0.5) / 10000.0 AS price, touches, floor(touches * (0.25 + 0.75 * power(0.5::DOUBLE, age / 50.0)) * 1000.0 + 0.5) / 1000.0 AS strength FROM g JOIN n USING (symbol)),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'support' THEN -price ELSE price END) AS rank FROM l)
SELECT symbol, side, price, touches, strength, rank FROM k WHERE rank <= 5"""
)
def support_resistance(spark, sf_dir):
    """The five nearest levels on either side, from the last 260 bars; the average range sets how near prices join."""
    return ops.levels(recurrences.indicators(tail(daily_bars(spark, sf_dir), 260)))


@query(
    f"""{_IDX}, dl AS (SELECT symbol, i, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down FROM z WHERE pc IS NOT NULL), {_recursive('g', 'dl', 'up', 14, '1.0/14', 1)}, {_recursive('lo', 'dl', 'down', 14, '1.0/14', 1)},
f AS (SELECT z.symbol, z.ts, z.i, z.high, z.low, CASE WHEN lo.v = 0 THEN 100 ELSE 100 - 100 / (1 + g.v / lo.v) END AS rsi, row_number() OVER (PARTITION BY z.symbol ORDER BY z.ts DESC) AS back FROM z LEFT JOIN g USING (symbol, i) LEFT JOIN lo USING (symbol, i)),
x AS (SELECT * FROM f WHERE back <= 60), sw AS ({_swings('x')}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY back) AS n FROM sw),
p AS (SELECT a.symbol, a.kind AS side, a.price AS pa, b.price AS pb, a.rsi AS oa, b.rsi AS ob, b.back FROM n a JOIN n b ON a.symbol = b.symbol AND a.kind = b.kind AND a.n = 2 AND b.n = 1)
SELECT symbol, CASE WHEN side = 'high' THEN 'bearish' ELSE 'bullish' END AS type, CASE WHEN (pb > pa) = (side = 'high') THEN 'regular' ELSE 'hidden' END AS kind, back - 1 AS bars_ago FROM p WHERE (pb > pa AND ob < oa) OR (pb < pa AND ob > oa)"""
)
def divergences(spark, sf_dir):
    """Divergences of price and RSI over the last sixty bars."""
    return ops.divergences(tail(recurrences.indicators(daily_bars(spark, sf_dir)), 60))


@query(
    f"""WITH {SQL_DAILY}, n AS (SELECT symbol, ts, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, open, high, low FROM daily), p AS (SELECT *, pc * 0.95 AS b, pc * 1.05 AS a FROM n WHERE pc IS NOT NULL)
SELECT symbol, ts, CASE WHEN low <= b THEN least(b, open) END AS long_limit, CASE WHEN high >= a THEN greatest(a, open) END AS long_stop, CASE WHEN high >= a THEN greatest(a, open) END AS short_limit, CASE WHEN low <= b THEN least(b, open) END AS short_stop FROM p"""
)
def order_fills(spark, sf_dir):
    """Fills of limit and stop orders five percent from the close before."""
    p = daily_bars(spark, sf_dir).withColumn("pc", F.lag("close").over(ops.w.series())).filter("pc IS NOT NULL")
    below, above = F.col("pc") * 0.95, F.col("pc") * 1.05
    fills = {"long_limit": ("limit", True, below), "long_stop": ("stop", True, above), "short_limit": ("limit", False, above), "short_stop": ("stop", False, below)}
    return p.select("symbol", "ts", *[ops.fill_price(*f).alias(k) for k, f in fills.items()])


@query("SELECT o_orderkey, floor((o_totalprice / 1000 * 0.03 / (o_totalprice / 1000 - o_totalprice / 1000 * 0.98) - 0.001 * (o_totalprice / 1000) / (o_totalprice / 1000 - o_totalprice / 1000 * 0.98)) * 10000.0 + 0.5) / 10000.0 AS r FROM orders WHERE o_totalprice > 0")
def trade_results(spark, sf_dir):
    """Result in R of a long trade that gains three percent on a two percent stop, at ten basis points."""
    e = F.col("o_totalprice") / 1000
    risk = e - e * 0.98
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 0")
    return o.select("o_orderkey", rounded(e * 0.03 / risk - 0.001 * e / risk).alias("r"))
