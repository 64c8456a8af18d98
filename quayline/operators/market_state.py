"""Market state of every bar as columns: direction, structure, momentum, regime, strategy.

Input is the output of ``recurrences.indicators``; everything here is window functions and CASE
ladders, so states of all symbols and bars come from one plan partitioned by symbol.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.operators import windows as w


@dataclass(frozen=True)
class Thresholds:
    """The ladders' default bounds."""

    adx_direction: float = 20
    adx_trending: float = 25
    adx_strong: float = 30
    adx_setup: float = 22
    drift_slope: float = 0.1
    rsi_overbought: float = 70
    rsi_bullish: float = 55
    rsi_neutral: float = 45
    rsi_oversold: float = 30
    rsi_extended_long: float = 72
    rsi_extended_short: float = 28
    stretched_atr: float = 2
    near_mean_atr: float = 1
    range_low: float = 0.3
    range_high: float = 0.7

    def but(self, **changes: float) -> Thresholds:
        """The same with some bounds changed, as sweeps do."""
        return replace(self, **changes)


def direction(t: Thresholds) -> tuple[Column, Column]:
    """up, down or sideways, and what says so: the directional index, else the slope."""
    trend = (F.col("adx14") >= t.adx_direction) & F.col("plus_di").isNotNull() & F.col("minus_di").isNotNull()
    drift = F.abs("slope_pct") > t.drift_slope
    way = F.when(trend, F.when(F.col("plus_di") > F.col("minus_di"), "up").otherwise("down")).when(drift, F.when(F.col("slope_pct") > 0, "up").otherwise("down")).otherwise("sideways")
    return way, F.when(trend, "adx").when(drift, "slope").otherwise("none")


def momentum(t: Thresholds) -> Column:
    rsi = F.col("rsi14")
    return (
        F.when(rsi >= t.rsi_overbought, "overbought")
        .when(rsi >= t.rsi_bullish, "bullish")
        .when(rsi > t.rsi_neutral, "neutral")
        .when(rsi > t.rsi_oversold, "bearish")
        .when(rsi.isNotNull(), "oversold")
    )


def strength_label() -> Column:
    adx = F.col("adx14")
    return F.when(adx.isNull(), "unknown").when(adx < 20, "no trend").when(adx < 25, "emerging").when(adx < 40, "trending").otherwise("strong trend")


def regime(t: Thresholds) -> Column:
    """Compression wins unless the trend is strong; then trend, then expansion, else range."""
    adx = F.col("adx14")
    squeezed = F.coalesce(F.col("squeeze"), F.lit(False)) & ~F.coalesce(adx >= t.adx_strong, F.lit(False))
    return F.when(squeezed, "compressed").when(adx >= t.adx_trending, "trending").when(F.col("atr_pct") > 4, "volatile-expansion").otherwise("ranging")


def with_structure(bars: DataFrame, k: int = 3) -> DataFrame:
    """Class of the last two confirmed swing highs and lows; a swing is confirmed k bars later."""
    order, before = w.series().rowsBetween(Window.unboundedPreceding, 0), w.series().rowsBetween(Window.unboundedPreceding, -1)
    x = bars.withColumns({"_sh": F.when(w.swing("high", k, True), F.col("high")), "_sl": F.when(w.swing("low", k, False), F.col("low"))})
    x = x.withColumns({c: F.lag(c, k).over(w.series()) for c in ("_sh", "_sl")})
    for c in ("_sh", "_sl"):
        x = x.withColumn(c + "p", F.when(F.col(c).isNotNull(), F.last(c, ignorenulls=True).over(before)))
        x = x.withColumns({c + "1": F.last(c, ignorenulls=True).over(order), c + "0": F.last(c + "p", ignorenulls=True).over(order)})
    higher_high, higher_low = F.col("_sh1") > F.col("_sh0"), F.col("_sl1") > F.col("_sl0")
    known = F.col("_sh0").isNotNull() & F.col("_sl0").isNotNull()
    label = F.when(~known, "unclear").when(higher_high & higher_low, "HH-HL").when(~higher_high & ~higher_low, "LH-LL").when(higher_high, "HH-LL").otherwise("LH-HL")
    return x.withColumn("structure", label).drop(*[c + s for c in ("_sh", "_sl") for s in ("", "p", "0", "1")])


def strategy(t: Thresholds) -> tuple[Column, Column]:
    """(strategy, timing) of a bar with columns bias, regime, direction, adx14, rsi14, range_position, mean_atr."""
    long = F.col("bias") == "long"
    trending = F.coalesce(F.col("adx14") >= t.adx_setup, F.lit(False))
    aligned = (long & (F.col("direction") == "up")) | (~long & (F.col("direction") == "down"))
    rsi, far, pos = F.coalesce("rsi14", F.lit(50.0)), F.col("mean_atr"), F.col("range_position")
    extended = (long & (rsi > t.rsi_extended_long)) | (~long & (rsi < t.rsi_extended_short))
    fade = F.coalesce((long & (pos < t.range_low)) | (~long & (pos > t.range_high)), F.lit(False))
    ranging = (F.col("regime") == "ranging") | ~trending
    both = (
        F.when(F.col("regime") == "compressed", F.lit("breakout/wait-breakout"))
        .when(trending & aligned & (far > t.stretched_atr), "none/stand-aside")
        .when(trending & aligned & extended, "trend-pullback/wait-pullback")
        .when(trending & aligned & (far <= t.near_mean_atr), "trend-pullback/enter-now")
        .when(trending & aligned, "trend-pullback/wait-pullback")
        .when(ranging & fade, "range-reversion/enter-now")
        .otherwise("none/stand-aside")
    )
    return F.split_part(both, F.lit("/"), F.lit(1)), F.split_part(both, F.lit("/"), F.lit(2))


def market_states(indicated: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """State columns for every bar of ``recurrences.indicators``' output."""
    t = t or Thresholds()
    mid, sd = w.sma("close", 20), w.full(F.stddev_pop("close").over(w.back(20)), "close", 20)
    high, low = w.full(F.max("high").over(w.back(20)), "close", 20), w.full(F.min("low").over(w.back(20)), "close", 20)
    x = indicated.withColumn("bar_idx", F.row_number().over(w.series()) - 1).withColumn("_signed", w.signed_volume())
    x = x.withColumns(
        {
            "slope_pct": w.slope_pct(20),
            "squeeze": (mid + 2 * sd < F.col("keltner_upper")) & (mid - 2 * sd > F.col("keltner_lower")),
            "range_position": F.when(high != low, (F.col("close") - low) / (high - low)),
            "obv": F.sum("_signed").over(w.series()),
            "_hist": F.lag("histogram").over(w.series()),
            "mean_atr": F.when(F.col("atr14") > 0, F.abs(F.col("close") - (F.col("keltner_upper") + F.col("keltner_lower")) / 2) / F.col("atr14")),
        }
    ).withColumn("_obv", F.lag("obv", 20).over(w.series()))
    way, source = direction(t)
    x = with_structure(x).withColumns({"direction": way, "direction_source": source, "regime": regime(t), "rsi_state": momentum(t), "adx_label": strength_label()})
    now, then = F.col("histogram") > 0, F.col("_hist") > 0
    x = x.withColumns(
        {
            "macd_cross": F.when(now & ~then, "bullish").when(~now & then, "bearish").otherwise("none"),
            "obv_trend": F.when(F.col("obv") > F.col("_obv"), "accumulation").when(F.col("obv") < F.col("_obv"), "distribution").when(F.col("_obv").isNotNull(), "flat").otherwise("none"),
            "bias": F.when(F.col("macd") < 0, "short").otherwise("long"),
        }
    )
    name, timing = strategy(t)
    return x.withColumns({"strategy": name, "timing": timing}).drop("_signed", "_hist", "_obv")


def alignment(reads: DataFrame) -> DataFrame:
    """symbol, direction over several timeframes' reads: up or down where all agree, else mixed."""
    agreed = reads.groupBy("symbol").agg(F.count(F.lit(1)).alias("frames"), F.bool_and(F.col("direction") == "up").alias("up"), F.bool_and(F.col("direction") == "down").alias("down"))
    return agreed.filter("frames > 1").select("symbol", "frames", F.when(F.col("up"), "up").when(F.col("down"), "down").otherwise("mixed").alias("direction"))


def position_size(entry: Column, stop: Column, account: float, risk_percent: float) -> dict[str, Column]:
    """Units and notional whose loss at the stop is the given share of the account."""
    risk = account * risk_percent / 100
    units = F.when(F.abs(entry - stop) > 0, F.lit(risk) / F.abs(entry - stop)).otherwise(0.0)
    return {"units": units, "notional": units * entry, "portfolio_percent": units * entry / account * 100}
