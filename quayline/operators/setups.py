"""Trade setups as columns: strategy, entry zone, stop, targets, confidence; and their simulation forward.

Everything is CASE ladders and array functions over one row a bar, so the plans of all symbols and
bars are one projection. A row holds what ``slices.slice_reads`` gives.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import market_state as state
from quayline.operators.joins import asof_excluding_forming
from quayline.operators.market_state import Thresholds
from quayline.operators.slices import slice_reads


@dataclass(frozen=True)
class Horizon:
    stop_atr: float  # buffer behind the structural level
    most_atr: float  # widest stop
    most_percent: float
    least_reward: float


#: fixed values: the four horizons
HORIZONS = {
    "day": Horizon(0.75, 3, 3, 1.5),
    "swing": Horizon(1.0, 3.5, 12, 2.0),
    "medium": Horizon(1.5, 4, 25, 2.5),
    "long": Horizon(2.5, 5, 40, 3.0),
}


def where(df: DataFrame, test: Column) -> DataFrame:
    """The rows that pass; the test is not pushed into the long expressions beneath, which would repeat them."""
    return df.withColumn("_pass", F.explode(F.when(test, F.array(F.lit(1))))).drop("_pass")


def with_read_states(reads: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """reads with direction, direction_source, regime, rsi_state, stoch_state, adx_label, macd_cross, obv_trend, range_position, signals."""
    t = t or Thresholds()
    x = reads.withColumns({"adx14": F.col("adx"), "rsi14": F.col("rsi"), "slope_pct": F.col("slope"), "atr_pct": F.when(F.col("price") != 0, F.col("atr") / F.col("price") * 100)})
    way, source = state.direction(t)
    now, then = F.col("histogram") > 0, F.col("histogram_before") > 0
    span = F.col("donchian_high") - F.col("donchian_low")
    obv = F.when(F.col("obv_change") > 0, "accumulation").when(F.col("obv_change") < 0, "distribution").when(F.col("obv_change").isNotNull(), "flat")
    stoch = F.when(F.col("stoch_rsi_k") >= 80, "overbought").when(F.col("stoch_rsi_k") <= 20, "oversold").when(F.col("stoch_rsi_k").isNotNull(), "neutral")
    x = x.withColumns(
        {
            "direction": way,
            "direction_source": source,
            "regime": state.regime(t),
            "rsi_state": state.momentum(t),
            "stoch_state": stoch,
            "adx_label": state.strength_label(),
            "macd_cross": F.when(now & ~then, "bullish").when(~now & then, "bearish"),
            "obv_trend": obv,
            "range_position": F.when(span != 0, rounded((F.col("price") - F.col("donchian_low")) / span, 3)),
            "vwap_distance": F.when(F.col("vwap") != 0, rounded((F.col("price") - F.col("vwap")) / F.col("vwap") * 100, 2)),
            "ma_regime": F.when(F.col("ema50") > F.col("ema200"), "golden").when(F.col("ema200").isNotNull(), "death"),
            "squeeze_released": F.coalesce(F.col("squeeze_before") & ~F.col("squeeze"), F.lit(False)),
        }
    )
    return x.withColumn("signals", signals(t))


#: fixed values: what a read says, in this order; {} is the number it rests on
SIGNALS = {
    "golden": "EMA50 above EMA200 — long-term regime is constructive",
    "death": "EMA50 below EMA200 — long-term regime is defensive",
    "no trend": "ADX {} — no trend; trend-following entries are low-quality here",
    "rising": "Higher highs and higher lows — intact uptrend structure",
    "falling": "Lower highs and lower lows — intact downtrend structure",
    "oversold": "RSI {} — oversold",
    "overbought": "RSI {} — overbought",
    "cross": "MACD histogram crossed {} on the last bar",
    "squeeze": "Volatility compressed (Bollinger inside Keltner) — expansion pending, direction unresolved",
    "released": "Squeeze just released — the expansion is starting now",
    "volume": "Volume {}x its 20-bar average — participation confirms the move",
    "no volume": "Volume {}x average — move lacks participation",
    "divergence": "{} RSI divergence",
    "top": "Price at the top of its 20-bar range — breakout or rejection zone",
    "bottom": "Price at the bottom of its 20-bar range — breakdown or reversal zone",
}


def signals(t: Thresholds) -> Column:
    """What the read says: one text for each observation that holds, divergences before the range."""
    number = lambda c, digits: F.regexp_replace(rounded(c, digits).cast("string"), r"\.0$", "")
    adx, rsi, volume, place = number("adx", 1), number("rsi", 1), rounded("relative_volume", 2), F.col("range_position")
    none = F.lit("")
    before = [
        (F.col("ma_regime") == "golden", "golden", none),
        (F.col("ma_regime") == "death", "death", none),
        (F.col("adx") < t.adx_direction, "no trend", adx),
        (F.col("structure") == "HH-HL", "rising", none),
        (F.col("structure") == "LH-LL", "falling", none),
        (F.col("rsi_state") == "oversold", "oversold", rsi),
        (F.col("rsi_state") == "overbought", "overbought", rsi),
        (F.col("macd_cross").isin("bullish", "bearish"), "cross", F.col("macd_cross")),
        (F.col("squeeze"), "squeeze", none),
        (F.col("squeeze_released"), "released", none),
        (volume > 1.5, "volume", number("relative_volume", 2)),
        (volume < 0.6, "no volume", number("relative_volume", 2)),
    ]
    after = [(place > 0.95, "top", none), (place < 0.05, "bottom", none)]
    said = lambda tests: F.array_compact(F.array(*[F.when(test, F.replace(F.lit(SIGNALS[name]), F.lit("{}"), value)) for test, name, value in tests]))
    return F.concat(said(before), F.transform("divergences", lambda d: F.replace(F.lit(SIGNALS["divergence"]), F.lit("{}"), d)), said(after))


def choose(t: Thresholds | None = None) -> Column:
    """struct(strategy, timing, side) from bias and the structure read; a reversal carries its own side."""
    t = t or Thresholds()
    long = F.col("bias") == "long"
    adx, rsi = rounded("adx", 1), F.coalesce(rounded("rsi", 1), F.lit(50.0))
    atr, mean = rounded("atr"), rounded("ema20")
    far = F.when(atr > 0, F.abs(rounded("price") - mean) / atr)
    trending = F.coalesce(adx >= t.adx_setup, F.lit(False))
    aligned = (long & (F.col("direction") == "up")) | (~long & (F.col("direction") == "down"))
    extended = (long & (rsi > t.rsi_extended_long)) | (~long & (rsi < t.rsi_extended_short))
    pos = F.col("range_position")
    fade = F.coalesce((long & (pos < t.range_low)) | (~long & (pos > t.range_high)), F.lit(False))
    turn = F.when(F.col("rsi_state") == "oversold", "long").when(F.col("rsi_state") == "overbought", "short")
    backed = F.array_contains("divergences", F.when(turn == "long", "regular bullish").otherwise("regular bearish"))
    made = lambda s, w, side=None: F.struct(F.lit(s).alias("strategy"), F.lit(w).alias("timing"), (F.col("bias") if side is None else side).alias("side"))
    return (
        F.when(F.col("regime") == "compressed", made("breakout", "wait-breakout"))
        .when(trending & aligned & F.coalesce(far > t.stretched_atr, F.lit(False)), made("none", "stand-aside"))
        .when(trending & aligned & extended, made("trend-pullback", "wait-pullback"))
        .when(trending & aligned & F.coalesce(far <= t.near_mean_atr, F.lit(False)), made("trend-pullback", "enter-now"))
        .when(trending & aligned, made("trend-pullback", "wait-pullback"))
        .when(((F.col("regime") == "ranging") | ~trending) & fade, made("range-reversion", "enter-now"))
        .when(((F.col("regime") == "ranging") | ~trending) & turn.isNotNull() & backed, made("reversal", "wait-confirmation", turn))
        .otherwise(made("none", "stand-aside"))
    )


def with_levels(df: DataFrame, h: Horizon, unit: Column | None = None) -> DataFrame:
    """df with entry, zone_low, zone_high, stop, stop_capped, stop_atr, targets and reward_risk.

    df holds side, strategy, price, atr, ema20, donchian_high and _low, support and resistance
    (nearest first), swing_high and _low. The stop lies behind the nearest structure, no farther than
    the horizon allows; targets are the next opposing levels, else multiples of the risk, then the
    range projected from its edge. Entry and stop are null where there is no setup. ``unit`` takes
    the place of the ATR where it is positive.
    """
    long = F.col("side") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    level = lambda side, k=0: F.try_element_at(side, F.lit(k + 1))["price"]
    edge = {c: rounded(c) for c in ("price", "atr", "ema20", "donchian_high", "donchian_low")}
    a = F.coalesce(F.when(unit > 0, unit) if unit is not None else F.lit(None).cast("double"), F.when(edge["atr"] > 0, edge["atr"]), edge["price"] * 0.02)
    x = df.withColumns({"_a": a, "_sign": sign, "_dh": edge["donchian_high"], "_dl": edge["donchian_low"], "_near": F.when(long, level("support")).otherwise(level("resistance")), "_mean": F.coalesce(edge["ema20"], edge["price"])})
    outer = F.when(long, F.col("_dh")).otherwise(F.col("_dl"))
    inner = F.when(long, F.col("_dl")).otherwise(F.col("_dh"))
    beyond = lambda p, q: F.when(long, F.greatest(p, q)).otherwise(F.least(p, q))
    is_ = lambda s: F.col("strategy") == s
    ideal = (
        F.when(is_("breakout"), F.coalesce(outer, edge["price"]) + F.col("_sign") * 0.15 * F.col("_a"))
        .when(is_("trend-pullback"), F.when(F.col("_near").isNull(), F.col("_mean")).otherwise(beyond(F.col("_mean"), F.col("_near"))))
        .when(is_("range-reversion"), F.coalesce("_near", inner, edge["price"]))
        .otherwise(edge["price"])
    )
    x = x.withColumn("_ideal", ideal)
    reach = F.when(is_("range-reversion"), 0.4).otherwise(0.5) * F.col("_a")
    wide_low, wide_high = F.col("_ideal") - reach, F.col("_ideal") + reach
    broken = F.coalesce(outer, edge["price"])
    low, high = F.when(is_("breakout") & long, broken).otherwise(wide_low), F.when(is_("breakout") & ~long, broken).otherwise(wide_high)
    held = F.array(F.col("_near"), F.when(long, F.col("swing_low")).otherwise(F.col("swing_high")), F.when(is_("breakout"), inner))
    held = F.filter(held, lambda v: v.isNotNull() & ((F.col("_ideal") - v) * F.col("_sign") > 0))
    x = x.withColumns({"_low": low, "_high": high, "_base": F.when(long, F.array_max(held)).otherwise(F.array_min(held))})
    buffer = F.when(F.col("_base").isNotNull(), h.stop_atr).otherwise(2 * h.stop_atr) * F.col("_a")
    x = x.withColumn("_stop", F.coalesce("_base", "_ideal") - F.col("_sign") * buffer).withColumn("_risk", F.abs(F.col("_ideal") - F.col("_stop")))
    most = F.least(h.most_atr * F.col("_a"), h.most_percent / 100 * F.col("_ideal"))
    x = x.withColumn("stop_capped", (F.col("_risk") > most) & (most > 0))
    x = x.withColumn("_risk", F.when(F.col("stop_capped"), most).otherwise(F.col("_risk"))).withColumn("_stop", F.when(F.col("stop_capped"), F.col("_ideal") - F.col("_sign") * F.col("_risk")).otherwise(F.col("_stop")))
    ahead = F.when(long, F.col("resistance")).otherwise(F.col("support"))
    first_past = lambda edge_: F.try_element_at(F.filter(ahead, lambda v: (v["price"] - edge_) * F.col("_sign") > 0), F.lit(1))["price"]
    at = lambda r: rounded(F.col("_ideal") + F.col("_sign") * r * F.col("_risk"))
    multiple = lambda p: rounded(F.abs(p - F.col("_ideal")) / F.col("_risk"), 2)
    goal = lambda p, r: F.struct(p.alias("price"), r.alias("r"))
    x = x.withColumn("_l1", first_past(F.col("_ideal") + F.col("_sign") * 0.8 * F.col("_risk")))
    x = x.withColumn("_t1", F.coalesce("_l1", at(1.5)))
    x = x.withColumn("_l2", first_past(F.col("_t1") * (1 + F.col("_sign") * 0.001)))
    x = x.withColumn("_t2", F.coalesce("_l2", at(h.least_reward)))
    x = x.withColumn("_p3", outer + F.col("_sign") * (F.col("_dh") - F.col("_dl")))
    goals = F.array(
        goal(F.col("_t1"), F.when(F.col("_l1").isNull(), 1.5).otherwise(multiple(F.col("_t1")))),
        goal(F.col("_t2"), F.when(F.col("_l2").isNull(), h.least_reward).otherwise(multiple(F.col("_t2")))),
        F.when((F.col("_p3") - F.col("_t2")) * F.col("_sign") > 0, goal(rounded("_p3"), multiple(F.col("_p3")))),
    )
    good = (F.col("strategy") != "none") & (F.col("_risk") > 0)
    x = x.withColumn("targets", F.when(good, F.filter(goals, lambda g: g["price"] > 0)))
    primary = F.coalesce(F.try_element_at("targets", F.lit(2)), F.try_element_at("targets", F.lit(1)))
    x = x.withColumns(
        {
            "entry": F.when(good, rounded("_ideal")),
            "zone_low": F.when(good, rounded("_low")),
            "zone_high": F.when(good, rounded("_high")),
            "stop": F.when(good, rounded("_stop")),
            "stop_atr": F.when(good, rounded(F.col("_risk") / F.col("_a"), 2)),
            "target": primary["price"],
            "reward_risk": primary["r"],
        }
    )
    return x.drop(*[c for c in x.columns if c.startswith("_") and c not in df.columns])


def confidence(h: Horizon, forced: Column | None = None) -> dict[str, Column]:
    """Points of each factor, and their sum within 0 and 100 as ``confidence``.

    Beside the setup's columns, trend_direction and trend_source are those of the higher timeframe,
    entry_histogram and entry_rsi_state those of the lower one.
    """
    up = F.col("side") == "long"
    agrees = lambda way: F.when(up, way == "up").otherwise(way == "down")
    htf, adx, rsi, volume = F.col("trend_direction"), F.coalesce(rounded("adx", 1), F.lit(0.0)), F.coalesce(rounded("rsi", 1), F.lit(50.0)), rounded("relative_volume", 2)
    coherent = F.col("structure").isin("HH-HL", "LH-LL")
    flow = F.coalesce(F.col("obv_trend") == F.when(up, "accumulation").otherwise("distribution"), F.lit(False))
    reward, histogram = F.col("reward_risk"), F.coalesce(rounded("entry_histogram"), F.lit(0.0))
    against = F.array_contains("divergences", F.when(up, "regular bearish").otherwise("regular bullish"))
    turned = F.when(up, (histogram > 0) | F.coalesce(F.col("entry_rsi_state") == "oversold", F.lit(False))).otherwise((histogram < 0) | F.coalesce(F.col("entry_rsi_state") == "overbought", F.lit(False)))
    points = {
        "bias": F.when(agrees(htf), F.when(F.col("trend_source") == "adx", 25).otherwise(12)).when(htf == "sideways", 8).otherwise(0),
        "alignment": F.when(agrees(F.col("direction")), F.when(coherent, 15).otherwise(8)).when(F.col("direction") == "sideways", 6).otherwise(0),
        "strength": F.when(adx >= 30, 10).when(adx >= 22, 7).when(adx >= 18, 3).otherwise(0),
        "headroom": F.when(F.when(up, rsi < 68).otherwise(rsi > 32), 10).otherwise(2),
        "participation": F.when(volume > 1.2, 5).when(volume > 0.7, 3).otherwise(0) + F.when(flow, 5).otherwise(0),
        "reward": F.when(reward >= h.least_reward * 1.5, 20).when(reward >= h.least_reward, 15).when(reward >= 1.5, 7).otherwise(0),
        "divergence": F.when(against, 0).otherwise(10),
        "confirmation": F.when(turned, 5).otherwise(0),
        "stop": F.when(F.col("stop_capped"), -12).otherwise(0),
        "forced": F.when((forced if forced is not None else F.lit(False)) & ~agrees(htf), -15).otherwise(0),
        "counter_trend": F.when(F.col("strategy") == "reversal", -10).otherwise(0),
    }
    total = sum(points.values(), F.lit(0))
    return {f"points_{k}": v for k, v in points.items()} | {"confidence": F.when(F.col("entry").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), total))).otherwise(0)}


def plans(reads: DataFrame, h: Horizon, t: Thresholds | None = None, unit: Column | None = None) -> DataFrame:
    """Every read with its strategy, levels and confidence; one timeframe serves as all three."""
    x = with_read_states(reads, t).withColumn("bias", F.when(F.col("direction") == "down", "short").otherwise("long"))
    x = x.withColumn("_c", choose(t)).select("*", "_c.*").drop("_c")
    x = with_levels(x, h, unit)
    x = x.withColumns({"trend_direction": F.col("direction"), "trend_source": F.col("direction_source"), "entry_histogram": F.col("histogram"), "entry_rsi_state": F.col("rsi_state")})
    return x.withColumns(confidence(h)).drop("trend_direction", "trend_source", "entry_histogram", "entry_rsi_state")


def framed_reads(entry: DataFrame, structure: DataFrame, trend: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """symbol, ts, and the reads entry, structure and trend that are known at every entry bar, as structs.

    The higher frames' reads are those of their last bar that is surely closed: of the bars that
    began before the entry bar the newest may still be forming. Bars without a read in one of the
    frames are left out. Each frame is read once and joined on (symbol, position).
    """
    read = lambda bars, name: with_read_states(slice_reads(bars), t).select("symbol", "bar_idx", "ts", F.struct("*").alias(name))
    out = read(entry, "entry").drop("bar_idx")
    for name, bars in (("structure", structure), ("trend", trend)):
        closed = asof_excluding_forming(entry, bars, idx="_at").filter("_at IS NOT NULL")
        known = read(bars, name).select(F.col("symbol").alias("_symbol"), F.col("bar_idx").alias("_idx"), name)
        found = closed.join(known, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("_at") == F.col("_idx"))).select(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts"), name)
        out = out.join(found, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("ts") == F.col("_ts"))).drop("_symbol", "_ts")
    return out


def framed_plans(reads: DataFrame, h: Horizon, t: Thresholds | None = None, forced: str | None = None, unit: Column | None = None) -> DataFrame:
    """Plans of ``framed_reads``: the trend frame gives the bias (unless ``forced``), the structure frame strategy and levels, the entry frame the confirmation.

    Returns symbol, ts, structure's columns, bias, strategy, timing, side, the levels and the points. A plan
    whose reward lies below the horizon's least carries ``poor_reward``; one that a forced bias sets against
    the trend ``against_trend``.
    """
    lean = F.when(F.col("trend.direction") == "down", "short").otherwise("long")
    own = [F.col(f"structure.{f.name}") for f in reads.schema["structure"].dataType if f.name not in ("symbol", "ts")]
    high = {"trend_direction": "trend.direction", "trend_source": "trend.direction_source", "entry_histogram": "entry.histogram", "entry_rsi_state": "entry.rsi_state", "structure_ts": "structure.ts", "trend_ts": "trend.ts"}
    x = reads.select("symbol", "ts", (F.lit(forced) if forced else lean).alias("bias"), lean.alias("lean"), *[F.col(c).alias(k) for k, c in high.items()], *own)
    x = x.withColumn("_c", choose(t)).select("*", "_c.*").drop("_c")
    x = with_levels(x, h, unit).withColumns(confidence(h, F.lit(forced is not None)))
    return x.withColumns({"poor_reward": F.coalesce(F.col("reward_risk") < h.least_reward, F.lit(False)), "against_trend": F.col("bias") != F.col("lean")}).drop("lean")


def iv_to_atr(iv: Column, price: Column, bars_per_year: float, atrs: Column, ivs: Column, prices: Column) -> Column:
    """An annualised implied volatility in units of the ATR, scaled by the trailing means; null below sixty values."""
    sigma = lambda v, p: v / 100 / F.sqrt(F.lit(float(bars_per_year))) * p
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v) / F.size(xs)
    raw, real = mean(F.zip_with(ivs, prices, sigma)), mean(atrs)
    return F.when((iv > 0) & (price > 0) & (F.size(atrs) >= 60) & (raw > 0) & (real > 0), sigma(iv, price) * (real / raw))


PENDING = 5  # bars that an order waits


def outcomes(bars: DataFrame, orders: DataFrame, hold: int = 60, cost: float = 0.001, pending: int = PENDING) -> DataFrame:
    """Fill and exit of each order: the order's columns, entry_ts, entry_price, exit_ts, exit_price, result_r, outcome, bars_held, resume.

    ``bars`` carry bar_idx and, for confirmations, histogram; ``orders`` symbol, bar_idx, side,
    timing, entry, zone_low, zone_high, stop, target, and any key. Each bar looks at a bounded number
    of bars behind it, gathered by one window, so no join of ranges is needed. A confirmation waits
    for the histogram to flip; limit and stop orders wait ``pending`` bars; a fill outside the zone or
    behind the stop ends the order. The stop wins a bar that meets both. Orders without a fill give no row.
    """
    series = Window.partitionBy("symbol").orderBy("bar_idx")
    far = 2 * pending + hold + 3
    kept = F.struct("bar_idx", "ts", "open", "high", "low", "close", "histogram", F.lag("histogram").over(series).alias("before"))
    b = bars.withColumn("_bar", kept).withColumns({"_ahead": F.collect_list("_bar").over(series.rowsBetween(1, far)), "_last": F.max("bar_idx").over(Window.partitionBy("symbol"))})
    x = orders.join(b.select("symbol", "bar_idx", "_ahead", "_last"), ["symbol", "bar_idx"])
    long, i = F.col("side") == "long", F.col("bar_idx")
    flips = F.filter("_ahead", lambda v: (v["bar_idx"] <= F.least(i + pending, F.col("_last") - 1)) & F.when(long, (v["histogram"] > 0) & (v["before"] <= 0)).otherwise((v["histogram"] < 0) & (v["before"] >= 0)))
    begin = F.when(F.col("timing") == "wait-confirmation", F.try_element_at(flips, F.lit(1))["bar_idx"] + 1).otherwise(i + 1)
    x = x.withColumn("_begin", begin)
    order = F.when(F.col("timing").isin("enter-now", "wait-confirmation"), "market").when(F.col("timing") == "wait-breakout", "stop").otherwise("limit")
    x = x.withColumn("_kind", order)
    below = (F.col("_kind") == "limit") == long  # a long limit and a short stop wait below
    price = lambda v: F.when(F.col("_kind") == "market", v["open"]).when(below, F.when(v["low"] <= F.col("entry"), F.least("entry", v["open"]))).otherwise(F.when(v["high"] >= F.col("entry"), F.greatest("entry", v["open"])))
    open_ = F.filter("_ahead", lambda v: (v["bar_idx"] >= F.col("_begin")) & (v["bar_idx"] <= F.least(F.col("_begin") + pending, F.col("_last") - 1)) & price(v).isNotNull())
    x = where(x.withColumn("_f", F.try_element_at(open_, F.lit(1))), F.col("_f").isNotNull()).withColumn("_fill", price(F.col("_f")))
    outside = (F.col("_fill") < F.col("zone_low") * 0.999) | (F.col("_fill") > F.col("zone_high") * 1.001)
    x = where(x, ~outside & F.when(long, F.col("_fill") > F.col("stop")).otherwise(F.col("_fill") < F.col("stop")))
    hit = lambda v, p, adverse: F.when(long == F.lit(adverse), v["low"] <= p).otherwise(v["high"] >= p)
    live = F.filter("_ahead", lambda v: (v["bar_idx"] > F.col("_f.bar_idx")) & (v["bar_idx"] <= F.col("_f.bar_idx") + hold))
    x = x.withColumn("_live", live).withColumn("_x", F.try_element_at(F.filter("_live", lambda v: hit(v, F.col("stop"), True) | hit(v, F.col("target"), False)), F.lit(1)))
    x = x.withColumn("_z", F.coalesce("_x", F.try_element_at("_live", F.lit(-1)), "_f"))
    kind = F.when(F.col("_x").isNull(), "timeout").when(hit(F.col("_x"), F.col("stop"), True), "stop").otherwise("target")
    x = x.withColumn("outcome", kind).withColumn("_leave", F.when(F.col("outcome") == "stop", F.col("stop")).when(F.col("outcome") == "target", F.col("target")).otherwise(F.col("_z.close")))
    risk, move = F.abs(F.col("_fill") - F.col("stop")), F.when(long, F.col("_leave") - F.col("_fill")).otherwise(F.col("_fill") - F.col("_leave"))
    x = x.withColumns(
        {
            "entry_ts": F.col("_f.ts"),
            "entry_price": rounded("_fill", 6),
            "exit_ts": F.col("_z.ts"),
            "exit_price": rounded("_leave", 6),
            "result_r": rounded(move / risk - cost * F.col("_fill") / risk),
            "bars_held": (F.col("_z.bar_idx") - F.col("_f.bar_idx")).cast("int"),
            "resume": F.col("_z.bar_idx") + 1,
        }
    )
    return x.drop(*[c for c in x.columns if c.startswith("_")])


def one_at_a_time(trades: DataFrame, keys: list[str]) -> DataFrame:
    """The trades of each key that a single position can take, the earliest decision first.

    Which trade is next depends on the last one taken, so a key's decisions are walked in order; two
    integers a decision go through one task.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, keep, free = part.sort_values("bar_idx"), [], -1
        for at, resume in zip(part["bar_idx"], part["resume"], strict=True):
            keep.append(at >= free)
            free = resume if at >= free else free
        return part[keep]

    kinds = ", ".join(f"{k} {trades.schema[k].dataType.simpleString()}" for k in keys)
    taken = trades.select(*keys, "bar_idx", "resume").groupBy(*keys).applyInPandas(run, f"{kinds}, bar_idx long, resume long")
    return trades.join(taken.drop("resume"), [*keys, "bar_idx"], "left_semi")


WARM_UP = 60


def walk_forward(bars: DataFrame, reads: DataFrame, horizon: str, t: Thresholds | None = None, hold: int = 60, cost: float = 0.001, step: int = 1, unit: str | None = None) -> DataFrame:
    """Trades of one series on one horizon, decided on closed bars alone.

    ``bars`` carry bar_idx and histogram, ``reads`` are slice_reads of the same series, with a column
    ``unit`` where a volatility unit replaces the ATR. The structure at bar i is the read two bars
    before: the bar before may still be forming.
    """
    h = HORIZONS[horizon]
    last = bars.groupBy("symbol").agg((F.max("bar_idx") - 2).alias("_until"))
    closed = reads.withColumn("bar_idx", F.col("bar_idx") + 2).filter(F.col("bar_idx") > WARM_UP).filter((F.col("bar_idx") - WARM_UP) % step == 0)
    planned = plans(closed.join(last, "symbol").filter("bar_idx <= _until"), h, t, F.col(unit) if unit else None)
    reward = F.abs(F.col("target") - F.col("entry")) / F.abs(F.col("entry") - F.col("stop"))
    orders = where(planned, F.col("entry").isNotNull() & (F.size("targets") > 0) & (reward >= h.least_reward))
    orders = orders.select("symbol", "bar_idx", F.lit(horizon).alias("horizon"), "side", "strategy", "timing", "entry", "zone_low", "zone_high", "stop", "target", "confidence")
    return one_at_a_time(outcomes(bars, orders, hold, cost), ["symbol", "horizon"])


def signature(trades: DataFrame) -> DataFrame:
    """One row: trades, expectancy_r, win_rate and trades by strategy."""
    by = trades.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum("result_r").alias("r"), F.count_if(F.col("result_r") > 0).alias("wins"))
    total = by.agg(F.sum("n").alias("trades"), F.sum("r").alias("r"), F.sum("wins").alias("wins"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("strategy", "n")))).alias("by_strategy"))
    return total.select("trades", rounded(F.col("r") / F.col("trades")).alias("expectancy_r"), rounded(F.col("wins") / F.col("trades") * 100, 1).alias("win_rate"), "by_strategy")
