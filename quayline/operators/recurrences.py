"""Indicators whose value depends on the value before: affine maps, scanned inside blocks of a symbol's bars and then over its blocks.

A smoothed value is a factor times the value before plus a summand, so a block of bars is such a map
too. Tasks hold one block of one symbol; one row a block and series carries on to the next.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.operators import windows as w
from quayline.storage import materialise

NAMES = ("ema12", "ema26", "macd", "signal", "histogram", "rsi14", "stoch_rsi_k", "stoch_rsi_d", "atr14", "atr_pct", "keltner_upper", "keltner_lower", "adx14", "plus_di", "minus_di")
BLOCK = 1 << 14  # bars of a symbol that one task scans
_WIDTH = 64
#: name: input, values in the seed, weight of the newest value, first bar with an input
FIRST = {
    "_e12": ("close", 12, 2 / 13, 0),
    "_e26": ("close", 26, 2 / 27, 0),
    "_e20": ("close", 20, 2 / 21, 0),
    "_gain": ("_up", 14, 1 / 14, 1),
    "_loss": ("_down", 14, 1 / 14, 1),
    "_atr14": ("_range", 14, 1 / 14, 0),
    "_atr10": ("_range", 10, 1 / 10, 0),
    "_plus": ("_plus_move", 14, 1 / 14, 1),
    "_minus": ("_minus_move", 14, 1 / 14, 1),
    "_wide": ("_moved_range", 14, 1 / 14, 1),
}
SECOND = {"_signal": ("_macd", 9, 2 / 10, 25), "_adx": ("_dx", 14, 1 / 14, "_dx_from")}


def affine_scan(b: np.ndarray, a: float) -> np.ndarray:
    """v[k] = a v[k-1] + b[k] from 0: rows of WIDTH values at once, then their ends in the same way."""
    n = len(b)
    if n <= _WIDTH:
        k = np.arange(n)
        return np.tril(a ** np.maximum(k[:, None] - k, 0)) @ b
    rows = np.zeros(-(-n // _WIDTH) * _WIDTH)
    rows[:n] = b
    rows = rows.reshape(-1, _WIDTH)
    k = np.arange(_WIDTH)
    local = rows @ np.tril(a ** np.maximum(k[:, None] - k, 0)).T
    carry = np.append(0.0, affine_scan(local[:, -1], a**_WIDTH)[:-1])
    return (local + carry[:, None] * a ** (k + 1)).ravel()[:n]


def smooth_map(x: np.ndarray, n: int, alpha: float, first: float, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands that give the smoothed values of bars ``start`` on from the value before them.

    The mean of the n values from bar ``first`` on seeds the smoothing: until it is complete a value is the
    sum so far over n. What is missing inside stays missing from there on.
    """
    at = np.arange(start, start + len(x))
    lost = np.logical_or.accumulate(np.isnan(x) & (at >= first))
    x = np.where(np.isnan(x), 0.0, x)
    seeding = at <= first + n - 1
    m = int(seeding.sum())
    factor, summand = np.ones(len(x)), np.cumsum(np.where(seeding & (at >= first), x / n, 0.0))
    if m < len(x):
        rest = 1 - alpha
        factor[m:] = rest ** np.arange(1, len(x) - m + 1)
        summand[m:] = affine_scan(alpha * x[m:], rest) + factor[m:] * (summand[m - 1] if m else 0.0)
    summand[lost] = np.nan
    return factor, summand


def smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential smoothing of one whole array from its first value on, seeded by the mean of n."""
    there = np.flatnonzero(~np.isnan(x))
    first = there[0] if len(there) else np.inf
    _, out = smooth_map(x, n, alpha, first)
    out[: int(min(len(x), first + n - 1))] = np.nan
    return out


def _maps(part: pd.DataFrame, series: Mapping[str, tuple]) -> pd.DataFrame:
    """One block's bars with the maps of every series."""
    part = part.sort_values("_idx")
    start, out = int(part["_idx"].iloc[0]), {}
    for name, (source, n, alpha, first) in series.items():
        since = part[first].iloc[0] if isinstance(first, str) else first
        since = np.inf if pd.isna(since) else float(since)
        out[f"{name}_a"], out[f"{name}_b"] = smooth_map(part[source].to_numpy(dtype=float), n, alpha, since, start)
    return part.assign(**out)


def _over_blocks(part: pd.DataFrame, series: Mapping[str, tuple]) -> pd.DataFrame:
    """What every block but the first starts from: the maps of the blocks before, one after the other."""
    part = part.sort_values("_block").iloc[:-1]
    out = {"_key": part["_key"], "_block": part["_block"] + 1}
    for name in series:
        value, values = 0.0, []
        for a, b in zip(part[f"{name}_a"], part[f"{name}_b"]):
            value = a * value + b
            values.append(value)
        out[f"{name}_in"] = values
    return pd.DataFrame(out)


def smoothed(rows: DataFrame, series: Mapping[str, tuple], label: str) -> DataFrame:
    """rows (with _key, _idx, _block) and the smoothed value of every series, null until its seed is complete."""
    doubles = [f"{n}_{x}" for n in series for x in "ab"]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in doubles)])
    mapped = materialise(rows.groupBy("_key", "_block").applyInPandas(lambda part: _maps(part, series), schema), label)
    begins = {n: F.lit(0.0) for n in series}
    whole = mapped
    if not mapped.filter("_block > 0").isEmpty():
        ends = mapped.groupBy("_key", "_block").agg(*[F.max_by(c, "_idx").alias(c) for c in doubles])
        kind = ", ".join(["_key string, _block long", *(f"{n}_in double" for n in series)])
        whole = mapped.join(ends.groupBy("_key").applyInPandas(lambda part: _over_blocks(part, series), kind), ["_key", "_block"], "left")
        begins = {n: F.coalesce(f"{n}_in", F.lit(0.0)) for n in series}
    value = lambda n, first, size: F.when(F.col("_idx") >= (F.col(first) if isinstance(first, str) else F.lit(first)) + size - 1, F.col(f"{n}_a") * begins[n] + F.col(f"{n}_b"))
    found = {n: value(n, first, size) for n, (_, size, _, first) in series.items()}
    return whole.select(*rows.columns, *[F.when(~F.isnan(v), v).alias(n) for n, v in found.items()])


def _directional_moves() -> dict[str, Column]:
    up, down = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    moved = F.col("_pc").isNotNull()
    return {
        "_up": F.greatest(F.col("close") - F.col("_pc"), F.lit(0.0)),
        "_down": F.greatest(F.col("_pc") - F.col("close"), F.lit(0.0)),
        "_range": w.true_range(),
        "_plus_move": F.when(moved, F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "_minus_move": F.when(moved, F.when((down > up) & (down > 0), down).otherwise(0.0)),
        "_moved_range": F.when(moved, w.true_range()),
    }


def indicators(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """bars with the columns NAMES, null until each look-back is full."""
    series = w.series()
    key = F.to_json(F.struct("symbol")).alias("_key")  # a symbol that is null has bars too
    placed = bars.select("*", key, (F.row_number().over(series) - 1).cast("long").alias("_idx"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("_bars"), *[F.lag(c).over(series).alias(f"_p{c[0]}") for c in ("close", "high", "low")])
    placed = placed.withColumns(_directional_moves()).withColumn("_block", F.floor(F.col("_idx") / block).cast("long")).drop("_pc", "_ph", "_pl")
    x = smoothed(placed, FIRST, "recurrences-first").drop(*{s[0] for s in FIRST.values() if s[0] != "close"})

    ratio = lambda a, b: F.when(b != 0, 100 * a / b)
    pdi, mdi = F.col("_pdi"), F.col("_mdi")
    x = x.withColumns({"_macd": F.col("_e12") - F.col("_e26"), "_pdi": ratio(F.col("_plus"), F.col("_wide")), "_mdi": ratio(F.col("_minus"), F.col("_wide"))})
    x = x.withColumn("_dx", F.when(pdi + mdi == 0, 0.0).otherwise(100 * F.abs(pdi - mdi) / (pdi + mdi)))
    x = x.withColumn("_dx_from", F.min(F.when(F.col("_dx").isNotNull(), F.col("_idx"))).over(Window.partitionBy("symbol")))
    x = smoothed(x, SECOND, "recurrences-second")

    rsi = F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    x = x.withColumn("rsi14", rsi)
    high, low = F.max("rsi14").over(w.back(14)), F.min("rsi14").over(w.back(14))
    x = x.withColumn("_raw", w.full(F.when(high == low, 50.0).otherwise((F.col("rsi14") - low) / (high - low) * 100), "rsi14", 14))
    x = x.withColumn("stoch_rsi_k", w.sma("_raw", 3)).withColumn("stoch_rsi_d", w.sma("stoch_rsi_k", 3))
    enough = F.col("_bars") >= 28
    values = {
        "ema12": F.col("_e12"),
        "ema26": F.col("_e26"),
        "macd": F.col("_macd"),
        "signal": F.col("_signal"),
        "histogram": F.col("_macd") - F.col("_signal"),
        "atr14": F.col("_atr14"),
        "atr_pct": F.col("_atr14") / F.col("close") * 100,
        "keltner_upper": F.col("_e20") + 1.5 * F.col("_atr10"),
        "keltner_lower": F.col("_e20") - 1.5 * F.col("_atr10"),
        "adx14": F.when(enough, F.col("_adx")),
        "plus_di": F.when(enough, pdi),
        "minus_di": F.when(enough, mdi),
    }
    x = x.withColumns(values)
    return x.select(*bars.columns, *NAMES)
