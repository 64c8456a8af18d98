"""The market read of every bar on its own trailing slice.

Recurrences are seeded where their input begins, so a read on the last 260 bars is not the read on
the whole series. The reads of all bars of a symbol are dealt out in blocks of bars, each with the
bars before it that its slices reach back to; a block's slices are walked together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.operators.bars import with_index

SLICE = 260
BLOCK = 512  # bars whose slices one task walks together
SIDE = 3  # bars on either side of a swing point
MOST = 4  # levels on either side
LEVEL = "array<struct<price:double,touches:int>>"
READ = (
    "price double, bars int, adx double, plus_di double, minus_di double, rsi double, ema20 double, ema50 double, ema200 double, atr double, macd double, histogram double, histogram_before double, "
    "squeeze boolean, squeeze_before boolean, slope double, donchian_high double, donchian_low double, relative_volume double, obv_change double, vwap double, stoch_rsi_k double, "
    f"structure string, swing_high double, swing_low double, support {LEVEL}, resistance {LEVEL}, divergences array<string>"
)


def _seeded(x: np.ndarray, n: int, alpha: float, first: int = 0) -> np.ndarray:
    """Exponential smoothing of each row from column ``first`` on, seeded by the mean of its first n values."""
    out = np.full(x.shape, np.nan)
    at = first + n - 1
    if x.shape[1] <= at:
        return out
    value = out[:, at] = x[:, first : at + 1].mean(1)
    for k in range(at + 1, x.shape[1]):
        value = out[:, k] = value + alpha * (x[:, k] - value)
    return out


def _recurrences(o: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Recurrent indicators of slices (rows) at every bar (columns)."""
    high, low, close = o["high"], o["low"], o["close"]
    move = np.diff(close, axis=1, prepend=close[:, :1])
    gain, loss = _seeded(np.maximum(move, 0), 14, 1 / 14, 1), _seeded(np.maximum(-move, 0), 14, 1 / 14, 1)
    before = np.concatenate([close[:, :1], close[:, :-1]], 1)
    tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    tr[:, 0] = high[:, 0] - low[:, 0]
    up, down = np.diff(high, axis=1, prepend=high[:, :1]), -np.diff(low, axis=1, prepend=low[:, :1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    p, m, t = (_seeded(x, 14, 1 / 14, 1) for x in (plus, minus, tr))
    fast, slow = _seeded(close, 12, 2 / 13), _seeded(close, 26, 2 / 27)
    macd = fast - slow
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(np.isnan(loss), np.nan, np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss)))
        pdi, mdi = np.where(t != 0, 100 * p / t, np.nan), np.where(t != 0, 100 * m / t, np.nan)
        dx = np.where(np.isnan(pdi), np.nan, np.where(pdi + mdi == 0, 0.0, 100 * np.abs(pdi - mdi) / (pdi + mdi)))
    return {
        "adx": _seeded(np.nan_to_num(dx), 14, 1 / 14, 14),
        "plus_di": pdi,
        "minus_di": mdi,
        "rsi": rsi,
        "ema20": _seeded(close, 20, 2 / 21),
        "ema50": _seeded(close, 50, 2 / 51),
        "ema200": _seeded(close, 200, 2 / 201),
        "atr": _seeded(tr, 14, 1 / 14),
        "atr10": _seeded(tr, 10, 1 / 10),
        "macd": macd,
        "histogram": macd - _seeded(macd, 9, 2 / 10, 25),
    }


def _swings(x: np.ndarray, sign: int) -> np.ndarray:
    """Places whose value no neighbour within SIDE exceeds, and which exceed one on each side."""
    if len(x) < 2 * SIDE + 1:
        return np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(x * sign, 2 * SIDE + 1)
    mid, left, right = w[:, SIDE : SIDE + 1], w[:, :SIDE], w[:, SIDE + 1 :]
    ok = (left <= mid).all(1) & (right <= mid).all(1) & (left < mid).any(1) & (right < mid).any(1)
    return np.flatnonzero(ok) + SIDE


def _half_up(x: float, digits: int = 4) -> float:
    return float(np.floor(x * 10.0**digits + 0.5) / 10.0**digits)


def _levels(prices: np.ndarray, price: float, atr_percent: float) -> tuple[list, list]:
    """Swing prices in ascending order join the open cluster while they lie within the tolerance of its first."""
    tolerance = min(max(1.5 if np.isnan(atr_percent) else atr_percent, 0.5), 4.0)
    clusters: list[list[float]] = []
    for p in np.sort(prices, kind="stable").tolist():
        if clusters and abs((p - clusters[-1][0]) / clusters[-1][0]) * 100 <= tolerance:
            clusters[-1].append(p)
        else:
            clusters.append([p])
    means = [(sum(c) / len(c), len(c)) for c in clusters]
    support = [(_half_up(p), n) for p, n in reversed(means) if p < price][:MOST]
    return support, [(_half_up(p), n) for p, n in means if p >= price][:MOST]


def _divergences(high: np.ndarray, low: np.ndarray, highs: np.ndarray, lows: np.ndarray, oscillator: np.ndarray) -> list[str]:
    """Kind and type of the disagreement of the last two swings with the oscillator; places are within the slice."""
    out = []
    for places, x, sign, name in ((highs[-2:], high, 1, "bearish"), (lows[-2:], low, -1, "bullish")):
        if len(places) == 2:
            (a, b), (oa, ob) = x[places] * sign, oscillator[places] * sign
            if b > a and ob < oa:
                out.append(f"regular {name}")
            elif b < a and ob > oa:
                out.append(f"hidden {name}")
    return out


def _read(part: pd.DataFrame, size: int, block: int) -> pd.DataFrame:
    """Reads of the bars of one block; the bars before it only serve the slices."""
    part = part.sort_values("bar_idx").reset_index(drop=True)
    x = {c: part[c].to_numpy(dtype=float) for c in ("open", "high", "low", "close", "volume")}
    ends = np.flatnonzero((part["bar_idx"] // block == part["block"]).to_numpy())
    names = [c.split()[0] for c in READ.split(", ")]
    if not len(ends):
        return pd.DataFrame(columns=["symbol", "ts", "bar_idx", *names])
    begins = np.maximum(0, ends + 1 - size)
    n = ends + 1 - begins
    at = np.minimum(begins[:, None] + np.arange(size), ends[:, None])  # short slices repeat their last bar behind it
    r = _recurrences({c: v[at] for c, v in x.items()})
    rows, last = np.arange(len(ends)), n - 1
    out = {c: r[c][rows, last] for c in ("adx", "plus_di", "minus_di", "rsi", "ema20", "atr", "macd", "histogram")}
    out["adx"] = np.where(n >= 28, out["adx"], np.nan)
    out |= {f"ema{k}": r[f"ema{k}"][rows, last] for k in (50, 200)}
    out["histogram_before"] = np.where(n > 1, r["histogram"][rows, np.maximum(last - 1, 0)], np.nan)
    close = x["close"]
    s = pd.DataFrame(x)
    back = lambda f, k: f(s, k).to_numpy()[ends]
    mid, sd = s["close"].rolling(20).mean(), s["close"].rolling(20).std(ddof=0)
    squeeze = np.full((2, len(ends)), np.nan)
    for k in (0, 1):
        e, col = ends - k, np.maximum(last - k, 0)
        m_, d_, a10, mean = mid.to_numpy()[e], sd.to_numpy()[e], r["atr10"][rows, col], r["ema20"][rows, col]
        known = ~(np.isnan(m_) | np.isnan(a10) | np.isnan(mean)) & (last - k >= 19)
        squeeze[k] = np.where(known, (m_ + 2 * d_ < mean + 1.5 * a10) & (m_ - 2 * d_ > mean - 1.5 * a10), np.nan)
    k = np.arange(20) - 9.5
    slope = np.full(len(ends), np.nan)
    window = np.lib.stride_tricks.sliding_window_view(close, 20) if len(close) >= 20 else np.zeros((0, 20))
    full = ends >= 19
    slope[full] = (window[ends[full] - 19] @ k) / (k @ k) / window[ends[full] - 19].mean(1) * 100
    typical = (x["high"] + x["low"] + x["close"]) / 3
    flow = np.cumsum(np.sign(np.diff(close, prepend=close[0])) * x["volume"])
    volume, money = s["volume"].rolling(20, min_periods=1).sum(), (pd.Series(typical) * s["volume"]).rolling(20, min_periods=1).sum()
    prior = s["volume"].rolling(20).mean().shift(1).to_numpy()[ends]
    with np.errstate(divide="ignore", invalid="ignore"):
        out |= {
            "price": close[ends],
            "bars": n,
            "slope": slope,
            "donchian_high": back(lambda d, z: d["high"].rolling(z).max(), 20),
            "donchian_low": back(lambda d, z: d["low"].rolling(z).min(), 20),
            "relative_volume": np.where(prior > 0, x["volume"][ends] / prior, np.nan),
            "obv_change": flow[ends] - flow[np.maximum(ends - np.minimum(20, n - 1), 0)],
            "vwap": np.where(volume.to_numpy()[ends] > 0, money.to_numpy()[ends] / volume.to_numpy()[ends], np.nan),
        }
    rsi = pd.DataFrame(r["rsi"].T)
    top, bottom = rsi.rolling(14).max(), rsi.rolling(14).min()
    raw = ((rsi - bottom) / (top - bottom).where(top != bottom) * 100).where(top != bottom, 50.0).where(top.notna())
    out["stoch_rsi_k"] = raw.rolling(3).mean().to_numpy().T[rows, last]
    out["squeeze"], out["squeeze_before"] = (pd.Series([None if np.isnan(v) else bool(v) for v in q], dtype=object) for q in squeeze)
    highs, lows = _swings(x["high"], 1), _swings(x["low"], -1)
    found = []
    for no, (b, e) in enumerate(zip(begins, ends, strict=True)):
        own = [p[np.searchsorted(p, b + SIDE) : np.searchsorted(p, e - SIDE, side="right")] for p in (highs, lows)]
        recent = [p[np.searchsorted(p, max(b, e - 59) + SIDE) :] - b for p in own]
        h, w = x["high"][own[0]], x["low"][own[1]]
        if len(h) < 2 or len(w) < 2:
            label = "unclear"
        else:
            label = ("HH" if h[-1] > h[-2] else "LH") + "-" + ("HL" if w[-1] > w[-2] else "LL")
        support, resistance = _levels(np.concatenate([h, w]), close[e], out["atr"][no] / close[e] * 100 if close[e] else np.nan)
        found.append((label, h[-1] if len(h) else np.nan, w[-1] if len(w) else np.nan, support, resistance, _divergences(x["high"][b:], x["low"][b:], *recent, r["rsi"][no])))
    out |= dict(zip(("structure", "swing_high", "swing_low", "support", "resistance", "divergences"), zip(*found, strict=True), strict=True))
    keys = part.iloc[ends][["symbol", "ts", "bar_idx"]].reset_index(drop=True)
    return pd.concat([keys, pd.DataFrame({c: out[c] for c in names})], axis=1)


def slice_reads(bars: DataFrame, size: int = SLICE, least: int = 30, block: int = BLOCK) -> DataFrame:
    """symbol, ts, bar_idx and the numbers of the read of every bar on its last ``size`` bars.

    Slices of fewer than ``least`` bars give no read; numbers are null until their look-back is full.
    """
    kind = f"{bars.schema['symbol'].dataType.simpleString()}"
    numbered = with_index(bars).select("symbol", "ts", F.col("bar_idx").cast("long").alias("bar_idx"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    reach = F.sequence(F.floor(F.col("bar_idx") / block), F.floor((F.col("bar_idx") + size - 1) / block))
    dealt = numbered.withColumn("block", F.explode(reach))
    schema = f"symbol {kind}, ts {bars.schema['ts'].dataType.simpleString()}, bar_idx long, {READ}"
    out = dealt.groupBy("symbol", "block").applyInPandas(lambda part: _read(part, size, block), schema)
    doubles = [f.name for f in out.schema if f.dataType.simpleString() == "double"]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}).filter(F.col("bars") >= least)
