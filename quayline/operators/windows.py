"""Window indicators: plain frames over each symbol's series, null until the look-back is full."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quayline.functions.numeric import col

def series():
    """A symbol's bars in order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


def back(n: int):
    """The last n bars with the current one."""
    return series().rowsBetween(-(n - 1), 0)


def full(value: Column, over: Column | str, n: int) -> Column:
    """value, once n non-null inputs stand in the window."""
    return F.when(F.count(col(over)).over(back(n)) == n, value)


def sma(c: Column | str, n: int) -> Column:
    return full(F.avg(col(c)).over(back(n)), c, n)


def roc(c: str, n: int) -> Column:
    then = F.lag(c, n).over(series())
    return F.when(then != 0, (F.col(c) - then) / then * 100)


def true_range() -> Column:
    before = F.lag("close", 1).over(series())
    wide = F.col("high") - F.col("low")
    return F.when(before.isNull(), wide).otherwise(F.greatest(wide, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def stochastic_raw(n: int = 14) -> Column:
    high, low = F.max("high").over(back(n)), F.min("low").over(back(n))
    return full(F.when(high == low, 50.0).otherwise((F.col("close") - low) / (high - low) * 100), "close", n)


def signed_volume() -> Column:
    """Volume with the sign of the close's change; its running sum is the on-balance volume."""
    before = F.lag("close", 1).over(series())
    return F.when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0.0)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(n: int | None = None) -> Column:
    """Volume-weighted typical price, cumulative or over the last n bars (fewer at the start)."""
    w = series().rowsBetween(Window.unboundedPreceding, 0) if n is None else back(n)
    volume = F.sum("volume").over(w)
    return F.when(volume != 0, F.sum(typical() * F.col("volume")).over(w) / volume)


def swing(column: str, k: int, high: bool) -> Column:
    """Whether a bar is a swing point: no neighbour within k bars beats it and each side has a worse one."""
    best, worst = (F.max, F.min) if high else (F.min, F.max)
    before, after = series().rowsBetween(-k, -1), series().rowsBetween(1, k)
    x = F.col(column)
    complete = (F.count(column).over(before) == k) & (F.count(column).over(after) == k)
    if high:
        return complete & (x >= best(column).over(before)) & (x >= best(column).over(after)) & (x > worst(column).over(before)) & (x > worst(column).over(after))
    return complete & (x <= best(column).over(before)) & (x <= best(column).over(after)) & (x < worst(column).over(before)) & (x < worst(column).over(after))


def realized_vol(n: int, bars_per_year: float) -> Column:
    """Annualised deviation of the last n log returns, in percent; expects column ``log_return``."""
    w = back(n)
    return F.when(F.count("log_return").over(w) == n, F.stddev_samp("log_return").over(w) * F.sqrt(F.lit(float(bars_per_year))) * 100)


def log_return() -> Column:
    before = F.lag("close", 1).over(series())
    return F.when((before > 0) & (F.col("close") > 0), F.log(F.col("close") / before))


def slope_pct(n: int) -> Column:
    """Least-squares slope of the last n closes in percent of their mean; expects ``bar_idx``."""
    w = back(n)
    return full(F.regr_slope("close", "bar_idx").over(w) / F.avg("close").over(w) * 100, "close", n)
