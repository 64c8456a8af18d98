"""OHLCV bars: building, folding, cleaning. One DataFrame holds all symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")


def bars_from_ticks(ticks: DataFrame, keys: Sequence[str], order: Column, price: str = "price", volume: str = "volume") -> DataFrame:
    """One bar per key: first, highest, lowest and last price by ``order``, and the volume."""
    return ticks.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume")
    )


def fold(bars: DataFrame, keys: Sequence[str], time: str = "ts") -> DataFrame:
    """Merge the bars of each key into one that opens at the first bar's time."""
    return bars.groupBy(*keys).agg(
        F.min(time).alias(time),
        F.min_by("open", time).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", time).alias("close"),
        F.sum("volume").alias("volume"),
    )


def with_index(bars: DataFrame, time: str = "ts", name: str = "bar_idx") -> DataFrame:
    """Position of each bar in its symbol's series, from 0."""
    return bars.withColumn(name, F.row_number().over(Window.partitionBy("symbol").orderBy(time)) - 1)


def resample(bars: DataFrame, factor: int, time: str = "ts") -> DataFrame:
    """Fold every ``factor`` bars into one; a trailing partial group is kept."""
    numbered = with_index(bars, time).withColumn("grp", F.floor(F.col("bar_idx") / factor))
    return fold(numbered, ["symbol", "grp"], time).drop("grp")


def resample_sessions(bars: DataFrame, factor: int, time: str = "ts") -> DataFrame:
    """As resample, but counting anew each calendar day."""
    day = F.to_date(time)
    place = F.row_number().over(Window.partitionBy("symbol", "day").orderBy(time)) - 1
    numbered = bars.withColumn("day", day).withColumn("grp", F.floor(place / factor))
    return fold(numbered, ["symbol", "day", "grp"], time).drop("day", "grp")


def drop_synthetic(bars: DataFrame) -> DataFrame:
    """Without the bars that no trade made: no volume and one price."""
    flat = (F.col("volume") == 0) & (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return bars.filter(~flat)


def drop_incomplete(bars: DataFrame) -> DataFrame:
    """Only bars with four finite prices; a null volume becomes 0."""
    ok = F.lit(True)
    for c in OHLCV[:4]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return bars.filter(ok).fillna(0.0, ["volume"])


def drop_weekly_duplicate(weekly: DataFrame, time: str = "ts") -> DataFrame:
    """Where a symbol's last two bars fall into one week, the larger volume stays (a tie: the earlier)."""
    last = Window.partitionBy("symbol").orderBy(F.desc(time))
    ahead = Window.partitionBy("symbol").orderBy(time)
    week = F.date_trunc("week", time)
    marked = weekly.withColumns(
        {
            "_n": F.row_number().over(last),
            "_next": F.lead(week).over(ahead),
            "_next_volume": F.lead("volume").over(ahead),
            "_prior": F.lag(week).over(ahead),
            "_prior_volume": F.lag("volume").over(ahead),
        }
    )
    lost_prior = (F.col("_n") == 2) & (F.col("_next") == week) & (F.col("_next_volume") > F.col("volume"))
    lost_last = (F.col("_n") == 1) & (F.col("_prior") == week) & (F.col("_prior_volume") >= F.col("volume"))
    return marked.filter(~F.coalesce(lost_prior, F.lit(False)) & ~F.coalesce(lost_last, F.lit(False))).drop("_n", "_next", "_next_volume", "_prior", "_prior_volume")


def tail(bars: DataFrame, n: int, time: str = "ts", skip: int = 0) -> DataFrame:
    """The last n bars of each symbol, after leaving out the newest ``skip`` (forming) ones."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(time)))
    return bars.withColumn("_n", place).filter((F.col("_n") > skip) & (F.col("_n") <= n + skip)).drop("_n")
