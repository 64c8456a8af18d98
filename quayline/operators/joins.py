"""Alignment joins as equi-joins: no range or nested-loop joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_excluding_forming(base: DataFrame, higher: DataFrame, time: str = "ts", idx: str = "higher_idx") -> DataFrame:
    """For each base bar, the index of the last higher-timeframe bar that is surely closed.

    Of the higher bars strictly before the base bar the newest may still be forming and is left
    out; null where none remains. Both sides are laid into one order and counted, so there is one
    shuffle by symbol and no range join.
    """
    sides = base.select("symbol", F.col(time).alias("t"), F.lit(0).alias("side")).unionByName(higher.select("symbol", F.col(time).alias("t"), F.lit(1).alias("side")))
    order = Window.partitionBy("symbol").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    counted = sides.withColumn("n", F.sum("side").over(order)).filter("side = 0")
    return counted.select("symbol", F.col("t").alias(time), F.when(F.col("n") >= 2, F.col("n") - 2).alias(idx))


def value_at_hour(points: DataFrame, hours: DataFrame, ahead: int, name: str) -> DataFrame:
    """Left equi-join of ``points`` (symbol, ts) with the close ``ahead`` hours later."""
    later = hours.select(F.col("symbol").alias("_s"), (F.unix_timestamp("ts") / 3600).cast("long").alias("_h"), F.col("close").alias(name))
    key = (F.unix_timestamp("ts") / 3600).cast("long") + ahead
    return points.join(later, (F.col("symbol") == F.col("_s")) & (key == F.col("_h")), "left").drop("_s", "_h")


def by_position_from_end(left: DataFrame, right: DataFrame, time: str = "ts") -> DataFrame:
    """Pair the series of ``left`` with one benchmark series by position from the newest bar."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(time)))
    a = left.withColumn("pos", newest)
    b = right.withColumn("pos", newest).select("pos", F.col("close").alias("bench_close"))
    return a.join(b, "pos")


def merge_scores(vector: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two score lists; a missing side counts 0."""
    joined = vector.join(keyword, key, "full_outer")
    return joined.fillna(0.0, ["vector_score", "keyword_score"])
