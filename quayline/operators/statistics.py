"""Trade metrics and interval inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded


def trade_metrics(trades: DataFrame, group: str, order: Sequence[str], result: str = "result_r") -> DataFrame:
    """Counts, rates, means and drawdown of results in R for each group; the running peak starts at 0."""
    run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(result).cast("double")
    t = trades.withColumn("_r", r).withColumn("_equity", F.sum(r).over(run))
    t = t.withColumn("_peak", F.greatest(F.lit(0.0), F.max("_equity").over(run)))
    won, lost = F.col("_r") > 0, F.col("_r") < 0
    n = F.count(F.lit(1))
    return t.groupBy(group).agg(
        n.alias("n"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        rounded(F.count_if(won) / n * 100, 1).alias("win_rate"),
        rounded(F.avg("_r")).alias("expectancy"),
        rounded(F.avg(F.when(won, F.col("_r")))).alias("avg_win"),
        rounded(F.avg(F.when(lost, F.col("_r")))).alias("avg_loss"),
        rounded(F.sum("_r"), 2).alias("total_r"),
        rounded(F.max(F.col("_peak") - F.col("_equity")), 2).alias("max_drawdown_r"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}s") for o in ("target", "stop", "timeout")],
    )


def median_interval(bars: DataFrame) -> DataFrame:
    """Upper median of the gaps in (0.5, 24] hours, snapped to 1, 2, 4 or 8 (ties down); 8 without gaps."""
    gap = (F.unix_timestamp("ts") - F.lag(F.unix_timestamp("ts")).over(Window.partitionBy("symbol").orderBy("ts"))) / 3600
    gaps = bars.select("symbol", gap.alias("gap"))
    place = Window.partitionBy("symbol").orderBy("gap")
    inside = gaps.filter("gap > 0.5 AND gap <= 24").withColumn("i", F.row_number().over(place) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    median = inside.filter(F.col("i") == F.floor(F.col("n") / 2)).select("symbol", F.col("gap").alias("med"))
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(h) - F.col("med")).alias("d"), F.lit(h).alias("h")) for h in (1, 2, 4, 8)]))["h"]
    return bars.select("symbol").distinct().join(median, "symbol", "left").select("symbol", F.when(F.col("med").isNull(), 8).otherwise(near).alias("interval_hours"))
