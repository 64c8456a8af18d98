"""Levels, divergences, thinning, order fills and results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import windows as w
from quayline.operators.bars import with_index
from quayline.operators.scans import running_sums
from quayline.storage import materialise


def swings(bars: DataFrame, k: int = 3) -> DataFrame:
    """symbol, bar_idx, price, kind of every swing point; bars must carry bar_idx."""
    high, low = F.when(w.swing("high", k, True), F.struct(F.col("high").alias("price"), F.lit("high").alias("kind"))), F.when(w.swing("low", k, False), F.struct(F.col("low").alias("price"), F.lit("low").alias("kind")))
    found = bars.withColumn("_p", F.array_compact(F.array(high, low)))
    return found.select("*", F.explode("_p").alias("_s")).select(*bars.columns, "_s.price", "_s.kind")


def levels(bars: DataFrame, tolerance: float | None = None, half_life: float = 50.0, most: int = 5, k: int = 3) -> DataFrame:
    """Nearest support and resistance of each symbol: symbol, side, rank, price, touches, strength.

    Swing prices in ascending order join the open cluster while they lie within ``tolerance`` percent
    of its first price: by default the newest ``atr_pct``, from 0.5 to 4, or 1.5 without one. Old touches keep a quarter of their weight. The fold runs over one symbol's
    swings of the given bars: pass a tail of the series, not all of it.
    """
    numbered = with_index(bars)
    noise = F.lit(float(tolerance)) if tolerance is not None else F.least(F.greatest(F.coalesce(F.max_by("atr_pct", "bar_idx"), F.lit(1.5)), F.lit(0.5)), F.lit(4.0)) if "atr_pct" in bars.columns else F.lit(1.5)
    ends = numbered.groupBy("symbol").agg(F.max("bar_idx").alias("end"), F.max_by("close", "bar_idx").alias("now"), noise.alias("tolerance"))
    points = swings(numbered, k).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("price", "bar_idx"))).alias("points")).join(ends.select("symbol", "tolerance"), "symbol")
    kind = "array<struct<anchor:double,n:int,total:double,last:bigint>>"

    def step(acc: Column, p: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(top["anchor"].alias("anchor"), (top["n"] + 1).alias("n"), (top["total"] + p["price"]).alias("total"), F.greatest(top["last"], p["bar_idx"].cast("long")).alias("last"))
        new = F.struct(p["price"].alias("anchor"), F.lit(1).alias("n"), p["price"].alias("total"), p["bar_idx"].cast("long").alias("last"))
        near = F.coalesce(F.abs(p["price"] - top["anchor"]) / top["anchor"] * 100 <= F.col("tolerance"), F.lit(False))
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new))).cast(kind)

    clusters = points.select("symbol", F.explode(F.aggregate("points", F.array().cast(kind), step)).alias("c")).join(ends, "symbol")
    price = F.col("c.total") / F.col("c.n")
    age = F.col("end") - F.col("c.last")
    out = clusters.select(
        "symbol",
        F.when(price < F.col("now"), "support").otherwise("resistance").alias("side"),
        rounded(price).alias("price"),
        F.col("c.n").alias("touches"),
        rounded(F.col("c.n") * (0.25 + 0.75 * F.pow(F.lit(0.5), age / half_life)), 3).alias("strength"),
    )
    near = Window.partitionBy("symbol", "side").orderBy(F.when(F.col("side") == "support", -F.col("price")).otherwise(F.col("price")))
    return out.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= most)


def divergences(bars: DataFrame, oscillator: str = "rsi14", k: int = 3) -> DataFrame:
    """symbol, type, kind, bars_ago: the last two swing highs and lows against an oscillator.

    Price and oscillator must disagree: against the price's extreme it is regular, with it hidden.
    """
    numbered = with_index(bars)
    ends = numbered.groupBy("symbol").agg(F.max("bar_idx").alias("end"))
    newest = F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc("bar_idx")))
    two = swings(numbered, k).withColumn("_n", newest).filter("_n <= 2").groupBy("symbol", F.col("kind").alias("side"))
    two = two.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("price", "bar_idx").alias("pa"),
        F.max_by("price", "bar_idx").alias("pb"),
        F.min_by(oscillator, "bar_idx").alias("oa"),
        F.max_by(oscillator, "bar_idx").alias("ob"),
        F.max("bar_idx").alias("at"),
    ).filter("n = 2")
    up, down = (F.col("pb") > F.col("pa")) & (F.col("ob") < F.col("oa")), (F.col("pb") < F.col("pa")) & (F.col("ob") > F.col("oa"))
    high = F.col("side") == "high"
    kind = F.when(up, F.when(high, "regular").otherwise("hidden")).when(down, F.when(high, "hidden").otherwise("regular"))
    found = two.withColumn("kind", kind).filter("kind IS NOT NULL").join(ends, "symbol")
    return found.select("symbol", F.when(F.col("side") == "high", "bearish").otherwise("bullish").alias("type"), "kind", (F.col("end") - F.col("at")).alias("bars_ago"))


def _left_block(part: pd.DataFrame) -> pd.DataFrame:
    """Where each row's pointers first leave the block: pointers inside it are doubled until none is left."""
    part = part.sort_values("_at")
    at, to = part["_at"].to_numpy(), part["_to"].to_numpy()
    first, out = at[0], to.copy()
    while (inside := out <= at[-1]).any():
        out[inside] = out[out[inside] - first]
    return part.assign(_to=out).drop(columns="_block")


def _marked_block(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block that its entry leads to."""
    part = part.sort_values("_at")
    at, to = part["_at"].to_numpy(), part["_to"].to_numpy()
    kept, k = [], int(np.argmax(part["_entry"].to_numpy())) if part["_entry"].any() else len(at)
    while k < len(at):
        kept.append(k)
        k = int(to[k] - at[0])
    return part.iloc[kept].drop(columns=["_block", "_to", "_entry"])


def thin(rows: DataFrame, key: str, time: str, spacing_seconds: int | Column, block: int = 1 << 16) -> DataFrame:
    """key, time (seconds): the times of each key kept greedily so that they lie at least so far apart.

    ``spacing_seconds`` may be a column that the key fixes. A kept time points to the first one that
    may follow it, found by counting the times before it. Pointers are followed inside blocks of
    times; between blocks what hangs from the first time is marked by pointer doubling: each round
    doubles how far the pointers reach and how many entries are marked, so the rounds grow with the
    logarithm of the blocks, and no task holds more than a block.
    """
    gap = F.lit(spacing_seconds) if isinstance(spacing_seconds, int) else spacing_seconds
    times = rows.select(key, F.col(time).cast("long").alias("_t"), gap.cast("long").alias("_gap")).distinct()
    asks = F.array(F.struct(F.col("_t").alias("x"), F.lit(1).cast("long").alias("counts")), F.struct((F.col("_t") + F.col("_gap")).alias("x"), F.lit(0).cast("long").alias("counts")))
    both = times.select(key, "_t", F.explode(asks).alias("_a")).select(key, "_t", F.col("_a.x").alias("_x"), F.col("_a.counts").alias("_counts"))
    placed = running_sums(both, key, ["_x", "_counts"], ["_counts"], [key, "_t", "_counts"], "thin-places")
    rank, after = F.max(F.when(F.col("_counts") == 1, F.col("run__counts"))), F.max(F.when(F.col("_counts") == 0, F.col("run__counts") + 1))
    links = placed.groupBy(key, "_t").agg(rank.alias("_at"), after.alias("_to")).withColumn("_block", F.floor((F.col("_at") - 1) / block))
    links = materialise(links, "thin-links")

    kind = rows.schema[key].dataType.simpleString()
    entries = links.filter("_at = 1").select(key, "_at")
    if not links.filter("_block > 0").isEmpty():
        far = links.drop("_t").groupBy(key, "_block").applyInPandas(_left_block, f"{key} {kind}, _at long, _to long")
        known = links.select(key, F.col("_at").alias("_to"))
        while not (far := materialise(far.join(known, [key, "_to"], "left_semi"), "thin-far")).isEmpty():
            entries = materialise(entries.unionByName(entries.join(far, [key, "_at"]).select(key, F.col("_to").alias("_at"))), "thin-entries")
            far = far.join(far.select(key, F.col("_at").alias("_to"), F.col("_to").alias("_next")), [key, "_to"]).select(key, "_at", F.col("_next").alias("_to"))
    flagged = links.join(entries.withColumn("_entry", F.lit(True)), [key, "_at"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(False)))
    kept = flagged.select(key, "_t", "_at", "_to", "_entry", "_block").groupBy(key, "_block").applyInPandas(_marked_block, f"{key} {kind}, _t long, _at long")
    return kept.select(key, F.col("_t").alias(time))


def fill_price(order: str, long: bool, price: Column) -> Column:
    """Price at which an order fills on a bar (open, high, low), null if it doesn't; gaps fill at the open."""
    o = F.col("open")
    if order == "market":
        return o
    below = (order == "limit") == long  # a long limit and a short stop wait below
    if below:
        return F.when(F.col("low") <= price, F.least(price, o))
    return F.when(F.col("high") >= price, F.greatest(price, o))


def result_r(entry: Column, stop: Column, leave: Column, long: bool, cost: float) -> Column:
    """Result in units of the risk, less the cost of the turnover."""
    risk = F.abs(entry - stop)
    move = leave - entry if long else entry - leave
    return rounded(move / risk - F.lit(cost) * entry / risk)
