"""Studies of what follows extreme values: each statistic against its own thinned population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators import windows as w
from quayline.operators.bootstrap import bootstrap_difference
from quayline.operators.structure import thin
from quayline.storage import materialise


def trailing_z(value: str, lookback: int = 90) -> Column:
    """Deviations of a value from the mean of the ``lookback`` values before it; null until they are there or where they are all one."""
    before = w.series().rowsBetween(-lookback, -1)
    sd = F.stddev_samp(value).over(before)
    return F.when((F.count(value).over(before) == lookback) & (sd > 0), (F.col(value) - F.avg(value).over(before)) / sd)


def observations(rates: DataFrame, prices: DataFrame, horizons: Sequence[int], lookback: int = 90) -> DataFrame:
    """symbol, time, z and forward (horizon in hours to move in percent) of every rate whose prices are all known and positive.

    ``rates`` has symbol, ts, rate; ``prices`` symbol, ts, close; a price is looked up by its hour.
    """
    hour = lambda c: F.floor(c.cast("timestamp").cast("long") / 3600)
    z = rates.withColumn("z", trailing_z("rate", lookback)).filter("z IS NOT NULL").select("symbol", F.col("ts").cast("timestamp").cast("long").alias("time"), "z", hour(F.col("ts")).alias("hour"))
    at = prices.filter("close > 0").groupBy("symbol", hour(F.col("ts")).alias("hour")).agg(F.max_by("close", "ts").alias("close"))
    asked = z.withColumn("h", F.explode(F.array(*[F.lit(h) for h in (0, *horizons)]))).withColumn("hour", F.col("hour") + F.col("h"))
    found = asked.join(at, ["symbol", "hour"]).groupBy("symbol", "time", "z").agg(F.map_from_entries(F.collect_list(F.struct("h", "close"))).alias("at"))
    found = found.filter(F.size("at") == len(horizons) + 1)
    moves = F.create_map(*[x for h in horizons for x in (F.lit(h), (F.col("at")[h] - F.col("at")[0]) / F.col("at")[0] * 100)])
    return found.select("symbol", "time", "z", moves.alias("forward"))


def pooled(found: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """horizon, time, symbol, z, move: the observations of all symbols, thinned to windows that don't overlap; of one time the first symbol stays."""
    first = found.groupBy("time").agg(F.min_by(F.struct("symbol", "z", "forward"), "symbol").alias("o"))
    each = first.select("time", "o.symbol", "o.z", F.explode("o.forward").alias("horizon", "move"))
    each = materialise(each, "study-moves")
    kept = thin(each, "horizon", "time", F.col("horizon").cast("long") * 3600)
    return each.join(kept, ["horizon", "time"])


def threshold_study(found: DataFrame, horizons: Sequence[int], thresholds: Sequence[float], split: int | None = None, resamples: int = 2000) -> DataFrame:
    """horizon, part, tail, threshold, n, baseline_n, mean, hit_rate, excess, low, high, clears.

    Observations are thinned first, so every statistic rests on windows that don't overlap. A cell
    is a horizon, a threshold and a tail, held against all thinned observations of the horizon;
    it clears if the interval of the difference leaves out zero. ``split`` (seconds) adds the upper
    tail beyond 2 before and after that time, each against its own part.
    """
    rows = materialise(pooled(found, horizons), "study-pooled")
    cells = [("all", tail, t) for t in thresholds for tail in ("high", "low")] + ([(part, "high", 2.0) for part in ("train", "test")] if split is not None else [])
    cell = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(tail).alias("tail"), F.lit(float(t)).alias("threshold")) for p, tail, t in cells])).alias("cell")
    every = rows.select("*", cell)
    if split is not None:
        every = every.filter((F.col("cell.part") == "all") | ((F.col("cell.part") == "train") == (F.col("time") < split)))
    every = every.withColumn("_g", F.concat_ws("|", F.col("horizon").cast("string"), "cell.part", "cell.tail", F.col("cell.threshold").cast("string")))
    inside = F.when(F.col("cell.tail") == "high", F.col("z") >= F.col("cell.threshold")).otherwise(F.col("z") <= -F.col("cell.threshold"))
    every = every.withColumn("_in", inside)
    plain = every.groupBy("_g", "horizon", "cell").agg(F.count_if("_in").alias("n"), F.count(F.lit(1)).alias("baseline_n"), rounded(F.avg(F.when(F.col("_in"), F.col("move")))).alias("mean"))
    drawn = bootstrap_difference(every, "_g", "move", "time", F.col("_in"), resamples=resamples).select("_g", "hit_rate", F.col("mean").alias("excess"), "low", "high")
    clears = F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)).alias("clears")
    return plain.join(drawn, "_g").select("horizon", "cell.*", "n", "baseline_n", "mean", "hit_rate", "excess", "low", "high", clears)


def findings(cells: DataFrame) -> DataFrame:
    """cells, cleared, expected: how many cells were tested, how many cleared zero, and how many would by chance."""
    whole = cells.filter("part = 'all'") if "part" in cells.columns else cells
    return whole.agg(F.count(F.lit(1)).alias("cells"), F.count_if("clears").alias("cleared"), rounded(F.count(F.lit(1)) * 0.05, 1).alias("expected"))


def forecast_rows(bars: DataFrame, implied: DataFrame, horizons: Sequence[int], warm: int = 260, year: int = 252) -> DataFrame:
    """One row a bar with what was known then and what came: symbol, bar_idx, iv, atr_annual, trailing_vol, iv_rank, vol_h, move_h, return_h, place, rows.

    ``bars`` has symbol, ts, high, low, close, bar_idx, atr_pct; ``implied`` symbol, ts, iv. place
    counts the symbol's rows from 0, rows is their number.
    """
    series, ahead = w.series(), lambda h: w.series().rowsBetween(1, h)
    x = bars.join(implied, ["symbol", "ts"], "left").withColumn("log_return", w.log_return())
    window = F.collect_list("iv").over(w.back(year))
    x = x.withColumns({"_known": F.size(window), "_below": F.size(F.filter(window, lambda v: v < F.col("iv"))), "trailing_vol": w.realized_vol(20, year), "_bars": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    for h in horizons:
        there = F.count("log_return").over(ahead(h)) == h
        later = F.lead("close", h).over(series)
        x = x.withColumns({
            f"vol_{h}": F.when(there, F.stddev_samp("log_return").over(ahead(h)) * F.sqrt(F.lit(float(year))) * 100),
            f"move_{h}": (F.max("high").over(ahead(h)) - F.min("low").over(ahead(h))) / F.col("close") * 100,
            f"return_{h}": (later - F.col("close")) / F.col("close") * 100,
        })
    ok = (F.col("bar_idx") >= warm) & (F.col("bar_idx") < F.col("_bars") - max(horizons) - 1) & (F.col("_known") >= 100)
    for c in ("iv", "atr_pct", "trailing_vol", *[f"vol_{h}" for h in horizons]):
        ok = ok & F.col(c).isNotNull()
    own = Window.partitionBy("symbol")
    x = x.filter(ok).withColumns({"place": F.row_number().over(series) - 1, "rows": F.count(F.lit(1)).over(own)})
    names = [f"{c}_{h}" for h in horizons for c in ("vol", "move", "return")]
    return x.select("symbol", "bar_idx", "iv", (F.col("atr_pct") * F.sqrt(F.lit(float(year)))).alias("atr_annual"), "trailing_vol", (F.col("_below") / F.col("_known") * 100).alias("iv_rank"), *names, "place", "rows")


def forecast_study(rows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """symbol, horizon, target, predictor, n_test, correlation, mae: scale and intercept fitted on the first half, tried on the second."""
    trial = lambda h, target, p, name: F.struct(F.lit(h).alias("horizon"), F.lit(target).alias("target"), F.lit(name).alias("predictor"), F.col(p).alias("x"), F.col(f"{target}_{h}").alias("y"))
    named = (("iv", "implied"), ("atr_annual", "range"), ("trailing_vol", "trailing"))
    trials = F.array(*[trial(h, t, p, name) for h in horizons for t in ("vol", "move") for p, name in named])
    x = rows.select("symbol", (F.col("place") < F.floor(F.col("rows") / 2)).alias("train"), F.explode(trials).alias("t")).select("symbol", "train", "t.*")
    key = ["symbol", "horizon", "target", "predictor"]
    fit = x.filter("train").groupBy(*key).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.covar_pop("x", "y").alias("_xy"), F.var_pop("x").alias("_xx"))
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(0.0)
    fit = fit.select(*key, slope.alias("_a"), (F.col("_my") - slope * F.col("_mx")).alias("_b"))
    tested = x.filter("not train").join(F.broadcast(fit), key)  # one row a symbol and trial, of the size of the symbol list
    return tested.groupBy(*key).agg(F.count(F.lit(1)).alias("n_test"), rounded(F.corr("x", "y")).alias("correlation"), rounded(F.avg(F.abs(F.col("_a") * F.col("x") + F.col("_b") - F.col("y")))).alias("mae"))


def rank_study(rows: DataFrame, horizons: Sequence[int], resamples: int = 2000) -> DataFrame:
    """symbol, horizon, bin, n, thinned_n, excess, low, high, clears: returns after calm, middle and panic ranks against all, every h-th row."""
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}").alias("move")) for h in horizons])
    x = rows.select("symbol", "place", "iv_rank", F.explode(each).alias("e")).select("symbol", "place", "iv_rank", "e.*").filter(F.col("place") % F.col("horizon") == 0)
    bins = F.array(*[F.struct(F.lit(n).alias("bin"), t.alias("inside")) for n, t in (("calm", F.col("iv_rank") < 20), ("middle", F.col("iv_rank").between(20, 80)), ("panic", F.col("iv_rank") > 80))])
    x = x.select("*", F.explode(bins).alias("b")).select("symbol", "horizon", "place", "move", "b.*")
    x = x.withColumn("_g", F.concat_ws("|", F.col("symbol").cast("string"), F.col("horizon").cast("string"), "bin"))
    plain = x.groupBy("_g", "symbol", "horizon", "bin").agg(F.count_if("inside").alias("n"), F.count(F.lit(1)).alias("thinned_n"))
    drawn = bootstrap_difference(x, "_g", "move", "place", F.col("inside"), resamples=resamples).select("_g", F.col("mean").alias("excess"), "low", "high")
    clears = F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)).alias("clears")
    return plain.join(drawn, "_g").select("symbol", "horizon", "bin", "n", "thinned_n", "excess", "low", "high", clears)


def agreement_study(points: DataFrame, venues: Sequence[str], effects: Sequence[float], daily_sd: float = 3.0, least: int = 30) -> DataFrame:
    """Whether venues agree with the first of them, and how large a sample an effect would need: one row an effect.

    ``points`` has venue, ts, value. Changes in percent from point to point meet by the hour, where all
    venues have one. Returns shared, correlation, sign_mismatch, flags, unconfirmed, first_sd,
    mean_sd, effect, needed, testable; statistics are null below ``least`` shared hours.
    """
    own = Window.partitionBy("venue").orderBy("ts")
    before = F.lag("value").over(own)
    hour = F.floor(F.col("ts").cast("timestamp").cast("double") / 3600 + 0.5)
    changes = points.withColumn("before", before).filter("before > 0").select("venue", "ts", hour.alias("hour"), ((F.col("value") - F.col("before")) / F.col("before") * 100).alias("d"))
    latest = changes.groupBy("hour", "venue").agg(F.max_by("d", "ts").alias("d"))
    wide = latest.groupBy("hour").agg(*[F.max(F.when(F.col("venue") == v, F.col("d"))).alias(f"d{k}") for k, v in enumerate(venues)])
    for k in range(len(venues)):
        wide = wide.filter(F.col(f"d{k}").isNotNull())
    first, mean = F.col("d0"), sum((F.col(f"d{k}") for k in range(1, len(venues))), F.col("d0")) / len(venues)
    other_way, flag = F.signum(first) != F.signum(mean), F.abs(first) > 1.0
    many = F.count(F.lit(1)) >= least
    said = wide.agg(
        F.count(F.lit(1)).alias("shared"),
        F.when(many, rounded(F.corr(first, mean), 3)).alias("correlation"),
        F.when(many, F.count_if((F.abs(mean) > 0.2) & other_way)).alias("sign_mismatch"),
        F.when(many, F.count_if(flag)).alias("flags"),
        F.when(many, F.count_if(flag & (other_way | (F.abs(mean) < 0.5)))).alias("unconfirmed"),
        F.when(many, rounded(F.stddev_samp(first), 3)).alias("first_sd"),
        F.when(many, rounded(F.stddev_samp(mean), 3)).alias("mean_sd"),
    )
    need = F.ceil(F.lit(2 * (1.96 + 0.84) ** 2) * F.pow(F.lit(daily_sd) / F.col("effect"), F.lit(2.0)))
    return said.withColumn("effect", F.explode(F.array(*[F.lit(float(e)) for e in effects]))).withColumn("needed", need).withColumn("testable", F.col("shared") >= F.col("needed"))
