"""Deterministic bootstraps over blocks of values: draws are made anew at each block, partial sums meet by resample."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.functions.numeric import rounded
from quayline.operators.scans import running_sums
from quayline.storage import materialise

A, C, MASK = 1664525, 1013904223, 0xFFFFFFFF  # s <- (A s + C) mod 2^32
PERIOD = 1 << 32  # steps after which the generator is where it began
ROW = 1 << 12  # values in one row, 32 kB
BLOCK = 1 << 22  # values that a task draws from, 32 MB
DRAWS = 1 << 20  # draws that one row of work makes
STRIDE = 1 << 16  # draws of a large series that are made at once
SHARE = 1 << 28  # draws of a large series that one task makes at a block


def steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What 1 to n steps of the generator do to a state: factors and summands, by doubling."""
    a, c = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    a[0], c[0], done = A, C, 1
    mask = np.uint64(MASK)
    while done < n:
        m = min(done, n - done)
        a[done : done + m] = a[:m] * a[done - 1] & mask
        c[done : done + m] = (a[:m] * c[done - 1] + c[:m]) & mask
        done += m
    return a, c


def jumped(seed: int, n: int) -> int:
    """The generator's state after n steps, by squaring the step."""
    a, c, out_a, out_c = A, C, 1, 0
    while n:
        if n & 1:
            out_a, out_c = out_a * a % 2**32, (out_c * a + c) % 2**32
        a, c, n = a * a % 2**32, (c * a + c) % 2**32, n >> 1
    return (out_a * seed + out_c) % 2**32


def _places(a: np.ndarray, c: np.ndarray, state: int | np.ndarray, n: int) -> np.ndarray:
    """The places from 0 to n - 1 that the draws after a state fall on."""
    s = (a * np.uint64(state) if np.isscalar(state) else a[None, :] * state[:, None]) + c & np.uint64(MASK)
    return (s.astype(np.float64) / 2.0**32 * n).astype(np.int64)


def _whole(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Sums of resamples whose values lie in one block."""
    for batch in batches:
        out = []
        for g, s, n, offset, stride, first, count, values in batch.itertuples(index=False):
            v, (a, c) = np.asarray(values, float), steps(n)
            starts = np.array([jumped(seed, r * stride + offset) for r in range(first, first + count)], np.uint64)
            sums = v[_places(a, c, starts, n)].sum(1)
            out.append(pd.DataFrame({"_group": g, "_s": s, "r": np.arange(first, first + count), "part": sums / n}))
        yield pd.concat(out) if out else pd.DataFrame(columns=["_group", "_s", "r", "part"])


def stretches(starts: np.ndarray, n: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The generator's circle cut where one of the draws' windows of n steps begins or ends: begins and ends of the
    stretches that a window covers, and how often each window does (window, stretch)."""
    laps, rest = divmod(n, period)
    cuts = np.unique(np.r_[0, starts % period, (starts + rest) % period])
    ends = np.r_[cuts[1:], period]
    covers = np.empty((len(starts), len(cuts)), np.int16)
    for r, start in enumerate(starts):
        covers[r] = laps + ((cuts - start) % period < rest)
    met = covers.any(0)
    return cuts[met], ends[met], covers[:, met]


def _first_state(place: int, n: int) -> int:
    """The least state whose draw falls on the place or behind it."""
    scale, s = n / 2.0**32, min(PERIOD, place * PERIOD // n)
    while s < PERIOD and int(s * scale) < place:
        s += 1
    while s > 0 and int((s - 1) * scale) >= place:
        s -= 1
    return s


def _sum_of_draws(values: np.ndarray, base: int, n: int, state: int, count: int, a: np.ndarray, c: np.ndarray) -> float:
    """The sum of those of the ``count`` draws after a state that fall on the values, which stand at ``base`` of n."""
    low, high = _first_state(base, n), _first_state(base + len(values), n)
    whole, scale, total = high - low == PERIOD, n / 2.0**32, 0.0
    while count > 0:
        m = min(count, len(a))
        s = a[:m] * np.uint32(state) + c[:m]  # modulo 2^32 of itself
        state, count = int(s[-1]), count - m
        if not whole:
            s = s[s - np.uint32(low) < np.uint32(high - low)]
        total += values[(s * scale).astype(np.int64) - base].sum()
    return float(total)


def _at_block(key: tuple, rows: pd.DataFrame, seed: int, resamples: int, block: int, draws: int) -> pd.DataFrame:
    """Partial sums by resample of one share of a series' draws at one of its blocks.

    Windows of resamples that lie on the same steps of the generator share them: a series takes no more steps than the
    generator has states, however many draws there are.
    """
    n, offset, stride, shares = (int(rows[c].iloc[0]) for c in ("n", "offset", "stride", "shares"))
    values = np.concatenate([np.asarray(v, float) for v in rows.sort_values("row")["values"]])
    begins, ends, covers = stretches(np.arange(resamples, dtype=np.int64) * stride + offset, n, PERIOD)
    before = np.cumsum(ends - begins) - (ends - begins)
    whole = int((ends - begins).sum())
    low, high = whole * key[3] // shares, whole * (key[3] + 1) // shares
    a, c = (x.astype(np.uint32) for x in steps(min(draws, STRIDE)))
    sums = np.zeros(len(begins))
    for k in range(len(begins)):
        first, last = max(int(before[k]), low), min(int(before[k] + ends[k] - begins[k]), high)
        if first < last:
            sums[k] = _sum_of_draws(values, key[2] * block, n, jumped(seed, int(begins[k]) + first - int(before[k])), last - first, a, c)
    met = np.flatnonzero((before < high) & (before + ends - begins > low))
    part = np.zeros(resamples)
    for k in met:
        at = np.flatnonzero(covers[:, k])
        part[at] += covers[at, k] * sums[k]
    r = np.flatnonzero(covers[:, met].any(1))
    return pd.DataFrame({"_group": key[0], "_s": key[1], "r": r, "part": part[r] / n})


def _intervals(rows: DataFrame, group: str, resamples: int, seed: int, least: int, block: int, draws: int) -> DataFrame:
    """group, n, mean, hit_rate, low, high from rows of group, _s (0 the sample, 1 what it is held against), _o, _v."""
    rows = materialise(rows, "bootstrap-rows")  # read three times below
    named = rows.select(F.to_json(F.struct(group)).alias("_group"), F.col("_s").cast("long"), "_o", F.col("_v").cast("double"), F.lit(1).cast("long").alias("_one"))
    named = named.withColumn("_k", F.concat("_group", F.lit("|"), "_s"))
    placed = running_sums(named, "_k", ["_o"], ["_one"], ["_group", "_s", "_v"], "bootstrap-places").withColumn("at", F.col("run__one") - 1)
    row = min(ROW, block)
    value = F.transform(F.sort_array(F.collect_list(F.struct("at", "_v"))), lambda x: x["_v"])  # of no more than a row
    blocks = placed.groupBy("_group", "_s", F.floor(F.col("at") / block).alias("block"), F.floor(F.col("at") % block / row).alias("row")).agg(value.alias("values"))
    blocks = materialise(blocks, "bootstrap-blocks")

    own, other = F.col("_s") == 0, F.col("_s") == 1
    stats = placed.groupBy("_group").agg(
        F.count_if(own).alias("n"), F.count_if(other).alias("m"), F.avg(F.when(own, F.col("_v"))).alias("_mean"), F.avg(F.when(other, F.col("_v"))).alias("_against"), F.avg(F.when(own, (F.col("_v") > 0).cast("double"))).alias("_hits")
    )
    names = rows.select(group, F.to_json(F.struct(group)).alias("_group")).groupBy("_group").agg(F.first(group).alias(group))
    stats = materialise(stats.join(names, "_group"), "bootstrap-sizes")

    enough = stats.filter((F.col("n") >= least) & ((F.col("m") == 0) | (F.col("m") >= least)))
    stride = (F.col("n") + F.col("m")).alias("stride")
    series = enough.select("_group", F.lit(0).cast("long").alias("_s"), "n", F.lit(0).cast("long").alias("offset"), stride).unionByName(
        enough.filter("m > 0").select("_group", F.lit(1).cast("long").alias("_s"), F.col("m").alias("n"), F.col("n").alias("offset"), stride)
    )
    key = "_group string, _s long, r long, part double"
    some = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(draws) / F.col("n"))).cast("long")
    work = series.filter(F.col("n") <= row).join(blocks.filter("block = 0 AND row = 0").drop("block", "row").hint("merge"), ["_group", "_s"])
    work = work.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"), some)))
    work = work.select("_group", "_s", "n", "offset", "stride", "first", F.least(some, F.lit(resamples) - F.col("first")).alias("count"), "values").repartition("_group", "_s", "first")
    sums = work.mapInPandas(partial(_whole, seed=seed), key)

    shares = F.ceil(F.least(F.lit(float(PERIOD)), F.col("n") * F.lit(float(resamples))) / SHARE).alias("shares")
    large = series.filter(F.col("n") > row).select("*", shares).join(blocks.hint("merge"), ["_group", "_s"])  # values never reach the driver
    large = large.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))

    def at_block(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _at_block(k, rows, seed, resamples, block, draws)

    met = large.groupBy("_group", "_s", "block", "share").applyInPandas(at_block, key)

    means = sums.unionByName(met).groupBy("_group", "r").agg(F.sum(F.when(own, F.col("part")).otherwise(-F.col("part"))).alias("mean"))
    drawn = means.groupBy("_group").agg(F.sort_array(F.collect_list("mean")).alias("_d"))  # one value a resample
    at = lambda share: rounded(F.try_element_at("_d", F.lit(int(share * resamples) + 1)))
    out = stats.join(drawn, "_group", "left")
    difference = F.col("_mean") - F.when(F.col("m") > 0, F.col("_against")).otherwise(0.0)
    return out.select(group, "n", rounded(difference).alias("mean"), rounded(F.col("_hits") * 100, 1).alias("hit_rate"), at(0.025).alias("low"), at(0.975).alias("high"))


def bootstrap_mean(df: DataFrame, group: str, value: str, order: str, resamples: int = 1000, seed: int = 42, least: int = 10, block: int = BLOCK, draws: int = DRAWS) -> DataFrame:
    """group, n, mean, hit_rate, low, high: mean of each group and the 2.5 and 97.5 % points of its resampled means.

    One generator runs through all draws of a group; each row of work jumps to its own. A group of a few values is
    drawn where they lie. A larger one lies in blocks; at each of them all draws are made anew, in shares, and those
    that fall on the block are summed. No interval below ``least`` values.
    """
    rows = df.select(group, F.lit(0).alias("_s"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    return _intervals(rows, group, resamples, seed, least, block, draws)


def bootstrap_difference(df: DataFrame, group: str, value: str, order: str, sampled: Column, resamples: int = 2000, seed: int = 20260801, least: int = 20, block: int = BLOCK, draws: int = DRAWS) -> DataFrame:
    """The same of the sampled rows' mean less that of all rows of the group; a resample draws the sample, then all."""
    rows = df.select(group, F.explode(F.when(sampled, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("_s"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    return _intervals(rows, group, resamples, seed, least, block, draws)


def sql_bootstrap(resamples: int, seed: int, least: int) -> str:
    """SQL of the intervals over a CTE samples(g, s, i, v), i from 0: CTEs ending in drawn(g, n, mean, hit_rate, low, high)."""
    return f"""
powers AS (
  SELECT j, a, c FROM (WITH RECURSIVE p(j, a, c) AS (
    SELECT 0, {A}::UBIGINT, {C}::UBIGINT UNION ALL SELECT j + 1, (a * a) & {MASK}, (a * c + c) & {MASK} FROM p WHERE j < 40) SELECT * FROM p)),
maps AS (SELECT list({{'a': a, 'c': c}} ORDER BY j) AS maps FROM powers),
sizes AS (SELECT g, count(*) FILTER (s = 0) AS n, count(*) FILTER (s = 1) AS m, avg(v) FILTER (s = 0) - coalesce(avg(v) FILTER (s = 1), 0) AS mean,
                 avg((v > 0)::INT) FILTER (s = 0) AS hits FROM samples GROUP BY g),
series AS (SELECT g, 0 AS s, n AS size, 0 AS skipped, n + m AS stride FROM sizes WHERE n >= {least} AND (m = 0 OR m >= {least})
           UNION ALL SELECT g, 1, m, n, n + m FROM sizes WHERE n >= {least} AND m >= {least}),
starts AS (SELECT g, s, size, r, r * stride + skipped AS steps FROM series, (SELECT unnest(range({resamples})) AS r)),
single AS (SELECT unnest(range(1, (SELECT coalesce(max(size), 0) FROM series) + 1)) AS steps),
affine AS (
  SELECT steps, list_reduce(list_prepend({{'a': 1::UBIGINT, 'c': 0::UBIGINT}}, list_transform(list_filter(range(40), lambda j: (steps >> j) & 1 = 1), lambda j: maps[j + 1])),
                            lambda x, y: {{'a': (x.a * y.a) & {MASK}, 'c': (y.a * x.c + y.c) & {MASK}}}) AS f
  FROM (SELECT steps FROM starts UNION SELECT steps FROM single), maps),
states AS (SELECT g, s, size, r, (f.a * {seed} + f.c) & {MASK} AS state FROM starts JOIN affine USING (steps)),
draws AS (SELECT g, s, size, r, floor(((f.a * state + f.c) & {MASK})::DOUBLE / 4294967296.0 * size)::BIGINT AS i FROM states JOIN single ON steps <= size JOIN affine USING (steps)),
means AS (SELECT g, r, sum(CASE WHEN s = 0 THEN part ELSE -part END) AS mean FROM (SELECT d.g, d.s, r, sum(v) / any_value(size) AS part FROM draws d JOIN samples USING (g, s, i) GROUP BY ALL) GROUP BY g, r),
sorted AS (SELECT g, list(mean ORDER BY mean) AS d FROM means GROUP BY g),
drawn AS (
  SELECT sizes.g, n, floor(mean * 10000.0 + 0.5) / 10000.0 AS mean, floor(hits * 100 * 10.0 + 0.5) / 10.0 AS hit_rate,
         floor(d[{int(0.025 * resamples) + 1}] * 10000.0 + 0.5) / 10000.0 AS low, floor(d[{int(0.975 * resamples) + 1}] * 10000.0 + 0.5) / 10000.0 AS high
  FROM sizes LEFT JOIN sorted USING (g))"""
