"""Scans, thinning, bootstraps and studies against plain walks."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.operators import bootstrap, studies
from quayline.operators.scans import ranked, running_sums
from quayline.operators.structure import thin


def walk(seed, sample, population=()):
    """Plain generator: means of one resample after the other."""
    s = seed
    while True:
        means = []
        for x in (sample, population):
            total = 0.0
            for _ in x:
                s = (s * 1664525 + 1013904223) % 2**32
                total += x[int(s / 2**32 * len(x))]
            means.append(total / len(x) if len(x) else 0.0)
        yield means[0] - means[1]


def interval(seed, resamples, sample, population=()):
    draw = walk(seed, sample, population)
    means = sorted(next(draw) for _ in range(resamples))
    return means[int(0.025 * resamples)], means[int(0.975 * resamples)]


def test_running_sums_and_ranks_over_many_parts(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.randint(-5, 5)) for g, n in (("a", 3000), ("b", 1), ("c", 40), ("d", 2500)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {(r["g"], r["k"]): r["run_v"] for r in running_sums(df, "g", ["k"], ["v"], ["g", "k"], "t").collect()}
        order = {(r["g"], r["k"]): r["n"] for r in ranked(df, [F.desc("v"), "g", "k"], "n", "t").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sums = defaultdict(int)
    for g, k, v in rows:
        sums[g] += v
        assert got[g, k] == sums[g]
    assert [order[g, k] for v, g, k in sorted((-v, g, k) for g, k, v in rows)] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("block", [1 << 16, 50, 7])
def test_thinning_is_greedy(spark, block):
    rng = random.Random(2)
    times = {g: sorted({rng.randint(0, 4000) for _ in range(n)}) for g, n in (("a", 600), ("b", 1), ("c", 90))}
    start = datetime(2026, 1, 1)
    rows = [(g, start + timedelta(seconds=t)) for g, ts in times.items() for t in ts for _ in range(1 + t % 2)]
    zero = int(start.timestamp())
    got = defaultdict(list)
    for r in thin(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 25, block=block).collect():
        got[r["k"]].append(r["ts"] - zero)
    for g, ts in times.items():
        want, last = [], -(10**9)
        for t in ts:
            if t - last >= 25:
                want.append(t)
                last = t
        assert sorted(got[g]) == want
    assert thin(spark.createDataFrame([], "k string, ts timestamp"), "k", "ts", 25).count() == 0


@pytest.mark.parametrize(("block", "draws"), [(1 << 18, 1 << 20), (16, 10), (60, 200)])
def test_bootstraps_equal_one_walk(spark, block, draws):
    rng = np.random.default_rng(4)
    rows = [(g, k, float(x)) for g in ("a", "b", None) for k, x in enumerate(rng.normal(size=60))] + [("few", k, 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    values = {g: [x for h, _, x in rows if h == g] for g in ("a", "b", None, "few")}
    seen = set()
    for r in bootstrap.bootstrap_mean(df, "g", "v", "k", resamples=133, block=block, draws=draws).collect():
        v = values[r["g"]]
        seen.add(r["g"])
        assert r["n"] == len(v) and r["hit_rate"] == pytest.approx(100 * sum(x > 0 for x in v) / len(v), abs=0.051)
        assert (r["low"], r["high"]) == (None, None) if r["g"] == "few" else np.allclose((r["low"], r["high"]), interval(42, 133, v), atol=1e-4)
    assert seen == set(values)
    for r in bootstrap.bootstrap_difference(df, "g", "v", "k", F.col("k") % 2 == 0, resamples=80, block=block, draws=draws).collect():
        v = values[r["g"]]
        if r["g"] != "few":
            assert r["n"] == 30 and r["mean"] == pytest.approx(np.mean(v[::2]) - np.mean(v), abs=1e-4)
            assert np.allclose((r["low"], r["high"]), interval(20260801, 80, v[::2], v), atol=1e-4)
        else:
            assert r["low"] is None and r["high"] is None


@pytest.mark.parametrize(("n", "stride", "resamples"), [(7, 7, 9), (30, 45, 40), (97, 97, 5), (250, 260, 12), (3, 40, 2)])
def test_windows_of_a_generator_that_comes_round(n, stride, resamples):
    period, values = 97, np.random.default_rng(1).normal(size=97)
    starts = np.arange(resamples) * stride + 5
    begins, ends, covers = bootstrap.stretches(starts, n, period)
    assert (ends - begins).sum() <= min(period, n * resamples)
    sums = covers @ np.array([values[a:b].sum() for a, b in zip(begins, ends)])
    assert np.allclose(sums, [values[np.arange(s, s + n) % period].sum() for s in starts])


def test_draws_fall_on_their_blocks():
    a, c = (x.astype(np.uint32) for x in bootstrap.steps(64))
    for n, block in ((1000, 300), (4097, 4096), (3_000_001, 1 << 20)):
        v = np.random.default_rng(2).normal(size=n)
        s, want = 99, 0.0
        for _ in range(1000):
            s = (s * 1664525 + 1013904223) % 2**32
            want += v[int(s / 2**32 * n)]
        got = sum(bootstrap._sum_of_draws(v[b : b + block], b, n, 99, 1000, a, c) for b in range(0, n, block))
        assert got == pytest.approx(want)


def test_a_large_group_is_drawn_without_its_draws_or_values_travelling_whole(spark, monkeypatch):
    v = np.random.default_rng(5).normal(size=9000)
    df = spark.range(9000).select(F.lit("a").alias("g"), F.col("id").alias("k"), F.element_at(F.lit(v.tolist()), (F.col("id") + 1).cast("int")).alias("v"))
    seen, whole = [], bootstrap.materialise
    monkeypatch.setattr(bootstrap, "materialise", lambda df, label: seen.append((label, whole(df, label))) or seen[-1][1])
    got = bootstrap.bootstrap_mean(df, "g", "v", "k", resamples=40).first()
    assert np.allclose((got["low"], got["high"]), interval(42, 40, v.tolist()), atol=1e-4)
    assert max(r["m"] for r in dict(seen)["bootstrap-blocks"].select(F.size("values").alias("m")).collect()) <= 4096


def test_threshold_study_of_a_planted_effect(spark):
    rng = np.random.default_rng(7)
    rates, prices, start = [], [], datetime(2024, 1, 1)
    price = 100.0
    for k in range(400):
        rate = float(rng.normal()) + (4.0 if k % 12 == 11 and k > 95 else 0.0)
        price *= 1.002 + float(rng.normal()) * 1e-4 + (0.05 if k and rates[-1][2] > 3 else 0)
        rates.append(("X", start + timedelta(hours=24 * k), rate))
        prices.append(("X", start + timedelta(hours=24 * k), price))
    found = studies.observations(spark.createDataFrame(rates, "symbol string, ts timestamp, rate double"), spark.createDataFrame(prices, "symbol string, ts timestamp, close double"), [24])
    assert found.count() == 400 - 90 - 1
    got = {(r["tail"], r["threshold"]): r for r in studies.threshold_study(found, [24], [2.0], resamples=200).collect()}
    high = got["high", 2.0]
    assert high["clears"] and high["low"] > 0 and high["baseline_n"] == 309 and high["mean"] > 4
    assert tuple(studies.findings(studies.threshold_study(found, [24], [2.0], resamples=50)).first()) == (2, 1, 0.1)


def test_too_little_overlap_says_nothing(spark):
    start = datetime(2024, 1, 1)
    rows = [(v, start + timedelta(hours=k), 100.0 + k * (j + 1)) for j, v in enumerate("abc") for k in range(20)]
    got = studies.agreement_study(spark.createDataFrame(rows, "venue string, ts timestamp, value double"), ("a", "b", "c"), (0.5,)).first()
    assert (got["shared"], got["correlation"], got["needed"], got["testable"]) == (19, None, 565, False)
