"""The walk-forward engine on series that a generator fixes, and the plan's rules."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quayline.operators import recurrences, setups, slices
from quayline.operators.bars import with_index


def frozen(n, seed, start):
    """fixed values: the generator that the engine's signature is taken on"""
    s, price, out = float(seed), start, []

    def draw():
        nonlocal s
        s = (s * 1103515245 + 12345) % 2147483648
        return s / 2147483648

    for i in range(n):
        price *= 1 + (draw() - 0.5) * 0.035 + math.sin(i / 55) * 0.0025
        spread = price * 0.011
        out.append((datetime.date(2019, 1, 1) + datetime.timedelta(i), price - spread * 0.3, price + spread, price - spread, price, 1e6 + math.floor(draw() * 4e5)))
    return out


@pytest.fixture(scope="module")
def series(spark):
    rows = [(f"s{seed}", *r) for seed, start in ((11, 100.0), (977, 42.0), (4242, 1850.0)) for r in frozen(600, seed, start)]
    assert [round(r[5], 6) for r in rows[:2]] == [100.533797, 101.710647] and rows[0][6] == 1152645
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


def test_signature_of_the_engine(series):
    bars = with_index(recurrences.indicators(series)).cache()
    reads = slices.slice_reads(series).cache()
    trades = None
    for horizon in ("swing", "medium"):
        one = setups.walk_forward(bars, reads, horizon, hold=40)
        trades = one if trades is None else trades.unionByName(one)
    got = setups.signature(trades).first()
    assert (got["trades"], got["expectancy_r"], got["win_rate"]) == (71, 0.3068, 56.3)
    assert sorted(got["by_strategy"].values()) == [1, 29, 41]


def test_reads_of_blocks_equal_reads_of_single_slices(series):
    one = series.filter("symbol = 's11'")
    got = {r["bar_idx"]: r for r in slices.slice_reads(one, block=64).filter("bar_idx in (30, 100, 259, 260, 400, 599)").collect()}
    rows = one.orderBy("ts").collect()
    for k, r in got.items():
        tail = series.sparkSession.createDataFrame(rows[max(0, k - 259) : k + 1], series.schema)
        alone = slices.slice_reads(tail).orderBy(F.desc("bar_idx")).first()
        for c in r.asDict():
            if c not in ("bar_idx",):
                assert r[c] == alone[c] or r[c] == pytest.approx(alone[c], rel=1e-9), c
    assert set(got) == {30, 100, 259, 260, 400, 599}


def test_plans_rest_on_closed_bars_of_their_own_frames(series):
    from quayline.operators.bars import resample

    frames = {"structure": resample(series, 4), "trend": resample(series, 15)}
    reads = setups.framed_reads(series, frames["structure"], frames["trend"]).cache()
    plans = {(r["symbol"], r["ts"]): r for r in setups.framed_plans(reads, setups.HORIZONS["medium"]).collect()}
    begun, known = {}, {}
    for name, bars in frames.items():
        for r in bars.orderBy("symbol", "ts").collect():
            begun.setdefault((name, r["symbol"]), []).append(r["ts"])
        for r in setups.with_read_states(slices.slice_reads(bars)).collect():
            known[name, r["symbol"], r["ts"]] = r
    own = {(r["symbol"], r["ts"]): r for r in setups.with_read_states(slices.slice_reads(series)).collect()}
    met = 0
    for key, entry in own.items():
        at = {n: [t for t in begun[n, key[0]] if t < key[1]][-2:-1] for n in frames}
        higher = {n: known.get((n, key[0], at[n][0])) if at[n] else None for n in frames}
        assert (key in plans) == all(higher.values())
        if key in plans:
            p, met = plans[key], met + 1
            assert (p["structure_ts"], p["trend_ts"]) == (at["structure"][0], at["trend"][0])
            assert p["price"] == higher["structure"]["price"] and p["regime"] == higher["structure"]["regime"]
            assert p["bias"] == ("short" if higher["trend"]["direction"] == "down" else "long") and not p["against_trend"]
            up = p["side"] == "long"
            turned = (entry["histogram"] > 0) == up if round(entry["histogram"], 4) else False
            assert p["points_confirmation"] == (5 if turned or entry["rsi_state"] == ("oversold" if up else "overbought") else 0)
    assert met > 300
    forced = setups.framed_plans(reads, setups.HORIZONS["medium"], forced="short").filter("against_trend")
    assert forced.count() and forced.filter("side = 'short' AND entry IS NOT NULL AND points_forced <> -15").count() == forced.filter("side = 'short' AND entry IS NOT NULL AND trend_direction = 'down'").count()


def test_signals_come_in_order(series):
    x = setups.with_read_states(slices.slice_reads(series))
    names = list(setups.SIGNALS.values())
    place = lambda s: next(k for k, n in enumerate(names) if all(part in s for part in n.split("{}")))
    said = [r["signals"] for r in x.select("signals").collect()]
    assert all([place(s) for s in row] == sorted(place(s) for s in row) for row in said)
    assert any("RSI divergence" in s for row in said for s in row) and any(s.startswith("ADX ") and s[4].isdigit() for row in said for s in row)
