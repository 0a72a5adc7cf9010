"""Indicators against plain Python over bars that rise, fall, stand still and have gaps."""

import random

import pytest
from pyspark.sql import functions as F

from barframe.functions import ta
from barframe.operators.frames import rolling


def make(seed=3, n=90, gaps=False):
    rng, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        price = max(1.0, price + rng.choice([-2, -1, 0, 0, 1, 2]) + rng.random() - 0.5)
        close = None if gaps and k % 7 == 5 else price
        out.append(("A", k, price + rng.random(), price + 2 + rng.random(), price - 2 - rng.random(), close, float(rng.randint(1, 9))))
    return out


def table(spark, bars):
    return spark.createDataFrame(bars, "symbol string, k int, open double, high double, low double, close double, volume double").withColumn("time", F.timestamp_seconds(F.col("k") * 3600))


def column(frame, name):
    return [r[0] for r in frame.orderBy("time").select(name).collect()]


def close_to(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (g is None or abs(g - w) < 1e-8)


def smooth(values, n, alpha):
    out, seen, e = [], [], None
    for v in values:
        if v is not None:
            seen.append(v)
            e = None if len(seen) < n else sum(seen) / n if len(seen) == n else alpha * v + (1 - alpha) * e
        out.append(e)
    return out


@pytest.mark.parametrize("gaps", [False, True])
def test_smoothing_keeps_its_value_over_gaps(spark, gaps):
    bars = make(gaps=gaps)
    closes = [b[5] for b in bars]
    close_to(column(ta.ema(table(spark, bars), "close", 5), "ema"), smooth(closes, 5, 2 / 6))
    close_to(column(ta.rma(table(spark, bars), "close", 5), "rma"), smooth(closes, 5, 1 / 5))


def test_compacting_window_counts_values_not_bars(spark):
    bars = make(gaps=True)
    want, seen = [], []
    for b in bars:
        seen += [] if b[5] is None else [b[5]]
        want.append(sum(seen[-6:]) / 6 if len(seen) >= 6 else None)
    got = column(rolling(table(spark, bars), "close", 6, "m", lambda c, w: F.avg(c).over(w), dense=False), "m")
    close_to(got, want)


def test_rsi_macd_and_tsi(spark):
    bars = make()
    closes = [b[5] for b in bars]
    steps = [None] + [b - a for a, b in zip(closes, closes[1:])]
    gain, loss = (smooth([None if s is None else max(sign * s, 0.0) for s in steps], 14, 1 / 14) for sign in (1, -1))
    close_to(column(ta.rsi(table(spark, bars), "close"), "rsi"), [None if g is None else 100.0 if d == 0 else 100 - 100 / (1 + g / d) for g, d in zip(gain, loss)])
    fast, slow = smooth(closes, 12, 2 / 13), smooth(closes, 26, 2 / 27)
    line = [None if s is None else f - s for f, s in zip(fast, slow)]
    made = ta.macd(table(spark, bars), "close")
    close_to(column(made, "macd_line"), line)
    close_to(column(made, "macd_signal"), smooth(line, 9, 0.2))
    twice = lambda v: smooth(smooth(v, 25, 2 / 26), 13, 2 / 14)
    up, down = twice(steps), twice([None if s is None else abs(s) for s in steps])
    close_to(column(ta.tsi(table(spark, bars), "close"), "tsi"), [None if u is None else 100 * u / d for u, d in zip(up, down)])


def test_constant_prices(spark):
    flat = [("A", k, 5.0, 5.0, 5.0, 5.0, 1.0) for k in range(40)]
    bars = table(spark, flat)
    assert column(ta.rsi(bars, "close"), "rsi")[-1] == 100.0
    assert column(ta.mfi(bars, "close"), "mfi")[-1] == 100.0
    for made, name in ((ta.cci(bars, "close"), "cci"), (ta.stoch(bars, "close", "high", "low", 5), "stoch"), (ta.wpr(bars, 5), "wpr"), (ta.correlation(bars, "close", "volume", 5), "correlation")):
        assert column(made, name)[-1] is None
    assert not any(column(ta.rising(bars, "close", 2), "rising"))


def test_empty_and_single(spark):
    empty = table(spark, make()).filter("k < 0")
    assert ta.ema(ta.sma(empty, "close", 3), "close", 3).count() == 0
    one = table(spark, make()[:1])
    assert column(ta.obv(one), "obv") == [0.0] and column(ta.sma(one, "close", 2), "sma") == [None] and column(ta.crossover(one, "close", "open"), "crossover") == [False]


def test_symbols_do_not_mix(spark):
    a = table(spark, make(1))
    both = a.union(table(spark, make(2)).withColumn("symbol", F.lit("B")))
    close_to(column(ta.ema(both, "close", 5).filter("symbol = 'A'"), "ema"), column(ta.ema(a, "close", 5), "ema"))


def test_valuewhen_and_barssince(spark):
    bars = make()
    hit = [b[5] > b[2] for b in bars]
    marked = table(spark, bars).withColumn("hit", F.col("close") > F.col("open"))
    for k in (0, 2):
        want = []
        for i in range(len(bars)):
            found = [j for j in range(i + 1) if hit[j]]
            want.append(bars[found[-1 - k]][5] if len(found) > k else None)
        close_to(column(ta.valuewhen(marked, "hit", "close", k, "v"), "v"), want)
    want = [next((i - j for j in range(i, -1, -1) if hit[j]), None) for i in range(len(bars))]
    assert column(ta.barssince(marked, "hit"), "barssince") == want
