"""Recursive columns: state that is carried from bar to bar.

The bars of a symbol are sorted within one partition and stream through the kernels batch by
batch, so memory does not grow with a symbol's history and all recursive columns of one level
share a single pass.  A kernel keeps a few numbers; it is started anew at each symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = Callable[..., tuple]


@dataclass(frozen=True)
class Fold:
    """A recursive column: the inputs, the outputs (name to type), and a maker of step functions."""

    inputs: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...]
    make: Callable[[], Step]


def apply_folds(bars: DataFrame, folds: list[Fold], symbol: str = "symbol", order: tuple[str, ...] = ("time",)) -> DataFrame:
    """``bars`` with the outputs of all folds."""
    needed = list(dict.fromkeys(c for f in folds for c in f.inputs))
    fields = [(name, kind) for f in folds for name, kind in f.outputs]
    rows = bars.select(F.struct(*bars.columns).alias("row"), F.col(symbol).alias("key"), *[F.col(c).alias(f"in_{c}") for c in needed], *[F.col(c).alias(f"by_{k}") for k, c in enumerate(order)])
    ordered = rows.repartition("key").sortWithinPartitions("key", *[f"by_{k}" for k in range(len(order))])
    schema = T.StructType([T.StructField("row", bars.schema), *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in fields)).fields])
    kinds = [pa.int64() if k in ("long", "bigint") else pa.bool_() if k == "boolean" else pa.float64() for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, steps = object(), []
        for batch in batches:
            columns = {c: batch.column(f"in_{c}").to_pylist() for c in needed}
            out: list[list] = [[] for _ in fields]
            for k, key in enumerate(batch.column("key").to_pylist()):
                if key != current:
                    current, steps = key, [f.make() for f in folds]
                at = 0
                for fold, step in zip(folds, steps):
                    for value in step(*(columns[c][k] for c in fold.inputs)):
                        out[at].append(value)
                        at += 1
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(o, t) for o, t in zip(out, kinds)]], names=["row", *[n for n, _ in fields]])

    done = ordered.mapInArrow(run, schema)
    return done.select("row.*", *[n for n, _ in fields])


def smoothing(n: int, alpha: float) -> Callable[[float | None], float | None]:
    """e = alpha * x + (1 - alpha) * e, started by the mean of the first n values; gaps keep the last value."""
    n = max(1, n)
    count, total, value = 0, 0.0, None

    def step(x: float | None) -> float | None:
        nonlocal count, total, value
        if x is not None:
            count += 1
            if count <= n:
                total += x
                value = total / n if count == n else None
            else:
                value = alpha * x + (1 - alpha) * value
        return value

    return step


def ema(n: int) -> Callable:
    return smoothing(n, 2 / (max(1, n) + 1))


def rma(n: int) -> Callable:
    return smoothing(n, 1 / max(1, n))


def ema_fold(x: str, n: int, out: str) -> Fold:
    """Exponential average."""
    return Fold((x,), ((out, "double"),), lambda: _one(ema(n)))


def rma_fold(x: str, n: int, out: str) -> Fold:
    """Wilder's average."""
    return Fold((x,), ((out, "double"),), lambda: _one(rma(n)))


def _one(f: Callable) -> Step:
    return lambda x: (f(x),)


def rsi_fold(x: str, n: int, out: str) -> Fold:
    """Relative strength: 100 where there is no loss."""

    def make() -> Step:
        gain, loss, before = rma(n), rma(n), None

        def step(v):
            nonlocal before
            up = down = None
            if v is not None and before is not None:
                up, down = max(v - before, 0.0), max(before - v, 0.0)
            before = v
            g, d = gain(up), loss(down)
            return (None if g is None else 100.0 if d == 0 else 100 - 100 / (1 + g / d),)

        return step

    return Fold((x,), ((out, "double"),), make)


def macd_fold(x: str, fast: int, slow: int, signal: int, out: str) -> Fold:
    """Difference of two exponential averages, its own average, and the rest."""

    def make() -> Step:
        a, b, c = ema(fast), ema(slow), ema(signal)

        def step(v):
            f, s = a(v), b(v)
            line = f - s if f is not None and s is not None else None
            smooth = c(line if v is not None else None)
            return line, smooth, line - smooth if line is not None and smooth is not None else None

        return step

    return Fold((x,), ((f"{out}_line", "double"), (f"{out}_signal", "double"), (f"{out}_hist", "double")), make)


def tsi_fold(x: str, short: int, long: int, out: str) -> Fold:
    """Twice smoothed change over twice smoothed absolute change."""

    def make() -> Step:
        a, b, c, d, before = ema(long), ema(short), ema(long), ema(short), None

        def step(v):
            nonlocal before
            delta = None
            if v is not None:
                delta = None if before is None else v - before
                before = v
            p, q = a(delta), c(None if delta is None else abs(delta))
            up, down = b(p if delta is not None else None), d(q if delta is not None else None)
            return (None if up is None or not down else 100 * up / down,)

        return step

    return Fold((x,), ((out, "double"),), make)


def dmi_fold(di: int, adx: int, out: str) -> Fold:
    """Directional movement: plus, minus and their average index; any gap ends the series."""

    def make() -> Step:
        plus, minus, ranges, smooth, before, broken = rma(di), rma(di), rma(di), rma(adx), None, False

        def step(h, low, c):
            nonlocal before, broken
            broken = broken or h is None or low is None or c is None
            if broken:
                return None, None, None
            if before is None:
                before = (h, low, c)
                return None, None, None
            up, down = h - before[0], before[1] - low
            tr = ranges(max(h - low, abs(h - before[2]), abs(low - before[2])))
            p, m = plus(up if up > down and up > 0 else 0.0), minus(down if down > up and down > 0 else 0.0)
            before = (h, low, c)
            if tr is None or tr == 0:
                return None, None, smooth(None)
            p, m = 100 * p / tr, 100 * m / tr
            return p, m, smooth(100 * abs(p - m) / (p + m) if p + m else None)

        return step

    return Fold(("high", "low", "close"), ((f"{out}_plus", "double"), (f"{out}_minus", "double"), (f"{out}_adx", "double")), make)


def supertrend_fold(factor: float, n: int, out: str) -> Fold:
    """A band at a multiple of the true range that only tightens; direction 1 is down, -1 is up."""

    def make() -> Step:
        atr, before, upper, lower, trend = rma(n), None, None, None, None

        def step(h, low, c):
            nonlocal before, upper, lower, trend
            if h is None or low is None or c is None:
                return trend or (None, None)
            a = atr(h - low if before is None else max(h - low, abs(h - before), abs(low - before)))
            if a is not None:
                u, d = (h + low) / 2 + factor * a, (h + low) / 2 - factor * a
                first = upper is None
                up = u if first or u < upper or before > upper else upper
                down = d if first or d > lower or before < lower else lower
                if first:
                    way = 1
                elif abs(trend[0] - upper) < 1e-10:
                    way = -1 if c > up else 1
                else:
                    way = 1 if c < down else -1
                upper, lower, trend = up, down, (down if way == -1 else up, way)
            before = c
            return trend or (None, None)

        return step

    return Fold(("high", "low", "close"), ((out, "double"), (f"{out}_direction", "long")), make)
