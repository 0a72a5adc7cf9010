"""Scalar mathematics: null for what has no value, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def maximum(*xs: Column) -> Column:
    """The greatest as a double, nulls left out."""
    return F.greatest(*map(_d, xs)) if len(xs) > 1 else _d(xs[0])


def minimum(*xs: Column) -> Column:
    return F.least(*map(_d, xs)) if len(xs) > 1 else _d(xs[0])


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def asin(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.asin(x))


def acos(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.acos(x))


def rounded(x: Column) -> Column:
    """Half away from zero, a whole number."""
    return F.round(x).cast("long")


def round_to_nearest(x: Column, step: Column) -> Column:
    return F.round(F.try_divide(_d(x), _d(step))) * step


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("long")


def floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


def copysign(size: Column, of: Column) -> Column:
    return F.when(of >= 0, F.abs(size)).otherwise(-F.abs(size))


def tostring(x: Column) -> Column:
    """Whole doubles without a fraction; ``na`` for null."""
    text = x.cast("string")
    return F.coalesce(F.when(x.cast("double") == F.floor(x), F.regexp_replace(text, r"\.0$", "")).otherwise(text), F.lit("na"))


def random(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    """Uniform between ``low`` and ``high``; null unless there is room between them."""
    return F.lit(None).cast("double") if low >= high else low + F.rand(seed) * (high - low)
