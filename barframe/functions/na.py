"""Operators that treat missing values as a charting language does.

Arithmetic with a missing value or by zero is missing; comparisons are never missing: all are
false but for "not equal", which is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def divide(a: Column, b: Column) -> Column:
    """Always a double; missing by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """The sign is that of ``a``; missing by zero."""
    return F.try_mod(a, b)


def power(a: Column, b: Column) -> Column:
    """Missing where the result isn't finite."""
    value = F.pow(a, b)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def not_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(True))


def less(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, F.lit(False))


def less_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a <= b, F.lit(False))


def greater(a: Column, b: Column) -> Column:
    return F.coalesce(a > b, F.lit(False))


def greater_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a >= b, F.lit(False))


def truthy(condition: Column, numeric: bool = False) -> Column:
    """Only missing and false are not true; every number is, 0 too."""
    return condition.isNotNull() if numeric else F.coalesce(condition, F.lit(False))


def choose(condition: Column, then: Column, otherwise: Column) -> Column:
    """``then`` where the condition is true, else (also where it is missing) ``otherwise``."""
    return F.when(truthy(condition), then).otherwise(otherwise)


def switch(subject: Column | None, cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first case that equals the subject, or that is true without a subject."""
    out = default if default is not None else F.lit(None)
    for test, value in reversed(cases):
        out = F.when(equal(subject, test) if subject is not None else truthy(test), value).otherwise(out)
    return out


def nz(x: Column, replacement: Column | float = 0.0) -> Column:
    return F.coalesce(x, replacement if isinstance(replacement, Column) else F.lit(replacement))
