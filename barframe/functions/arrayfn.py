"""Array functions: none changes its argument; reducers read numbers as doubles and skip nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def new(value: Column, size: int) -> Column:
    return F.array_repeat(value, size)


def get(a: Column, i: Column) -> Column:
    """Null beyond the end; a negative place is the first."""
    return F.get(a, F.greatest(i, F.lit(0)))


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def put(a: Column, i: Column, value: Column) -> Column:
    """A copy with another value at a place; the same where there is no such place."""
    return F.transform(a, lambda x, k: F.when(k == i, value).otherwise(x))


def insert(a: Column, i: Column, value: Column) -> Column:
    return F.when((i >= 0) & (i <= F.size(a)), F.concat(F.slice(a, F.lit(1), F.greatest(i, F.lit(0))), F.array(value), F.slice(a, F.greatest(i, F.lit(0)) + 1, F.greatest(F.size(a) - i, F.lit(0))))).otherwise(a)


def push(a: Column, value: Column) -> Column:
    return F.concat(a, F.array(value))


def unshift(a: Column, value: Column) -> Column:
    return F.concat(F.array(value), a)


def fill(a: Column, value: Column) -> Column:
    return F.transform(a, lambda _: value)


def cut(a: Column, begin: Column, end: Column) -> Column:
    """From ``begin`` up to ``end``; null where these aren't places in order."""
    ok = (begin >= 0) & (begin <= end) & (end <= F.size(a))
    return F.when(ok, F.slice(a, F.greatest(begin, F.lit(0)) + 1, F.greatest(end - begin, F.lit(0))))


def includes(a: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(a, value), F.lit(False))


def every(a: Column, value: Column) -> Column:
    return F.forall(a, lambda x: F.coalesce(x == value, F.lit(False)))


def indexof(a: Column, value: Column) -> Column:
    at = F.array_position(a, value)
    return F.when(at > 0, at - 1)


def lastindexof(a: Column, value: Column) -> Column:
    at = F.array_position(F.reverse(a), value)
    return F.when(at > 0, F.size(a) - at)


def joined(a: Column, by: str) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), by, "NaN")


def _there(a: Column) -> Column:
    return F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: x.cast("double"))


def total(a: Column) -> Column:
    """Null of nothing."""
    own = _there(a)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x))


def mean(a: Column) -> Column:
    return total(a) / F.size(_there(a))


def smallest(a: Column) -> Column:
    return F.array_min(_there(a))


def largest(a: Column) -> Column:
    return F.array_max(_there(a))


def spread(a: Column) -> Column:
    return largest(a) - smallest(a)


def median(a: Column) -> Column:
    own = F.sort_array(_there(a))
    n = F.size(own)
    return F.when(n > 0, (F.get(own, F.floor((n - 1) / 2).cast("int")) + F.get(own, F.floor(n / 2).cast("int"))) / 2)


def variance(a: Column) -> Column:
    """Population variance."""
    own = _there(a)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + (x - mean(a)) * (x - mean(a))) / F.size(own))


def stdev(a: Column) -> Column:
    return F.sqrt(variance(a))


def percentrank(a: Column, value: Column) -> Column:
    """Share of the numbers below ``value``, in per cent."""
    own = _there(a)
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda x: x < value)) * 100.0 / F.size(own))


def standardize(a: Column) -> Column:
    """Distances to the mean in deviations; zeros where there is no deviation."""
    own, m, s = _there(a), mean(a), stdev(a)
    return F.transform(own, lambda x: F.when(s > 0, (x - m) / s).otherwise(0.0))


def covariance(a: Column, b: Column) -> Column:
    """Population covariance of arrays of equal length; else null."""
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - mean(a)) * (y.cast("double") - mean(b)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def ordered(a: Column) -> Column:
    """Numbers in order, as doubles, nulls left out."""
    return F.sort_array(_there(a))


def binary_search(a: Column, value: Column) -> Column:
    """The place of ``value`` in an ordered array, else null."""
    return indexof(_there(a), value.cast("double"))
