"""Maps with text keys: none changes its argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def new_from_pair(key: Column, value: Column) -> Column:
    return F.create_map(key, value)


def get(m: Column, key: Column) -> Column:
    return F.try_element_at(m, key)


def contains(m: Column, key: Column) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def clear(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: F.lit(False))


def size(m: Column) -> Column:
    return F.when(m.isNull(), 0).otherwise(F.size(m)).cast("long")


def is_empty(m: Column) -> Column:
    return size(m) == 0


def keys(m: Column) -> Column:
    """In order."""
    return F.sort_array(F.map_keys(m))


def values(m: Column) -> Column:
    """In the order of their keys."""
    return F.transform(keys(m), lambda k: F.try_element_at(m, k))
