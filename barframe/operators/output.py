"""Plots and alerts: titled series over bars, as long tables and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plots(bars: DataFrame, series: dict[str, Column]) -> DataFrame:
    """Long form: symbol, time, title, value, one row for each bar and series; booleans are 1 and 0."""
    entries = [F.struct(F.lit(title).alias("title"), value.cast("double").alias("value")) for title, value in series.items()]
    return bars.select("symbol", "time", F.explode(F.array(*entries)).alias("p")).select("symbol", "time", "p.title", "p.value")


def last_values(long: DataFrame) -> DataFrame:
    """The newest value of each series, and how many bars it has."""
    return long.groupBy("symbol", "title").agg(F.max_by("value", "time").alias("value"), F.count(F.lit(1)).alias("bars"))


def wide(long: DataFrame, titles: list[str]) -> DataFrame:
    """A column for each title."""
    return long.groupBy("symbol", "time").pivot("title", titles).agg(F.first("value"))


def alerts(bars: DataFrame, condition: Column, title: str, most: int = 100) -> DataFrame:
    """The newest bars of each symbol on which an alert fires, at most ``most`` (the kept history)."""
    fired = bars.filter(F.coalesce(condition, F.lit(False))).select("symbol", "time", F.lit(title).alias("title"))
    return fired.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))).filter(F.col("__n") <= most).drop("__n")
