"""All queries of the bar engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions import ta
from barframe.operators.folds import dmi_fold, ema_fold, macd_fold, rsi_fold, supertrend_fold
from barframe.plans import indicators, scalars, scripts, tables
from barframe.sources.bars import event_bars

QUERIES: dict[str, Callable] = {**indicators.QUERIES, **scalars.QUERIES, **tables.QUERIES, **scripts.QUERIES}
ORACLE_SQL: dict[str, str] = {**indicators.ORACLE_SQL, **scalars.ORACLE_SQL, **tables.ORACLE_SQL, **scripts.ORACLE_SQL}


def flagship(spark, folder: str) -> DataFrame:
    """Averages, bands and oscillators over hourly bars: one shuffle for all windows, one for all folds."""
    bars = ta.stoch(ta.bb(ta.sma(event_bars(spark, folder), "close", 14), "close", 20), "close", "high", "low", 14)
    made = ta.recursive(bars, [ema_fold("close", 12, "ema"), rsi_fold("close", 14, "rsi"), macd_fold("close", 12, 26, 9, "macd"), dmi_fold(14, 14, "dmi"), supertrend_fold(3.0, 10, "supertrend")])
    return made.withColumn("time_ms", F.unix_millis("time")).drop("time")
