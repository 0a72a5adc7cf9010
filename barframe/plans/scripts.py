"""Queries in the shape of indicator scripts: loops, branches, kept variables, functions of prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions import arrayfn, na
from barframe.functions.control import for_each, for_range, for_until, option, persistent, setting, source, while_loop
from barframe.operators.folds import apply_folds
from barframe.operators.frames import history, last
from barframe.plans.indicators import BARS
from barframe.sources.bars import event_bars


def _six(x):
    return F.round(F.round(x, 9), 6)


def script_loops(spark, folder: str) -> DataFrame:
    """Loops over ranges and over the last bars."""
    bars = event_bars(spark, folder).withColumn("recent", F.collect_list("close").over(last(5)))
    n = F.col("volume").cast("int")
    return bars.select(
        "symbol", F.unix_millis("time").alias("time_ms"), for_range(F.lit(1), n, F.lit(0), lambda s, i: s + i * i).alias("squares"), for_range(n, F.lit(0), F.lit(0), lambda s, i: s + i, -2).alias("downwards"),
        _six(for_each("recent", F.lit(0.0), lambda s, i, x: s + x * (i + 1))).alias("weighted"), _six(for_until(F.reverse("recent"), F.lit(0.0), lambda s, x: s + x, lambda s, x: x > 80)).alias("until_high"), _six(for_each("recent", F.lit(0.0), lambda s, i, x: s + x) / F.size("recent")).alias("own_mean"),
    )


def script_branches(spark, folder: str) -> DataFrame:
    """Ternaries, switches and history of derived prices."""
    width = int(setting(14, 1, 50))
    spread = lambda a, b: a - b  # noqa: E731  a script's function: each call is a column of its own
    bars = event_bars(spark, folder).withColumn("mid", source("hlc3"))
    bars = bars.withColumns({"before": history(F.col("mid"), 2), "mean": F.avg("mid").over(last(width))})
    move = na.subtract(F.col("mid"), F.col("before"))
    return bars.select(
        "symbol", F.unix_millis("time").alias("time_ms"), _six("before").alias("before"), na.choose(na.greater(F.col("close"), F.col("open")), F.lit("up"), F.lit("down")).alias("way"), na.switch(None, [(move > 10, F.lit(2)), (move > 0, F.lit(1)), (move < -10, F.lit(-2)), (move < 0, F.lit(-1))], F.lit(0)).alias("strength"),
        _six(na.nz(F.col("before"))).alias("before_or_0"), _six(spread(source("ohlc4"), source("hl2"))).alias("lean"), _six(spread(F.col("mid"), F.col("mean"))).alias("off_mean"),
    )


def script_variables(spark, folder: str) -> DataFrame:
    """Variables kept from bar to bar: a count of runs, a stop that only rises, a sum with a floor."""
    folds = [
        persistent(("open", "close"), "streak", 0.0, lambda v, o, c: v + 1 if c > o else 0.0),
        persistent(("low",), "stop", 0.0, lambda v, low: max(v, low - 5) if low >= v else low - 5),
        persistent(("open", "close"), "floored", 0.0, lambda v, o, c: max(0.0, v + c - o)),
    ]
    made = apply_folds(event_bars(spark, folder), folds)
    return made.select("symbol", F.unix_millis("time").alias("time_ms"), "streak", _six("stop").alias("stop"), _six("floored").alias("floored"))


def script_while(spark, folder: str) -> DataFrame:
    """Loops that end by their condition, with a turn passed over and a way out."""
    bars = event_bars(spark, folder)
    n = (F.floor(F.col("high") * 1000)).cast("long")
    digit = lambda s: s["n"] % 10
    less = lambda s: F.floor(s["n"] / 10).cast("long")
    zero = F.lit(0).cast("long")
    every = while_loop({"n": n, "sum": zero}, lambda s: s["n"] > 0, lambda s: {"n": less(s), "sum": s["sum"] + digit(s)}, F.lit(20))
    odd = while_loop({"n": n, "sum": zero}, lambda s: s["n"] > 0, lambda s: {"n": less(s), "sum": F.when(digit(s) % 2 == 0, s["sum"]).otherwise(s["sum"] + digit(s))}, F.lit(20))
    left = while_loop({"n": n}, lambda s: (s["n"] > 0) & (s["n"] % 10 != 7), lambda s: {"n": less(s)}, F.lit(20))
    side = option("high", None, ("high", "low"))
    return bars.select("symbol", F.unix_millis("time").alias("time_ms"), every["sum"].alias("digits"), odd["sum"].alias("odd_digits"), left["n"].alias("from_seven"), F.lit(side).alias("side"), arrayfn.joined(F.array(every["sum"], odd["sum"]), "-").alias("both"))


_W = "PARTITION BY symbol ORDER BY time"
QUERIES: dict[str, Callable] = {f.__name__: f for f in (script_loops, script_branches, script_variables, script_while)}
ORACLE_SQL: dict[str, str] = {
    "script_loops": f"""WITH {BARS}, l AS (SELECT *, CAST(volume AS INTEGER) AS n, list(close) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r FROM b), m AS (SELECT *, list_reverse(r) AS q FROM l)
      SELECT symbol, epoch_ms(time) AS time_ms, CAST(n * (n + 1) * (2 * n + 1) / 6 AS INTEGER) AS squares, CAST(list_sum(range(n, -1, -2)) AS INTEGER) AS downwards, round(round(list_sum(list_transform(r, lambda x, i: x * i)), 9), 6) + 0.0 AS weighted,
      round(round(coalesce(list_sum(q[1:coalesce(list_position(list_transform(q, lambda x: x > 80), true), len(q) + 1) - 1]), 0), 9), 6) + 0.0 AS until_high, round(round(list_avg(r), 9), 6) + 0.0 AS own_mean FROM m""",
    "script_branches": f"""WITH {BARS}, d AS (SELECT *, hlc3 AS mid, lag(hlc3, 2) OVER ({_W}) AS before, avg(hlc3) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS mean FROM b)
      SELECT symbol, epoch_ms(time) AS time_ms, round(round(before, 9), 6) + 0.0 AS before, CASE WHEN close > open THEN 'up' ELSE 'down' END AS way, CASE WHEN mid - before > 10 THEN 2 WHEN mid - before > 0 THEN 1 WHEN mid - before < -10 THEN -2 WHEN mid - before < 0 THEN -1 ELSE 0 END AS strength,
      round(round(coalesce(before, 0), 9), 6) + 0.0 AS before_or_0, round(round((open + high + low + close) / 4 - (high + low) / 2, 9), 6) + 0.0 AS lean, round(round(mid - mean, 9), 6) + 0.0 AS off_mean FROM d""",
    "script_while": f"""WITH {BARS}, d AS (SELECT *, CAST(CAST(floor(high * 1000) AS BIGINT) AS VARCHAR) AS t FROM b), e AS (SELECT *, list_transform(string_split(t, ''), lambda x: CAST(x AS BIGINT)) AS l FROM d),
      f AS (SELECT *, CAST(list_sum(l) AS BIGINT) AS digits, CAST(coalesce(list_sum(list_filter(l, lambda x: x % 2 = 1)), 0) AS BIGINT) AS odd_digits FROM e)
      SELECT symbol, epoch_ms(time) AS time_ms, digits, odd_digits, CASE WHEN contains(t, '7') THEN CAST(regexp_extract(t, '^.*7') AS BIGINT) ELSE 0 END AS from_seven, 'high' AS side, digits || '-' || odd_digits AS both FROM f""",
    "script_variables": f"""WITH RECURSIVE {BARS}, s AS (
        SELECT symbol, time, k, CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS streak, CASE WHEN low >= 0 THEN greatest(0.0::DOUBLE, low - 5) ELSE low - 5 END AS stop, greatest(0.0::DOUBLE, close - open) AS floored FROM b WHERE k = 1
        UNION ALL SELECT b.symbol, b.time, b.k, CASE WHEN b.close > b.open THEN s.streak + 1 ELSE 0 END, CASE WHEN b.low >= s.stop THEN greatest(s.stop, b.low - 5) ELSE b.low - 5 END, greatest(0.0::DOUBLE, s.floored + b.close - b.open) FROM s JOIN b ON b.symbol = s.symbol AND b.k = s.k + 1)
      SELECT symbol, epoch_ms(time) AS time_ms, streak, round(round(stop, 9), 6) + 0.0 AS stop, round(round(floored, 9), 6) + 0.0 AS floored FROM s""",
}
